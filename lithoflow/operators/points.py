"""Drawing informed points: more of them where a surface is rough."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow.operators.neighbourhood import laplacian

_PARAMETERS = ("P0", "L0", "A", "B", "C", "D", "E", "g")


def transfer(lap: Column, p: Mapping[str, float]) -> Column:
    """Probability from the absolute Laplacian: a rise by tanh, a resonance, and the base P0."""
    P0, L0, A, B, C, D, E, g = (float(p[k]) for k in _PARAMETERS)
    f1 = F.lit(C * P0 / 2) * (F.tanh((lap - F.lit(A * L0)) * F.lit(g)) + 1.0)
    f2 = F.lit((C + D) * P0) / ((lap - F.lit(B * L0)) * (lap - F.lit(B * L0)) / F.lit(E * L0) + 1.0) - F.lit(D * P0)
    return F.when(lap.isNotNull(), F.when(lap < B * L0, f1).otherwise(f2) + P0)


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key only, not on partitioning."""
    return F.pmod(F.xxhash64(F.lit(int(seed)), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def draw_probability(
    surface: DataFrame,
    nx: int,
    ny: int,
    parameters: Mapping[str, float],
    dx: float = 1.0,
    dy: float = 1.0,
    wells: DataFrame | None = None,
    normalize: bool = False,
    north_up: bool = True,
) -> DataFrame:
    """``iy, ix, laplacian, transfer, probability``.

    In order: transfer of the Laplacian at unit spacing, optional scaling to the mean
    P0, one expected point more in every tenth raster row and column, scaling down
    if the mean exceeds 1, one more for each well (``x, y``; ``x0`` and ``y0`` of the
    parameters are the lower left corner), and a cap at 1. ``north_up`` counts the
    tenth rows from the north, as raster rows do.
    """
    if missing := [k for k in _PARAMETERS if k not in parameters]:
        raise ValueError(f"parameters are missing {missing}")
    lap = laplacian(surface, nx, ny).withColumn("laplacian", F.abs("laplacian"))
    rows = lap.withColumn("transfer", transfer(F.col("laplacian"), parameters)).withColumn("_p", F.col("transfer"))
    # as in an array, one missing probability makes a mean missing, and nothing is scaled by that
    mean = lambda df: df.agg(F.when(F.count("_p") == F.count(F.lit(1)), F.avg("_p")).alias("_m"))
    if normalize:
        m = F.broadcast(mean(rows))
        rows = rows.crossJoin(m).withColumn("_p", F.when(F.col("_m") > 0, F.col("_p") * F.lit(float(parameters["P0"])) / F.when(F.col("_m") > 0, F.col("_m"))).otherwise(F.col("_p"))).drop("_m")
    row = F.lit(ny - 1) - F.col("iy") if north_up else F.col("iy")
    tenth = (F.pmod(row, F.lit(10)) == 0) & (F.pmod("ix", F.lit(10)) == 0)
    rows = rows.withColumn("_p", F.col("_p") + F.when(tenth, 1.0).otherwise(0.0))
    rows = rows.crossJoin(F.broadcast(mean(rows))).withColumn("_p", F.when(F.col("_m") > 1, F.col("_p") / F.when(F.col("_m") > 1, F.col("_m"))).otherwise(F.col("_p"))).drop("_m")
    if wells is not None:
        ix = F.floor((F.col("x") - F.lit(float(parameters["x0"]))) / F.lit(float(dx))).cast("int")
        iy = F.floor((F.col("y") - F.lit(float(parameters["y0"]))) / F.lit(float(dy))).cast("int")
        n = wells.select(iy.alias("iy"), ix.alias("ix")).groupBy("iy", "ix").agg(F.count(F.lit(1)).alias("_n"))
        rows = rows.join(n, ["iy", "ix"], "left").withColumn("_p", F.col("_p") + F.coalesce("_n", F.lit(0)))
    p = F.when(F.col("_p") > 1, F.lit(1.0)).otherwise(F.col("_p"))
    return rows.select("iy", "ix", "laplacian", "transfer", p.alias("probability"))


def draw_points(probability: DataFrame, seed: int) -> DataFrame:
    """``iy, ix, drawn``; a missing probability draws nothing."""
    u = uniform(seed, F.col("iy"), F.col("ix"))
    return probability.select("iy", "ix", F.coalesce(u < F.col("probability"), F.lit(False)).alias("drawn"))


def transfer_curve(spark, parameters: Mapping[str, float], lap_max: float = 10.0, n: int = 200) -> DataFrame:
    """``laplacian, probability`` at ``n`` even steps, for inspection of a parameter set."""
    x = F.col("id") * F.lit(lap_max / (n - 1))
    return spark.range(n).select(x.alias("laplacian")).withColumn("probability", transfer(F.col("laplacian"), parameters))


def sample_cells(field: DataFrame, n: int, seed: int, value: str = "value") -> DataFrame:
    """``n`` cells (all, if there are fewer) without replacement, the same for any partitioning."""
    return field.withColumn("_u", uniform(seed, F.col("iy"), F.col("ix"))).orderBy("_u", "iy", "ix").limit(n).drop("_u")
