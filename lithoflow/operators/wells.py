"""Boreholes: summed precision of the nearest wells, preparation and tie maps."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lithoflow.functions.kernels import well_kernel
from lithoflow.functions.missing import SENTINEL, safe_recip
from lithoflow.operators.grid import require_ascending
from lithoflow.operators.nearest import nearest_n

#: Range by complexity class at the well; class 0 is used here.
COMP2RANGE = (100, 500, 400, 250, 100)


def check_quality(wells: DataFrame, tables: DataFrame) -> None:
    """Every quality must be a whole number with a row in ``tables`` of its source; an error names up to ten that are not."""
    q = F.col("quality").cast("double")
    known = tables.select("source", F.col("quality").cast("double").alias("_q")).distinct()
    bad = wells.withColumn("_v", q).join(F.broadcast(known), (wells["source"] == known["source"]) & q.eqNullSafe(known["_q"]) & q.isNotNull() & (q == F.floor(q)), "left_anti")
    rows = bad.select("layer", wells["source"], "quality").limit(10).collect()
    if rows:
        raise ValueError("well quality must be a whole number of the table: " + "; ".join(f"layer {r[0]}, {r[1]}: {r[2]}" for r in rows))


def warn_if_tables_decrease(tables: DataFrame) -> list[str]:
    """Warn once per source whose figures fall with worse quality; returns the sources."""
    w = W.partitionBy("source").orderBy("quality")
    falls = tables.withColumn("_f", (F.col("k") < F.lag("k").over(w)) | (F.col("gradient") < F.lag("gradient").over(w)))
    bad = sorted(r[0] for r in falls.where("_f").select("source").distinct().collect())
    for s in bad:
        warnings.warn(f"uncertainty of {s} wells falls with worse quality; is the table in the order of quality 1, 2, ...?", stacklevel=2)
    return bad


def build_well_theme(
    wells: DataFrame,
    tables: DataFrame,
    gx: Sequence[float],
    gy: Sequence[float],
    n_layers: int,
    cells: DataFrame,
    search_radius: int = 6,
    comp2range: Sequence[float] = COMP2RANGE,
    n_nearest: int = 3,
) -> DataFrame:
    """``iy, ix, layer, variance`` from wells ``layer, source, wid, x, y, depth, quality, cls``.

    ``tables`` gives ``source, quality, k, gradient``. In each cell the ``n_nearest``
    wells of each source (ties by ``wid``) add their precisions; a cell without any
    has the sentinel. A missing class at a well counts as class 0.
    """
    check_quality(wells, tables)
    warn_if_tables_decrease(tables)
    ranges = wells.sparkSession.createDataFrame([(k, float(r)) for k, r in enumerate(comp2range)], "_c int, range_ double")
    t = tables.select("source", F.col("quality").cast("long").alias("_q"), "k", "gradient")
    w = wells.withColumn("_q", F.col("quality").cast("long")).join(F.broadcast(t), ["source", "_q"])
    w = w.withColumn("_c", F.coalesce(F.col("cls").cast("int"), F.lit(0))).join(F.broadcast(ranges), "_c")
    var0 = F.col("k") * F.col("k") + F.pow(F.col("gradient") * F.col("depth"), 2)
    w = w.select("layer", "source", "wid", "x", "y", safe_recip(var0).alias("sill"), "range_")
    near = nearest_n(w, gx, gy, search_radius, n_nearest, by=["layer", "source"], order="wid")
    prec = near.groupBy("iy", "ix", "layer").agg(F.sum(well_kernel(F.col("d"), F.col("range_"), F.col("sill"))).alias("p"))
    full = cells.select("iy", "ix").withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(n_layers - 1))))
    v = F.when(F.col("p") > 0, F.lit(1.0) / F.when(F.col("p") > 0, F.col("p"))).otherwise(F.lit(SENTINEL))
    return full.join(prec, ["iy", "ix", "layer"], "left").select("iy", "ix", "layer", v.alias("variance"))


def tie_map(wells: DataFrame, gx: Sequence[float], gy: Sequence[float], dx: float | None = None, dy: float | None = None, fix_quality_pairing: bool = False) -> DataFrame:
    """``iy, ix, quality`` of cells with a well (``wid, x, y, quality, zero_thickness``) where the layer is absent.

    As in the established maps the quality of the k-th flagged well is that of the
    k-th well of all; ``fix_quality_pairing`` takes its own. The last well of a cell wins.
    """
    gx, gy = require_ascending("grid_x", gx), require_ascending("grid_y", gy)
    dx, dy = dx or gx[1] - gx[0], dy or gy[1] - gy[0]
    flag = F.coalesce(F.col("zero_thickness").cast("boolean"), F.lit(False))
    from lithoflow.plans.tables import sorted_names

    cols = ["wid", "x", "y", "quality"]
    z = sorted_names(wells.where(flag).select(*cols), ["wid"], "k", "tie-flagged")
    if not fix_quality_pairing:
        every = sorted_names(wells.select("wid", F.col("quality").alias("_q")), ["wid"], "k", "tie-all").select("k", "_q")
        z = z.join(every, "k").withColumn("quality", F.col("_q"))
    at = z.withColumn("ix", (F.ceil((F.col("x") - gx[0]) / F.lit(float(dx))) - 1).cast("int")).withColumn("iy", (F.ceil((F.col("y") - gy[0]) / F.lit(float(dy))) - 1).cast("int"))
    at = at.where(F.col("ix").between(0, len(gx) - 1) & F.col("iy").between(0, len(gy) - 1))
    return at.groupBy("iy", "ix").agg(F.max_by("quality", "k").alias("quality"))


def date_filter(wells: DataFrame, model_year: int, year: str = "year") -> DataFrame:
    """Wells of years after 1000 up to the model's; the mistyped year 2107 is read as 2017."""
    y = F.when(F.col(year) == 2107, 2017).otherwise(F.col(year))
    return wells.where((y > 1000) & (y <= model_year)).withColumn(year, y)


def prepare_wells(snapped: DataFrame, database: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each list without repeated coordinates (the first ``wid`` stays); database wells at a snapped coordinate go."""
    def first(df: DataFrame) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(W.partitionBy("x", "y").orderBy("wid"))).where("_r = 1").drop("_r")

    s = first(snapped)
    return s, first(database).join(s.select("x", "y"), ["x", "y"], "left_anti")


def bbox(points: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    return points.where(F.col("x").between(float(xmin), float(xmax)) & F.col("y").between(float(ymin), float(ymax)))


def union_layer_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Point tables of consecutive layers (``X, Y, Z, PointType, SnapID``) as one with ``layer``."""
    out = None
    for k, t in enumerate(tables):
        t = t.select(F.lit(k).alias("layer"), *(F.col(c) for c in ("X", "Y", "Z", "PointType", "SnapID")))
        out = t if out is None else out.unionByName(t)
    if out is None:
        raise ValueError("no layer tables")
    return out
