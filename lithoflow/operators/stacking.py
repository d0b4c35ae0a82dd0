"""Boundaries on top of each other: clamping, ensembles, perturbation, ties and background."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lithoflow.functions.missing import all_present


def clamp_to_upper(lower: Column, upper: Column) -> Column:
    """A boundary may not rise above the one over it; where it is missing it follows that one."""
    return F.when((lower > upper) | lower.isNull(), upper).otherwise(lower)


def stack_realizations(surfaces: DataFrame, terrain: DataFrame | None = None, preq: DataFrame | None = None, preq_layers: tuple[int, int] | None = None) -> DataFrame:
    """``iy, ix, real, boundary, elevation, moved`` of boundaries stacked from the top.

    ``surfaces`` has ``iy, ix, layer, real, elevation``; with ``terrain`` (``iy, ix,
    value``) this is boundary 0 of every realization and layers follow from 1.
    Clamping from the top is a running minimum, as a missing boundary inherits.
    ``preq`` (``iy, ix, value``) lifts boundaries ``first <= boundary < last`` of
    ``preq_layers`` to that surface before clamping.
    """
    s = surfaces.select("iy", "ix", F.col("real").cast("int").alias("real"), F.col("layer").cast("int").alias("boundary"), "elevation")
    if terrain is not None:
        reals = s.select("real").distinct()
        top = terrain.select("iy", "ix", F.lit(0).alias("boundary"), F.col("value").alias("elevation")).crossJoin(F.broadcast(reals))
        s = s.withColumn("boundary", F.col("boundary") + 1).unionByName(top.select(*s.columns))
    if preq is not None:
        lo, hi = preq_layers
        p = preq.select("iy", "ix", F.col("value").alias("_p"))
        up = F.when(F.col("boundary").between(lo, hi - 1) & (F.col("elevation") < F.col("_p")), F.col("_p")).otherwise(F.col("elevation"))
        s = s.join(p, ["iy", "ix"], "left").withColumn("elevation", up).drop("_p")
    w = W.partitionBy("iy", "ix", "real").orderBy("boundary").rowsBetween(W.unboundedPreceding, 0)
    out = s.withColumn("_e", F.min("elevation").over(w))
    moved = ~F.col("_e").eqNullSafe(F.col("elevation"))
    return out.select("iy", "ix", "real", "boundary", F.col("_e").alias("elevation"), moved.alias("moved"))


def ensemble_mean(model: DataFrame) -> DataFrame:
    """``iy, ix, boundary, mean`` over realizations, missing where one is."""
    e = F.col("elevation")
    return model.groupBy("iy", "ix", "boundary").agg(all_present(F.avg(e), e).alias("mean"))


def clamp_counts(model: DataFrame) -> DataFrame:
    """``boundary, n_clamped``: cells and realizations that clamping moved."""
    return model.groupBy("boundary").agg(F.count_if("moved").alias("n_clamped"))


def perturb_shift(surfaces: DataFrame, k: float = 1.0, fixed: Sequence[str] = ("top_surface",), nodata: float | None = None) -> DataFrame:
    """``name, iy, ix, value`` lowered by ``k``, except fixed surfaces and cells without data."""
    v = F.col("value")
    keep = F.col("name").isin(list(fixed)) | v.isNull()
    if nodata is not None:
        keep = keep | (v == float(nodata))
    return surfaces.withColumn("value", F.when(keep, v).otherwise(v - F.lit(float(k))))


def perturb_realization(realizations: DataFrame, k: int, layers: Sequence[str] | None = None) -> DataFrame:
    """Surfaces of realization ``k`` (``real, name, iy, ix, value``), of the given names; an error if there are none."""
    out = realizations.where(F.col("real") == int(k))
    if layers is not None:
        out = out.where(F.col("name").isin(list(layers)))
    if out.isEmpty():
        raise ValueError(f"realization {k} has no such layers")
    return out.drop("real")


def to_absolute(layer: DataFrame, lf_mean: DataFrame) -> DataFrame:
    """Residual ``mean`` and ``reals`` (array) plus the smooth surface ``lf_mean``."""
    out = layer.join(lf_mean.select("iy", "ix", "lf_mean"), ["iy", "ix"], "left")
    base = F.col("lf_mean") + F.col("mean")
    return out.withColumn("reals", F.transform("reals", lambda r: base + r)).withColumn("mean", base).drop("lf_mean")


def tie_realizations(upper: DataFrame, lower: DataFrame, ties: DataFrame, radius: int = 4) -> DataFrame:
    """``iy, ix, real, elevation`` of ``lower`` drawn to ``upper`` around cells of absent layer (``iy, ix``).

    The weight of the upper surface is ``exp(-d^2 / 3)`` of the nearest tie within
    ``radius`` cells.
    """
    step = F.sequence(F.lit(-radius), F.lit(radius))
    near = ties.select("iy", "ix").withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step))
    d2 = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")
    near = near.select((F.col("iy") + F.col("_dy")).alias("iy"), (F.col("ix") + F.col("_dx")).alias("ix"), d2.alias("_d2")).where(F.col("_d2") <= radius * radius)
    w = near.groupBy("iy", "ix").agg(F.exp(-F.min("_d2") / F.lit(3.0)).alias("_w"))
    u = upper.select("iy", "ix", "real", F.col("elevation").alias("_u"))
    rows = lower.join(u, ["iy", "ix", "real"]).join(w, ["iy", "ix"], "left")
    e = F.when(F.col("_w").isNull(), F.col("elevation")).otherwise(F.col("_w") * F.col("_u") + (F.lit(1.0) - F.col("_w")) * F.col("elevation"))
    return rows.select("iy", "ix", "real", e.alias("elevation"))


def merge_layers(model: DataFrame, background: DataFrame, weights: DataFrame) -> DataFrame:
    """``weight * model + (1 - weight) * background``; a missing model value counts as 0 (``iy, ix, value``)."""
    m = model.select("iy", "ix", F.coalesce("value", F.lit(0.0)).alias("_m"))
    rows = background.join(m, ["iy", "ix"], "left").join(weights.select("iy", "ix", "weight"), ["iy", "ix"], "left")
    w = F.coalesce("weight", F.lit(0.0))
    return rows.select("iy", "ix", (w * F.coalesce("_m", F.lit(0.0)) + (F.lit(1.0) - w) * F.coalesce("value", F.lit(0.0))).alias("value"))


def add_bottom(model: DataFrame, below: float = 50.0) -> DataFrame:
    """One more boundary ``below`` the last (``iy, ix, real, boundary, elevation``)."""
    last = model.agg(F.max("boundary").alias("_last"))
    low = model.join(F.broadcast(last), F.col("boundary") == F.col("_last")).drop("_last")
    low = low.withColumn("boundary", F.col("boundary") + 1).withColumn("elevation", F.col("elevation") - F.lit(float(below)))
    return model.unionByName(low)


def elevation_order(surfaces: DataFrame) -> DataFrame:
    """``name, mean`` of surfaces from the highest down."""
    return surfaces.groupBy("name").agg(F.avg("value").alias("mean")).orderBy(F.col("mean").desc(), "name")
