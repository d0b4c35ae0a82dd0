"""Combination of themes, background, floor and informed mask."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow.functions.missing import SENTINEL, all_present, safe_recip

#: Fixed values of the Danish national model; never defaults.
DANISH_CLASS_FMIN = {0: 20.0, 1: 20.0, 2: 12.5, 3: 12.5, 4: 11.25, 5: 10.0}
DANISH_DEPTH_RAMP = {"break_depth": 50.0, "shallow_gradient": 0.3, "deep_gradient": 0.15}
_KEY = ["iy", "ix", "layer"]


def stack(themes: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(*_KEY, "variance") for t in themes])


def combine_variances(themes: Sequence[DataFrame], *, prior: DataFrame | None, warn: bool = True) -> DataFrame:
    """``1 / sum(1 / variance)`` over the themes and the prior, per cell and layer.

    A cell that is missing in one theme (a row with a missing variance) is missing.
    Infinite variances add nothing. Without a prior a warning counts the cells that
    no theme informs or whose combination reaches the sentinel; ``warn=False`` saves
    that extra pass.
    """
    if not themes:
        raise ValueError("no themes to combine")
    rows = stack([*themes, prior] if prior is not None else themes)
    v = F.col("variance")
    out = rows.groupBy(*_KEY).agg(all_present(safe_recip(F.sum(safe_recip(v))), v).alias("variance"))
    if prior is None and warn:
        n = suspect_count(themes).agg(F.sum("n_suspect")).first()[0]
        if n:
            warnings.warn(f"{n} cell(s) are informed by no theme or reach the sentinel, and there is no prior", stacklevel=2)
    return out


def suspect_count(themes: Sequence[DataFrame]) -> DataFrame:
    """``layer, n_suspect``: cells that no theme informs, or whose combination is missing or at least the sentinel."""
    v = F.col("variance")
    rows = stack(themes).groupBy(*_KEY).agg(all_present(safe_recip(F.sum(safe_recip(v))), v).alias("_c"), F.coalesce(F.bool_or(v < SENTINEL), F.lit(False)).alias("_i"))
    return rows.groupBy("layer").agg(F.count_if(~F.col("_i") | ~F.coalesce(F.col("_c") < SENTINEL, F.lit(False))).alias("n_suspect"))


def constant_prior(cells: DataFrame, variance_per_layer: Sequence[float]) -> DataFrame:
    vals = list(variance_per_layer) if isinstance(variance_per_layer, list | tuple) else [variance_per_layer]
    if not vals or any(isinstance(v, list | tuple) or not math.isfinite(float(v)) or float(v) <= 0 for v in vals):
        raise ValueError("the prior is one positive finite variance for each layer")
    rows = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(vals)], "layer int, variance double")
    return cells.select("iy", "ix").crossJoin(F.broadcast(rows))  # every cell has every layer


def model_theme(bottoms: DataFrame, cells: DataFrame, *, class_fmin: Mapping[int, float], depth_ramp: Mapping[str, float]) -> DataFrame:
    """Background from the model's own quality class and depth: ``(0.5 * ramp) ** 2``.

    ``cells`` has ``iy, ix, cls, terrain``, ``bottoms`` has ``iy, ix, layer, bottom``.
    A class without a value has variance 0.
    """
    if not class_fmin:
        raise ValueError("class_fmin must give a value for each class, for example DANISH_CLASS_FMIN")
    keys = ("break_depth", "shallow_gradient", "deep_gradient")
    if depth_ramp is None or set(depth_ramp) != set(keys):
        raise ValueError(f"depth_ramp must have exactly {keys}, for example DANISH_DEPTH_RAMP")
    b, gs, gd = (float(depth_ramp[k]) for k in keys)
    if not all(map(math.isfinite, (b, gs, gd))) or b < 0:
        raise ValueError("depth_ramp must be finite with a break depth of 0 or more")
    fmin = cells.sparkSession.createDataFrame([(int(k), float(v)) for k, v in class_fmin.items()], "cls int, f double")
    rows = bottoms.join(cells.select("iy", "ix", F.col("cls").cast("int").alias("cls"), "terrain"), ["iy", "ix"]).join(F.broadcast(fmin), "cls", "left")
    x, f = F.col("terrain") - F.col("bottom"), F.col("f")
    ramp = F.when(x < b, F.lit(gs) * x + f).otherwise(F.lit(gd) * x + F.lit((gs - gd) * b) + f)
    v = F.when(f.isNotNull(), F.pow(F.lit(0.5) * ramp, 2)).otherwise(F.lit(0.0))
    return rows.select(*_KEY, v.alias("variance"))


def minimum_map(bottoms: DataFrame, terrain: DataFrame) -> DataFrame:
    """``(0.01 * depth) ** 2`` as ``minimum``."""
    d = F.col("terrain") - F.col("bottom")
    return bottoms.join(terrain.select("iy", "ix", "terrain"), ["iy", "ix"]).select(*_KEY, F.pow(F.lit(0.01) * d, 2).alias("minimum"))


def floored(v: Column, m: Column) -> Column:
    """Raised where below; a missing variance stays missing, a missing minimum raises nothing."""
    return F.when(v < m, m).otherwise(v)


def apply_floor(variance: DataFrame, minimum: DataFrame) -> DataFrame:
    rows = variance.join(minimum, _KEY, "left")
    return rows.select(*_KEY, floored(F.col("variance"), F.col("minimum")).alias("variance"))


def informed_mask(themes: Sequence[DataFrame]) -> DataFrame:
    """``informed``: some theme has a finite variance below the sentinel."""
    if not themes:
        raise ValueError("no themes")
    return stack(themes).groupBy(*_KEY).agg(F.coalesce(F.bool_or(F.col("variance") < SENTINEL), F.lit(False)).alias("informed"))
