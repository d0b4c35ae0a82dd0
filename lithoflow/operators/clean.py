"""Preparation of observations: depth of investigation, time, repeats, wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lithoflow.functions.missing import least_prop


def resolve_doi(
    points: DataFrame,
    *,
    doi: str = "doi",
    horizon_top: str | None = None,
    horizon_thickness: str | None = None,
    min_horizon_thickness: float = 10.0,
    fallback_doi: float | None = None,
    fallback_when_empty: float = 150.0,
) -> DataFrame:
    """``points`` with missing depths of investigation filled.

    Without a horizon, or where it is thin or of unknown thickness, the fallback
    stands in; elsewhere the smaller of fallback and top of the horizon (missing if
    the top is). The fallback is the mean of what is reported, or a set value if
    nothing is.
    """
    if (horizon_top is None) != (horizon_thickness is None):
        raise ValueError("a horizon needs both its top and its thickness")
    c = F.col(doi)
    if fallback_doi is None:
        mean = points.agg(F.coalesce(F.avg(doi), F.lit(float(fallback_when_empty))).alias("_fallback"))
        rows = points.crossJoin(F.broadcast(mean))  # one row
    else:
        rows = points.withColumn("_fallback", F.lit(float(fallback_doi)))
    fill = F.col("_fallback")
    if horizon_top is not None:
        thick = F.col(horizon_thickness)
        fill = F.when(thick >= min_horizon_thickness, least_prop(F.col("_fallback"), F.col(horizon_top))).otherwise(fill)
    return rows.withColumn(doi, F.when(c.isNotNull(), c).otherwise(fill)).drop("_fallback")


def temporal_filter(points: DataFrame, model_year: int, year: str = "survey_year") -> DataFrame:
    return points.where(F.col(year) <= model_year)


def dedup_keep_last(points: DataFrame, by: Sequence[str] = ("x", "y"), order: str = "pid") -> DataFrame:
    """Of points with equal coordinates the last stays."""
    w = W.partitionBy(*by).orderBy(F.col(order).desc())
    return points.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def check_label_width(columns: Sequence[str], prefix: str, attribute: str) -> None:
    by: dict[int, str] = {}
    for c in columns:
        by.setdefault(len(c) - len(prefix), c)
    if len(by) > 1:
        a, b = by[min(by)], by[max(by)]
        raise ValueError(f"layer labels of {attribute!r} differ in width ({a!r}, {b!r}); pad them so that text order is layer order")


def wide_to_layers(df: DataFrame, attributes: dict[str, dict], n_layers: int, key: str = "pid") -> DataFrame:
    """``pid, layer`` and one column per attribute from blocks of layer columns and single columns.

    An attribute is ``{"per_layer": True, "prefix": ...}`` or ``{"column": ...}``. The
    columns of a block go to the layers in text order; a single column holds for all.
    """
    names = df.columns
    parts: dict[str, list[str]] = {}
    for a, spec in attributes.items():
        if not isinstance(spec, dict):
            raise ValueError(f"attribute {a!r} must be a mapping with per_layer and prefix, or column")
        if spec.get("per_layer"):
            prefix = spec.get("prefix")
            if not prefix:
                raise ValueError(f"attribute {a!r} needs a prefix")
            cols = sorted(c for c in names if c.startswith(prefix))
            if not cols:
                raise ValueError(f"attribute {a!r}: no column begins with {prefix!r}")
            if len(cols) != n_layers:
                raise ValueError(f"attribute {a!r}: {len(cols)} columns begin with {prefix!r}, n_layers is {n_layers}")
            check_label_width(cols, prefix, a)
            parts[a] = cols
        else:
            col = spec.get("column")
            if not col:
                raise ValueError(f"attribute {a!r} needs a column, or per_layer with a prefix")
            if col not in names:
                raise ValueError(f"attribute {a!r}: there is no column {col!r}")
            parts[a] = [col] * n_layers
    rows = F.array(*(F.struct(F.lit(k).alias("layer"), *(F.col(f"`{cols[k]}`").cast("double").alias(a) for a, cols in parts.items())) for k in range(n_layers)))
    return df.select(key, F.explode(rows).alias("_r")).select(key, "_r.*")
