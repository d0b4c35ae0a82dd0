"""Streaming update of a variance map: precisions add, so a stream of theme rows is a running sum by cell.

The reference workflow is batch only; this is an extra for feeds of new soundings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.functions.missing import safe_recip


def running_combination(rows: DataFrame) -> DataFrame:
    """``iy, ix, layer, variance, n`` over a stream of ``iy, ix, layer, variance``; use output mode ``update`` or ``complete``.

    Missing variances add nothing here, as a late theme may still deliver the cell.
    """
    v = F.col("variance")
    agg = rows.where(v.isNotNull()).groupBy("iy", "ix", "layer").agg(F.sum(safe_recip(v)).alias("_p"), F.count(F.lit(1)).alias("n"))
    return agg.select("iy", "ix", "layer", safe_recip(F.col("_p")).alias("variance"), "n")
