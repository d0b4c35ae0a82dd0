"""Windowed nearest observations: an open 2-D range join with exact ties.

Cell ``i`` sees the points strictly between the axis coordinates ``i - R`` and
``i + R`` (clamped to the axis ends). The loop is turned around: each point finds the
run of cells that see it on either axis and scatters itself to them, so the join is
two small explodes and an aggregate by cell, never a product of cells and points.
Distances are computed once for all layers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lithoflow.functions.missing import REDUCERS
from lithoflow.operators.grid import require_ascending

#: Axis coordinates that may be written into the plan as an array literal.
AXIS_LITERAL = 20_000


def _span(coord: Column, axis: list[float], radius: int) -> Column:
    """First and last index of the cells whose open window holds ``coord``; missing if none does."""
    n = len(axis)
    arr = F.array(*(F.lit(v) for v in axis)) if n <= 200 else F.from_json(F.lit("[" + ",".join(map(repr, axis)) + "]"), "array<double>")
    # number of coordinates below, and at or below: by bisection over the array
    def bisect(strict: bool) -> Column:
        steps = n.bit_length()
        state = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")),
            lambda s, _: _step(s, arr, coord, strict),
        )
        return state["lo"]

    below, upto = bisect(True), bisect(False)
    a, b = below - 1, upto  # last index below, first index above
    ok = (coord > axis[0]) & (coord < axis[-1])
    return F.when(ok, F.struct(F.greatest(F.lit(0), b - radius).alias("lo"), F.least(F.lit(n - 1), a + radius).alias("hi")))


def _step(s: Column, arr: Column, coord: Column, strict: bool) -> Column:
    mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    v = F.get(arr, mid)
    right = (v < coord) if strict else (v <= coord)
    go = (s["lo"] < s["hi"]) & right
    stop = (s["lo"] < s["hi"]) & ~right
    return F.struct(F.when(go, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(stop, mid).otherwise(s["hi"]).alias("hi"))


def _uniform_span(coord: Column, axis: list[float], radius: int) -> Column | None:
    """The same for an evenly spaced axis, by arithmetic with an exact correction."""
    n = len(axis)
    if n < 2:
        return None
    x0, d = axis[0], axis[1] - axis[0]
    if any(v != x0 + k * d for k, v in enumerate(axis)):
        return None
    at = lambda k: F.lit(x0) + k.cast("double") * F.lit(d)
    g = F.floor((coord - F.lit(x0)) / F.lit(d)).cast("int")
    low = F.when(at(g) > coord, g - 1).when(at(g + 1) <= coord, g + 1).otherwise(g)  # last index at or below
    a = F.when(at(low) == coord, low - 1).otherwise(low)
    b = low + 1
    ok = (coord > axis[0]) & (coord < axis[-1])
    return F.when(ok, F.struct(F.greatest(F.lit(0), b - radius).alias("lo"), F.least(F.lit(n - 1), a + radius).alias("hi")))


def candidates(points: DataFrame, gx: Sequence[float], gy: Sequence[float], radius: int) -> DataFrame:
    """All columns of ``points`` (``x, y, ...``) with ``iy, ix, d`` for each cell whose window holds the point."""
    if int(radius) != radius or radius < 1:
        raise ValueError("the search radius must be a whole number of cells, 1 or more")
    gx, gy = require_ascending("grid_x", gx), require_ascending("grid_y", gy)
    px, py = F.col("x"), F.col("y")

    def span(coord, axis):
        return u if (u := _uniform_span(coord, axis, radius)) is not None else _span(coord, axis, radius)

    def coords(k: Column, axis: list[float]) -> Column:
        if all(v == axis[0] + i * (axis[1] - axis[0]) for i, v in enumerate(axis)) if len(axis) > 1 else False:
            return F.lit(axis[0]) + k.cast("double") * F.lit(axis[1] - axis[0])
        return F.get(F.from_json(F.lit("[" + ",".join(map(repr, axis)) + "]"), "array<double>"), k)

    on = points.withColumn("_sx", span(px, gx)).withColumn("_sy", span(py, gy)).where("_sx is not null and _sy is not null and _sx.lo <= _sx.hi and _sy.lo <= _sy.hi")
    on = on.withColumn("iy", F.explode(F.sequence("_sy.lo", "_sy.hi"))).withColumn("ix", F.explode(F.sequence("_sx.lo", "_sx.hi"))).drop("_sx", "_sy")
    dx, dy = px - coords(F.col("ix"), gx), py - coords(F.col("iy"), gy)
    return on.withColumn("d", F.sqrt(dx * dx + dy * dy))


def windowed_nearest(
    points: DataFrame,
    gx: Sequence[float],
    gy: Sequence[float],
    radius: int,
    reducers: Mapping[str, str],
    attributes: DataFrame | None = None,
) -> DataFrame:
    """Nearest observations per cell: ``iy, ix[, layer], d, n_ties`` and one reduced column for each attribute.

    ``points`` has ``pid, x, y`` and, unless ``attributes`` (``pid, layer, ...``)
    carries them by layer, the attributes. Reducers ``mean``, ``min`` and ``max``
    cover the points at exactly the smallest distance and are missing if one of
    these is; ``first`` is the value of the lowest ``pid`` in the whole window. Cells
    that no point informs have no row. Points with missing coordinates inform
    nothing.
    """
    bad = {r for r in reducers.values() if r not in REDUCERS and r != "first"}
    if bad:
        raise ValueError(f"unknown reducer(s) {sorted(bad)}; available: {sorted([*REDUCERS, 'first'])}")
    values = [c for c in reducers if attributes is None]
    cand = candidates(points.select("pid", "x", "y", *values), gx, gy, radius)
    cell = ["iy", "ix"]
    # rank <= 1 becomes a group limit before and after the shuffle by cell
    ties = cand.withColumn("_r", F.rank().over(W.partitionBy(*cell).orderBy("d"))).where("_r = 1").drop("_r")
    nearest = {k: r for k, r in reducers.items() if r != "first"}
    first = [k for k, r in reducers.items() if r == "first"]
    key = cell
    if attributes is not None:
        key = [*cell, "layer"]
        ties = ties.select("pid", *cell, "d").join(attributes, "pid")
    out = ties.groupBy(*key).agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("n_ties"), *(REDUCERS[r](F.col(k)).alias(k) for k, r in nearest.items()))
    if first:
        if attributes is None:
            low = cand.groupBy(*cell).agg(*(F.min_by(k, "pid").alias(k) for k in first))
        else:
            low = cand.groupBy(*cell).agg(F.min("pid").alias("pid")).join(attributes.select("pid", "layer", *first), "pid").drop("pid")
        out = out.join(low, key)
    return out.select(*key, "d", "n_ties", *reducers)


def nearest_n(points: DataFrame, gx: Sequence[float], gy: Sequence[float], radius: int, n: int, by: Sequence[str] = (), order: str = "pid") -> DataFrame:
    """The ``n`` nearest points of each cell (and group ``by``), ties in the order of ``order``; with ``rank``."""
    cand = candidates(points, gx, gy, radius)
    w = W.partitionBy(*by, "iy", "ix").orderBy("d", order)
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
