"""Neighbourhood operators on cell tables ``iy, ix, ...``: edges, rings, modes, windows, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _row():
    return W.partitionBy("iy").orderBy("ix")


def _column():
    return W.partitionBy("ix").orderBy("iy")


def _second(v: str, w, n: int) -> Column:
    """Second difference at unit spacing; at either end the neighbour's."""
    def at(k: int) -> Column:
        m, c, p = (F.lag(v, -(k + j)).over(w) if k + j else F.col(v) for j in (-1, 0, 1))
        return p - F.lit(2.0) * c + m

    i = F.row_number().over(w)
    return F.when(i == 1, at(1)).when(i == n, at(-1)).otherwise(at(0))


def laplacian(surface: DataFrame, nx: int, ny: int, dx: float = 1.0, dy: float = 1.0, value: str = "value") -> DataFrame:
    """``iy, ix, laplacian`` = (Uxx + Uyy) / 4 of a full grid."""
    if nx < 3 or ny < 3:
        raise ValueError("the Laplacian needs 3 cells or more on each axis")
    s = surface.select("iy", "ix", F.col(value).alias("_v"))
    s = s.withColumn("_x", _second("_v", _row(), nx) / F.lit(float(dx * dx))).withColumn("_y", _second("_v", _column(), ny) / F.lit(float(dy * dy)))
    return s.select("iy", "ix", ((F.col("_x") + F.col("_y")) / 4.0).alias("laplacian"))


def _gradient(v: str, w) -> Column:
    """Central difference, one-sided at the ends, 0 on an axis of one cell."""
    a, b, c = F.lag(v).over(w), F.lead(v).over(w), F.col(v)
    g = F.when(a.isNotNull() & b.isNotNull(), (b - a) / 2.0).when(b.isNotNull(), b - c).when(a.isNotNull(), c - a)
    return F.coalesce(g, F.lit(0.0))


def border_ring(mask: DataFrame, direction: str, value: str = "value") -> DataFrame:
    """``iy, ix, border``: cells of value 0 (``positive``) or 1 (``negative``) where the 0/1 grid has a gradient."""
    if direction not in ("positive", "negative"):
        raise ValueError(f"direction must be positive or negative, not {direction!r}")
    s = mask.select("iy", "ix", F.col(value).cast("double").alias("_v"))
    s = s.withColumn("_g", F.abs(_gradient("_v", _row())) + F.abs(_gradient("_v", _column())))
    return s.select("iy", "ix", ((F.col("_g") > 0) & (F.col("_v") == (0 if direction == "positive" else 1))).alias("border"))


def around(cells: DataFrame, radius: int, keep: list[str]) -> DataFrame:
    """Each cell at all targets within ``radius`` on both axes: ``ty, tx`` and ``keep``."""
    step = F.sequence(F.lit(-radius), F.lit(radius))
    e = cells.withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step))
    return e.select((F.col("iy") + F.col("_dy")).alias("ty"), (F.col("ix") + F.col("_dx")).alias("tx"), *keep)


def mode_of(counts: DataFrame, by: list[str], value: str = "cls", n: str = "n") -> DataFrame:
    """Most frequent value, the smallest on ties, as ``mode`` with ``mode_n`` and the total ``total``."""
    best = F.min_by(value, F.struct(-F.col(n), F.col(value)))
    return counts.groupBy(*by).agg(best.alias("mode"), F.max(n).alias("mode_n"), F.sum(n).alias("total"))


def mode_cleanup(classes: DataFrame, radius: int = 4, least: int = 10, share: float = 0.2) -> DataFrame:
    """``iy, ix, cls`` with each labelled cell set to the mode around it.

    A cell changes where more than ``least`` labelled cells lie around it and the
    mode has over ``share`` of them. All counts are of the input.
    """
    on = classes.where("cls is not null")
    near = around(on, radius, ["cls"]).groupBy("ty", "tx", "cls").agg(F.count(F.lit(1)).alias("n"))
    m = mode_of(near, ["ty", "tx"]).select(F.col("ty").alias("iy"), F.col("tx").alias("ix"), "mode", "mode_n", "total")
    ok = F.col("cls").isNotNull() & (F.col("total") > least) & (F.col("mode_n") > F.lit(share) * F.col("total"))
    return classes.join(m, ["iy", "ix"], "left").select("iy", "ix", F.when(ok, F.col("mode")).otherwise(F.col("cls")).alias("cls"))


def nearest_label(labels: DataFrame, missing: DataFrame) -> DataFrame:
    """``iy, ix, label`` for the cells of ``missing`` from the nearest of ``labels`` (``iy, ix, label``).

    Nearest by squared distance, then row, then column. Rings of doubling radius
    settle most cells close by; each round joins only what is still open.
    """
    span = labels.agg(F.max("iy") - F.min("iy"), F.max("ix") - F.min("ix")).first()
    if span[0] is None:
        raise ValueError("there is no label to fill from")
    far = missing.agg(F.max("iy") - F.min("iy"), F.max("ix") - F.min("ix"), F.min("iy"), F.max("iy"), F.min("ix"), F.max("ix")).first()
    if far[0] is None:
        return missing.select("iy", "ix", F.lit(None).cast(labels.schema["label"].dataType).alias("label"))
    lab = labels.agg(F.min("iy"), F.max("iy"), F.min("ix"), F.max("ix")).first()
    most = max(abs(a - b) for a, b in ((far[2], lab[1]), (far[3], lab[0]), (far[4], lab[3]), (far[5], lab[2])))
    from lithoflow.plans.tables import materialize

    out, todo, r = None, missing.select("iy", "ix"), 2
    while True:
        near = around(labels.where("label is not null").select("iy", "ix", "label", F.col("iy").alias("_y"), F.col("ix").alias("_x")), r, ["label", "_y", "_x"])
        d2 = (F.col("ty") - F.col("_y")) * (F.col("ty") - F.col("_y")) + (F.col("tx") - F.col("_x")) * (F.col("tx") - F.col("_x"))
        near = near.withColumn("_d", d2).where(F.col("_d") <= r * r)
        hit = todo.join(near, (F.col("iy") == F.col("ty")) & (F.col("ix") == F.col("tx"))).groupBy("iy", "ix").agg(F.min_by("label", F.struct("_d", "_y", "_x")).alias("label"))
        hit = materialize(hit, "nearest-label")
        out = hit if out is None else out.unionByName(hit)
        todo = materialize(todo.join(hit, ["iy", "ix"], "left_anti"), "nearest-label-open")
        if r > most * 1.5 + 2 or todo.isEmpty():
            return out
        r *= 2


def window_mean_sill(surface: DataFrame, points: DataFrame, centres: DataFrame, margin: int) -> DataFrame:
    """``iy, ix, mean, sill, n`` per centre over the points within ``margin`` cells (closed square).

    A missing value at a point counts as the mean of the present values of the window.
    """
    vals = points.select("iy", "ix").join(surface.select("iy", "ix", "value"), ["iy", "ix"])
    near = around(vals, margin, ["value"])
    got = centres.select("iy", "ix").join(near, (F.col("iy") == F.col("ty")) & (F.col("ix") == F.col("tx")))
    # filling with the mean leaves the mean as it is and shrinks the variance by the share present
    return got.groupBy("iy", "ix").agg(F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value") / F.count(F.lit(1))).alias("sill"), F.count(F.lit(1)).alias("n"))


def reflect_pad(surface: DataFrame, nx: int, ny: int, pad: int) -> DataFrame:
    """The grid mirrored by ``pad`` cells on all sides without repeating the edge; indices run from ``-pad``."""
    if pad >= min(nx, ny):
        raise ValueError("the padding must be smaller than the grid")

    def mirrored(c: str, n: int) -> Column:
        i = F.col(c)
        return F.filter(F.array(i, -i, F.lit(2 * (n - 1)) - i), lambda k: (k >= -pad) & (k < n + pad))

    m = surface.select("iy", "ix", "value", F.array_distinct(mirrored("iy", ny)).alias("_ys"), F.array_distinct(mirrored("ix", nx)).alias("_xs"))
    m = m.select("value", F.explode("_ys").alias("iy"), "_xs")
    return m.select("iy", F.explode("_xs").alias("ix"), "value")


def patches(surface: DataFrame, centres: DataFrame, size: int = 33) -> DataFrame:
    """``iy, ix, patch``: the square of ``size`` cells around each centre, row by row, missing outside the grid."""
    if size < 1 or size % 2 == 0:
        raise ValueError("the patch size must be odd")
    h = size // 2
    near = around(surface.select("iy", "ix", "value", F.col("iy").alias("_y"), F.col("ix").alias("_x")), h, ["value", "_y", "_x"])
    got = centres.select("iy", "ix").join(near, (F.col("iy") == F.col("ty")) & (F.col("ix") == F.col("tx")), "left")
    pos = (F.col("_y") - F.col("iy") + h) * size + (F.col("_x") - F.col("ix") + h)
    m = got.groupBy("iy", "ix").agg(F.map_from_entries(F.collect_list(F.when(F.col("_y").isNotNull(), F.struct(pos.alias("k"), "value")))).alias("_m"))
    return m.select("iy", "ix", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.try_element_at("_m", k)).alias("patch"))


def smooth(surface: DataFrame, height: int, width: int) -> DataFrame:
    """``iy, ix, value``: mean of the present values in a ``height`` x ``width`` window, by sliding sums."""
    a, b = height // 2, width // 2
    rows = W.partitionBy("iy").orderBy("ix").rangeBetween(-b, b)
    cols = W.partitionBy("ix").orderBy("iy").rangeBetween(-a, a)
    s = surface.withColumn("_s", F.sum("value").over(rows)).withColumn("_n", F.count("value").over(rows))
    s = s.withColumn("_t", F.sum("_s").over(cols)).withColumn("_m", F.sum("_n").over(cols))
    return s.select("iy", "ix", F.when(F.col("_m") > 0, F.col("_t") / F.when(F.col("_m") > 0, F.col("_m"))).alias("value"))


def smooth_zero_sills(sills: DataFrame, radii: tuple[int, ...] = (4, 100)) -> DataFrame:
    """Zero sills (``iy, ix, value``) take the mean of the others around, first close by, then far."""
    out = sills
    for r in radii:
        mean = smooth(out.withColumn("value", F.when(F.col("value") != 0, F.col("value"))), 2 * r + 1, 2 * r + 1).withColumnRenamed("value", "_m")
        out = out.join(mean, ["iy", "ix"]).select("iy", "ix", F.when(F.col("value") == 0, F.coalesce("_m", F.lit(0.0))).otherwise(F.col("value")).alias("value"))
    return out


def percentile_summary(values: DataFrame, by: str = "label", value: str = "value") -> DataFrame:
    """``label, p00 .. p95``: percentiles in steps of five."""
    p = F.percentile(value, F.array(*(F.lit(k / 100) for k in range(0, 100, 5))))
    return values.groupBy(by).agg(p.alias("_p")).select(by, *(F.get("_p", F.lit(k)).alias(f"p{5 * k:02d}") for k in range(20)))
