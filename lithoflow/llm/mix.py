"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only).

Documents of a source form blocks in a hashed order. With weight ``w`` the block
``j`` (from 0) of a source has release ``floor(j / w)`` and deadline
``ceil((j + 1) / w)``; in each slot the released block with the earliest deadline
runs. Weights are exact fractions of one denominator, the frame, so the schedule
repeats after one frame and only that one is simulated, in a single row whose size
the frame bounds. After any number of slots a source has had less than one block more
or less than its weight asks for.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lithoflow.plans.tables import Scratch, materialize

#: Without given weights: slots in which the default weights are expressed, for each 50 sources.
FRAME = 1000
#: Slots of the longest frame that given weights may need.
MOST_SLOTS = 100_000
BLOCK_DOCS = 8
#: Without given weights a source weighs its number of documents to this power.
ALPHA = 0.5
SEED = "mix-1"
SCHEDULE = ["block", "place", "slot", "release", "deadline", "in_target"]


def exact_slots(weights: dict[str | None, float | int | str | Fraction]) -> dict[str | None, int]:
    """The given weights as whole slots of the shortest frame; a float counts as the decimal that it prints."""
    parts = {k: Fraction(str(v)) if isinstance(v, float) else Fraction(v) for k, v in weights.items()}
    if any(v <= 0 for v in parts.values()):
        raise ValueError("weights must be positive")
    whole = lcm(*(v.denominator for v in parts.values()))
    slots = {k: int(v * whole) for k, v in parts.items()}
    common = gcd(*slots.values())
    slots = {k: v // common for k, v in slots.items()}
    if sum(slots.values()) > MOST_SLOTS:
        raise ValueError(f"these weights need a frame of {sum(slots.values())} slots; {MOST_SLOTS} at most")
    return slots


def target_slots(counts: DataFrame, weights: dict | None, alpha: float) -> DataFrame:
    """``src, n, c``: slots of each source in a frame."""
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
        total = counts.agg(F.sum(raw).alias("total"), (F.lit(FRAME) * F.ceil(F.count(F.lit(1)) / 50)).alias("frame"))
        share = F.greatest(F.lit(1), F.round(raw / F.col("total") * F.col("frame"))).cast("int")
        return counts.join(F.broadcast(total)).select("src", "n", share.alias("c"))
    spark = counts.sparkSession
    given = [("n" if k is None else f"s{k}", v) for k, v in exact_slots(weights).items()]
    table = spark.createDataFrame(given, "src string, c int")
    missing = F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("source", F.lit("null")))).cast("int")
    return counts.join(table, "src", "left").select("src", "n", F.coalesce("c", missing).alias("c"))


#: One frame: of the sources whose next block is released, the earliest deadline, then the first source.
_EDF = """
aggregate(
  sequence(0, p - 1),
  named_struct('had', transform(c, x -> 0), 'picks', cast(array() as array<int>)),
  (s, t) -> transform(
    array(array_min(transform(c, (y, k) -> named_struct(
      'd', if(cast(s.had[k] as bigint) * p < cast(t + 1 as bigint) * y, (cast(s.had[k] + 1 as bigint) * p + y - 1) div y, 9223372036854775807),
      'k', k))).k),
    pick -> named_struct('had', transform(s.had, (x, i) -> if(i = pick, x + 1, x)), 'picks', array_append(s.picks, pick))
  )[0],
  s -> s.picks
)
"""


def frame_schedule(slots: DataFrame) -> DataFrame:
    """``src, within, at, c, p``: the slot in the frame of each source's blocks."""
    one = slots.agg(F.sort_array(F.collect_list(F.struct("src", "c"))).alias("a"), F.sum("c").cast("int").alias("p"))
    one = one.select("p", F.col("a.src").alias("srcs"), F.col("a.c").alias("c")).where("p is not null")
    picks = one.select("p", "srcs", F.col("c").alias("cs"), F.posexplode(F.expr(_EDF)).alias("at", "k"))
    picks = picks.select(F.get("srcs", F.col("k")).alias("src"), "at", F.get("cs", F.col("k")).alias("c"), "p")
    return picks.withColumn("within", F.row_number().over(W.partitionBy("src").orderBy("at")) - 1)


def mix(
    docs: DataFrame,
    weights: dict | None = None,
    block_docs: int = BLOCK_DOCS,
    alpha: float = ALPHA,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Every row of ``docs``, all columns, with ``block, place, slot, release, deadline, in_target``.

    Reading by ``(slot, place)`` gives the mixed order. No row is dropped: when a
    source has no blocks left its slots stay empty, and ``in_target`` is false from
    the first empty slot on, where the target can no longer be met. ``weights`` are
    taken exactly; without them the target of a source is the root of its documents
    (``alpha``) in whole slots of a frame of 1000 for each 50 sources, one at least.
    A null source is a source of its own; null ids are ordinary rows; repeated rows
    are placed each for itself, in an order that does not matter as they are equal;
    the last block of a source may be short; texts are carried whole, null, empty or
    long. A column of ``docs`` named as one of the six is returned as ``input_`` and
    its name. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    names, taken = {}, {*docs.columns, *SCHEDULE}
    for c in docs.columns:
        new = c
        while new in SCHEDULE or new != c and new in taken:
            new = f"input_{new}"
        names[c] = new
        taken.add(new)
    row = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    src = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + seed)))
    rows = docs.select(src.alias("src"), key.alias("_k"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), row.alias("_row"))
    order = ["src", "_k", "_id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = materialize(placed.select("src", "source", "_m", "_row"), "mix-order").withColumn("_p", F.shiftright("_m", 33))
    # one row per partition and source in it: at most partitions + sources
    runs = placed.groupBy("_p", "src").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"), F.first("source").alias("source"))
    runs = scratch.write(runs, "mix-runs")
    counts = runs.groupBy("src").agg(F.max("source").alias("source"), F.sum("_n").alias("n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("src").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = target_slots(counts, weights, alpha)
    sched = materialize(frame_schedule(slots), "mix-frame")
    runs = runs.select("_p", "src", "_first", before.alias("_before")).join(slots.select("src", F.col("c").alias("_c")), "src")
    runs = materialize(runs, "mix-starts")

    def slot_of(j, c, p, at):
        return (F.floor(j / c) * p + at).cast("long")

    ends = slots.select("src", F.ceil(F.col("n") / block_docs).cast("long").alias("j"), F.col("c").alias("_c"))
    ends = ends.join(sched, (sched["src"] == ends["src"]) & (F.pmod(F.col("j"), F.col("_c")) == sched["within"]))
    end = ends.agg(F.min(slot_of(F.col("j"), F.col("c"), F.col("p"), F.col("at"))).alias("_end"))
    last = end.first()["_end"]
    scratch.clear()
    # starts: a row per partition and source, broadcast only where Spark finds it small; the frame is bounded
    ranked = placed.join(runs, ["_p", "src"]).withColumn("_r", F.col("_m") - F.col("_first") + F.col("_before"))
    ranked = ranked.withColumn("block", F.floor(F.col("_r") / block_docs).cast("long")).withColumn("place", F.pmod(F.col("_r"), F.lit(block_docs)).cast("int"))
    ranked = ranked.withColumn("within", F.pmod(F.col("block"), F.col("_c")).cast("int"))
    out = ranked.join(F.broadcast(sched), ["src", "within"])
    slot = slot_of(F.col("block"), F.col("c"), F.col("p"), F.col("at"))
    return out.select(
        *(F.col("_row")[n].alias(n) for n in names.values()), "block", "place", slot.alias("slot"),
        F.expr("cast(cast(block as decimal(19,0)) * p div c as long)").alias("release"),
        F.expr("cast((cast(block + 1 as decimal(19,0)) * p + c - 1) div c as long)").alias("deadline"),
        (slot < F.lit(last)).alias("in_target"),
    )


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))


SQL = {
    "op4_mix_sources": f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, cast(greatest(1, round(pow(n::double, {ALPHA}) / sum(pow(n::double, {ALPHA})) OVER () * {FRAME})) AS bigint) AS c FROM n),
l AS (SELECT list(c ORDER BY source) AS c, list(source ORDER BY source) AS s, sum(c)::bigint AS p FROM w),
edf(t, had, k) AS (
  SELECT 0::bigint, list_transform(c, lambda x: 0::bigint), 0::bigint FROM l
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(c) + 1), lambda i: had[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (SELECT t, had, c, p, (list_min(list_transform(range(1, len(c) + 1),
      lambda i: CASE WHEN had[i] * p < (t + 1) * c[i] THEN (((had[i] + 1) * p + c[i] - 1) // c[i]) * 100000 + i ELSE 9000000000000000 END)) % 100000)::bigint AS pick
    FROM edf, l WHERE t < p)
),
f AS (SELECT l.s[k] AS source, t - 1 AS spot, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS within, p FROM edf, l WHERE t > 0),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::varchar || ':{SEED}'), doc_id) - 1 AS r FROM documents),
e AS (SELECT min((((n + {BLOCK_DOCS} - 1) // {BLOCK_DOCS}) // c) * p + spot) AS e FROM w JOIN f USING (source) WHERE within = ((n + {BLOCK_DOCS} - 1) // {BLOCK_DOCS}) % c),
o AS (SELECT doc_id, r.source, r // {BLOCK_DOCS} AS block, cast(r % {BLOCK_DOCS} AS int) AS place, c FROM r JOIN w ON r.source = w.source)
SELECT doc_id, o.source, block, place, (block // c) * p::bigint + spot AS slot,
  cast(block * p // c AS bigint) AS release, cast(((block + 1) * p + c - 1) // c AS bigint) AS deadline, (block // c) * p + spot < e.e AS in_target
FROM o JOIN f ON f.source = o.source AND f.within = block % c, e
"""
}
QUERIES = {"op4_mix_sources": op4_mix_sources}
