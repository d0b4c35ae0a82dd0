"""Chat formatting: collapse of cumulative snapshots, then rendering (DataFrame operations only).

Logs often hold a conversation again at each of its turns. Every turn prefix gets a
rolling 128-bit hash; a conversation whose whole hash is a proper prefix of another
one is dropped by an anti-join, and the conversations that remain are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lithoflow.plans.tables import materialize

#: Turns that one window holds at most, by turn number; longer conversations are split.
SPAN = 512


def turn_prefixes(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """``conv_id, pos, role, text, h1, h2, n``: the rolling hash after each turn.

    A turn's hash covers its position, so the exclusive-or of the first ``pos``
    hashes identifies that sequence. Running values are kept inside spans of turn
    numbers and shifted by the spans before, so no window grows with a conversation.
    """
    t = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    t = materialize(t.withColumn("b", F.floor(F.col("turn") / span)), "chat-turns")
    spans = t.groupBy("conv_id", "b").agg(F.count(F.lit(1)).alias("c"))
    past = W.partitionBy("conv_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(F.col("conv_id").alias("_c"), F.col("b").alias("_b"), F.coalesce(F.sum("c").over(past), F.lit(0)).alias("_o"), F.sum("c").over(W.partitionBy("conv_id")).alias("n"))
    inner = W.partitionBy("conv_id", "b").orderBy("turn", "role", "text")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("b") == F.col("_b"))
    t = t.join(spans, same).drop("_c", "_b").withColumn("pos", F.row_number().over(inner) + F.col("_o"))
    said = [F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n")) for c in ("role", "text")]
    t = t.withColumn("x1", F.xxhash64(F.lit(1), "pos", *said)).withColumn("x2", F.xxhash64(F.lit(2), *said[::-1], "pos"))
    run = W.partitionBy("conv_id", "b").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("r1", F.bit_xor("x1").over(run)).withColumn("r2", F.bit_xor("x2").over(run))
    t = materialize(t, "chat-runs")
    whole = t.groupBy("conv_id", "b").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    shift = whole.select(F.col("conv_id").alias("_c"), F.col("b").alias("_b"), *(F.coalesce(F.bit_xor(f"x{k}").over(past), F.lit(0)).alias(f"s{k}") for k in (1, 2)))
    t = t.join(shift, same)
    return t.select("conv_id", "pos", "role", "text", F.col("r1").bitwiseXOR(F.col("s1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("s2")).alias("h2"), "n")


def chat_format(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """Maximal conversations, rendered: ``conv_id, n_turns, n_copies, rendered``.

    Turns are taken in the order of turn number, role, text; a row repeated with
    equal conversation, turn, role and text counts once; a null turn number comes
    first; null role or text differs from an empty one in comparing and renders as
    empty. Of equal conversations the smallest id stays, ``n_copies`` counts them. A
    conversation that is a proper prefix of another is dropped. Rows with a null
    conversation id form one conversation. Other columns are ignored; an empty table
    gives an empty result. A rendered conversation is one value, so its length is
    bounded by what a row can hold.
    """
    t = materialize(turn_prefixes(turns, span), "chat-prefixes")
    whole = t.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    begun = t.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    kept = whole.join(begun, ["n", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("_c"), "n_copies")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    told = t.select("conv_id", "pos", "n", line.alias("line")).join(kept, F.col("conv_id").eqNullSafe(F.col("_c")))
    out = told.groupBy("conv_id").agg(F.first("n").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    return out.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join("_l.line", "").alias("rendered"))


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = {
    "op8_chat_format": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list(coalesce('s' || role, 'n') || chr(1) || coalesce('s' || text, 'n') ORDER BY turn, role, text) AS turns,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM t GROUP BY conv_id),
g AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(rendered) AS rendered FROM c GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM g))
SELECT conv_id, len(turns)::bigint AS n_turns, n_copies, rendered FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = g.turns)
"""
}
QUERIES = {"op8_chat_format": op8_chat_format}
