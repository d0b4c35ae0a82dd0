"""Exact dedup by deterministic block naming (DataFrame operations only).

The normalised text is cut into fixed-size blocks. Distinct blocks are sorted and
their ranks become integer names; then neighbouring names are paired, the distinct
pairs sorted and named again, until one name is left. Two documents are equal if
and only if they end with the same name after the same number of rounds: a name
stands for one string, so there are no collisions.

Blocks are sorted by (64-bit hash, text). Where a hash occurs once in the corpus
the text is not needed to place the block, so only blocks whose hash occurs again
carry their text through the sort; equality is always decided on text.

Copies share block, pair and identity. Each join on one of these sends the names of
the few that a large part of the rows have to those rows, which stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.plans.tables import join_skewed, materialize, sorted_names

#: Runs of these bytes count as one space.
SPACES = r"[\x20\x09-\x0D]+"
BLOCK_CHARS = 8192


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_blocks``.

    Texts are equal when identical after white-space runs become one space; null
    text counts as empty, so nulls and empty texts form one group. ``keep_id`` is
    the smallest id of the group; ``kept`` marks rows that have it. Rows repeated
    with one id are all marked alike. A null id is never the smallest unless the
    whole group has none (then ``keep_id`` is null and the rows are kept). Other
    columns of ``docs`` are ignored, whatever their names. An empty table gives an
    empty result.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    src = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_t"))
    blocks = F.regexp_extract_all("_t", F.lit(rf"(?s).{{1,{block_chars}}}"), F.lit(0))
    blocks = F.when(F.length("_t") <= block_chars, F.array("_t")).otherwise(blocks)

    def cut(df: DataFrame) -> DataFrame:
        head = [c for c in df.columns if c != "_t"]
        n = F.size("_b").alias("n")
        return df.select(*head, blocks.alias("_b")).select(*head, n, F.posexplode("_b").alias("i", "block"))

    def numbered(table: DataFrame, parts: list[str], name: str) -> DataFrame:
        """Names of the distinct ``parts`` as ``key``, with the number of rows that have them."""
        counted = table.groupBy(*parts).agg(F.count(F.lit(1)).alias("_c"))
        return sorted_names(counted, parts, "name", name).select(F.struct(*parts).alias("key"), "_c", "name")

    again = cut(src).groupBy(F.xxhash64("block").alias("h")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    again = materialize(again.withColumn("_tie", F.lit(True)), "exact-again")
    tied = again.agg(F.sum("_c")).first()[0] or 0
    first = src.withColumn("uid", F.monotonically_increasing_id()).withColumn("_s", F.sha2(F.encode("_t", "UTF-8"), 256))
    rows = cut(first).withColumn("h", F.xxhash64("block"))
    rows = join_skewed(rows, again, "h", "_c", tied, "left").select(
        "uid", "doc_id", "n", "i", "h",
        F.when(F.col("i") == 0, F.col("_s")).alias("sha"),
        F.when(F.col("_tie"), F.col("block")).alias("tie"),
    )
    rows = materialize(rows, "exact-blocks")
    names = numbered(rows, ["h", "tie"], "exact-names-0")
    level = join_skewed(rows.select("uid", "n", "i", F.struct("h", "tie").alias("key")), names, "key", "_c", rows.count())
    level = materialize(level.select("uid", "n", "i", "name"), "exact-level-0")
    most = level.agg(F.max("n")).first()[0] or 1
    k = 0
    done = level.where("n = 1").select("uid", F.lit(0).alias("level"), "name")
    while most > 1:
        k += 1
        pairs = (
            level.where("n > 1")
            .groupBy("uid", "n", F.floor(F.col("i") / 2).cast("int").alias("j"))
            .agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"))
        )
        pairs = materialize(pairs, f"exact-pairs-{k}")
        named = numbered(pairs, ["a", "b"], f"exact-names-{k}")
        level = join_skewed(pairs.select("uid", "n", "j", F.struct("a", "b").alias("key")), named, "key", "_c", pairs.count())
        level = level.select("uid", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("j").alias("i"), "name")
        level = materialize(level, f"exact-level-{k}")
        done = done.unionByName(level.where("n = 1").select("uid", F.lit(k).alias("level"), "name"))
        most = (most + 1) // 2
    heads = rows.where("i = 0").select("uid", "doc_id", "sha", "n")
    ident = heads.join(done, "uid").select("doc_id", "sha", "n", F.struct("level", "name").alias("key"))
    ident = materialize(ident, "exact-identity")
    groups = ident.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "exact-groups")
    return join_skewed(ident, groups, "key", "group_size", ident.count()).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"), F.col("n").alias("n_blocks"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the smallest id. All columns are kept.

    Repeated rows with the kept id all stay; rows with a null id stay only in a
    group without any id.
    """
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_blocks")


SQL = {
    "op1_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
