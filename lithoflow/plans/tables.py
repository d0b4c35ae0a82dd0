"""Written tables that cut lineage, in the folder that all executors share.

``spark.checkpoint.dir`` names the folder. Where it is unset a folder beside the
warehouse is used, in local mode only; a cluster must name one. A table is Parquet,
so a lost executor costs no recomputation of what was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def write_shared(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once and return it as read back, with its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lithoflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return write_shared(df, name)[0]


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`write_shared` made and nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sorted_names(distinct: DataFrame, keys: list[str], name_col: str, name: str) -> DataFrame:
    """Dense 1-based integer names of distinct key rows, in sort order, without a single-task sort.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    shifted by the rows of earlier partitions (one figure per partition reaches
    the driver). Written once, so the names stay the same for all readers.
    """
    spark = distinct.sparkSession
    cols = [F.col(k).asc_nulls_first() for k in keys]
    ranged = distinct.repartitionByRange(*cols).sortWithinPartitions(*cols)
    placed = materialize(ranged.withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    shift = spark.createDataFrame(offsets or [(0, 0)], "_p long, _o long")
    return (
        placed.withColumn("_p", part)
        .join(F.broadcast(shift), "_p")
        .withColumn(name_col, F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_o") + F.lit(1))
        .drop("_m", "_p", "_o")
    )


def null_safe(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


class Scratch:
    """Written tables of one operator call; :meth:`clear` deletes those that the result does not read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, path = write_shared(df, name)
        self.paths.append(path)
        return out

    def clear(self) -> None:
        for path in self.paths:
            remove_shared(self.spark, path)
        self.paths = []


#: A key with more than one row in this many is joined by broadcast; so that many keys at most are sent.
HOT_PART = 512


def join_skewed(rows: DataFrame, side: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` on ``key`` (unique in ``side``), however uneven the key is.

    ``count`` of ``side`` holds the number of rows with the key, of ``total`` in all.
    Keys with more than a 512th of the rows, fewer than 512 of them by definition,
    are sent to all tasks; their rows are dealt evenly and meet no partner in the
    shuffled join that serves the others. ``how`` is ``inner`` or ``left``.
    """
    other = [c for c in side.columns if c != key]
    value = F.struct(*other)
    is_hot = F.col(count) * F.lit(HOT_PART) > F.lit(total)
    hot = side.where(is_hot).select(F.col(key).alias("_hot_key"), value.alias("_hot"))
    cold = side.where(~is_hot).select(F.col(key).alias("_cold_key"), F.xxhash64(key).alias("_cold_deal"), value.alias("_cold"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    deal = F.when(F.col("_hot").isNotNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(key))
    joined = marked.withColumn("_deal", deal).join(cold, (F.col("_deal") == F.col("_cold_deal")) & (F.col(key) == F.col("_cold_key")), "left")
    found = F.coalesce("_hot", "_cold")
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(*rows.columns, *(found[c].alias(c) for c in other))
