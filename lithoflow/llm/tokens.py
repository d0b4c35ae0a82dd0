"""Token counts with a public byte-level BPE, batch-encoded inside Arrow functions.

Texts are cut at safe boundaries, a space between two characters that are not
white space: the pre-tokenizer starts a new piece there whatever surrounds it, and
no special string holds a space, so the lengths of the parts add up to the length
of the whole. That bounds a single call by the longest stretch without such a boundary
(a text without any space is one call), and makes parts that recur (most words do)
encode once per worker. Only the lengths leave the worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes of text handled at once, and entries that a worker remembers.
BATCH_BYTES = 4 << 20
REMEMBERED = 400_000
#: Parts per call of the library.
PARTS = 4096

_SAFE = re.compile(r"(?<=\S) (?=\S)")


class Counter:
    """Lengths of whole texts as the library gives them, remembered by part."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.remembered = remembered
        self.inner: dict[str, int] = {}

    def encode(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for k in range(0, len(parts), PARTS):
            out += [len(e) for e in self.lib.encode_batch(parts[k : k + PARTS], add_special_tokens=False)]
        return out

    def batch(self, texts: list[str]) -> list[int]:
        split = [t.split(" ") for t in texts]
        if len(self.inner) > self.remembered:
            self.inner.clear()
        fresh: set[str] = set()
        known = self.inner.keys()
        for parts in split:
            fresh.update(parts)
        fresh -= known
        safe, out = [], []
        for p in fresh:
            if p and not p[0].isspace() and not p[-1].isspace():
                safe.append(p)
            else:
                self.inner[p] = -(1 << 60)  # not between two safe boundaries
        self.inner.update(zip(safe, self.encode([" " + p for p in safe])))
        heads = self.encode([parts[0] for parts in split])
        get = self.inner.__getitem__
        for text, parts, head in zip(texts, split, heads):
            n = head + sum(map(get, parts)) - get(parts[0]) if get(parts[0]) >= 0 else -1
            out.append(n if n >= 0 else self.exact(text))
        return out

    def exact(self, text: str) -> int:
        """A text with runs of white space: only truly safe boundaries are used."""
        if not text:
            return 0
        parts = _SAFE.split(text)
        return sum(self.encode([parts[0], *(" " + p for p in parts[1:])]))


_COUNTERS: dict[str, Counter] = {}


def counts_in(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
    for b in batches:
        ids, texts, sizes = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
        n_tokens: list[int] = []
        group: list[str] = []
        size = 0
        for t, n in zip(texts, sizes):
            group.append(t or "")
            size += n
            if size >= BATCH_BYTES:
                n_tokens += counter.batch(group)
                group, size = [], 0
        if group:
            n_tokens += counter.batch(group)
        yield pa.RecordBatch.from_arrays([ids, b.column(2), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Null text counts as empty (0 bytes, 0 tokens). Repeated rows are counted each
    for itself, null ids pass through, other columns are ignored, an empty table
    gives an empty result. No truncation, padding or added tokens; a special string
    inside a text is one token, as is the library's default.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    id_type = src.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = src.mapInArrow(lambda it: counts_in(tokenizer_path, it), schema)
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))


SQL: dict[str, str] = {}
QUERIES = {"op2_token_counts": op2_token_counts}
