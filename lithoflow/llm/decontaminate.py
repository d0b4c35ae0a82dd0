"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared runs of five words (seeds). Where the
seeds of an item could cover enough of it, running Karp-Rabin tiles the pair: the
longest common run that touches no marked word is marked, again and again, down to
the shortest length. The share of the item under tiles decides, in whatever order
its parts stand in the document.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.bytesets import ALNUM, chunks, grams, prefix, spans, table, words

MIN_WORDS = 5
COVERAGE = 0.75
#: Benchmark text that is held at once; a larger benchmark is taken in blocks of about this size.
BLOCK_BYTES = 16 << 20
_TABLE = table(3, fold_case=True)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (runs of ASCII letters and digits or longer characters, A-Z as a-z) and each text's range."""
    lo, hi, at = words(data, off, ALNUM)
    return spans(prefix(data, _TABLE), lo, hi), at


def tile(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: ``(pattern start, text start, length)`` of the tiles."""
    free_p, free_t = [True] * len(pattern), [True] * len(text)
    tiles: list[tuple[int, int, int]] = []
    base, mod = 1_000_003, (1 << 61) - 1

    def windows(seq: list[int], free: list[bool], s: int):
        """Rolling hashes of the windows of ``s`` unmarked words."""
        top = pow(base, s - 1, mod)
        h, run = 0, 0
        for k, x in enumerate(seq):
            if not free[k]:
                h, run = 0, 0
                continue
            if run == s:
                h = (h - seq[k - s] * top) % mod
                run -= 1
            h = (h * base + x) % mod
            run += 1
            if run == s:
                yield k - s + 1, h

    s = max(least, min(len(pattern), len(text), 20))
    while True:
        at = defaultdict(list)
        for i, h in windows(pattern, free_p, s):
            at[h].append(i)
        found: list[tuple[int, int, int]] = []
        longest = 0
        for j, h in windows(text, free_t, s) if at else ():
            for i in at.get(h, ()):
                if i and j and free_p[i - 1] and free_t[j - 1] and pattern[i - 1] == text[j - 1]:
                    continue  # inside a match that began further left
                n = 0
                while i + n < len(pattern) and j + n < len(text) and free_p[i + n] and free_t[j + n] and pattern[i + n] == text[j + n]:
                    n += 1
                if n >= s:
                    found.append((n, i, j))
                    longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_p[i : i + n]) and all(free_t[j : j + n]):
                tiles.append((i, j, n))
                free_p[i : i + n] = [False] * n
                free_t[j : j + n] = [False] * n
            else:
                again = True
        if again:
            continue  # what is left of overlapped matches may still hold runs of this length
        if s == least:
            return tiles
        s = max(least, s // 2 if s > 2 * least else s - 1)


class Items:
    """Benchmark items with their seeds, ready to meet texts."""

    def __init__(self, ids: list, texts: list[str], least: int):
        self.ids, self.least = ids, least
        col = pa.array(texts, pa.large_string())
        self.words: list[np.ndarray] = []
        for _, _, data, off in chunks(col):
            w, at = word_hashes(data, off)
            self.words += [w[at[k] : at[k + 1]] for k in range(len(off) - 1)]
        seeds = defaultdict(lambda: ([], [], []))
        for k, w in enumerate(self.words):
            if len(w):
                n = min(least, len(w))
                g = grams(w, n)
                seeds[n][0].append(g), seeds[n][1].append(np.full(len(g), k)), seeds[n][2].append(np.arange(len(g)))
        self.seeds = {}
        for n, parts in seeds.items():
            g, k, i = map(np.concatenate, parts)
            order = np.argsort(g, kind="stable")
            g = g[order]
            bits = np.zeros(1 << 20, bool)
            bits[(g >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[n] = (g, k[order], i[order], bits)

    def matches(self, w: np.ndarray, at: np.ndarray, coverage: float):
        """``text, item, covered words, tiles`` of the pairs that reach ``coverage``."""
        for n, (g, owner, place, bits) in self.seeds.items():
            s = grams(w, n)
            pos = np.flatnonzero(bits[(s >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(g, s[pos], "left"), np.searchsorted(g, s[pos], "right")
            hit = hi > lo
            pos, lo, hi = pos[hit], lo[hit], hi[hit]
            doc = np.searchsorted(at, pos, "right") - 1
            inside = pos + n <= at[doc + 1]
            pos, lo, hi, doc = pos[inside], lo[inside], hi[inside], doc[inside]
            for d in np.unique(doc):
                a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
                rows = np.unique(np.concatenate([np.arange(x, y) for x, y in zip(lo[a:b], hi[a:b])]))
                for k in np.unique(owner[rows]):
                    p = self.words[k]
                    could = np.zeros(len(p) + n, np.int64)
                    starts = place[rows[owner[rows] == k]]
                    np.add.at(could, starts, 1), np.add.at(could, starts + n, -1)
                    if (np.cumsum(could) > 0).sum() < coverage * len(p) - 1e-9:
                        continue
                    text = self.near(w[at[d] : at[d + 1]], pos[a:b] - at[d], n)
                    tiles = tile(p.tolist(), text, n)
                    covered = sum(t[2] for t in tiles)
                    if covered >= coverage * len(p) - 1e-9:
                        yield int(d), int(k), covered, len(tiles)

    @staticmethod
    def near(w: np.ndarray, starts: np.ndarray, n: int) -> list[int]:
        """The words under seeds, other stretches as one word that equals nothing: no tile can lie there."""
        on = np.zeros(len(w) + 1, np.int64)
        np.add.at(on, starts, 1), np.add.at(on, starts + n, -1)
        under = np.cumsum(on)[: len(w)] > 0
        out = np.where(under, w, np.uint64(0)).astype(object)
        keep = under | np.concatenate([[True], under[:-1]])
        return [int(x) if x else -1 for x in out[keep]]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, coverage, covered_words, item_words, n_tiles`` of the pairs with enough coverage.

    Tiles have ``least`` words or more; an item of fewer words must occur as a whole.
    Items without words (null, empty, signs only) match nothing, nor do such texts.
    Repeated rows and items match each for itself; null ids pass through; other
    columns are ignored; an empty table on either side gives an empty result. The
    benchmark travels to the executors if it has at most ``block_bytes``; a larger
    one is met in hashed blocks of about that size, each against all documents.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("_k", T.LongType()), T.StructField("covered_words", T.LongType()), T.StructField("n_tiles", T.LongType())])
    sc = docs.sparkSession.sparkContext
    out = None
    for b in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(n_blocks)) == b)
        rows = block.collect()
        shared = sc.broadcast(Items([r["item_id"] for r in rows], [r["t"] for r in rows], least))

        def run(batches, shared=shared):
            met = shared.value
            for batch in batches:
                for i, _, data, off in chunks(batch.column(1)):
                    w, at = word_hashes(data, off)
                    got = list(met.matches(w, at, coverage))
                    if got:
                        d, k, c, n = zip(*got)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d) if not i else pa.array([i + x for x in d])), pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=schema.names)

        names = [(k, r["item_id"], len(w)) for k, (r, w) in enumerate(zip(rows, shared.value.words))]
        fields = T.StructType([T.StructField("_k", T.LongType()), items.schema["item_id"], T.StructField("item_words", T.LongType())])
        named = F.broadcast(docs.sparkSession.createDataFrame(names, fields))
        part = src.mapInArrow(run, schema).join(named, "_k")
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "item_id", (F.col("covered_words") / F.col("item_words")).alias("coverage"), "covered_words", "item_words", "n_tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a benchmark item; rows with a null id stay."""
    found = contaminated(docs, benchmark, coverage, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(found, docs[id_col] == found["_bad"], "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op3_decontaminate": op3_decontaminate}
