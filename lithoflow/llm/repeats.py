"""Suffix dedup: removal of passages that occur earlier, by longest-previous-factor arrays.

A byte goes if a ``MATCH``-byte string over it also starts earlier (smaller id, or
same document and smaller start). A string goes with its anchor, the smallest of its
32-byte grams by hash: equal strings have equal anchors at equal offsets, so only
suffixes around equal anchors must be sorted together. In four steps:

1. anchors that occur once in the corpus are set aside;
2. consecutive strings with one anchor form a context; of equal contexts the first
   keeps its strings, all others lose them (hashes of 128 bits over the whole context);
3. anchors with several different contexts: the suffixes of these contexts are sorted,
   the previous and next one of smaller position found for each, and the longer of the
   two common lengths, the longest previous factor, decides whether a string stays. An
   anchor with very many contexts (a phrase of the whole corpus) takes its strings one by
   one to the tasks of their own hash, where the first is found by an aggregate;
4. the bytes under the strings that go are cut out of each text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.bytesets import chunks, mix, prefix, spans, table
from lithoflow.plans.tables import materialize, sorted_names

MATCH, GRAM = 100, 32
#: Contexts of one anchor that are sorted in one task; beyond it strings are dealt one by one.
HEAVY = 2000
#: Context bytes in one suffix array, give or take the contexts of one anchor.
BLOCK = 1 << 18
#: Bytes of text that are hashed at once; positions in a piece fit ``POSITION_BITS``.
PIECE, POSITION_BITS = 1 << 18, 20
_T1, _T2 = table(21), table(22)


def anchors(data: np.ndarray, off: np.ndarray, match: int = MATCH, gram: int = GRAM):
    """``text, start, strings, gram position, gram hash, context hash`` of each run of strings with one anchor."""
    n, w = len(data), match - gram + 1
    if n < match:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    p1, p2 = prefix(data, _T1), prefix(data, _T2)
    pos = np.arange(n - gram + 1)
    h = spans(p1, pos, pos + gram)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    # smallest gram of each window, the leftmost on ties; the low bits hold positions, as many bits for all
    bits = np.uint64(POSITION_BITS)
    key = (h >> bits << bits) | pos.astype(np.uint64)
    pad = -len(key) % w
    rows = np.concatenate([key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - match + 1
    best = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:m]
    ok = np.arange(m) + match <= off[text + 1]
    new = np.ones(m, bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
    lo = np.flatnonzero(ok & new)
    last = np.ones(m, bool)
    last[:-1] = new[1:] | ~ok[1:]
    hi = np.flatnonzero(ok & last)
    at = best[lo]
    c = spans(p2, lo, hi + match)
    c = mix(c + mix(((hi - lo).astype(np.uint64) << np.uint64(32)) + (at - lo).astype(np.uint64)))
    return text[lo], lo - off[text[lo]], hi - lo + 1, at - off[text[lo]], h[at], c


def _pieces(column: pa.Array):
    """``first text, first byte, bytes, offsets`` of runs of whole texts, or of parts of a long one.

    Each string lies in one part: a part goes on over the strings that start in it. A run of strings
    with one anchor may be cut in two there; the factors treat these like any two contexts.
    """
    for i, _, data, off in chunks(column, PIECE):
        if len(data) <= PIECE:
            yield i, 0, data, off
            continue
        for a in range(0, max(1, len(data) - MATCH + 1), PIECE):
            part = data[a : a + PIECE + MATCH - 1]
            yield i, a, part, np.array([0, len(part)])


def _grams(batches):
    """Anchors of each batch with how often they occur in it, once or more."""
    for b in batches:
        for _, _, data, off in _pieces(b.column(1)):
            g, n = np.unique(anchors(data, off)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["h", "n"])


#: ``key`` is the anchor's hash, or an arbitrary one for what is gone.
_CONTEXT = "key long, c long, doc long, start int, len int, gone boolean"


def _contexts(batches):
    """Contexts of each batch; of equal ones all but the first are gone already and need not meet others."""
    for b in batches:
        ids = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64)
        for i, first, data, off in _pieces(b.column(1)):
            text, start, count, _, h, c = anchors(data, off)
            doc, start = ids[i + text], start + first
            order = np.lexsort((start, doc, c, h))
            start, count, h, c, doc = (x[order] for x in (start, count, h, c, doc))
            gone = np.zeros(len(h), bool)
            gone[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            key = np.where(gone, mix(doc.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64)), h)
            i32 = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), i32(start), i32(count), pa.array(gone)], names=[x.split()[0] for x in _CONTEXT.split(", ")])


def _ranks(data: np.ndarray, match: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The eight bytes from each position, and by prefix doubling the rank of each suffix to depths up to ``match``."""
    n = len(data)
    pad = np.concatenate([data, np.zeros(match + 16, np.uint8)])
    key = np.zeros(n + match, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | pad[k : k + n + match]
    depth, ranks = min(8, match), {}
    rank = np.unique(key >> np.uint64(64 - 8 * depth), return_inverse=True)[1].astype(np.uint64)
    ranks[depth] = rank.astype(np.uint32)
    while depth < match:
        step = min(depth, match - depth)
        nxt = np.concatenate([rank[step:], np.zeros(step, np.uint64)])
        rank = np.unique((rank << np.uint64(32)) | nxt, return_inverse=True)[1].astype(np.uint64)
        depth += step
        ranks[depth] = rank.astype(np.uint32)
    return key, ranks


def _smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix in order, what it shares with the nearest one before it that has a smaller position.

    ``common`` holds what each suffix shares with the one before it. Pointers jump along
    those found so far, and the smallest common length on the way goes with them.
    """
    at, share = np.arange(len(place)) - 1, common.copy()
    live = np.arange(1, len(place))
    while len(live):
        live = live[place[at[live]] > place[live]]
        to = at[live]
        share[live] = np.minimum(share[live], share[to])
        at[live] = at[to]
        live = live[at[live] >= 0]
    share[at < 0] = 0
    return share


def longest_previous(data: np.ndarray, starts: np.ndarray, place: np.ndarray, match: int = MATCH) -> np.ndarray:
    """The longest previous factor, counted up to ``match``, of each suffix in ``starts``; ``place`` orders them by position.

    In suffix order the earlier suffixes that share most with one are the previous and
    the next one of smaller position; the longer of the two common lengths is the factor.
    """
    key, ranks = _ranks(data, match)
    order = np.lexsort((place, ranks[match][starts]))
    x, y = starts[order][:-1].copy(), starts[order][1:].copy()
    common = np.zeros(len(x), np.int64)
    for depth in sorted((d for d in ranks if d < match or d & (d - 1) == 0), reverse=True):
        step = np.where(ranks[depth][x] == ranks[depth][y], depth, 0)
        common += step
        x += step
        y += step
        over = np.minimum(match - common, 0)  # positions past the depth are not looked at
        x += over
        y += over
    differ = key[x] ^ key[y]
    for k in range(1, 8):
        common += (differ >> np.uint64(64 - 8 * k)) == 0
    common = np.minimum(common, match)
    before = _smaller(place[order], np.concatenate([[0], common]))
    after = _smaller(place[order][::-1], np.concatenate([[0], common[::-1]]))[::-1]
    out = np.empty(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _factor(batches):
    """Rows ``h, doc, start, ctx`` in order of ``h``: the strings of each context that occur earlier, as runs."""

    def solve(t: pa.Table):
        doc, start = t.column("doc").to_numpy(), t.column("start").to_numpy().astype(np.int64)
        ctx = t.column("ctx").to_pylist()
        size = np.fromiter(map(len, ctx), np.int64, len(ctx))
        base = np.concatenate([[0], np.cumsum(size)])
        n = size - MATCH + 1
        row = np.repeat(np.arange(len(ctx)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        rank = np.empty(len(ctx), np.int64)
        rank[np.lexsort((start, doc))] = np.arange(len(ctx))
        # strings of one document may lie in two contexts only if these are of different anchors, so rows order positions
        gone = longest_previous(np.frombuffer(b"".join(ctx), np.uint8), base[row] + inner, rank[row] * 1_000_000 + inner) >= MATCH
        edge = np.ones(len(row), bool)
        edge[1:] = (row[1:] != row[:-1]) | ~gone[:-1]
        lo = np.flatnonzero(gone & edge)
        stop = np.ones(len(row), bool)
        stop[:-1] = (row[1:] != row[:-1]) | ~gone[1:]
        hi = np.flatnonzero(gone & stop)
        return pa.RecordBatch.from_arrays([pa.array(doc[row[lo]]), pa.array((start[row[lo]] + inner[lo]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32))], names=["doc", "start", "len"])

    held = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        held = rows if held is None else pa.concat_tables([held, rows])
        h = held.column("h").to_numpy()
        first = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1]) if len(h) else np.zeros(1, np.int64)
        # whole anchors, about BLOCK bytes of them at a time; the last one may go on in the next batch
        size = np.cumsum(pc.binary_length(held.column("ctx")).to_numpy()) if len(h) else np.zeros(1, np.int64)
        block = size[first] // BLOCK
        cuts = first[np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))].tolist()
        cuts = [k for k in cuts if k < first[-1]] + [int(first[-1])]
        for lo, hi in zip(cuts, cuts[1:]):
            yield solve(held.slice(lo, hi - lo))
        held = held.slice(cuts[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield solve(held)


def _windows(batches):
    """Every string of each context under a 128-bit hash of its own."""
    for b in batches:
        doc, start = b.column("doc").to_numpy(), b.column("start").to_numpy()
        for i, j, data, off in chunks(b.column("ctx").cast(pa.large_binary()).view(pa.large_string()) if b.num_rows else pa.array([], pa.large_string()), PIECE):
            n = np.diff(off) - MATCH + 1
            row = np.repeat(np.arange(j - i), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            lo = off[row] + inner
            k1, k2 = (mix(spans(prefix(data, t), lo, lo + MATCH)).view(np.int64) for t in (_T1, _T2))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(doc[i + row]), pa.array((start[i + row] + inner).astype(np.int32))], names=["k1", "k2", "doc", "start"])


_CUT = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.BinaryType())])


def _cut(batches, keep_text: bool):
    for b in batches:
        out = []
        for doc, text, at, size in zip(*(b.column(k).to_pylist() for k in range(4))):
            data = text or b""
            runs, kept, k = 0, [], 0
            if at:
                lo = np.asarray(at, np.int64)
                hi = lo + np.asarray(size, np.int64) + MATCH - 1
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                head = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                ends = np.concatenate([hi[head[1:] - 1], hi[-1:]])
                for a, e in zip(lo[head].tolist(), ends.tolist()):
                    kept.append(data[k:a])
                    k = e
                runs = len(head)
            kept.append(data[k:])
            rest = b"".join(kept)
            out.append((doc, len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=_CUT.names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep_text``, ``kept_text`` (bytes) per row.

    Texts are their UTF-8 bytes, null counts as empty; matches never cross texts.
    Documents are ordered by id, null ids last, and by a hash of the text among
    equal ids; rows repeated with one id and text are one document and get equal
    rows. Ids of another type than whole numbers raise an error. Texts under 100 bytes
    lose nothing; very long texts are read whole. Other columns
    are ignored; an empty table gives an empty result.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, ids = src.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    plain = n == ids and src.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if plain:
        keyed = src.select(F.col("doc_id").alias("doc"), "text")
    else:
        th = F.xxhash64(F.coalesce("text", F.lit("")))
        names = src.select(F.col("doc_id").isNull().alias("last"), "doc_id", th.alias("th")).distinct()
        names = sorted_names(names, ["last", "doc_id", "th"], "doc", "repeats-ids").select(F.col("doc_id").alias("_i"), F.col("th").alias("_th"), "doc")
        src = src.withColumn("_t", th)
        keyed = src.join(names, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_th"))).select("doc", "text").dropDuplicates(["doc"])
        keyed = materialize(keyed, "repeats-texts")
    again = keyed.mapInArrow(_grams, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("h").alias("key"), F.lit(True).alias("twice"))
    again = materialize(again, "repeats-anchors")
    rows = keyed.mapInArrow(_contexts, _CONTEXT).join(again, "key", "left").where("gone or twice").withColumnRenamed("key", "h").drop("twice")
    rows = materialize(rows, "repeats-contexts")
    live = rows.where("not gone")
    first = live.groupBy("h", "c").agg(F.min(F.struct("doc", "start", "len")).alias("f"))
    first = materialize(first.select("h", "c", "f.*"), "repeats-first")
    gone = rows.where("gone").select("doc", "start", "len")
    f = first.select("h", "c", F.col("doc").alias("_d"), F.col("start").alias("_s"))
    later = live.join(f, ["h", "c"]).where((F.col("doc") != F.col("_d")) | (F.col("start") != F.col("_s"))).select("doc", "start", "len")
    many = first.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mixed = first.join(many, "h").select("doc", F.struct("h", "start", "len", (F.col("n") > heavy).alias("heavy")).alias("r"))
    asked = mixed.groupBy("doc").agg(F.collect_list("r").alias("rs"))  # a text's own contexts
    ctx = keyed.select("doc", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b")).join(asked, "doc").select("doc", "b", F.explode("rs").alias("r"))
    ctx = ctx.select("r.h", "doc", "r.start", "r.heavy", F.substring("b", F.col("r.start") + 1, F.col("r.len") + MATCH - 1).alias("ctx"))
    ctx = materialize(ctx, "repeats-mixed")
    light = ctx.where("not heavy").drop("heavy").repartition("h").sortWithinPartitions("h")
    by_order = light.mapInArrow(_factor, "doc long, start int, len int")
    strings = ctx.where("heavy").select("doc", "start", "ctx").mapInArrow(_windows, "k1 long, k2 long, doc long, start int")
    lead = strings.groupBy("k1", "k2").agg(F.min(F.struct("doc", "start")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    one = strings.join(lead, ["k1", "k2"]).where(F.struct("doc", "start") != F.col("f")).select("doc", "start", F.lit(1).alias("len"))
    out = gone.unionByName(later).unionByName(by_order).unionByName(one)
    per = out.groupBy("doc").agg(F.collect_list("start").alias("at"), F.collect_list("len").alias("size"))
    per = materialize(per, "repeats-cuts")
    done = keyed.select("doc", F.encode("text", "UTF-8").alias("b")).join(per, "doc", "left").mapInArrow(lambda it: _cut(it, keep_text), _CUT)
    if plain:
        done = done.withColumnRenamed("doc", "doc_id")
    else:
        done = src.select("doc_id", "_t").join(names, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_th"))).select("doc_id", "doc").join(done, "doc").drop("doc")
    return done if keep_text else done.drop("kept_text")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)


SQL: dict[str, str] = {}
QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
