"""Near-duplicate groups: chosen-path set similarity join over word shingles.

A document is the set of its five-word shingles. Equal sets collapse to one class
first. Each class has a row of minwise tokens. In each of several independent trees a
node picks two positions of that row by its own name, and a class goes to one child
for each of them, named by the token it has there; the first two picks are made at
once, so a root's grandchildren are the first nodes that are looked at. A node whose
classes are all of one component ends.

A node of up to ``SCREEN`` classes is first cut into the groups that hold together by
pairs which may be links: of sizes that allow it and alike in ``ALIKE`` tokens or more,
compared by 8 bits each. So classes that merely share a passage go no further, and only
the others' texts are read. Groups of all nodes and trees that share classes make up a
cluster. A small cluster is compared exhaustively, once, so each of its sets travels once;
what follows is for the classes of larger clusters.

Small nodes are compared exhaustively on the full sets: shared shingles are counted
by a product of incidence matrices, so a node yields components and no pairs. Nodes of
the same classes, in one tree or several, are compared once. The
members of a large node are dealt into blocks that are compared in the same way, each
together with a few pivots of the node: this joins dense groups at once, which
branching alone would copy down every path. Jaccard distance is a metric, so the exact
similarities to the pivots rule out members that cannot be linked with anything outside
the node's largest component. What is left branches on, or, where only a bounded number
of members is outside that component, these meet all others in blocks and the node ends;
nodes that have the same largest component do so as one where that makes fewer rows.
The first tree runs alone, the others with its components known; where few members
are left, all trees go down at once, as rounds cost more than comparisons there.

A link at the threshold survives one tree with probability of about 0.9, so ``TREES``
of them miss it with less than 1 in 5000; links above it and groups of several links
are safer still. What is called a link is always confirmed on full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.bytesets import grams, mix, word_runs
from lithoflow.llm.graph import components
from lithoflow.plans.tables import Scratch, join_skewed, materialize

SHINGLE = 5
#: Similarity in per cent.
SIMILAR = 75
#: Minwise tokens of a class; trees.
TOKENS, TREES = 64, 4
#: Classes and shingles of a node that is compared exhaustively (two classes always are); pivots of a larger one.
LEAF, WEIGHT, PIVOTS = 256, 4 << 20, 4
#: A large node with no more members outside its largest component compares these with all others and ends.
ODD = 1024
#: Classes of a node that is cut by its members' tokens; tokens of ``TOKENS`` that a pair must share there.
#: A link at the threshold shares fewer with probability of under 1 in 10^7 (Chernoff: 1.0e-8).
SCREEN, ALIKE = 2048, 26
#: Levels below the first nodes; what is large and mixed even there is compared block by block.
LEVELS = 16
#: Members of large nodes up to which a figure of each node is sent to all tasks.
SENT = 1 << 18
#: Counted rows, without their sets, that are summed in one task, so that nothing is shuffled; rows of a comparison never are.
FEW = 1 << 16
#: Bits of the map of the documents whose texts are needed, as a power of two: 8 MB at most.
MAP_BITS = 26

_MUL = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, TOKENS + 1001, dtype=np.uint64))
_STEP = 1 << 16


def shingled(column: pa.Array, k: int = SHINGLE):
    """Runs of texts as ``shingle hashes, offsets``; a text of fewer than ``k`` words has one, without words none."""
    for w, at in word_runs(column, fold_case=True):
        n = np.diff(at)
        short = (n > 0) & (n < k)
        many = np.where(n >= k, n - k + 1, short)
        off = np.concatenate([[0], np.cumsum(many)])
        text = np.repeat(np.arange(len(n)), n)[: max(0, len(w) - k + 1)]
        whole = grams(w, k)[np.arange(len(text)) + k <= at[text + 1]]
        if short.any():
            out = np.empty(off[-1], np.uint64)
            lone = off[:-1][short]
            out[lone] = [grams(w[a:b], int(b - a))[0] for a, b in zip(at[:-1][short], at[1:][short])]
            rest = np.ones(len(out), bool)
            rest[lone] = False
            out[rest] = whole
            whole = out
        yield whole, off


def shingle_sets(column: pa.Array, k: int = SHINGLE):
    """The sorted distinct shingle hashes of each text."""
    for g, off in shingled(column, k):
        for a, b in zip(off[:-1], off[1:]):
            yield np.unique(g[a:b])


def minwise(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each run ``off[i]:off[i + 1]``, per position the smallest of one multiply-add hash, as 32 bits."""
    n = len(off) - 1
    out = np.full((TOKENS, n), np.uint64(2**64 - 1))
    for s in range(0, len(g), _STEP):
        e = min(len(g), s + _STEP)
        first, last = np.searchsorted(off, s, "right") - 1, np.searchsorted(off, e, "left")
        lo, hi = np.maximum(off[first:last], s), np.minimum(off[first + 1 : last + 1], e)
        full = hi > lo
        runs, starts = np.arange(first, last)[full], lo[full] - s
        part = g[s:e]
        for k in range(TOKENS):
            out[k, runs] = np.minimum(out[k, runs], np.minimum.reduceat(part * _MUL[k] + _ADD[k], starts))
    return (mix(out.T) >> np.uint64(32)).astype(np.uint32)


def _digest(s: np.ndarray) -> tuple[int, int, int]:
    if not len(s):
        return 0, 0, 0
    return len(s), int(np.add.reduce(mix(s ^ np.uint64(0xABCDEF))).view(np.int64)), int(np.bitwise_xor.reduce(s).view(np.int64))


_KEY = T.StructType([T.StructField(c, T.LongType(), False) for c in ("n", "k1", "k2")])


def _key_array(keys) -> pa.Array:
    cols = list(zip(*keys)) or [()] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=[pa.field(c, pa.int64(), False) for c in ("n", "k1", "k2")])


def _signatures(batches):
    for b in batches:
        k = 0
        for g, off in shingled(b.column(1)):
            sig = minwise(g, off)
            keys = [_digest(np.unique(g[x:y])) for x, y in zip(off[:-1], off[1:])]
            rows = [s.tobytes() if key[0] else b"" for s, key in zip(sig, keys)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(k, len(keys)), _key_array(keys), pa.array(rows, pa.binary())], names=["doc_id", "key", "sig"])
            k += len(keys)


def _sets(batches):
    """``cls, node, key, text`` to ``cls, node, set`` of the rows whose text has that key."""
    for b in batches:
        cls, node, want = (b.column(k).to_pylist() for k in range(3))
        k = 0
        for g, off in shingled(b.column(3)):
            out = []
            for x, y in zip(off[:-1], off[1:]):
                s = np.unique(g[x:y])
                if _digest(s) == tuple(want[k].values()):
                    out.append((cls[k], node[k], s.tobytes()))
                k += 1
            types = pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["cls", "node", "set"])


def _children(node: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
    """Names of the two children that each class goes to."""
    h = mix(node ^ np.uint64(0x5851F42D4C957F2D))
    first = (h >> np.uint64(20)) % np.uint64(TOKENS)
    second = (first + np.uint64(1) + (h >> np.uint64(40)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
    rows, out = np.arange(len(sig)), []
    for pick in (first, second):
        token = sig[rows, pick.astype(np.int64)].astype(np.uint64)
        out.append(mix(mix(node ^ ((pick + np.uint64(1)) << np.uint64(7))) + token))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _roots(batches):
    """``cls, n, sig`` to ``cls, n, tree, node``: two picks below the root of each tree."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = _matrix(b.column(2))
        for tree in range(TREES):
            root = mix(np.full(len(sig), tree + 1, np.uint64) * np.uint64(77))
            nodes = [y for x in _children(root, sig) for y in _children(x, sig)]
            k = len(nodes)
            own = [pa.concat_arrays([b.column(i)] * k) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(k * len(sig), tree, np.int32)), pa.array(np.concatenate(nodes).view(np.int64))], names=["cls", "n", "tree", "node"])


def _sketches(batches):
    """``cls, sig`` to ``cls, sketch``: 8 bits of each token."""
    for b in batches:
        low = np.ascontiguousarray(_matrix(b.column(1)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in low], pa.binary())], names=["cls", "sketch"])


def _may_link(sketch: np.ndarray, n: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether classes with these sketches and set sizes may be links of the others, along all but the sketches' last axis."""
    same = np.zeros(np.broadcast_shapes(n.shape, sizes.shape), np.uint8)
    for k in range(TOKENS):
        same += sketch[..., k] == others[..., k]
    return (same >= ALIKE) & (100 * n >= SIMILAR * sizes) & (100 * sizes >= SIMILAR * n)


def _screen(batches):
    """``cls, n, tree, node, sketch`` in order of node and class to ``cls, n, tree, node, low`` of the groups that may hold links; each becomes a node, ``low`` its smallest class."""

    def cut(cls, n, tree, node, sketch):
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        ends = np.append(first[1:], len(node))
        label = np.arange(len(node))
        two = first[ends - first == 2]
        two = two[_may_link(sketch[two], n[two], sketch[two + 1], n[two + 1])]
        label[two + 1] = two
        for a, b in zip(first, ends):
            if b - a > 2:
                label[a:b] = a + _merged(_may_link(sketch[a:b, None], n[a:b, None], sketch[None, a:b], n[None, a:b]))
        keep = np.bincount(label, minlength=len(label))[label] > 1
        name = mix(node.view(np.uint64) ^ mix(cls[label].view(np.uint64) + np.uint64(1)))
        cols = cls[keep], n[keep], tree[keep], name[keep].view(np.int64), cls[label][keep]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cls", "n", "tree", "node", "low"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [np.array(b.column(k).to_numpy(zero_copy_only=False)) for k in range(4)]
        rows.append(np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, TOKENS))
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        last = int(np.searchsorted(rows[3], rows[3][-1]))  # the last node may go on in the next batch
        if last:
            yield cut(*(x[:last] for x in rows))
        held = [x[last:] for x in rows]
    if held is not None:
        yield cut(*held)


def _branch(batches):
    """``cls, n, node, sig`` to ``cls, n, node`` of the children."""
    for b in batches:
        if b.num_rows:
            node = np.array(b.column(2).to_numpy(zero_copy_only=False)).view(np.uint64)
            kids = _children(node, _matrix(b.column(3)))
            own = [pa.concat_arrays([b.column(i)] * 2) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(kids).view(np.int64))], names=["cls", "n", "node"])


def shared_counts(sets: list[np.ndarray], most: int = 1 << 22) -> np.ndarray:
    """Sizes of all intersections of the sets, by products of incidence matrices."""
    m = len(sets)
    out = np.zeros((m, m), np.float64)
    value, row = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    col = np.cumsum(new) - 1
    often = np.bincount(col, minlength=1)[col] > 1 if len(col) else new
    row, col = row[often], col[often]
    col = np.unique(col, return_inverse=True)[1]
    step = max(64, most // (4 * m))
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        a, b = np.searchsorted(col, [c, c + step])
        block = np.zeros((m, step), np.float32)
        block[row[a:b], col[a:b] - c] = 1
        out += block @ block.T
    return out


def _merged(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row that it reaches."""
    m = len(link)
    label = np.arange(m, dtype=np.int32)
    link = link | np.eye(m, dtype=bool)
    while True:
        low = np.where(link, label[None, :], np.int32(m)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


_FOUND = "a long, b long, node long, cls long, n long, js array<double>"


def _compare(batches):
    """Rows ``node, block, cls, grp, pivot, set`` in order of node and block; ``pivot`` is -1 for a plain member of a
    large node, -2 in a small one.

    Gives ``a, b``, groups that links of full sets join, and for members of large nodes their set sizes and similarities to the pivots.
    """

    def solve(cls, grp, pivot, sets):
        at = {}
        for k, c in enumerate(cls):  # a class that is both member and pivot, or repeated
            at.setdefault(c, k)
        pick = np.fromiter(at.values(), np.int64, len(at))
        s = [np.frombuffer(sets[k], np.uint64) for k in pick]
        size = np.array([len(x) for x in s], np.float64)
        both = shared_counts(s)
        union = size[:, None] + size[None, :] - both
        g = np.array([grp[k] for k in pick])
        link = (both > 0) & (100 * both >= SIMILAR * union)
        root = g[_merged(link | (g[:, None] == g[None, :]))]
        joined = {(int(x), int(y)) for x, y in zip(g, root) if x != y}
        place = {c: k for k, c in enumerate(at)}
        heads = sorted((p, place[c]) for c, p in zip(cls, pivot) if p >= 0)
        rows = []
        if heads:
            near = both / union
            cols = [k for _, k in dict(heads).items()]
            rows = [(c, len(s[place[c]]), near[place[c], cols].tolist()) for c in dict.fromkeys(c for c, p in zip(cls, pivot) if p == -1)]
        return joined, rows

    held, last = [], None
    out = [[], [], [], [], [], []]

    def flush():
        nonlocal held
        if held:
            joined, rows = solve(*zip(*held))
            for a, b in joined:
                for col, v in zip(out, (a, b, None, None, None, None)):
                    col.append(v)
            for c, n, js in rows:
                for col, v in zip(out, (None, None, last[0], c, n, js)):
                    col.append(v)
        held = []

    def batch():
        types = (*[pa.int64()] * 5, pa.list_(pa.float64()))
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["a", "b", "node", "cls", "n", "js"])
        for c in out:
            c.clear()
        return done

    for b in batches:
        node, block = b.column(0).to_pylist(), b.column(1).to_pylist()
        cls, grp, pivot, sets = (b.column(k).to_pylist() for k in range(2, 6))
        for k, where in enumerate(zip(node, block)):
            if where != last:
                flush()
                last = where
            held.append((cls[k], grp[k], pivot[k], sets[k]))
        yield batch()
    flush()
    yield batch()


def _met(rows: DataFrame, sets: DataFrame | None, name: str, scratch: Scratch) -> DataFrame:
    """What :func:`_compare` finds among ``node, block, cls, grp, pivot``; without ``sets`` the rows have them."""
    full = (rows if sets is None else rows.join(sets, "cls")).select("node", "block", "cls", "grp", "pivot", "set")
    full = full.repartition("node", "block").sortWithinPartitions("node", "block")
    return scratch.write(full.mapInArrow(_compare, _FOUND), name)


def _beside(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """``rows``, ``total`` in all, joined with ``side``, one row for each ``key`` of them; ``size`` of ``side`` counts the rows."""
    return rows.join(F.broadcast(side), key) if total <= SENT else join_skewed(rows, side, key, "size", total)


def _few(df: DataFrame, total: int) -> DataFrame:
    """``df`` of ``total`` rows of written tables: in one task where they are few."""
    return df.coalesce(1) if total <= FEW else df


def _screened(rows: DataFrame, sketches: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``cls, n, tree, node, low`` of the nodes that may hold links, with their smallest class; a node of up to ``SCREEN`` classes is cut by their sketches."""
    shared = scratch.write(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("cls").alias("low")).where("size > 1"), f"{name}-shared")
    met = scratch.write(rows.join(shared, "node").select("cls", "n", "tree", "node", "low", "size"), f"{name}-meeting")
    some = met.where(F.col("size") <= SCREEN).join(sketches, "cls").select("cls", "n", "tree", "node", "sketch")
    some = some.repartition("node").sortWithinPartitions("node", "cls").mapInArrow(_screen, "cls long, n long, tree int, node long, low long")
    return scratch.write(some.unionByName(met.where(F.col("size") > SCREEN).drop("size")), f"{name}-starts")


def _likely(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``rows`` whose ``doc_id`` is among the ``n`` of ``ids``, and a few others; no row is shuffled.

    The ids are bits of a map, 16 bits an id or more until the map has its largest size; an exact join must follow.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << min(MAP_BITS, max(15, (16 * n).bit_length()))))
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    bits = ids.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    placed = rows.withColumn("_bucket", bucket).withColumn("_bit", bit).join(F.broadcast(bits), "_bucket")
    set_ = "shiftright(cast(conv(hex(substring(_bits, cast(shiftright(_bit, 3) as int) + 1, 1)), 16, 10) as int), cast(_bit & 7 as int)) & 1 = 1"
    return placed.where(set_).select(*rows.columns)


#: What tells the classes of a node: exact for two of them, with 128 bits of hash for more.
_MEMBERS = ["size", "weight", "low", "high", "hash1", "hash2"]


def _small() -> Column:
    """Whether a node is compared exhaustively."""
    return F.expr(f"size = 2 or size <= {LEAF} and weight <= {WEIGHT}")


class _Forest:
    """Components found so far, the small nodes compared so far and the walk down the trees."""

    def __init__(self, tokens: DataFrame, sketches: DataFrame, sets: DataFrame, scratch: Scratch):
        self.tokens, self.sketches, self.sets, self.scratch = tokens, sketches, sets, scratch
        self.groups: DataFrame | None = None
        self.seen: DataFrame | None = None

    def grouped(self, rows: DataFrame) -> DataFrame:
        if self.groups is None:
            return rows.withColumn("grp", F.col("cls"))
        return rows.join(self.groups, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))

    def learn(self, links: DataFrame, name: str) -> None:
        """Join groups along ``a, b``; classes that were never linked are not in the table."""
        if links.isEmpty():
            return
        new = components(links, self.scratch)
        if self.groups is not None:
            new = self.scratch.write(new, f"{name}-merged")
            old = self.groups.join(new, F.col("grp") == F.col("node"), "left").select("cls", F.coalesce("component", "grp").alias("grp"))
            fresh = new.join(self.groups, F.col("node") == F.col("cls"), "left_anti")
            new = old.unionByName(fresh.select(F.col("node").alias("cls"), F.col("component").alias("grp")))
        else:
            new = new.select(F.col("node").alias("cls"), F.col("component").alias("grp"))
        self.groups = self.scratch.write(new, name)

    def live(self, rows: DataFrame, name: str) -> DataFrame:
        """``cls, n, node, grp, size, weight`` of the nodes that hold several components, from ``cls, n, node``.

        Near copies meet in most nodes that they go to: of small nodes with the same classes one is compared, once.
        """
        known = self.grouped(rows)
        rows = known if self.groups is None else self.scratch.write(known, f"{name}-rows")
        total = rows.count()
        members = F.min("cls").alias("low"), F.max("cls").alias("high"), F.bit_xor(F.xxhash64("cls")).alias("hash1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("hash2")
        stats = _few(rows, total).groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("grp").alias("_a"), F.max("grp").alias("_b"), *members)
        stats = self.scratch.write(stats.where("_a != _b").drop("_a", "_b"), f"{name}-nodes")
        once = _few(stats, total).where(_small()).groupBy(*_MEMBERS).agg(F.min("node").alias("node"))
        if self.seen is not None:
            once = once.join(self.seen, _MEMBERS, "left_anti")
        met = stats.where(_small()).select(*_MEMBERS)
        self.seen = met if self.seen is None else self.seen.unionByName(met)
        stats = stats.where(~_small()).select("node", "size", "weight").unionByName(once.select("node", "size", "weight"))
        # where there are many, both sides are shuffled as they are, so that the adaptive plan splits large nodes
        return self.scratch.write(rows.join(F.broadcast(stats) if total <= FEW else stats, "node"), f"{name}-live")

    def descend(self, rows: DataFrame, name: str) -> None:
        for level in range(LEVELS + 1):
            tag = f"{name}-{level}"
            live = self.live(rows, tag)
            small = _small()
            pairs = live.where(small).select("node", F.lit(0).alias("block"), "cls", "grp", F.lit(-2).alias("pivot"))
            large = live.where(~small)
            if large.isEmpty():
                self.learn(_met(pairs, self.sets, f"{tag}-met", self.scratch).where("a is not null").select("a", "b"), f"{tag}-groups")
                return
            blocks = F.ceil(F.greatest(F.col("size") / LEAF, F.col("weight") / WEIGHT)).cast("int")
            large = large.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(level)), "_blocks").cast("int"))
            head = [F.min(F.struct(F.xxhash64("cls", F.lit(k)), "cls", "grp")).alias(f"_{k}") for k in range(PIVOTS)]
            heads = _few(large, live.count()).groupBy("node", "_blocks").agg(*head)
            pivots = heads.select("node", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), F.array(*(f"_{k}" for k in range(PIVOTS))).alias("_p"))
            pivots = pivots.select("node", "block", F.posexplode("_p").alias("pivot", "_p")).select("node", "block", "_p.cls", "_p.grp", "pivot")
            members = large.select("node", "block", "cls", "grp", F.lit(-1).alias("pivot"))
            met = _met(pairs.unionByName(members).unionByName(pivots), self.sets, f"{tag}-met", self.scratch)
            self.learn(met.where("a is not null").select("a", "b"), f"{tag}-groups")
            near = self.scratch.write(self.grouped(met.where("a is null").select("node", "cls", "n", "js")), f"{tag}-near")
            kept = self.scratch.write(self.reachable(near, tag), f"{tag}-kept")
            few = F.col("odds") <= (ODD if level < LEVELS else F.col("size"))
            self.rest(self.pooled(kept.where(few), tag), f"{tag}-rest")
            kept = kept.where(~few)
            if kept.isEmpty():
                return
            rows = kept.drop("n").join(self.tokens, "cls").select("cls", "n", "node", "sig").mapInArrow(_branch, "cls long, n long, node long")
            rows = _screened(self.scratch.write(rows.withColumn("tree", F.lit(0)), f"{tag}-kids"), self.sketches, self.scratch, tag).drop("tree", "low")

    def reachable(self, near: DataFrame, name: str) -> DataFrame:
        """``node, cls, n, grp, odd, size, weight, odds, main``: the members, ``odd`` or not, that a link out of the largest component, ``main``, may concern.

        Such a link has an odd end, one outside that component, and distances to a pivot differ by no more than the
        distance of its ends; so the other end lies within it of what odd members have. Nodes without odd members end.
        """
        total = near.count()
        main = _few(near, total).groupBy("node", "grp").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max(F.struct("c", "grp")).alias("m"), F.sum("c").alias("size"))
        main = main.select("node", F.col("m.grp").alias("main"), "size")
        marked = _beside(near, main, "node", total).withColumn("odd", F.col("grp") != F.col("main")).drop("size")
        marked = self.scratch.write(marked, f"{name}-marked")
        slack = 1 - SIMILAR / 100 + 1e-9
        j = [F.col("js")[k] for k in range(PIVOTS)]
        when = [F.when(F.col("odd"), x) for x in j]
        bounds = _few(marked, total).groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.count(F.when(F.col("odd"), 1)).alias("odds"), *(F.min(x).alias(f"_lo{k}") for k, x in enumerate(when)), *(F.max(x).alias(f"_hi{k}") for k, x in enumerate(when)))
        bounds = bounds.where("odds > 0")
        inside = F.lit(True)
        for k, x in enumerate(j):
            inside = inside & x.between(F.col(f"_lo{k}") - slack, F.col(f"_hi{k}") + slack)
        return _beside(marked, bounds, "node", total).where(inside).select("node", "cls", "n", "grp", "odd", "size", "weight", "odds", "main")

    def pooled(self, kept: DataFrame, name: str) -> DataFrame:
        """Nodes that have the same largest component as one node, where that makes fewer rows than each by itself.

        A dense group is in several nodes of each tree, and most of its members are in most of them.
        """
        total = kept.count()
        pool = _few(kept, total).select(F.col("main").alias("node"), "cls", "n", "grp", "odd").distinct()
        sizes = pool.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.count(F.when(F.col("odd"), 1)).alias("odds"))
        each = _few(kept, total).groupBy(F.col("main").alias("node")).agg(F.sum(F.col("odds") + F.when(F.col("odd"), F.col("size")).otherwise(0)).alias("_each"))
        sizes = self.scratch.write(sizes.join(each, "node").withColumn("_one", 2 * F.col("size") * F.col("odds") <= F.col("_each")), f"{name}-pools")
        whole = _beside(pool, sizes.where("_one").drop("_one", "_each"), "node", total)
        apart = kept.join(sizes.where("not _one").select(F.col("node").alias("main")), "main", "left_semi")
        return self.scratch.write(whole.unionByName(apart.select(*whole.columns)), f"{name}-pooled")

    def rest(self, kept: DataFrame, name: str) -> None:
        """Odd members against all members of their node, block by block, each pair of blocks a comparison of its own."""
        # light sets meet in larger blocks: a member comes once for each block of the others
        half = F.least(F.lit(2 * LEAF), F.greatest(F.lit(LEAF // 2), F.floor(F.lit(WEIGHT // 2) * F.col("size") / F.col("weight"))))
        n_all, n_odd = F.ceil(F.col("size") / half).cast("int").alias("_all"), F.ceil(F.col("odds") / half).cast("int").alias("_odd")
        rows = kept.select("node", "cls", "grp", "odd", n_all, n_odd)
        deal = F.xxhash64("cls", F.lit(99))
        others = F.sequence(F.lit(0), F.col("_odd") - 1)
        every = rows.select("node", "cls", "grp", F.explode(F.transform(others, lambda o: F.pmod(deal, "_all").cast("int") * F.col("_odd") + o)).alias("block"))
        odd = rows.where("odd").select("node", "cls", "grp", F.explode(F.transform(F.sequence(F.lit(0), F.col("_all") - 1), lambda o: o * F.col("_odd") + F.pmod(deal, "_odd").cast("int"))).alias("block"))
        both = every.unionByName(odd).withColumn("pivot", F.lit(-2))
        self.learn(_met(both, self.sets, f"{name}-met", self.scratch).where("a is not null").select("a", "b"), f"{name}-groups")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of bytes other than white space, A-Z taken as a-z. Documents with
    100 * intersection >= 75 * union of their shingle sets are linked, and
    ``component_id`` is the smallest id reachable. Null and empty texts, and texts
    without words, have no shingles and are linked with nothing. Very long texts are
    read in pieces of about a megabyte and compared whole. Rows repeated with one id
    and text count as one row each with the same result; rows repeated with one id
    and other texts are documents of their own that share the id; rows with a null id
    are returned with their shingle count, a null component and ``kept`` true. Ids are
    compared in their own type. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("key", _KEY), T.StructField("sig", T.BinaryType())])
    sigs = scratch.write(src.mapInArrow(_signatures, schema), "near-signatures")
    grouped = sigs.where("doc_id is not null and key.n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.write(grouped.withColumn("cls", F.monotonically_increasing_id()), "near-classes")
    tokens = classes.select("cls", F.col("key.n").alias("n"), "sig")

    rows = tokens.mapInArrow(_roots, "cls long, n long, tree int, node long")
    rows = scratch.write(rows, "near-roots")
    sketches = tokens.select("cls", "sig").mapInArrow(_sketches, "cls long, sketch binary")
    live = _screened(rows, sketches, scratch, "near")
    pairs = live.where("cls != low").select(F.col("cls").alias("a"), F.col("low").alias("b"))
    clusters = components(pairs.distinct(), scratch).select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
    need = clusters.join(classes, "cls").select("cls", "cluster", F.col("key.n").alias("n"), "key", F.col("first").alias("_first"))
    need = scratch.write(need, "near-need")
    total = need.count()
    sizes = scratch.write(_few(need, total).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")), "near-clusters")
    # node: the cluster, where it is small
    need = _beside(need, sizes, "cluster", total).select("cls", F.when(_small(), F.col("cluster")).alias("node"), "key", "_first")
    need = scratch.write(need, "near-needed")
    texts = _likely(src, need.select(F.col("_first").alias("doc_id")), total)
    texts = texts.join(need, F.col("doc_id") == F.col("_first")).select("cls", "node", "key", "text")
    sets = scratch.write(texts.mapInArrow(_sets, "cls long, node long, set binary"), "near-sets")
    small = sets.where("node is not null").select("node", F.lit(0).alias("block"), "cls", F.col("cls").alias("grp"), F.lit(-2).alias("pivot"), "set")
    # a small cluster is compared once, so its links are stars already
    stars = _few(_met(small, None, "near-small-met", scratch), total).select(F.explode(F.array(*(F.struct(F.col(x).alias("cls"), F.col("b").alias("grp")) for x in "ab"))).alias("_s"))
    groups = scratch.write(stars.select("_s.cls", "_s.grp").distinct(), "near-small")
    forest = _Forest(tokens, sketches, sets.where("node is null").select("cls", "set"), scratch)
    live = scratch.write(live.join(need.where("node is null").select("cls"), "cls", "left_semi"), "near-large")
    members = live.count()
    if 0 < members <= SENT:
        forest.descend(live.select("cls", "n", "node"), "near-all")
    elif members:
        forest.descend(live.where("tree = 0").select("cls", "n", "node"), "near-first")
        forest.descend(live.where("tree > 0").select("cls", "n", "node"), "near-others")
    if forest.groups is not None:
        groups = groups.unionByName(forest.groups)

    many = groups.count()
    first = _few(need, total).select("cls", F.col("_first").alias("first"))
    named = _few(groups, many).join(first, "cls").groupBy("grp").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("size"))
    linked = _beside(groups, named, "grp", many).select("cls", "component")
    found = classes.select("key", "cls", "first", "copies").join(F.broadcast(linked) if many <= SENT else linked, "cls", "left")
    found = found.withColumn("component", F.coalesce("component", "first"))
    found = scratch.write(found.select("key", "component", "copies"), "near-found")
    total = sigs.count()
    out = join_skewed(sigs.select("doc_id", "key"), found, "key", "copies", total, "left")
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("key.n").alias("n_shingles"), cid.alias("component_id"))
    out = materialize(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-result")
    scratch.clear()
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one document of each group stays.

    Rows with a null id stay; rows repeated with one id stay or go together, and
    stay if one of them does.
    """
    found = near_groups(docs, id_col, text_col).where("doc_id is not null")
    gone = found.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("_kept")).where("not _kept").select("_gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
