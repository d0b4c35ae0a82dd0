"""Quality classifier: multiple-instance learning with gated attention over passages.

A text is a bag of passages. Each passage is encoded from byte statistics; gated
attention, learned from labels of whole documents, weighs the encodings, and the
weighted representation is scored. Training runs on all passages of a bounded sample
of labelled documents, scoring on every passage of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lithoflow.llm.bytesets import SPACE, chunks, prefix, spans, table, words

#: Bytes of a passage; labelled documents learned from, and their passages in all.
PASSAGE = 512
TRAIN_DOCS = 6000
TRAIN_PASSAGES = 200_000
THRESHOLD = 0.3
EPOCHS = 150
HIDDEN, ATTENTION = 24, 12

# byte classes: white space and each ASCII sign by itself, else lower, upper, digit, longer characters
_SIGNS = b"\n .,;:!?'\"()[]{}<>|#$%&*+-/=@_~^\\`"
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _k, _c in enumerate(_SIGNS):
    _CLASS[_c] = 5 + _k
N_CLASS = 5 + len(_SIGNS)
# coarse kinds for pairs of neighbours: other, lower, upper, digit, longer, white space, stop, other sign
_KIND = np.minimum(_CLASS, 7)
_KIND[_CLASS >= 5] = 7
_KIND[[32, *range(9, 14)]] = 5
_KIND[[33, 44, 46, 58, 59, 63]] = 6
N_FEATURES = N_CLASS + 64 + 6
_WORDS = table(11)


def passage_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts and each text's range of passages (an empty text has one)."""
    size = np.diff(off)
    count = np.maximum(1, (size + PASSAGE - 1) // PASSAGE)
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(data)) - off[owner]
    p = first[owner] + place // PASSAGE
    bytes_in = np.bincount(p, minlength=n).astype(np.float64)
    base = np.maximum(bytes_in, 1)[:, None]
    hist = np.bincount(p * N_CLASS + _CLASS[data], minlength=n * N_CLASS).reshape(n, N_CLASS) / base
    kind = _KIND[data]
    same = p[1:] == p[:-1]
    pair = np.bincount(p[1:][same] * 64 + kind[:-1][same] * 8 + kind[1:][same], minlength=n * 64).reshape(n, 64) / base
    lo, hi, _ = words(data, off, ~SPACE)
    h = spans(prefix(data, _WORDS), lo, hi)
    at = p[lo] if len(lo) else np.zeros(0, np.int64)
    w = np.bincount(at, minlength=n).astype(np.float64)
    wb = np.maximum(w, 1)

    def again(k: int) -> np.ndarray:
        eq = (h[k:] == h[:-k]) & (at[k:] == at[:-k])
        return np.bincount(at[k:][eq], minlength=n) / wb

    kinds = np.bincount(at * 64 + (h >> np.uint64(58)).astype(np.int64), minlength=n * 64).reshape(n, 64)
    spread = (kinds > 0).sum(axis=1) / np.minimum(wb, 64)
    extra = np.stack([np.log1p(bytes_in), np.log1p(np.bincount(at, weights=(hi - lo), minlength=n) / wb), again(1), again(2), spread, kinds.max(axis=1) / wb], axis=1)
    return np.sqrt(np.hstack([hist, pair, extra])).astype(np.float32), first


@dataclass
class Attention:
    """Gated attention: h = tanh(xW), a = softmax(w . (tanh(hV) * sigmoid(hU))), score = sigmoid(c . sum(a h) + b)."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    prior: float

    def logits(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _forward(self.w, (x - self.mean) / self.scale, first)[0]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x, first), -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray):
    h = np.tanh(x @ w["W"] + w["Wb"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    s = (v * u) @ w["a"]
    size = np.diff(first)
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, first[:-1]), size))
    a = e / np.repeat(np.add.reduceat(e, first[:-1]), size)
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return z @ w["c"] + w["b"], h, v, u, a, z


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Attention:
    """Adam on the log-loss over whole bags, fixed seed."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    w = {
        "W": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "Wb": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "a": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "b": np.array(np.log(prior / (1 - prior))),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    size = np.diff(first)
    for t in range(1, epochs + 1):
        logit, h, v, u, a, z = _forward(w, x, first)
        err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - y) / len(y)
        dz = np.repeat(err[:, None] * w["c"], size, axis=0)
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), size))
        dv, du = ds[:, None] * w["a"] * u * (1 - v * v), ds[:, None] * w["a"] * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
        g = {"W": x.T @ dh, "Wb": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ ds, "c": z.T @ err, "b": err.sum()}
        for k in w:
            gk = g[k] + 1e-4 * w[k] * (k in "WVU")
            m[k] = 0.9 * m[k] + 0.1 * gk
            s[k] = 0.99 * s[k] + 0.01 * gk * gk
            w[k] = (w[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return Attention(mean, scale, w, prior)


def _bags(batches, ids: int, text: int, label: int):
    for b in batches:
        for i, j, data, off in chunks(b.column(text)):
            x, first = passage_features(data, off)
            bags = [x[first[k] : first[k + 1]].tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([b.column(ids).slice(i, j - i), b.column(label).slice(i, j - i), pa.array(bags, pa.binary())], names=["k", "y", "bag"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, passages: int = TRAIN_PASSAGES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Attention:
    """Learn from at most ``most`` labelled documents, chosen by hash of the id.

    Documents are taken whole, in that order, up to ``passages`` in all (one that is
    longer by itself is passed over); what learning holds is bounded by the two.
    Labels that are null are ignored; of several for one id the largest holds.
    Without any label every score is 0.5.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_k")).agg(F.max(label_col).cast("int").alias("_y"))
    marks = marks.orderBy(F.xxhash64(F.lit("quality"), F.col("_k")), "_k").limit(most)
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    size = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("_t"), F.lit(0)) / PASSAGE))
    sized = texts.join(F.broadcast(marks), F.col("_i") == F.col("_k")).groupBy("_k", "_y").agg(F.sum(size).alias("_n")).where(F.col("_n") <= passages)
    upto = F.sum("_n").over(W.orderBy(F.xxhash64(F.lit("quality"), F.col("_k")), "_k"))  # over at most ``most`` rows
    marks = sized.withColumn("_upto", upto).where(F.col("_upto") <= passages).select("_k", "_y")
    picked = texts.join(F.broadcast(marks), F.col("_i") == F.col("_k"))
    picked = picked.select(F.col("_i").cast("string").alias("k"), F.col("_t").alias("t"), F.col("_y").alias("y"))
    rows = picked.mapInArrow(lambda it: _bags(it, 0, 1, 2), "k string, y int, bag binary").collect()  # ``most`` bags and ``passages`` rows of features at most
    rows = sorted({(r["k"], r["y"], bytes(r["bag"])) for r in rows})
    if not rows:
        x, first, y = np.zeros((1, N_FEATURES), np.float32), np.array([0, 1]), np.array([0.5])
    else:
        bags = [np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in rows]
        x, first, y = np.vstack(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), np.array([r[1] for r in rows], float)
    return fit(x, first, y)


def good(docs: DataFrame, model: Attention, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns, whatever their names."""
    plain = docs.toDF(*(f"_carry{k}" for k in range(len(docs.columns))))
    scored = predict(plain, model, threshold, text_col=f"_carry{docs.columns.index(text_col)}", carry=plain.columns)
    return scored.where("predicted = 1").select(*plain.columns).toDF(*docs.columns)


def predict(docs: DataFrame, model: Attention, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id, score, predicted, n_passages`` for each input row; with ``carry`` these columns of ``docs`` in place of ``doc_id``.

    Null text counts as empty; an empty text is a bag with one empty passage and has
    a score too; a very long text is as many passages as it has. Repeated rows are scored each for itself, null ids pass through,
    other columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    heads = [F.col(id_col).alias("doc_id")] if carry is None else [F.col(c) for c in carry]
    n_heads = len(heads)
    src = docs.select(*heads, F.col(text_col).alias("_scored"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType())])

    def run(batches):
        for b in batches:
            score, n = [], []
            for _, _, data, off in chunks(b.column(n_heads)):
                x, first = passage_features(data, off)
                score.append(shared.value.score(x, first).astype(np.float64)), n.append(np.diff(first))
            if score:
                yield pa.RecordBatch.from_arrays([*b.columns[:n_heads], pa.array(np.concatenate(score)), pa.array(np.concatenate(n).astype(np.int64))], names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(col: str = "doc_id"):
    """A null id is not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_passages")


SQL: dict[str, str] = {}
QUERIES = {"op9_quality_classifier": op9_quality_classifier}
