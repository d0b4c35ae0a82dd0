"""Language of whole texts: scripts narrow the candidates, Viterbi labels spans of words.

A word's score for a language is the mean log-probability of its hashed character
n-grams. Languages that do not use the word's script are no candidates. Viterbi with
one penalty for each switch labels the words, so a text of several languages falls
into spans; the language with the most letters is the prediction.

Where one language is best for the whole text, no stretch of words gains as much as a
switch costs, and no beginning and end together do, its constant path is the Viterbi
path and the step-by-step search is not run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow.llm.bytesets import mix

#: Training texts taken per language, by hash of the id; the only sampled figure.
TRAIN_PER_LANG = 1500
#: Languages of a model; more raise an error.
MOST_LANGS = 1000
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
SWITCH = 12.0
#: Score in place of a language that does not use the word's script.
BARRED = -30.0
#: Words whose scores a worker remembers.
REMEMBERED = 300_000
#: First code points of script ranges.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
_FROM = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_KIND = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_WORD = re.compile(r"[^\W\d_]+")


def script_of(words: list[str]) -> np.ndarray:
    return _KIND[np.searchsorted(_FROM, [ord(w[0]) for w in words], "right") - 1]


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of ``words`` (each between two marks) and each one's word."""
    text = np.frombuffer(("\x02" + "\x02".join(words) + "\x02").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(text == 2) - 1
    buckets, owners = [], []
    for n in GRAMS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        acc = np.full(m, np.uint64(n))
        inner = np.zeros(m, bool)
        for j in range(n):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + text[j : j + m]
            if 0 < j < n - 1 or n == 1:
                inner |= text[j : j + m] == 2
        ok = ~inner & (owner[:m] < len(words))
        buckets.append((mix(acc[ok]) >> np.uint64(64 - 15)).astype(np.int64))
        # a gram that begins with the mark that ends a word belongs to the next one
        owners.append(owner[:m][ok])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (buckets, langs) float32
    scripts: np.ndarray  # (scripts, langs) bool

    def words(self, words: list[str]) -> np.ndarray:
        b, owner = gram_buckets(words)
        # mean over the grams, times a length that grows slowly, so that long words do not drown the rest
        n = np.bincount(owner, minlength=len(words)).astype(np.float32)
        order = np.argsort(owner, kind="stable")
        b, owner = b[order], owner[order]
        first = np.searchsorted(owner, np.arange(len(words)))
        total = np.add.reduceat(self.logp[b], first, axis=0)
        score = total / n[:, None] * np.sqrt(n)[:, None]
        may = self.scripts[script_of(words)]
        may |= ~may.any(axis=1, keepdims=True)
        return np.where(may, score, score + BARRED).astype(np.float32)


def viterbi(e: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path over ``e`` (words, languages) when each change of language costs ``switch``; ties to the first language and to staying."""
    t = len(e)
    if not t:
        return np.zeros(0, np.int64)
    best = int(e.sum(axis=0).argmax())
    gain = np.cumsum(e - e[:, best : best + 1], axis=0, dtype=np.float64)
    before = np.vstack([np.zeros((1, e.shape[1])), gain[:-1]])
    low = np.minimum.accumulate(before, axis=0)
    # a path without ``best`` has a switch less than segments: its first and last must make up for one between them
    if (gain - low).max() < switch and gain.max() + (gain[-1] - before).max() < switch:
        return np.full(t, best)
    stay = np.empty(e.shape, bool)
    top = np.empty(t, np.int64)
    v = e[0].astype(np.float64)
    for k in range(1, t):
        top[k] = m = v.argmax()
        jump = v[m] - switch
        stay[k] = v >= jump
        v = np.where(stay[k], v, jump) + e[k]
    path = np.empty(t, np.int64)
    path[-1] = v.argmax()
    for k in range(t - 1, 0, -1):
        path[k - 1] = path[k] if stay[k, path[k]] else top[k]
    return path


class Labeller:
    def __init__(self, model: Model):
        self.model, self.ids, self.scores = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def spans(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        split = [[w for w in _WORD.findall((t or "").lower())] for t in texts]
        if len(self.ids) > REMEMBERED:
            self.ids, self.scores = {}, self.scores[:0]
        fresh = set().union(*split) - self.ids.keys()
        fresh = [w for w in fresh if any(map(str.isalpha, w))]
        if fresh:
            at = len(self.ids)
            self.ids.update(zip(fresh, range(at, at + len(fresh))))
            self.scores = np.vstack([self.scores, self.model.words(fresh)])
        get = self.ids.get
        for ws in split:
            ids = [i for w in ws if (i := get(w)) is not None]
            if len(ids) != len(ws):
                ws = [w for w in ws if w in self.ids]
            yield ws, viterbi(self.scores[ids]) if ids else np.zeros(0, np.int64)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[int]]:
        if not self.model.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
        langs, scores, n_spans = [], [], []
        for ws, path in self.spans(texts):
            if not ws:
                langs.append("und"), scores.append(0.0), n_spans.append(0)
                continue
            share = np.bincount(path, weights=np.fromiter(map(len, ws), np.int64, len(ws)), minlength=len(self.model.langs))
            k = int(share.argmax())
            langs.append(self.model.langs[k]), scores.append(float(share[k] / share.sum())), n_spans.append(1 + int((path[1:] != path[:-1]).sum()))
        return langs, scores, n_spans


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from about ``per_lang`` texts of each language, chosen by hash of the id; counting is distributed."""
    src = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    have = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(have) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages; the model holds a column of {BUCKETS} scores for each")
    langs = sorted(have)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    cut = [(k, float(per_lang) / n) for k, n in have.items()]
    cuts = F.broadcast(docs.sparkSession.createDataFrame(cut, "lang string, rate double"))  # one row per language
    u = F.pmod(F.xxhash64(F.lit("lang-sample"), F.col("_i").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = src.join(cuts, "lang").where(u < F.col("rate")).select("lang", "text")

    def count(batches):
        """What each batch adds: ``language, bucket, n`` of grams, and of letters by script behind the last bucket."""
        for b in batches:
            total: dict[int, np.ndarray] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = _WORD.findall((text or "").lower())
                if ws:
                    row = total.setdefault(langs.index(lang), np.zeros(BUCKETS + len(_NAMES), np.int64))
                    row[:BUCKETS] += np.bincount(gram_buckets(ws)[0], minlength=BUCKETS)
                    row[BUCKETS:] += np.bincount(script_of(ws), weights=[len(w) for w in ws], minlength=len(_NAMES)).astype(np.int64)
            for k, row in total.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["k", "at", "n"])

    counts = np.zeros((len(langs), BUCKETS + len(_NAMES)))
    found = sample.mapInArrow(count, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    for r in found.collect():  # a figure per language and bucket at most
        counts[r["k"], r["at"]] = r["n"]
    grams, letters = counts[:, :BUCKETS], counts[:, BUCKETS:]
    p = (grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    uses = letters > 0.01 * np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return Model(langs, np.log(p).T.astype(np.float32), uses.T)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, n_spans`` for each input row.

    Null, empty and letterless texts give ``und`` with score 0; ``score`` is the
    share of letters in spans of the predicted language; ties go to the first
    language by name. Repeated rows are scored each for itself, null ids pass
    through, other columns are ignored. Without any training text all is ``und``.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # buckets x languages: bounded by the two parameters
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.IntegerType())])

    def run(batches):
        lab = Labeller(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            langs, scores, n_spans = [], [], []
            k = 0
            while k < len(texts):
                size, a = 0, k
                while k < len(texts) and size < 2_000_000:
                    size += len(texts[k] or "")
                    k += 1
                for x, y in zip((langs, scores, n_spans), lab.predict(texts[a:k])):
                    x += y
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(n_spans, pa.int32())], names=schema.names)

    return src.mapInArrow(run, schema)


def held_out(col: str = "doc_id"):
    """A null id is not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")


SQL: dict[str, str] = {}
QUERIES = {"op6_language_id": op6_language_id}
