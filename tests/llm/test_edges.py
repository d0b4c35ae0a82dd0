"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns for every operator."""

import random
from fractions import Fraction

import brute
import numpy as np
import pytest

from lithoflow.llm import chat, decontaminate, exact, langid, licenses, mix, near, quality, repeats, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, node long, h long, `keep_id` string, `_t` string, `kept` boolean, n long, sig binary, name string, tie string"
EXTRA = (9, 8, 7, "k", "t", True, 5, b"s", "nm", "ti")
RNG = random.Random(5)
WORDS = [f"w{k}{'aeiou'[k % 5]}n" for k in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(20_000, 1)
BASE = prose(60, 2)
CHANGED = " ".join("zz" if k == 30 else w for k, w in enumerate(BASE.split()))
TEXTS = {
    1: BASE, 2: BASE, 3: CHANGED, 4: "", 5: None, 6: LONG, 7: LONG + " tail", 8: "one two", 9: "ONE  two", 10: " \t\n ", 11: "été naïve 世界 мир " * 30,
    12: prose(80, 3), 13: prose(40, 4) + " " + prose(80, 3)[:350], 14: "und " * 200, 15: "one two",
}
ROWS = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in TEXTS.items()]
ODD = [*ROWS, ROWS[0], ROWS[5], (None, BASE, None, None, None), (None, None, None, None, None)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def plain(spark):
    return docs(spark, ROWS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact(odd, empty):
    import hashlib

    got = exact.exact_groups(odd, block_chars=64).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t, *_ in ODD:
        groups.setdefault(norm(t), []).append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        least = min((i for i in ids if i is not None), default=None)
        assert r.group_size == len(ids) and r.keep_id == least and r.kept == (r.doc_id == least)
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in ODD)
    kept = exact.exact_dedup(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {min(i for i in v if i is not None) for v in groups.values()}
    assert exact.exact_groups(empty).collect() == []


def test_exact_blocks_do_not_matter(plain):
    a = {tuple(r)[:5] for r in exact.exact_groups(plain).collect()}
    b = {tuple(r)[:5] for r in exact.exact_groups(plain, block_chars=7).collect()}
    assert a == b


def test_tokens(odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.TOKENIZER)
    lib = Tokenizer.from_file(path)
    got = tokens.token_counts(odd, path).collect()
    assert len(got) == len(ODD)
    want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.token_counts(empty, path).collect() == []


@pytest.mark.parametrize("text", ["a  b", " a b", "a b ", "a\n b", "a \nb", "x<|endoftext|>y z", "x <|endoftext|> y", "a  b c", "a b  c", "don't  can't 12 34", "\x1c a", "a \x85b"])
def test_token_boundaries(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.TOKENIZER)
    lib = Tokenizer.from_file(path)
    c = tokens.Counter(path, remembered=2)
    for t in (text, text * 3, text + " plain words", "plain " + text):
        assert c.batch([t]) == [len(lib.encode(t, add_special_tokens=False))]


def test_near(plain, odd, empty):
    want = brute.near([(i, t) for i, t, *_ in ROWS])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_groups(plain).collect()}
    assert got == want and want[3][1] == 1 and want[7][1] == 6 and want[15][1] == 8
    rows = near.near_groups(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == {(i, *v) for i, v in want.items()}
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    kept = near.near_dedup(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {v[1] for v in want.values()} | {None}
    assert near.near_groups(empty).collect() == []


def test_near_compares_the_same_classes_once(spark, monkeypatch):
    """Near copies meet in most nodes of all trees; small nodes of the same classes are compared in one of them."""
    words = [f"w{k}" for k in range(400)]
    changed = lambda n: " ".join("x" + w if k % 400 < n else w for k, w in enumerate(words))
    rows = [(1, changed(0)), (2, changed(10)), (3, changed(120)), (4, changed(140)), (5, "some other words that nothing shares"), (6, changed(250))]
    met, seen = near._met, []

    def spy(rows, *args):
        nodes = {}
        for r in rows.where("pivot = -2").collect():
            nodes.setdefault((r.node, r.block), set()).add(r.cls)
        seen.extend(map(frozenset, nodes.values()))
        return met(rows, *args)

    monkeypatch.setattr(near, "_met", spy)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)
    assert seen and len(seen) == len(set(seen))


def test_near_large_groups(spark, monkeypatch):
    """Groups beyond the exhaustive size: chains of drifting copies, which only hold together link by link."""
    r = random.Random(7)
    rows, base = [], prose(120, 9).split()
    for i in range(400):
        if i % 10 == 0:
            base = base[1:] + [f"n{i}"]
        words = list(base)
        words[r.randrange(len(words))] = f"m{i}"
        rows.append((i, " ".join(words), None, None, None))
    for name, v in (("LEAF", 8), ("PIVOTS", 2), ("ODD", 3), ("LEVELS", 1)):
        monkeypatch.setattr(near, name, v)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near.near_groups(docs(spark, rows)).collect()}
    assert got == brute.near([(i, t) for i, t, *_ in rows])


def test_near_dense_group_meets_once(spark, monkeypatch):
    """A dense group is in many large nodes; its members outside the largest component are compared with it once, in no more rows than node by node."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(1, 8)):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    for name, v in (("LEAF", 8), ("ODD", 1000)):
        monkeypatch.setattr(near, name, v)
    pooled, seen = near._Forest.pooled, []

    def spy(self, kept, name):
        out = pooled(self, kept, name)
        found = []
        for df in (kept, out):
            nodes = {}
            for r in df.collect():
                nodes.setdefault(r.node, []).append(r)
            found.append((sum(r.odds + (r.size if r.odd else 0) for n in nodes.values() for r in n), {(a.cls, b.cls) for n in nodes.values() for a in n for b in n if a.odd}))
        seen.append(found)
        return out

    monkeypatch.setattr(near._Forest, "pooled", spy)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)
    assert all(after[0] <= before[0] and after[1] >= before[1] for before, after in seen)
    assert sum(after[0] for _, after in seen) < 0.7 * sum(before[0] for before, _ in seen)


def test_near_sends_each_set_once(spark, monkeypatch):
    """Classes of a small cluster are compared in one node, whichever nodes of the trees they share; those that share but a passage are not compared at all."""
    rng = random.Random(11)
    rows, passage = [], [f"p{k}" for k in range(60)]
    for family in range(5):
        base = [f"f{family}-{k}" for k in range(150)]
        for i in range(5):
            words = list(base)
            for k in rng.sample(range(150), 1 + 3 * i):  # some of a family are links, some are not
                words[k] = f"x{family}-{i}-{k}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(passage + [f"o{i}-{k}" for k in range(90)])) for i in range(20)]
    met, seen = near._met, []

    def spy(rows, *args):
        seen.extend(r.cls for r in rows.collect())
        return met(rows, *args)

    monkeypatch.setattr(near, "_met", spy)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)
    assert 1 < len({c for i, (_, c) in got.items() if i < 5}) < 5
    assert len(seen) == len(set(seen)) <= 25


def test_near_screen_keeps_nodes_over_batches():
    """A node is cut alike wherever the batches end, and nodes over batches are not torn."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    groups = [rng.integers(0, 256, near.TOKENS, dtype=np.uint8) for _ in range(4)]
    rows = [(c, 100 + c % 3, 0, node, groups[(c + node) % 4].tobytes()) for node in range(6) for c in range(node * 7, node * 7 + 2 + node * 2)]
    rows.append((1000, 100, 0, 6, groups[0].tobytes()))
    rows.append((1001, 10, 0, 6, groups[0].tobytes()))  # alike, but of a size that no link can have
    names = ["cls", "n", "tree", "node", "sketch"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(step):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + step]), types)], names=names) for k in range(0, len(rows), step)]
        return sorted(tuple(r.values()) for b in near._screen(iter(batches)) for r in b.to_pylist())

    whole = run(len(rows))
    assert whole and all(run(step) == whole for step in (1, 3, 8))
    want = {}
    for c, n, _, node, sketch in rows[:-2]:
        want.setdefault((node, sketch), []).append(c)
    found = {}
    for c, _, _, node, low in whole:
        found.setdefault((node, low), []).append(c)
    assert sorted(found.values()) == sorted(v for v in want.values() if len(v) > 1)


def test_near_light_sets_meet_in_large_blocks(spark, monkeypatch):
    """Members outside the largest component meet the others in few rows where sets are light."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(1, 8)):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    for name, v in (("LEAF", 8), ("ODD", 1000)):
        monkeypatch.setattr(near, name, v)
    rest, met, most, made = near._Forest.rest, near._met, [], []

    def spy_rest(self, kept, name):
        most.extend(2 * r.size * r.odds / 16 + r.size + r.odds for r in kept.select("node", "size", "odds").distinct().collect())
        return rest(self, kept, name)

    def spy_met(rows, sets, name, scratch):
        made.append(rows.count() if "rest" in name else 0)
        return met(rows, sets, name, scratch)

    monkeypatch.setattr(near._Forest, "rest", spy_rest)
    monkeypatch.setattr(near, "_met", spy_met)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)
    assert 0 < sum(made) <= sum(most)


@pytest.mark.parametrize("few", [True, False])
def test_near_takes_few_rounds_for_few_rows(spark, monkeypatch, few):
    """Where few members are in large clusters their sums shuffle nothing and all trees go down at once; more of them give the same groups in more rounds."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(1000 + k, prose(60, 90 + k // 3) + f" end{k}") for k in range(12)]
    for i in range(100):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(1, 8)):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near, "LEAF", 8)
    if not few:
        monkeypatch.setattr(near, "SENT", 0)
        monkeypatch.setattr(near, "FEW", 0)
    shuffles = spark.sparkContext._jsc.sc().newShuffleId
    before = shuffles()
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    made = shuffles() - before - 1
    assert got == brute.near(rows)
    assert not few or made <= 40


def test_near_reads_needed_texts_only(spark):
    """The texts of documents that share no node are left out before the shuffle; none that is needed is."""
    have = spark.range(40_000).selectExpr("id as doc_id", "'t' as text")
    ids = spark.range(0, 40_000, 40).withColumnRenamed("id", "doc_id")
    left = {r.doc_id for r in near._likely(have, ids, 1000).collect()}
    assert left >= set(range(0, 40_000, 40)) and len(left) < 6000
    assert near._likely(have, ids.limit(0), 0).count() == 0


def test_repeats(plain, odd, empty):
    want = brute.repeats([(i, t) for i, t, *_ in ROWS])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(plain).collect()}
    assert got == want and want[13][1] > 300
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == len(ODD)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows if r.doc_id is not None}
    assert got == {(i, *v) for i, v in want.items()}
    assert sorted((r.n_bytes, r.n_removed) for r in rows if r.doc_id is None) == sorted([(0, 0), (len(BASE), len(BASE))])
    assert repeats.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("match", [3, 8, 9, 16, 37, 100])
def test_longest_previous_factor(match):
    """The array against its definition, on strings of two letters with a long repeat."""
    r = np.random.default_rng(match)
    data = r.integers(97, 99, 260).astype(np.uint8)
    data[130:250] = data[:120]
    starts = np.arange(260 - match + 1)
    place = r.permutation(len(starts))
    b = bytes(data)

    def common(i, j):
        return next((k for k in range(match) if b[i + k] != b[j + k]), match)

    want = [max((common(i, j) for j in starts if place[j] < place[i]), default=0) for i in starts]
    assert repeats.longest_previous(data, starts, place, match).tolist() == want


def test_repeats_heavy_anchor(plain):
    """Anchors with many contexts take the way of single strings; the result is the same."""
    a = {tuple(r)[:5] for r in repeats.remove_repeats(plain, keep_text=False).collect()}
    b = {tuple(r)[:5] for r in repeats.remove_repeats(plain, keep_text=False, heavy=1).collect()}
    assert a == b


def test_repeats_in_long_texts(spark):
    """Texts over several pieces, with copies from over the cuts and from within one text."""
    a = prose(80_000, 11)
    cut = repeats.PIECE
    rows = [(1, a), (2, a[1000 : cut + 40_000]), (3, "x" * (cut + 500)), (4, prose(40, 12) + a[cut - 150 : cut + 150]), (5, a[-90_000:] + a[-200:])]
    rows += [(k, a[k * 700 : k * 700 + 130 + k]) for k in range(10, 40)]
    assert len(a) > cut
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows)


@pytest.mark.parametrize("seed", range(6))
def test_repeats_random(spark, seed):
    """Few letters, so that everything repeats somewhere."""
    r = random.Random(seed)
    part = ["".join(r.choice("ab") for _ in range(r.randrange(60, 180))) for _ in range(6)]
    rows = [(i, "".join(r.choice(part) for _ in range(r.randrange(0, 7))) + "é" * r.randrange(3)) for i in range(25)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), heavy=3).collect()}
    assert got == brute.repeats(rows)


def test_language(plain, odd, empty):
    model = langid.train(plain.where("lang is not null"))
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows} <= {"en", "und"}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in dict(TEXTS).get(r.doc_id) or "")) for r in rows if r.doc_id is not None)
    assert langid.predict(empty, model).collect() == []
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(plain, none).collect()} == {"und"}


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    g = np.random.default_rng(3)
    for _ in range(60):
        e = g.normal(0, 3, (6, 3))
        best = max(sum(e[t, p[t]] for t in range(6)) - 2.5 * sum(a != b for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=6))
        p = langid.viterbi(e, 2.5)
        assert abs(best - (sum(e[t, p[t]] for t in range(6)) - 2.5 * int((p[1:] != p[:-1]).sum()))) < 1e-9


def test_mixed_language_spans(spark):
    a, b = "der die das und nicht eine schön straße " * 40, "the and with this that from which there " * 40
    train = spark.createDataFrame([(k, (a if k % 2 else b), "de" if k % 2 else "en") for k in range(20)], "doc_id long, text string, lang string")
    lab = langid.Labeller(langid.train(train))
    (_, path), = lab.spans(["the and with this that from which " * 3 + "nicht eine schön straße der die " * 3])
    assert lab.model.langs == ["de", "en"] and set(path[:15]) == {1} and set(path[-15:]) == {0}


def test_quality(spark, plain, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (12, 1, 0), (14, 0, 0), (14, None, 0), (None, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(plain, labels)
    rows = quality.predict(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.predict(empty, model).collect() == []
    none = quality.train(plain, labels.where("false"))
    assert {r.predicted for r in quality.predict(plain, none).collect()} == {1}


def test_attention_gradient():
    import numpy as np

    g = np.random.default_rng(1)
    x, first, y = g.normal(0, 1, (40, 5)).astype(np.float32), np.array([0, 3, 4, 12, 20, 33, 40]), np.array([0, 1, 1, 0, 1, 0.0])
    a = quality.fit(x, first, y, epochs=400)
    assert (np.abs(a.score(x, first) - y) < 0.3).all()


def test_decontamination(spark, odd, empty):
    item = prose(30, 77).split()
    swapped = item[15:] + ["inbetween"] + item[:15]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "one two"), (5, "!!!"), (None, prose(25, 78)), (1, " ".join(item))], "item_id long, text string")
    extra = [(50, "x " + " ".join(item).upper() + ", y", None, None, None), (51, " ".join(swapped), None, None, None), (52, " ".join(item[:14]), None, None, None), (53, prose(25, 78), None, None, None)]
    d = docs(spark, [*ODD, *extra])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, bench).collect()}
    assert got == {(50, 1), (51, 1), (53, None), (8, 4), (9, 4), (15, 4)}
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, bench, block_bytes=100).collect()}
    assert blocks == got
    left = decontaminate.decontaminate(d, bench)
    assert left.columns == d.columns and left.count() == d.count() - 6
    assert decontaminate.contaminated(empty, bench).collect() == [] and decontaminate.contaminated(odd, bench.where("false")).collect() == []


def slow_tiles(p, t, least):
    """Greedy string tiling by its definition."""
    fp, ft, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and i + n not in fp and j + n not in ft and p[i + n] == t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(x[0] for x in out)
        out.append(best)
        fp.update(range(i, i + n)), ft.update(range(j, j + n))


@pytest.mark.parametrize("seed", range(40))
def test_tiling_against_definition(seed):
    r = random.Random(seed)
    p = [r.randrange(4) for _ in range(r.randrange(5, 30))]
    cut = sorted(r.sample(range(len(p)), 2))
    t = p[cut[1] :] + [9] + p[: cut[0]] + [r.randrange(4) for _ in range(10)] + p[cut[0] : cut[1]]
    got = decontaminate.tile(p, t, 3)
    for i, j, n in got:
        assert n >= 3 and p[i : i + n] == t[j : j + n]
    assert sorted(x[2] for x in got)[-1:] == slow_tiles(p, t, 3)[-1:]
    used = [k for i, _, n in got for k in range(i, i + n)]
    assert len(used) == len(set(used))
    # nothing is left that could still be tiled
    fp = set(range(len(p))) - set(used)
    ft = set(range(len(t))) - {k for _, j, n in got for k in range(j, j + n)}
    assert not any(all(i + k in fp and j + k in ft and p[i + k] == t[j + k] for k in range(3)) for i in range(len(p) - 2) for j in range(len(t) - 2))


def test_mix(spark, odd, empty):
    rows = mix.mix(odd, block_docs=2).collect()
    assert len(rows) == len(ODD) and len({(r.slot, r.place) for r in rows}) == len(ODD)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert mix.mix(empty).collect() == []
    with pytest.raises(ValueError, match="frame"):
        mix.mix(odd, weights={"s0": 1.0, "s1": 1e-9})
    with pytest.raises(Exception, match="no weight"):
        mix.mix(odd, weights={"s0": 1.0}).collect()


@pytest.mark.parametrize(
    "w",
    [
        {"a": 0.61, "b": 0.27, "c": 0.07, "d": 0.05},
        {"a": 0.99995, "b": 0.00005},
        {"a": 1, "b": 2},
        {"a": Fraction(1, 3), "b": Fraction(1, 3), "c": Fraction(1, 7), "d": Fraction(4, 21)},
    ],
)
def test_mix_deviation(spark, w):
    """Each prefix of slots holds less than one block more or less than the given weights ask for."""
    d = spark.createDataFrame([(k, sorted(w)[k % len(w)]) for k in range(4800)], "doc_id long, source string")
    rows = [r for r in mix.mix(d, weights=w, block_docs=4).collect() if r.in_target]
    slots = {r.slot: r.source for r in rows}
    end = max(slots)
    assert sorted(slots) == list(range(end + 1)) and end > 100
    total, seen = sum(map(Fraction, map(str, w.values()))), dict.fromkeys(w, 0)
    for t in range(end + 1):
        seen[slots[t]] += 1
        assert all(abs(seen[s] - Fraction(str(w[s])) / total * (t + 1)) < 1 for s in w)


def test_mix_keeps_rows_and_columns(spark):
    """Repeated ids stay apart and columns named as the schedule are carried under another name."""
    d = spark.createDataFrame([(1, "x", "a", 7), (1, "y", "a", 8), (2, None, None, 9)], "doc_id long, text string, source string, block int")
    got = mix.mix(d)
    assert got.columns == ["doc_id", "text", "source", "input_block", *mix.SCHEDULE]
    assert sorted((r.doc_id, r.text or "", r.input_block) for r in got.collect()) == [(1, "x", 7), (1, "y", 8), (2, "", 9)]


def test_licenses(spark, odd, empty):
    files = spark.createDataFrame(
        [
            (1, "a/LICENSE", "some words\nReleased under the MIT License."), (2, "a/b/c/x.txt", "nothing"), (3, "a/b/NOTICE", "Licensed under the Apache License, Version 2.0."), (4, "a/y.txt", None),
            (5, "z.txt", "plain"), (6, None, "Licensed under CC BY-NC 4.0."), (7, "a/b/c/own.txt", "x " * 5000 + "\nThis work is licensed under the GNU General Public License, version 3."), (None, "q/x", ""), (2, "a/b/c/x.txt", "nothing"),
        ],
        "doc_id long, path string, text string",
    )
    got = {(r.doc_id, r.path, r.own_license, r.license, r.from_dir) for r in licenses.license_scan(files).collect()}
    assert got == {
        (1, "a/LICENSE", "MIT", "MIT", None), (2, "a/b/c/x.txt", None, "Apache-2.0", "a/b"), (3, "a/b/NOTICE", "Apache-2.0", "Apache-2.0", None), (4, "a/y.txt", None, "MIT", "a"),
        (5, "z.txt", None, None, None), (6, None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (7, "a/b/c/own.txt", "GPL-3.0", "GPL-3.0", None), (None, "q/x", None, None, None),
    }
    assert licenses.license_scan(files).count() == 9
    assert licenses.license_scan(licenses.corpus_path(odd)).count() == len(ODD)
    assert licenses.license_scan(licenses.corpus_path(empty)).collect() == []


def test_license_headers_and_files(spark):
    """Whole license files, wrapped notices and notices inside a line are found, and a license file is inherited."""
    mit = dict(x for x in licenses.TEMPLATES if x[0] == "MIT")["MIT"]
    files = spark.createDataFrame(
        [
            (1, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit), (2, "a/b/x.txt", "plain words"), (3, "c/h.py", "# " + mit.replace("\n", "\n# ") + "\ncode and more code " * 300),
            (4, "d/y", "it says This work is licensed under the GNU\nGeneral Public License, version 3. and goes on " + "so " * 500), (5, "e/z", "Licensed under the Apache\nLicense, Version 2.0."), (6, "e/w", "an apache in a license of the public"),
        ],
        "doc_id long, path string, text string",
    )
    got = {r.doc_id: (r.own_license, r.license, r.from_dir) for r in licenses.license_scan(files).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "MIT", "a"), 3: ("MIT", "MIT", None), 4: ("GPL-3.0", "GPL-3.0", None), 5: ("Apache-2.0", "Apache-2.0", None), 6: (None, None, None)}
    own = licenses.license_scan(files.where("doc_id = 1"), templates={"X": files.first()["text"]}).first()
    assert own.own_license == "X" and abs(own.score - 1) < 1e-8


def test_chat(spark):
    def conv(c, *turns):
        return [(c, k, "user" if k % 2 == 0 else "assistant", t, "x", 3) for k, t in enumerate(turns)]

    rows = [*conv(1, "a", "b"), *conv(2, "a", "b", "c"), *conv(3, "a", "b", "c"), *conv(4, "a", None), *conv(5, "a", "", "z"), *conv(None, "n"), *conv(7, *map(str, range(40))), *conv(8, *map(str, range(39))), (2, 0, "user", "a", "x", 3), (9, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h1 string, pos int")
    for span in (512, 7, 1):
        got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.chat_format(df, span).collect()}
        assert set(got) == {2, 4, 5, None, 7, 9}
        assert got[2] == (3, 2, "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\nc\n<|end|>\n") and got[7][0] == 40
    assert chat.chat_format(df.where("false")).collect() == []
