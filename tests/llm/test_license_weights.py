"""Term weights of the license scan come from the document frequencies of all terms."""

import math
import re

from lithoflow.llm import licenses


def cosine(a, b, texts):
    terms = lambda t: re.findall(licenses._TERM, t.lower())
    df = {}
    for t in texts:
        for w in set(terms(t)):
            df[w] = df.get(w, 0) + 1

    def vector(t):
        return {w: terms(t).count(w) * (math.log((1 + len(texts)) / (1 + df.get(w, 0))) + 1) for w in set(terms(t))}

    a, b = vector(a), vector(b)
    return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_common_words_weigh_little(spark):
    """A notice with other words in it keeps its license, whatever the number of texts; a header is as long as its template."""
    notice = "Released by us under the it MIT License."
    template = [x for x in licenses.TEMPLATES if x[0] == "MIT"][0]
    assert template[1] == "Released under the MIT License."
    for copies in (40, 2000):
        texts = [notice, *["by us that it la the on a"] * copies]
        rows = spark.createDataFrame([(k, f"a/{k}", t) for k, t in enumerate(texts)], "doc_id long, path string, text string")
        got = licenses.license_scan(rows, templates=[template]).where("doc_id = 0").first()
        runs = [" ".join(notice.lower().rstrip(".").split()[k : k + 5]) for k in range(4)]
        assert abs(got.score - max(cosine(r, template[1], texts) for r in runs)) < 1e-8
        assert got.own_license == "MIT"


def test_rarest_terms_changed(spark):
    """A long notice without the eight rarest terms of its template is found, as a header and as a license file."""
    name, template = licenses.TEMPLATES[1]
    terms = re.findall(licenses._TERM, template.lower())
    changed = [t for t in sorted(set(terms)) if terms.count(t) == 1][:8]  # the rarest, as no other text has them
    notice = " ".join(f"w{changed.index(t)}" if t in changed else t for t in terms)
    common = "w0 w1 w2 w3 w4 w5 w6 w7 "
    texts = [notice, common * 40 + notice + " " + common * 40, "nothing", *[common] * 30]
    paths = ["a/LICENSE", "b/x.py", "a/y.py", *[f"c/{k}" for k in range(30)]]
    rows = spark.createDataFrame(list(zip(range(len(texts)), paths, texts)), "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licenses.license_scan(rows, templates=[(name, template)]).collect()}
    expected = cosine(notice, template, texts)
    assert expected > 0.76
    for k in (0, 1):
        assert got[k].own_license == name and abs(got[k].score - expected) < 1e-8
    assert (got[2].own_license, got[2].license, got[2].from_dir) == (None, name, "a")
    assert all(got[k].license is None for k in range(3, len(texts)))


def test_terms_that_touch(spark):
    """A number with dots ends at a letter: the terms on both sides of the seam count."""
    rows = spark.createDataFrame([(0, "a/x", "licensed under cc by nc 4.0licensed"), (1, "a/y", "by the way 4.0under")], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in licenses.license_scan(rows, templates=[("CC", "NC 4.0")]).collect()}
    assert got == {0: "CC", 1: None}
    lone = licenses.license_scan(rows.where("doc_id = 0"), templates=[("N", "4.0")]).first()
    assert lone.own_license == "N"
