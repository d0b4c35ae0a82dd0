"""License scan: TF-IDF cosine to templates, then inheritance from the nearest directory (DataFrame operations only).

Templates are short notices, the usual file headers and whole licenses. A header is
the run of terms of a text that lies where a template would lie: wherever one of the
template's rarest terms stands, as many terms as the template has are taken with that
term at its place in it, however lines are broken and whatever stands before and after.
Files named as licenses are compared as wholes besides. Both are sparse TF-IDF vectors,
and the cosine to the template decides. Documents that declare nothing take the license
of the nearest ancestor directory with a license file, found by joins on paths.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow.plans.tables import Scratch, join_skewed, materialize

# fixed values: notices, file headers and short licenses in their public wording
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
#: License name and one wording of it; a parameter of the operator.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", _BSD),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
]
THRESHOLD = 0.75
#: The SQL form looks for a template at so many of its rarest terms at most; the operator at as many as the threshold needs.
ANCHORS = 8
#: What rounding may take from the squared weight that a unit at the threshold has in terms of its template.
SLACK = 4e-9
#: Files whose name marks them as the license of their directory.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"

_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def _spark_terms(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(c, _UPPER, _SMALL), F.lit(_TERM), F.lit(0))


def _vectors(templates: list[tuple[str, str]], idf: dict[str, float], threshold: float) -> list[tuple[int, str, list[str], dict[str, float], list[str]]]:
    """``number, name, terms, unit vector, anchors`` of each template.

    Anchors are its rarest terms, until the others alone cannot reach the threshold: what reaches it has an anchor.
    """
    out = []
    for k, (name, text) in enumerate(templates):
        ts = _terms(text)
        w = {t: ts.count(t) * idf[t] for t in set(ts)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit = {t: x / norm for t, x in w.items()}
        rest, anchors = 1.0, []
        for t in sorted(unit, key=lambda t: (-round(idf[t], 9), -round(unit[t], 9), t)):
            if rest < threshold**2 - SLACK:
                break
            anchors.append(t)
            rest -= unit[t] ** 2
        out.append((k, name, ts, unit, anchors))
    return out


def _texts(terms: Column, vectors: list, least: float) -> Column:
    """Whether the terms of a text weigh enough in some template; the square of a cosine is never more than that weight."""
    vocabulary = sorted({t for _, _, ts, *_ in vectors for t in ts})
    squares = F.create_map(*(x for t in vocabulary for x in (F.lit(t), F.array(*(F.lit(unit.get(t, 0.0) ** 2) for *_, unit, _ in vectors)))))
    zero = F.array(*[F.lit(0.0)] * len(vectors))
    shared = F.array_intersect(F.array(*map(F.lit, vocabulary)), terms)
    sums = F.aggregate(shared, zero, lambda acc, t: F.zip_with(acc, F.try_element_at(squares, t), lambda a, b: a + b))
    return F.exists(sums, lambda x: x >= least)


def _units(k: int, ts: list[str], unit: dict[str, float], anchors: list[str], least: float) -> Column:
    """What is compared with template ``k``: from the terms ``_w`` of a text, the headers, and the whole of a license file.

    Those whose terms weigh less than ``least`` in the template are left out, as they cannot reach the threshold.
    """
    own, squares = F.array(*map(F.lit, unit)), F.create_map(*(x for t, v in unit.items() for x in (F.lit(t), F.lit(v * v))))
    enough = lambda u: F.aggregate(F.array_intersect(own, u), F.lit(0.0), lambda acc, t: acc + F.try_element_at(squares, t)) >= least
    places = F.create_map(*(x for t in anchors for x in (F.lit(t), F.array(*(F.lit(i) for i, u in enumerate(ts) if u == t)))))
    starts = F.transform("_w", lambda x, i: F.transform(F.try_element_at(places, x), lambda o: F.greatest(i - o + 1, F.lit(1))))
    starts = F.array_distinct(F.flatten(F.filter(starts, lambda x: x.isNotNull())))
    headers = F.transform(starts, lambda s: F.slice("_w", s, F.lit(len(ts))))
    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.array("_w")).otherwise(F.array().cast("array<array<string>>"))
    texts = F.transform(F.filter(F.concat(headers, whole), enough), lambda u: F.array_join(u, " "))
    return F.transform(F.array_distinct(texts), lambda u: F.struct(F.lit(k).alias("k"), u.alias("unit")))


def license_scan(
    files: DataFrame,
    templates: list[tuple[str, str]] | dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, path, own_license, score, license, from_dir``.

    ``own_license`` is the template nearest to any header of the whole text, or to a
    license file as a whole, if its cosine reaches the threshold (``score``, 0
    otherwise; ties go to the first name). ``license`` is that, or the license of the
    nearest ancestor directory with a license file that declares one (``from_dir``;
    several such files in a directory: the highest score, then the first license
    name), else null. Terms weigh ``log((1 + texts) / (1 + texts with the term)) + 1``
    over all texts. A template is looked for at its rarest terms, as many as the
    threshold needs, so no run of terms that reaches it is without one. Null and empty texts declare nothing;
    a null path belongs to no directory; very long texts are read whole. Rows are told
    apart by id and path: repeated rows give equal rows. Other columns are ignored; an
    empty table gives an empty result.
    """
    templates = sorted((templates or TEMPLATES).items() if isinstance(templates, dict) else templates or TEMPLATES)
    spark = files.sparkSession
    scratch = Scratch(spark)
    src = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    vocabulary = sorted({w for _, t in templates for w in _terms(t)})
    words = src.select(F.explode(F.array_distinct(_spark_terms(F.col("_t")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    words = scratch.write(words, "license-df")
    n_texts = src.count()
    df = {r["term"]: r["df"] for r in words.where(F.col("term").isin(vocabulary)).collect()}  # at most one row per template term
    idf = {w: math.log((1 + n_texts) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    vectors = _vectors(templates, idf, threshold)

    # texts that may reach the threshold, and their headers: one scan
    least = threshold**2 - SLACK
    terms = _spark_terms(F.col("_t"))
    hits = src.where(_texts(terms, vectors, least)).select("doc_id", "path", terms.alias("_w"))
    units = [_units(k, ts, unit, own, least) for k, _, ts, unit, own in vectors]
    found = hits.select("doc_id", "path", F.explode(F.flatten(F.array(*units))).alias("u")).select("doc_id", "path", "u.k", "u.unit")
    found = scratch.write(found.distinct(), "license-units")

    # a header that many texts share is scored once, under a number, as a text may be long and has many terms
    distinct = found.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    distinct = scratch.write(distinct.withColumn("u", F.monotonically_increasing_id()), "license-distinct")
    found = join_skewed(found, distinct, "unit", "n", found.count()).select("doc_id", "path", F.struct("k", "u").alias("ku"))
    found = scratch.write(found, "license-found")
    terms = distinct.select("u", F.explode(F.split("unit", " ")).alias("term")).groupBy("u", "term").agg(F.count(F.lit(1)).alias("tf"))
    used = words.join(terms.select("term").distinct(), "term", "left_semi")
    weight = F.col("tf") * (F.log((F.lit(1.0) + n_texts) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1)
    terms = scratch.write(terms.join(used, "term", "left").select("u", "term", weight.alias("w")), "license-weights")
    norms = terms.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit_rows = [(k, t, float(x)) for k, _, _, unit, _ in vectors for t, x in unit.items()]
    given = F.broadcast(spark.createDataFrame(unit_rows, "k int, term string, v double"))  # one row per template term
    scored = terms.join(given, "term").groupBy("u", "k").agg(F.sum(F.col("w") * F.col("v")).alias("dot")).join(norms, "u")
    s = F.round(F.col("dot") / F.col("norm"), 9)
    names = F.element_at(F.array(*(F.lit(name) for _, name, *_ in vectors)), F.col("k") + 1)
    scored = scored.where(s >= threshold).select(F.struct("k", "u").alias("ku"), F.struct((-s).alias("s"), names.alias("l")).alias("best"))
    scored = scratch.write(scored.join(found.groupBy("ku").agg(F.count(F.lit(1)).alias("n")), "ku"), "license-scored")
    own = join_skewed(found, scored, "ku", "n", found.count()).groupBy("doc_id", "path").agg(F.min("best").alias("best"))
    own = scratch.write(own.select(F.col("doc_id").alias("_i"), F.col("path").alias("_q"), F.col("best.l").alias("own_license"), (-F.col("best.s")).alias("score")), "license-own")

    parent = F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1)
    rows = src.drop("_t").join(own, F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("path").eqNullSafe(F.col("_q")), "left").drop("_i", "_q")
    rows = materialize(rows.withColumn("_dir", F.when(F.col("path").contains("/"), parent).when(F.col("path").isNotNull(), F.lit(""))), "license-rows")
    at_dir = rows.where(F.col("own_license").isNotNull() & F.col("path").rlike(LICENSE_FILE))
    at_dir = at_dir.groupBy(F.col("_dir").alias("at")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own_license").alias("l"))).alias("g")).select("at", F.col("g.l").alias("dir_license"))
    dirs = scratch.write(rows.where("_dir is not null").groupBy("_dir").agg(F.count(F.lit(1)).alias("files")), "license-dirs")
    parts = F.split("_dir", "/")
    up = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    up = scratch.write(dirs.select("_dir", F.explode(F.array_distinct(up)).alias("at")), "license-ancestors")
    # the root and top directories are above very many others
    at_dir = at_dir.join(up.groupBy("at").agg(F.count(F.lit(1)).alias("below")), "at")
    nearest = join_skewed(up, at_dir, "at", "below", up.count()).groupBy("_dir").agg(F.max(F.struct(F.length("at").alias("len"), "at", "dir_license")).alias("m"))
    nearest = materialize(nearest.join(dirs, "_dir").select("_dir", "files", "m.at", "m.dir_license"), "license-nearest")
    scratch.clear()
    out = join_skewed(rows, nearest, "_dir", "files", n_texts, "left")
    return out.select(
        "doc_id", "path", "own_license", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("at")).alias("from_dir"),
    )


def corpus_path(docs: DataFrame) -> DataFrame:
    """The corpus laid out as a tree, ``source/thousand/hundred/name``; each hundredth document is its directory's license file."""
    d = F.col("doc_id")
    name = F.when(F.pmod(d, F.lit(100)) == 0, F.lit("LICENSE")).otherwise(F.concat(d.cast("string"), F.lit(".txt")))
    return docs.withColumn("path", F.concat_ws("/", "source", F.floor(d / 1000).cast("string"), F.floor(d / 100).cast("string"), name))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(corpus_path(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_V = ",\n".join(f"({k}, {_quoted(n)}, {_quoted(t)})" for k, (n, t) in enumerate(sorted(TEMPLATES)))
_LOWER = f"translate({{}}, '{_UPPER}', '{_SMALL}')"
SQL = {
    "op5_license_scan": rf"""
WITH tpl(k, l, t) AS (VALUES {_V}),
ta AS (SELECT k, l, regexp_extract_all({_LOWER.format("t")}, '{_TERM}') AS ts FROM tpl),
tt AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM ta) GROUP BY ALL),
d AS (SELECT doc_id, source || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS path,
  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM d) GROUP BY term),
tw AS (SELECT k, term, ln((1 + n)::double / (1 + coalesce(df, 0))) + 1 AS f, tf * f AS x FROM tt LEFT JOIN df USING (term), n),
tv AS (SELECT k, term, f, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS v FROM tw),
ranked AS (SELECT k, term, row_number() OVER o AS rank, 1 - coalesce(sum(v * v) OVER (PARTITION BY k ORDER BY round(f, 9) DESC, round(v, 9) DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM tv WINDOW o AS (PARTITION BY k ORDER BY round(f, 9) DESC, round(v, 9) DESC, term)),
anchor AS (SELECT k, term FROM ranked WHERE rank <= {ANCHORS} AND rest >= {THRESHOLD**2 - 1e-9}),
spot AS (SELECT k, len(ts) AS m, term, o FROM (SELECT k, ts, unnest(ts) AS term, generate_subscripts(ts, 1) AS o FROM ta) JOIN anchor USING (k, term)),
p AS (SELECT doc_id, term, i FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM d) WHERE term IN (SELECT term FROM anchor)),
head AS (SELECT DISTINCT doc_id, k, greatest(i - o + 1, 1) AS s, m FROM p JOIN spot USING (term)),
u AS (SELECT doc_id, k, w[s : s + m - 1] AS unit FROM head JOIN d USING (doc_id)
  UNION SELECT doc_id, k, w FROM d, tpl WHERE path LIKE '%/LICENSE' AND doc_id IN (SELECT doc_id FROM p)),
ut AS (SELECT k, unit, term, count(*) AS tf FROM (SELECT DISTINCT k, unit, unnest(unit) AS term, generate_subscripts(unit, 1) AS i FROM u) GROUP BY ALL),
uw AS (SELECT k, unit, term, tf * (ln((1 + n)::double / (1 + df)) + 1) AS x FROM n, ut JOIN df USING (term)),
c AS (SELECT uw.k, unit, round(sum(x * coalesce(v, 0)) / sqrt(sum(x * x)), 9) AS s FROM uw LEFT JOIN tv ON tv.k = uw.k AND tv.term = uw.term GROUP BY ALL),
own AS (SELECT doc_id, arg_min(l, (-s, l)) AS own_license, max(s) AS score FROM u JOIN c USING (k, unit) JOIN ta USING (k) WHERE s >= {THRESHOLD} GROUP BY doc_id),
r AS (SELECT d.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, own_license, coalesce(score, 0) AS score FROM d LEFT JOIN own USING (doc_id)),
g AS (SELECT dir AS at, arg_min(own_license, (-score, own_license)) AS dl FROM r WHERE own_license IS NOT NULL AND path LIKE '%/LICENSE' GROUP BY dir),
m AS (SELECT r.doc_id, arg_max(g.at, length(g.at)) AS at, arg_max(dl, length(g.at)) AS dl FROM r JOIN g ON r.dir = g.at OR starts_with(r.dir, g.at || '/') OR g.at = '' GROUP BY r.doc_id)
SELECT r.doc_id, path, own_license, score, coalesce(own_license, dl) AS license, CASE WHEN own_license IS NULL THEN m.at END AS from_dir
FROM r LEFT JOIN m USING (doc_id)
"""
}
QUERIES = {"op5_license_scan": op5_license_scan}
