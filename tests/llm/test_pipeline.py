"""The pipeline held against brute force on the smallest table, and the registered queries."""

import importlib.util
from pathlib import Path

import brute
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


def entry():
    spec = importlib.util.spec_from_file_location("entry", Path(__file__).resolve().parents[2] / "__spark_entry__.py")
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_pipeline(spark):
    import corpus_pipeline
    from lithoflow.llm import decontaminate, quality

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    src = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(src.where(~quality.held_out()), labels.where(~quality.held_out()))
    left = {r.doc_id: docs[r.doc_id] for r in quality.predict(src, model).collect() if r.predicted == 1}
    first = {}
    for i in sorted(left):
        first.setdefault(" ".join(brute.WORD.findall(left[i])), i)
    left = {i: left[i] for i in left if any(True for t, k in first.items() if k == i)}
    left = {i: left[i] for i, (_, c) in brute.near(list(left.items())).items() if i == c}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    import pyarrow as pa

    from lithoflow.llm.bytesets import chunks

    def hashes(t):
        for _, _, data, off in chunks(pa.array([t], pa.large_string())):
            return decontaminate.word_hashes(data, off)[0].tolist()

    def held(t):
        w = hashes(t)
        return any(sum(x[2] for x in decontaminate.tile(p, w, min(5, len(p)))) >= 0.75 * len(p) for b in bench if (p := hashes(b)))

    left = {i for i, t in left.items() if not held(t)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == left and len({(r.slot, r.place) for r in rows}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert len(corpus_pipeline.STAGES) == 5


def test_sql(spark):
    from lithoflow.llm import catalog

    c = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    q = catalog.queries()
    for name, sql in catalog.oracle_sql().items():
        df = q[name](spark, SF)
        cols = sorted(df.columns)
        r = c.sql(sql)
        assert sorted(r.columns) == cols
        key = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in x]) for x in rows)
        at = [r.columns.index(k) for k in cols]
        assert key([tuple(x[k] for k in cols) for x in df.collect()]) == key([tuple(x[k] for k in at) for x in r.fetchall()]), name


def test_one_query_each():
    names = entry().queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names
