"""The pipeline on nulls, empty texts, repeated rows and ids, clashing columns and empty tables."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, block int, slot string, _gone long, _kept_id long, kept boolean, n long"


def table(k):
    words = f"the river of number {k} runs by an old mill where people of town {k * 7} meet each morning to trade their bread and talk".split()
    return " ".join(words[(j * (k + 3)) % len(words)] + ("" if j % 5 else f"{k}x{j}") for j in range(60))


@pytest.fixture
def folder(spark, tmp_path):
    extra = (0.5, 7, 3, "s", 1, 2, True, 9)
    rows = [(k, table(k), "en", "ab"[k % 2], 1, *extra) for k in range(12)]
    rows += [(0, table(0), "en", "a", 1, *extra), (1, table(40), None, None, None, *extra), (20, None, None, "a", None, *extra), (21, "", None, "b", 0, *extra), (None, table(50), None, None, None, *extra), (22, table(3) + " more", "en", "a", 1, *extra), (23, table(9).upper(), "en", "a", 1, *extra)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(12)] + [(21, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, table(5)), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return tmp_path


def test_edges(spark, folder):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, str(folder))
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]
    assert out.columns == ["input_" + c if c in ("block", "slot") else c for c in names] + ["block", "place", "slot", "release", "deadline", "in_target"]
    rows = out.collect()
    assert len({(r.slot, r.place) for r in rows}) == len(rows) and all(r.input_block == 3 and r.input_slot == "s" for r in rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in rows)
    # copies of the kept id stay with it; 5 holds the benchmark item; 22 and 23 are near copies of 3 and 9
    ids = [i for i, _ in got]
    assert ids.count(0) == 2 and ids.count(1) == 2 and -1 in ids and not {5, 22, 23} & set(ids) and set(range(12)) - {5} <= set(ids)


def test_empty(spark, folder, tmp_path_factory):
    import corpus_pipeline

    where = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(folder / f"{t}.parquet")).where("false").write.parquet(str(where / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(where)).collect() == []
