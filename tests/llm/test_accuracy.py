"""Accuracy of the two classifiers on rows that they did not learn from."""

from pathlib import Path

import pytest

from lithoflow.llm import langid, quality

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").collect()}
    rows = [r for r in langid.op6_language_id(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").collect()}
    rows = [(r.score, truth[r.doc_id], r.predicted) for r in quality.op9_quality_classifier(spark, SF).collect() if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y, _ in rows if y == 1], [s for s, y, _ in rows if y == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert len(rows) > 30 and wins >= 0.95 * len(good) * len(bad)
    assert sum(p == y for _, y, p in rows) >= 0.9 * len(rows)


def test_training_takes_whole_documents(spark):
    """A bound on passages leaves out documents, never passages of one."""
    docs = spark.createDataFrame([(k, ("good words " if k % 2 else "bad;;;; ") * (20 + 400 * (k == 3))) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    model = quality.train(docs, labels, passages=20)
    got = {r.doc_id: r.predicted for r in quality.predict(docs, model).collect()}
    assert sum(got[k] == k % 2 for k in got) >= 38
