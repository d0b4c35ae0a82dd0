"""Fixtures cover all rows of the tables they are made from."""

from pathlib import Path

import pytest

from lithoflow.plans import fixtures as X

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


def test_points_are_all_orders(spark):
    orders = {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    assert sorted(r.pid for r in X.frame(spark, SF, X.POINTS).collect()) == sorted(orders)
    assert X.frame(spark, SF, X.ATTRIBUTES).count() == X.LAYERS * len(orders)


def test_covariance_of_all_cells(spark):
    from lithoflow.plans import catalog

    pairs = catalog.queries()["pairwise_covariance"](spark, SF)
    assert pairs.count() == (X.SIDE * X.SIDE) ** 2 and pairs.select("a", "b").distinct().count() == (X.SIDE * X.SIDE) ** 2
