"""Connected components against union-find, in one task and dealt over many."""

import random

import pytest

from lithoflow.llm import graph
from lithoflow.plans.tables import Scratch

random.seed(4)
CASES = {
    "chain": [(i, i + 1) for i in range(120)],
    "random": [(random.randrange(300), random.randrange(300)) for _ in range(190)],
    "stars that touch, a loop": [(0, i) for i in range(1, 40)] + [(60, 39), (60, 61), (61, 61)],
    "repeated and turned": [(9, 5), (5, 9), (9, 3), (9, 5)],
    "loops only": [(1, 1)],
    "empty": [],
}


def union_find(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {x: find(x) for x in list(top)}


@pytest.mark.parametrize("one_task", [True, False])
@pytest.mark.parametrize("case", CASES)
def test_components(spark, monkeypatch, case, one_task):
    if not one_task:
        monkeypatch.setattr(graph, "EDGES_A_TASK", -1)
    got = graph.components(spark.createDataFrame(CASES[case], "a long, b long"), Scratch(spark)).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted(union_find(CASES[case]).items())
