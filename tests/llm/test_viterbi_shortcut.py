"""The search is left out only where the constant path is the best path."""

import itertools

import numpy as np

from lithoflow.llm import langid


def value(e, p, switch):
    return sum(e[t, k] for t, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))


def test_two_halves_and_a_third_language():
    e = np.array([(0.0, -8, -3)] * 3 + [(-8.0, 0, -3)] * 3)
    assert langid.viterbi(e, 12.0).tolist() == [0, 0, 0, 1, 1, 1]


def test_against_all_paths_with_dear_switches():
    g = np.random.default_rng(11)
    for k in range(300):
        e = np.round(g.normal(0, 4, (6, 3)) + np.repeat(g.normal(0, 4, (2, 3)), 3, axis=0), 3)
        switch = (6.0, 12.0, 20.0)[k % 3]
        best = max(value(e, p, switch) for p in itertools.product(range(3), repeat=6))
        assert abs(best - value(e, langid.viterbi(e, switch).tolist(), switch)) < 1e-9
    assert langid.viterbi(e[:1], 12.0).tolist() == [int(e[0].argmax())]
