"""Near pairs of many lines and leaders against distances pair by pair; rounds of clustering."""

import random

import numpy as np
import pytest

from logweave.functions.near import ALL, Near
from logweave.functions.patterns import PatternSet
from logweave.functions.text import automaton, normalised_distance
from logweave.operators import cluster

PATTERNS = PatternSet.default()


def numbers(n):
    draw = random.Random(3)
    return [f"Supplier#{i:09d} {draw.randrange(25)} {draw.uniform(-999, 9999):.2f}" for i in range(n)]


ODD = ["", " ", "a 1.2.3.4 b", "a 1.2.3.5 b", "é 1.2.3.9 c ü", "é 10.2.3.9 c", "user=1 view", "user=12 view", "\U0001f600 x", "a"]


@pytest.mark.parametrize(("lines", "threshold"), [(numbers(60), 0.009), (numbers(30) + ODD, 0.05), (ODD * 2, 0.4), (ODD, 1.5)])
def test_near_pairs_are_those_of_single_distances(lines, threshold):
    dfas, densities = PATTERNS.dfas(), PATTERNS.densities()
    of = Near(list(range(len(lines))), lines, PATTERNS, threshold)
    seen, every = of.bound.seen(lines, dfas), np.full(len(lines), ALL)
    own = [automaton(x, PATTERNS, dfas) for x in lines]
    want = {(i, j): d for i, x in enumerate(own) for j, y in enumerate(own) if (d := normalised_distance(x, y, densities, threshold)) is not None}
    found = {(i, j): d for i, j, d in zip(*(c.tolist() for c in of(lines, seen, every, -every)))}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(d, abs=1e-12) for k, d in want.items())
    earlier = {(i, j) for i, j, _ in zip(*(c.tolist() for c in of(lines, seen, np.arange(len(lines)), -every)))}
    assert earlier == {(i, j) for i, j in want if j < i}
    closest = [(i, d, j) for i, j, d in zip(*(c.tolist() for c in of(lines, seen, every, every)))]
    best = lambda rows: {i: min((d, j) for k, d, j in rows if k == i) for i, _, _ in rows}
    assert best(closest) == best([(i, d, j) for (i, j), d in found.items()])


def test_rounds_stay_few_where_leaders_are_many(spark, monkeypatch):
    lines, rounds = numbers(1500), []
    first = cluster._first_in_cells
    monkeypatch.setattr(cluster, "_first_in_cells", lambda *a: rounds.append(1) or first(*a))
    found = cluster.cluster(spark.createDataFrame(list(enumerate(lines)), "line_id long, line string"), PATTERNS, 0.009)
    own = [r["cluster_id"] for r in found.orderBy("line_id").collect()]
    assert len(rounds) <= 4
    # the sequential pass over the same near pairs
    every = np.full(len(lines), ALL)
    of = Near(list(range(len(lines))), lines, PATTERNS, 0.009)
    near = {}
    for i, j, d in zip(*(c.tolist() for c in of(lines, of.bound.seen(lines, PATTERNS.dfas()), every, -every))):
        near.setdefault(i, []).append((d, j))
    leaders, want = set(), []
    for i in range(len(lines)):
        there = [(d, j) for d, j in near[i] if j in leaders]
        want.append(min(there)[1] if there else i)
        leaders |= set() if there else {i}
    assert own == want and len(leaders) > 300
