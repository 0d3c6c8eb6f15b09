"""The lower bound of distances, and the join that it drives, against all pairs."""

import random

import numpy as np
import pytest

from logweave.functions.bounds import Bound
from logweave.functions.distances import PairDistances
from logweave.functions.graphs import graphs
from logweave.functions.patterns import PatternSet
from logweave.operators import cluster
from logweave.operators.storage import release


def all_pairs(lines, patterns):
    g = graphs(lines, patterns)
    x, y = (a.ravel() for a in np.meshgrid(np.arange(len(lines)), np.arange(len(lines))))
    return g, x, y, PairDistances(g, patterns.densities())(x, y, np.full(len(x), 1e6))


@pytest.mark.parametrize("patterns", [PatternSet.default(), PatternSet.full(), PatternSet.named(["int", "word", "spaces"], handmade_any=True), PatternSet.default().with_densities({n: 0.2 for n in PatternSet.default().names})])
def test_never_above_the_distance(patterns):
    draw = random.Random(1)
    lines = ["".join(draw.choices("abcXYZ0189.:-/ \té🙂", k=draw.randint(0, 30))) for _ in range(60)] + ["", "1.2.3.4 5", "a" * 200]
    g, x, y, d = all_pairs(lines, patterns)
    bound = Bound(patterns)
    assert (bound.least(g, x, y) <= d).all()
    masses = bound.masses(lines)
    assert (np.abs(masses[x] - masses[y]).sum(axis=1) * (1 - 1e-9) <= d).all()
    assert bound.least(g, x, y)[d > 0].mean() > 0.05 * d[d > 0].mean()


def test_pairs_left_of_events(spark, sf):
    from logweave.plans.queries import ev_lines

    lines = [r["line"] for r in ev_lines(spark, sf).orderBy("line_id").limit(250).collect()]
    g, x, y, d = all_pairs(lines, PatternSet.default())
    norm = np.array([len(w) for w in lines])[x] + np.array([len(w) for w in lines])[y]
    left = Bound(PatternSet.default()).least(g, x, y) < 0.03 * norm
    near = d < 0.03 * norm
    assert not (near & ~left).any()
    # a fifth of all pairs has one event type, and nearly all of these are near
    assert left.mean() < 0.25 and (left & ~near).mean() < 0.05


@pytest.mark.parametrize("threshold", [0.02, 0.2, 0.7])
def test_cells_lose_no_near_pair(spark, threshold):
    draw = random.Random(2)
    words = ["GET", "PUT", "/index.html", "10.0.0.1", "x" * 90, "error 17", "é🙂", "a:b:c", " "]
    lines = sorted({" ".join(draw.choices(words, k=draw.randint(1, 6))) + str(draw.randint(0, 30)) for _ in range(120)} | {"", "y" * 700})
    _, x, y, d = all_pairs(lines, PatternSet.default())
    size = np.array([len(w) for w in lines])
    norm = size[x] + size[y]
    want = {(i, j, round(v / n, 9)) for i, j, v, n in zip(x.tolist(), y.tolist(), d.tolist(), norm.tolist()) if j < i and v < threshold * n}
    frame = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    own, _ = cluster.prepared(frame, PatternSet.default())
    pairs = cluster.candidate_pairs(own, own, threshold).where("leader < line_id")
    rows = cluster.near_pairs(pairs, PatternSet.default(), threshold).collect()
    assert len(rows) == len(want) and {(r["line_id"], r["leader"], round(r["d"], 9)) for r in rows} == want
    release(spark)


def test_independent_set(spark):
    draw = random.Random(3)
    nodes = draw.sample(range(500), 80)
    edges = {(max(a, b), min(a, b)) for a, b in (draw.sample(nodes, 2) for _ in range(200))}
    chosen = set()
    for i in sorted(nodes):
        if not any((i, j) in edges for j in chosen):
            chosen.add(i)
    found, _ = cluster.independent(spark.createDataFrame([(i,) for i in nodes], "line_id long"), spark.createDataFrame(sorted(edges), "line_id long, leader long"))
    assert {r["line_id"] for r in found.collect()} == chosen
    release(spark)


def test_clusters_of_many_cells_and_rounds(spark):
    draw = random.Random(4)
    kinds = [f"{draw.choice(['open', 'close', 'Read', 'WRITE'])} {'abcdefgh'[k % 8] * (k % 13 + 1)} {k}" for k in range(40)]
    lines = [draw.choice(kinds) + draw.choice(["", " 1", " 22", " x"]) for _ in range(260)] + ["", ""]
    frame = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string").repartition(3)
    got = [r["cluster_id"] for r in cluster.cluster(frame, threshold=0.04, block=3).orderBy("line_id").collect()]
    assert got == cluster.sequential(lines, PatternSet.default(), 0.04) and len(set(got)) > 30
