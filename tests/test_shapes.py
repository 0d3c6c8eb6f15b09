"""Distances by shapes against those pair by pair; few steps for many lines of few shapes."""

import random

import numpy as np
import pytest

from logweave.functions import near, shapes
from logweave.functions.distances import PairDistances
from logweave.functions.graphs import graphs
from logweave.functions.near import ALL, Near
from logweave.functions.patterns import PatternSet
from logweave.operators import cluster
from logweave.streaming import leaders as streaming
from logweave.streaming.leaders import StreamingClusters

ALPHABETS = ["ab1.2 ", "0123456789.:/-+ \tabcdefXYZ{}\"", "0123456789", "01 a-."]


def events(n, seed=5):
    draw = random.Random(seed)
    return [f"2024-01-{draw.randint(1, 28):02d} 00:{draw.randrange(60):02d}:{draw.randrange(60):02d} user={draw.randrange(3000)} {draw.choice(['view', 'click', 'error'])} {draw.uniform(0, 200):.2f}" for _ in range(n)]


def strings(alphabet):
    draw = random.Random(2)
    return ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(60)] + ["x" * 70 + "1" * 90 + " 7", "y" * 70 + "2" * 80, "1.2.3.4", "é1", "", "0" * 300, "\0" + "1"]


@pytest.mark.parametrize("collision", ["overwrite", "keep"])
@pytest.mark.parametrize("limit", [1e6, 6.0, 1.5])
@pytest.mark.parametrize("own", [events(60), *map(strings, ALPHABETS)])
def test_distances_are_those_of_whole_automata(own, limit, collision):
    patterns = PatternSet.default(any_collision=collision)
    draw = np.random.default_rng(1)
    i, j = draw.integers(0, len(own), 500), draw.integers(0, len(own), 500)
    want = PairDistances(graphs(own, patterns), patterns.densities())(i, j, np.full(500, limit))
    of = shapes.Shapes(patterns)
    lines = of.lines(own)
    place = of.known(lines.shape[i], lines.shape[j], find=True)
    there = np.flatnonzero(place >= 0)
    assert len(there) > 50
    got = of.distances(lines, lines, i[there], j[there], place[there], np.full(len(there), limit))
    assert np.array_equal(got, want[there], equal_nan=True)
    below = got == got
    assert (of.least(place[there])[below] <= got[below] + 1e-9).all()


def test_lines_whose_digits_matter_have_no_shape():
    of = shapes.Shapes(PatternSet.default())
    plain = of.lines(["user=1 2.5", "user=7 9.1", "at 1.2.3.4", "1.2.3", "é1", "", "1" * 300]).shape
    assert plain[0] == plain[1] >= 0 and plain[3] >= 0
    assert plain[[2, 4, 5, 6]].tolist() == [-1] * 4
    own = ["1.2.3.4 7", "user=1", "", "300.1.1.1", "é 5"]
    assert of.seen(own).tolist() == of.bound.seen(own, of.dfas).tolist()


def test_what_is_kept_is_bounded_and_found_again(monkeypatch):
    monkeypatch.setattr(shapes, "KEPT", 500)
    of, own = shapes.Shapes(PatternSet.default()), events(40)
    i, j = np.arange(39), np.arange(1, 40)
    for _ in range(3):
        lines = of.lines(own)
        place = of.known(lines.shape[i], lines.shape[j], find=True)
        assert of.distances(lines, lines, i, j, place, np.full(39, 1e6)).tolist() == PairDistances(graphs(own, of.patterns), of.densities)(i, j, np.full(39, 1e6)).tolist()
    assert of.generation > 2


@pytest.mark.parametrize("threshold", [0.03, 0.3])
def test_few_leaders_are_compared_by_shapes_alone(monkeypatch, threshold):
    """Events and one leader of each type: no automata of lines are made, and distances are whole."""
    patterns = PatternSet.default()
    lines = events(3000) + ["1.2.3.4 view", ""]
    leaders = [lines[0], lines[1], lines[2], lines[3]]
    seen = shapes.Shapes(patterns).seen(lines)
    every = np.full(len(lines), ALL)
    made = []
    monkeypatch.setattr(near, "graphs", lambda x, *a: made.extend(x) or graphs(x, *a))
    of = Near([0, 1, 2, 3], leaders, patterns, threshold)
    found = {(i, j): d for i, j, d in zip(*(c.tolist() for c in of(lines, seen, every, -every)))}
    assert len(made) < 20
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(lines)), np.arange(4), indexing="ij"))
    norm = np.array([len(lines[a]) + len(leaders[b]) for a, b in zip(i, j)], float)
    d = PairDistances(graphs(lines, patterns), patterns.densities())(i, j, threshold * norm) / norm
    assert found == {(a, b): x for a, b, x in zip(i.tolist(), j.tolist(), d.tolist()) if x == x}
    closest = [(i, d, j) for i, j, d in zip(*(c.tolist() for c in of(lines, seen, every, every)))]
    best = lambda rows: {i: min((d, j) for k, d, j in rows if k == i) for i in {r[0] for r in rows}}
    few = lambda rows: [r for r in rows if r[0] % 20 == 0 or r[0] > 2990]
    assert best(few(closest)) == best(few([(i, d, j) for (i, j), d in found.items()]))


def test_few_leaders_meet_lines_where_these_are_read(spark):
    """Nothing is shuffled or joined, and the rows are those of the form for many leaders."""
    own = [*events(150), None, "", "é 1.2.3.4", "zz top"]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(own + own[:40])], "line_id int, line string")
    leaders = [(7, own[7]), (3, own[3]), (9, own[7]), (11, "é 1.2.3.9")]
    found = cluster.nearest_representative(lines, leaders, threshold=0.05)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = {tuple(r) for r in found.collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(cluster, "few", lambda leaders: None)
        other = cluster.nearest_representative(lines, leaders, threshold=0.05)
        assert rows == {tuple(r) for r in other.collect()} and found.schema == other.schema
    assert len(rows) == len(own) + 40 and any(r[1] == 11 for r in rows)
    assert cluster.nearest_representative(lines, [], threshold=0.05).where("leader IS NOT NULL").count() == 0


def test_clusters_and_batches_of_few_leaders_are_those_of_many(spark, tmp_path):
    own = [*events(120), "", "", None, "é 1.2.3.4", "é 1.2.3.5", *events(30)]
    lines = spark.createDataFrame(list(enumerate(own)), "line_id long, line string")
    batches = [lines.where(c) for c in ("line_id % 2 = 1", "line_id < 0", "line_id % 2 = 0")]

    def both(name):
        stream = StreamingClusters(str(tmp_path / name), threshold=0.05)
        for number, batch in enumerate(batches):
            stream(batch, number)
        return sorted(map(tuple, stream.clusters(spark).collect())), sorted(map(tuple, cluster.cluster(lines, threshold=0.05).collect()))

    few = both("few")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(cluster, "few", lambda leaders: None)
        m.setattr(streaming, "few", lambda leaders: None)
        assert few == both("many")
    want = cluster.sequential([x or "" for x in own], PatternSet.default(), 0.05)
    assert [c for _, c in few[1]] == want and len(set(want)) > 5
    order = [i for k in (1, 0) for i in range(len(own)) if i % 2 == k]
    want = cluster.sequential([own[i] or "" for i in order], PatternSet.default(), 0.05)
    assert few[0] == sorted((i, order[c]) for i, c in zip(order, want))
