"""Distances of many pairs at a time against those of one pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.functions import distances, text
from logweave.functions.graphs import graphs
from logweave.functions.patterns import PatternSet
from logweave.operators import distance

ALPHABETS = ["ab", "ab1.2 ", "0123456789.:/-+ \tabcdefXYZ{}\"é漢🙂"]


def strings(seed, longest):
    draw = random.Random(seed)
    own = ["".join(draw.choices(ALPHABETS[k % 3], k=draw.randint(0, longest))) for k in range(60)]
    return own + ["", "a", own[5], own[5] + "x", "\0", "\ud800a"]


@pytest.mark.parametrize("longest", [5, 63, 64, 65, 200])
def test_lcs_of_many_pairs(longest):
    own = strings(longest, longest)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(own)), np.arange(len(own))))
    want = [text.lcs_length(own[a], own[b]) for a, b in zip(i, j)]
    assert distances.lcs_lengths(own, i, j).tolist() == want
    assert distances.lcs_distances(own, i, j).tolist() == [len(own[a]) + len(own[b]) - 2 * n for a, b, n in zip(i, j, want)]


def test_lcs_in_parts(monkeypatch):
    own = strings(3, 150)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(own)), np.arange(len(own))))
    want = distances.lcs_lengths(own, i, j).tolist()
    monkeypatch.setattr(distances, "TABLE", 5000)
    assert distances.lcs_lengths(own, i, j).tolist() == want
    assert distances.lcs_lengths([], i[:0], j[:0]).tolist() == []


@pytest.mark.parametrize("collision", ["overwrite", "keep"])
@pytest.mark.parametrize(("limit", "limits"), [(1e5, {}), (6.0, {}), (0.0, {}), (1e5, {"STATES": 3000, "STEPS": 500}), (8.0, {"HUGE": 60})])
def test_pattern_distances_of_many_pairs(monkeypatch, collision, limit, limits):
    for name, value in limits.items():
        monkeypatch.setattr(distances, name, value)
    patterns = PatternSet.default(any_collision=collision)
    own = strings(17, 40)
    g = graphs(own, patterns)
    draw = np.random.default_rng(1)
    i, j = draw.integers(0, len(own), 400), draw.integers(0, len(own), 400)
    got = distances.PairDistances(g, patterns.densities())(i, j, np.full(len(i), limit))
    one = g.automata()
    want = [text.pattern_distance(one[a], one[b], patterns.densities(), limit) for a, b in zip(i, j)]
    assert np.array_equal(got, np.array([np.nan if d is None else d for d in want]), equal_nan=True)


def test_columns(spark):
    own = ["1.2.3.4 5", "", None, "x y 12", "1.2.3.4 6", "x y 12", "z" * 130 + " 7", "z" * 131 + " 8"]
    rows = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in own for b in own)]
    frame = spark.createDataFrame(rows, "k int, a string, b string").repartition(3)
    a, b = F.col("a"), F.col("b")
    found = frame.select(
        "k", distance.lcs_length(a, b).alias("n"), distance.lcs_distance(a, b).alias("d"), distance.pattern_distance(a, b).alias("p"), distance.pattern_distance(a, b, normalized=True, limit=0.1).alias("q")
    ).collect()
    default = PatternSet.default()
    for r in found:
        _, x, y = rows[r["k"]]
        if x is None or y is None:
            assert r[1:] == (None,) * 4
            continue
        g, h = (text.automaton(w, default) for w in (x, y))
        assert (r["n"], r["d"]) == (text.lcs_length(x, y), text.lcs_distance(x, y))
        assert r["p"] == text.pattern_distance(g, h, default.densities()) and r["q"] == text.normalised_distance(g, h, default.densities(), 0.1)


def test_limits_leave_out_pairs_before_their_automata_are_made(spark, monkeypatch):
    """Only pairs whose characters allow a distance below the limit are computed; the others' lines get no automata."""
    from pyspark.sql import functions as F

    from logweave.operators import distance

    rows = [(i, f"2024-01-01 00:00:{i:02d} user={i} {'view' if i % 2 else 'error'} {i}.50", f"2024-01-01 00:01:{i:02d} user={i + 1} view {i}.25") for i in range(20)] + [(20, "", ""), (21, None, "a"), (22, "1.2.3.4 a", "1.2.3.5 a")]
    frame = spark.createDataFrame(rows, "i long, a string, b string")
    whole = {r["i"]: r["d"] for r in frame.select("i", distance.pattern_distance(F.col("a"), F.col("b"), normalized=True).alias("d")).collect()}
    below = {r["i"]: r["d"] for r in frame.select("i", distance.pattern_distance(F.col("a"), F.col("b"), normalized=True, limit=0.05).alias("d")).collect()}
    assert below == {i: d if d is not None and d < 0.05 else None for i, d in whole.items()}
    made = []
    graphs = distance.graphs
    monkeypatch.setattr(distance, "graphs", lambda lines, *a: made.extend(lines) or graphs(lines, *a))
    import pandas as pd

    own = {}
    monkeypatch.setattr(distance.F, "pandas_udf", lambda kind: lambda f: lambda a, b: own.setdefault("run", f))
    distance.pattern_distance(F.col("a"), F.col("b"), normalized=True, limit=0.05)
    own["run"](pd.Series([r[1] for r in rows]), pd.Series([r[2] for r in rows]))
    assert made and not any("error" in x for x in made)
