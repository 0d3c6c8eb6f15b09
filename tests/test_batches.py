"""Cheapest paths and delimited matches of many lines at a time against those of one line."""

import random

import numpy as np
import pytest

from logweave.functions import scan, text
from logweave.functions.graphs import graphs
from logweave.functions.paths import cheapest_paths, weights_by_name
from logweave.functions.patterns import PatternSet
from logweave.operators import automaton, experiment
from logweave.plans.table_functions import register

FULL = PatternSet.full()


def lines(seed, n=80):
    draw = random.Random(seed)
    return ["".join(draw.choices("ab12.-:/ \té", k=draw.randint(0, 25))) for _ in range(n)] + ["", "1.2.3.4 5", "x" * 5000, "a " * 3000]


@pytest.mark.parametrize("patterns", [PatternSet.default(), FULL, PatternSet.named(["int", "word", "spaces"])])
@pytest.mark.parametrize("weights", [None, {"int": 0.5, "word": 0.5, "spaces": 0.25}, {"word": 1.0, "any": 0.0}, {}])
def test_cheapest_paths(patterns, weights):
    own = lines(3)
    g = graphs(own, patterns)
    known = patterns.densities() if weights is None else weights
    found = cheapest_paths(g, weights_by_name(g, known))
    got = [[] for _ in own]
    for i, arc in zip(found.line.tolist(), found.arc.tolist()):
        got[i].append((int(g.src[arc]), int(g.dst[arc]), g.names[g.name[arc]]))
    for i, one in enumerate(g.automata()):
        cost, path = text.cheapest_path(one, known)
        assert (found.cost[i], got[i]) == (cost, path), own[i][:60]


def test_path_columns(spark):
    frame = spark.createDataFrame([(0, "1.2.3.4 x"), (1, ""), (2, None), (3, "a 1")], "line_id long, line string").repartition(2)
    default = PatternSet.default()
    rows = {r["line_id"]: r["path"] for r in automaton.paths(frame, default).collect()}
    assert rows == {0: "ipv4 spaces word", 1: "", 2: "", 3: "hexa spaces uint"}
    lengths = automaton.paths(frame, default, weigh=lambda g: (g.dst - g.src).astype(float) ** 2)
    assert {r["line_id"]: r["cost"] for r in lengths.collect()} == {0: 9.0, 1: 0.0, 2: 0.0, 3: 3.0}
    assert {r["path"] for r in automaton.paths(frame, default, weights={"any": 0.0, "word": 0.0}).where("line_id = 3").collect()} == {"any"}
    own = automaton.slices(frame, default).where("line_id = 0").orderBy("place").collect()
    assert [(r["name"], r["j"], r["k"], r["text"]) for r in own] == [("ipv4", 0, 7, "1.2.3.4"), ("spaces", 7, 8, " "), ("word", 8, 9, "x")]


@pytest.mark.parametrize("strategy", ["all", "largest", "greedy"])
@pytest.mark.parametrize("free", [(set(), set()), ({"int", "word"}, set()), (set(), {"int"}), ({"float"}, {"float", "word"})])
def test_delimited(monkeypatch, strategy, free):
    monkeypatch.setattr(scan, "TOGETHER", 300)
    dfas = {n: d for n, d in FULL.dfas().items() if n in ("int", "float", "word", "spaces", "delimiter", "ipv4")}
    own = [None, *lines(5)[:84], "ab " * 40]
    for separators in ({"spaces"}, {"spaces", "delimiter"}, set()):
        found = scan.scan_delimited(own, dfas, separators, *free, strategy)
        got = [[] for _ in own]
        for name, (at, j, k) in found.items():
            for i, a, b in zip(at.tolist(), j.tolist(), k.tolist()):
                got[i].append((name, a, b))
        for i, line in enumerate(own):
            assert sorted(got[i]) == sorted(text.delimited(line or "", dfas, separators, *free, strategy)), line


def test_empty_batches():
    g = graphs([], FULL)
    assert len(cheapest_paths(g, np.zeros(0)).cost) == 0
    assert all(not len(x[0]) for x in scan.scan_delimited([], FULL.dfas(), {"spaces"}).values())


def test_table_function(spark):
    register(spark)
    rows = spark.sql("SELECT v.id, m.* FROM VALUES (1, 'a1 22'), (2, NULL), (3, '') v(id, line), LATERAL multi_grep(v.line, 'int, spaces') m").collect()
    assert sorted(map(tuple, rows)) == [(1, "int", 1, 2), (1, "int", 3, 5), (1, "spaces", 2, 3)]
    rows = spark.sql("""SELECT m.* FROM multi_grep('ab', '{"x": "[a-b]+"}', 'all') m""").collect()
    assert sorted(map(tuple, rows)) == [("x", 0, 1), ("x", 0, 2), ("x", 1, 2)]
    assert spark.sql("SELECT * FROM multi_grep('ab', NULL)").count() == 0


def test_delta(spark):
    rows = [("1.2.3.4 x", u, n) for u in (-1, 0, 7, 8, 99, None) for n in ("ipv4", "word", "spaces", "nothing", None)] + [(None, 0, "word"), ("", 0, "any"), ("é", 0, "any")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, line string, u int, name string").repartition(3)
    default = PatternSet.default()
    for r in frame.select("i", automaton.delta("line", "u", "name", default).alias("v")).collect():
        line, u, name = rows[r["i"]]
        want = None if None in (line, u, name) else text.automaton(line, default).moves.get(u, {}).get(name)
        assert r["v"] == want, rows[r["i"]]


def test_runtimes(spark):
    frame = spark.createDataFrame([(i, f"line {i} {'x' * (i % 3)}") for i in range(40)], "line_id long, line string")
    rows = experiment.runtimes(frame, [5, 40], threshold=0.05).orderBy("lines").collect()
    assert [r["lines"] for r in rows] == [5, 40] and all(r["seconds"] > 0 and r["clusters"] > 0 for r in rows)
