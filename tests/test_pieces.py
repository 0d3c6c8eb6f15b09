"""Batches in pieces, and texts of matches made where lines are read."""

import pandas as pd

from logweave.functions.patterns import PatternSet
from logweave.operators import matching

LINES = [(0, "user=12 view 3.5"), (1, ""), (2, None), (3, "a  b"), (4, "word 1 2 3"), (5, "é 10.0.0.1 ü"), (6, "x" * 200)]


def test_pieces_are_bounded_and_whole():
    b = pd.DataFrame({"line_id": range(400), "line": [None if i % 7 == 0 else "x" * (i % 50) for i in range(399)] + ["y" * 5000]})
    got = list(matching.pieces(iter([b, b.iloc[:0], b.iloc[:3]]), lines=60, characters=1000))
    assert pd.concat(got).equals(pd.concat([b, b.iloc[:3]]))
    assert all(len(p) <= 60 and (len(p) == 1 or sum(len(x) for x in p["line"] if x) <= 1000) for p in got)


def test_rows_handed_over_are_bounded(monkeypatch):
    monkeypatch.setattr(matching, "ROWS", 100)
    b = pd.DataFrame({"line_id": range(50), "line": ["some words in a line"] * 50})
    parts = list(matching._scanned(iter([b]), PatternSet.default().dfas(), "all"))
    assert max(map(len, parts)) <= 100 and len(pd.concat(parts).drop_duplicates()) == sum(map(len, parts)) > 1000


def test_texts_and_reports_without_shuffle(spark):
    lines = spark.createDataFrame(LINES, "line_id long, line string")
    for patterns in (PatternSet.default(), PatternSet.named(["float", "spaces", "word"])):
        found = matching.matches(lines, patterns)
        for own, plain in ((matching.matched_texts(lines, patterns), matching.as_map(lines, found)), (matching.reports(lines, patterns), matching.as_string(lines, found))):
            assert sorted(own.collect()) == sorted(plain.collect())
            assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
