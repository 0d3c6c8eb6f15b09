"""Grouping by a relation, and templates behind one automaton, against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import evaluate, grouping


def one_pass(rows, equal):
    firsts, out = [], {}
    for i, key, x in sorted(rows):
        found = next((j for j, k, y in firsts if k == key and equal(y, x)), None)
        if found is None:
            firsts.append((i, key, x))
        out[i] = i if found is None else found
    return out


@pytest.mark.parametrize("block", [2, 40])
def test_group_by_relation(spark, block):
    draw = random.Random(block)
    rows = [(i, draw.choice(["a", "b", None]), draw.randint(0, 60)) for i in draw.sample(range(1000), 90)]
    frame = spark.createDataFrame(rows, "line_id long, kind string, x int").repartition(3)
    near = lambda a, b: (a["x"] - b["x"]).abs() <= 4
    want = one_pass([(i, k or "", x) for i, k, x in rows], lambda y, x: abs(x - y) <= 4)
    assert {r["line_id"]: r["group_id"] for r in grouping.group_by_relation(frame, near, "kind", block).collect()} == want
    apart = lambda a, b: a["x"] < b["x"] - 30
    want = one_pass([(i, "", x) for i, k, x in rows], lambda y, x: y < x - 30)
    assert {r["line_id"]: r["group_id"] for r in grouping.group_by_relation(frame, apart, block=block).collect()} == want
    assert grouping.group_by_relation(frame.where("false"), near, "kind").count() == 0


def plain_best(line, templates):
    fits = [(i, parts) for i, parts in sorted(templates) if line is not None and all(p in line for p in parts)]
    if not fits:
        return None
    if all(p in fits[0][1] or not p for _, parts in fits for p in parts):
        return fits[0][0]
    return min(fits, key=lambda t: (-sum(map(len, t[1])), t[0]))[0]


def test_templates_at_once():
    draw = random.Random(1)
    word = lambda n: "".join(draw.choices("abc é", k=draw.randint(0, n)))
    templates = [(i, [word(3) for _ in range(draw.randint(0, 3))]) for i in draw.sample(range(500), 60)]
    for own in (templates, templates[:7], [t for t in templates if all(t[1]) and t[1]], []):
        known = evaluate.Templates(own)
        for line in [None, "", *(word(14) for _ in range(300))]:
            assert known.best(line) == plain_best(line, own)


def test_many_templates(spark):
    templates = spark.range(100_000).select(F.col("id").cast("int").alias("template_id"), F.array(F.concat(F.lit("kind"), "id", F.lit(":")), F.lit("end")).alias("parts"))
    lines = spark.range(3000).select(F.col("id").alias("line_id"), F.concat(F.lit("x kind"), F.col("id") * 33, F.lit(": y end")).alias("line"))
    found = evaluate.template_match(lines, templates)
    assert found.where(F.col("template_id") != F.col("line_id") * 33).count() == 0 and found.count() == 3000
