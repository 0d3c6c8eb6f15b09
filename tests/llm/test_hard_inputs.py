"""Inputs that once took more than linear time or memory, and tables that outlive a run."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from logweave.llm import html_extract, langid, shared, warc
from logweave.llm.exact_dedup import exact_dedup
from logweave.llm.simhash import simhash_dedup


def old_successor(at, data):
    """The record's end by its header alone."""
    stop = data.find(b"\r\n\r\n")
    if stop < 0 or not re.match(rb"\d+[ \t]*\r\n", data):
        return -1
    found = [line.partition(b":")[2].strip() for line in data[:stop].split(b"\r\n")[1:] if line.partition(b":")[0].strip().lower() == b"content-length"]
    return at + 7 + stop + 4 + int(found[-1]) + 4 if found and found[-1].isdigit() else -1


@pytest.mark.parametrize("unit", [b"", b"1\r\n", b"1\r\nContent-Length: 5\r\n"])
def test_a_megabyte_of_magics(unit):
    n = (1 << 20) // (7 + len(unit))
    began = time.time()
    found = warc.successors([i * (7 + len(unit)) for i in range(n)], [unit] * n)
    assert time.time() - began < 2 and set(found.values()) == {-1}


def test_successors_equal_headers_one_by_one():
    head = b"1\r\nWARC-Type: response\r\nX: "
    rest = [b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"1\r\nContent-Length : 12\r\n\r\n", b"0\r\n content-length:\t7 \r\ncontent-length: 9\r\n\r\nx", b"x\r\nContent-Length: 1\r\n\r\n", b"1\r\nContent-Length: z\r\n\r\n", b""]
    chunks = [head, *rest, b"1\r\nA: " + b"y" * (1 << 17) + b"\r\nContent-Length: 4\r\n\r\n", head, b"z" * (1 << 17), rest[0]]
    offsets, at = [], 0
    for c in chunks:
        offsets.append(at)
        at += 7 + len(c)
    got = warc.successors(offsets, chunks)
    for i, (offset, chunk) in enumerate(zip(offsets, chunks)):
        data, j = chunk, i + 1
        while b"\r\n\r\n" not in data and j < len(chunks) and len(data) < warc.HEADER:
            data += b"WARC/1." + chunks[j]
            j += 1
        assert got[offset] == old_successor(offset, data), i


def test_magics_in_payloads(spark):
    payloads = ["WARC/1." * 9000, "WARC/1.1\r\nContent-Length: 5\r\n" * 3000, "x" * 70_000 + "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 50, "plain", None]
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(payloads * 2)]
    found = {r["id"]: r for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r["bytes"] for i, r in found.items()} == {i: len((p or "").encode()) for i, _, p in rows}


@pytest.mark.parametrize("unit", ["<li>x", "<p>x", "<tr><td>x", "<dd>x", "<option>x"])
def test_a_megabyte_of_open_elements(unit):
    n = (1 << 20) // (5 + len(unit))
    began = time.time()
    page = html_extract.Page("<div>" * n + unit * n)
    assert time.time() - began < 6 and len(page.tags) >= 2 * n


def test_closing_equals_a_walk_over_the_stack():
    for source in ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "<p>a<table><tr><td><p>b<div>c</table><p>d", "<dl><dt>a<dd>b<dl><dd>c<dt>d</dl><dt>e</dl>", "<table><tr><td>a<td>b<tr><th>c<tbody><tr><td>d</table>", "<li>a<div><li>b</div><li>c"):
        page = html_extract.Page(source)
        depth = lambda i: 0 if page.parents[i] < 0 else 1 + depth(page.parents[i])
        outline = [(page.tags[i], depth(i)) for i in range(1, len(page.tags))]
        assert outline == OUTLINES[source]


OUTLINES = {
    "<ul><li>a<ul><li>b<li>c</ul><li>d</ul>": [("ul", 1), ("li", 2), ("ul", 3), ("li", 4), ("li", 4), ("li", 2)],
    "<p>a<table><tr><td><p>b<div>c</table><p>d": [("p", 1), ("table", 1), ("tr", 2), ("td", 3), ("p", 4), ("div", 4), ("p", 1)],
    "<dl><dt>a<dd>b<dl><dd>c<dt>d</dl><dt>e</dl>": [("dl", 1), ("dt", 2), ("dd", 2), ("dl", 3), ("dd", 4), ("dt", 4), ("dt", 2)],
    "<table><tr><td>a<td>b<tr><th>c<tbody><tr><td>d</table>": [("table", 1), ("tr", 2), ("td", 3), ("td", 3), ("tr", 2), ("th", 3), ("tbody", 2), ("tr", 3), ("td", 4)],
    "<li>a<div><li>b</div><li>c": [("li", 1), ("div", 2), ("li", 1), ("li", 1)],
}


def test_a_hot_text_is_one_row_of_the_sample(spark, monkeypatch):
    hot = spark.range(20_000).select(F.lit("the same line of text").alias("text"), F.lit("en").alias("lang"))
    others = spark.range(3000).select(F.concat(F.lit("mot "), F.col("id").cast("string"), F.lit(" une phrase")).alias("text"), F.lit("fr").alias("lang"))
    learnt = []
    plain = langid.hash_bound
    monkeypatch.setattr(langid, "hash_bound", lambda share: learnt.append(share) or plain(1.0))  # all hashes are below the bound
    sizes = []
    cut = langid.cut
    monkeypatch.setattr(langid, "cut", lambda df: cut(df))
    rows = hot.unionByName(others)
    real = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, n, *cols: sizes.append(self.count()) or real(self, n, *cols))
    model = langid.fit(rows, sample=100)
    assert sizes == [3001] and learnt and model.predict("une phrase")[0] == "fr"


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(4)], "text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        langid.fit(rows)


def test_results_outlive_runs(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = simhash_dedup(docs)
    kept = exact_dedup(docs)
    first = p.run(spark, sf)
    rows = first.count()
    second = p.run(spark, sf)
    assert held.count() == kept.count() == docs.count()
    assert first.count() == rows == second.count()
    shared.release(spark)
    root = shared.scratch_root(spark)
    assert not [x for x in os.listdir(root) if x.startswith("pipeline-")]
