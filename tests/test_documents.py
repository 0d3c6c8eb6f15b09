"""Documents in parts, and lines from an iterable of any size."""

import glob
import io
import json

from logweave.operators import render
from logweave.sources import documents
from logweave.sources import lines as sources


def tables(spark, n=300):
    lines = spark.createDataFrame([(i, f"line <{i}>" if i % 7 else "") for i in range(n)], "line_id long, line string").repartition(4)
    return lines, spark.createDataFrame([(i, i // 3 * 3) for i in range(n)], "line_id long, cluster_id long").repartition(3)


def test_parts_joined_are_the_document(spark, tmp_path):
    lines, clusters = tables(spark)
    html = render.html_of(lines, clusters, head="<html><body>", tail="</body></html>")
    whole = "<html><body>" + render.clustered_html(lines, clusters).first()["html"] + "</body></html>"
    for name, sections, want in (("html", html, whole), ("json", documents.json_of(clusters), sources.result_json(clusters))):
        path = str(tmp_path / name)
        documents.write_document(sections, path, parts=5)
        assert "".join(documents.read_document(spark, path, [s.join for s in sections])) == want
        assert len(glob.glob(f"{path}/0000-1-body/part-*")) == 5
        out = io.StringIO()
        documents.stream_document(sections, out)
        assert out.getvalue() == want
    assert "<pre>" in "".join(documents.pieces_of(render.html_of(lines, clusters, show_caption=False))).split("Cluster")[0]


def test_empty_documents(spark, tmp_path):
    lines, clusters = tables(spark, 0)
    assert "".join(documents.pieces_of(documents.json_of(clusters))) == "[]"
    documents.write_document(documents.json_of(clusters), str(tmp_path / "none"), 2)
    assert json.loads("".join(documents.read_document(spark, str(tmp_path / "none"), [", "]))) == []
    assert "".join(documents.pieces_of(render.html_of(lines, clusters))) == "<pre></pre>"


def test_ranks_of_many_values(spark):
    values = spark.range(1000).selectExpr("(id * 37) % 501 AS v").repartition(6)
    rows = render.values_to_colors(values, "v").orderBy("v").collect()
    assert [(r["v"], r["i"]) for r in rows] == [(i, i) for i in range(501)]


def test_lines_of_an_iterable(spark):
    for n in (0, 1, 9, 10, 25):
        got = sources.from_strings(spark, (f"l{i}" for i in range(n)), block=10).orderBy("line_id").collect()
        assert [(r["line_id"], r["line"]) for r in got] == [(i, f"l{i}") for i in range(n)]
