"""Operators on DataFrames, and the queries against their SQL."""

import collections
import json
import os
import types

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logweave.cli import main
from logweave.functions.patterns import PatternSet
from logweave.functions.text import staircase
from logweave.operators import automaton, cluster, distance, evaluate, experiment, matching, render, storage
from logweave.plans.queries import queries
from logweave.plans.sql import oracle_sql
from logweave.sources import lines as sources
from logweave.streaming.leaders import StreamingClusters, cluster_stream

HEADERS = ["header_a header_b header_c", "hdr_a    hdr_b    hdr_c", "", "1.23     5.89     2.34", "1        4        7", "0.000000 1.111111 2.222222"]
FOUR = PatternSet.named(["int", "alnum", "word", "float"], handmade_any=True)


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")


def in_order(df, name="cluster_id"):
    return [r[name] for r in df.orderBy("line_id").collect()]


def test_cluster_golden(spark):
    assert in_order(cluster.cluster(frame(spark, HEADERS), FOUR, 0.3)) == [0, 0, 2, 3, 3, 3]
    assert cluster.sequential(HEADERS, FOUR, 0.3) == [0, 0, 2, 3, 3, 3]


@pytest.mark.parametrize("threshold", [0.02, 0.05, 0.6])
def test_cluster_is_sequential(spark, sf, threshold):
    own = queries_lines(spark, sf)
    texts = [r["line"] for r in own.orderBy("line_id").limit(70).collect()]
    texts = [*texts, "", None, texts[3], "é è", "é è", "", "x" * 40, texts[0]]
    want = cluster.sequential([t or "" for t in texts], PatternSet.default(), threshold)
    assert in_order(cluster.cluster(frame(spark, texts), threshold=threshold, block=7)) == want


def queries_lines(spark, sf):
    from logweave.plans.queries import ev_lines

    return ev_lines(spark, sf)


def test_cluster_preprocessed(spark):
    lines = ["a 1", "b 2", "", "c 3 x", "", "d 4"]
    patterns = PatternSet.default()
    rows = in_order(cluster.cluster_preprocessed(frame(spark, lines), patterns, 0.05))
    assert rows[0] == rows[1] == 0 and rows[2] == rows[4] == 2
    ranks = in_order(cluster.cluster_preprocessed(frame(spark, lines), patterns, 0.05, id_space="distinct"))
    assert max(ranks) <= max(rows) and ranks[2] == ranks[4]
    alone = cluster.cluster_preprocessed(frame(spark, lines), patterns, 0.05, same=lambda x: x.select("line_id", F.col("line_id").cast("string").alias("signature")))
    assert in_order(alone) == cluster.sequential(lines, patterns, 0.05)


def test_nearest_representative(spark):
    assert staircase([(3, 0.1), (1, 0.2), (2, 0.2), (5, 0.1)]) == [(1, 0.2), (3, 0.1)]
    rows = cluster.nearest_representative(frame(spark, ["a 1", "zzzz"]), [(7, "b 2"), (5, "a 1")], threshold=0.2).orderBy("line_id").collect()
    assert (rows[0]["leader"], rows[0]["d"]) == (5, 0.0)


def test_matching_operators(spark):
    own, patterns = frame(spark, ["1.2.3.4 5", "", None, "x"]), PatternSet.named(["ipv4", "uint", "word"])
    got = {r["name"]: r["texts"] for r in matching.as_map(own, matching.matches(own, patterns)).where("line_id = 0").collect()}
    assert got == {"ipv4": ["1.2.3.4"], "uint": ["1", "2", "3", "4", "5"], "word": ["1.2.3.4", "5"]}
    report = matching.as_string(own, matching.matches(own, patterns)).where("line_id = 3").first()["report"]
    assert report == "word : ['x']"
    odd = matching.matches(own, patterns, lambda line, name, dfa: [(name, 0, 1)])
    assert odd.count() == 6
    assert automaton.automata(own, patterns).where("n_arcs = 0").count() == 2


def test_distance_columns(spark):
    row = spark.createDataFrame([("abc", "axc", None)], "a string, b string, c string").select(
        distance.lcs_length(F.col("a"), F.col("b")).alias("n"), distance.lcs_distance(F.col("a"), F.col("b")).alias("d"), distance.lcs_distance(F.col("a"), F.col("c")).alias("none"), distance.pattern_distance(F.col("a"), F.col("c")).alias("p")
    ).first()
    assert (row["n"], row["d"], row["none"], row["p"]) == (2, 2, None, None)


def test_sources(spark, tmp_path):
    (tmp_path / "a_2k.log").write_text("  one \ntwo\t\n\nthree")
    assert [r["line"] for r in sources.read_lines(spark, str(tmp_path)).orderBy("line_id").collect()] == ["one", "two", "", "three"]
    rows = sources.read_logs(spark, f"{tmp_path}/*.log").orderBy("line_id").collect()
    assert [(r["log"], r["line_id"], r["line"]) for r in rows] == [("a", 0, "  one "), ("a", 1, "two\t"), ("a", 2, ""), ("a", 3, "three")]
    (tmp_path / "t.csv").write_text('EventId,EventTemplate\nE1,"jk2 <*> of, <*> workers"\nE2,<*>: 12 <*>\n')
    rows = sources.read_templates(spark, str(tmp_path / "t.csv")).orderBy("template_id").collect()
    assert [list(r["parts"]) for r in rows] == [["jk2", "of,", "workers"], []]
    for k, n in enumerate((3, 4000, 1, 700)):
        (tmp_path / f"part{k}.txt").write_text("\n".join(f"{k} {i}" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        lines = [r["line"] for r in sources.read_lines(spark, f"{tmp_path}/part*.txt").orderBy("line_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert lines == [f"{k} {i}" for k, n in enumerate((3, 4000, 1, 700)) for i in range(n)]
    big = sources.dense(spark.range(1000).repartition(7))
    assert sorted(r["line_id"] for r in big.collect()) == list(range(1000))


def test_template_rules(spark):
    templates = spark.createDataFrame([(0, ["a"]), (1, ["a", "b"]), (2, ["long word"]), (3, ["b", "a", "c"])], "template_id int, parts array<string>")
    lines = frame(spark, ["a", "a b", "c b a", "long word", "zzz", "b only a x long word", "", None])
    for most in (1 << 25, 0):
        got = {r["line_id"]: r["template_id"] for r in evaluate.template_match(lines, templates, strict=False, most=most).collect()}
        assert got == {0: 0, 1: 1, 2: 3, 3: 2, 4: None, 5: 2, 6: None, 7: None}
        free = templates.union(spark.createDataFrame([(9, []), (7, [""])], "template_id int, parts array<string>"))
        got = {r["line_id"]: r["template_id"] for r in evaluate.template_match(lines.where("line_id < 7"), free, most=most).collect()}
        assert got == {0: 0, 1: 1, 2: 3, 3: 2, 4: 7, 5: 2, 6: 7}
    with pytest.raises(Exception, match="no template"):
        evaluate.template_match(frame(spark, ["zzz"]), templates).collect()
    assert [r["line_id"] for r in evaluate.unmatched(frame(spark, ["a", "zzz"]), templates).collect()] == [1]


def test_metrics(spark):
    rows = spark.createDataFrame([(0, "a", "x"), (1, "a", "x"), (2, "b", "y"), (3, "b", "z"), (4, "c", None)], "line_id long, truth string, found string")
    assert evaluate.parsing_accuracy(rows).first()[0] == pytest.approx(0.4)
    same = rows.withColumn("found", F.col("truth"))
    assert evaluate.adjusted_rand_index(same).first()[0] == 1.0 and evaluate.parsing_accuracy(same).first()[0] == 1.0
    assert evaluate.adjusted_rand_index(rows).first()[0] == pytest.approx((1 - 0.2) / (1.5 - 0.2))


def test_unassigned_rows_are_no_empty_class(spark):
    rows = spark.createDataFrame([(0, "a", ""), (1, "a", ""), (2, "b", None), (3, "b", None)], "line_id long, truth string, found string")
    assert evaluate.adjusted_rand_index(rows).first()[0] == 1.0


def test_render(spark):
    own, found = frame(spark, ["a<b", "c", "d"]), spark.createDataFrame([(0, 5), (1, 3)], "line_id long, cluster_id long")
    html = render.clustered_html(own, found).first()["html"]
    blue, red = "hsl(180, 80%, 40%)", "hsl(0, 80%, 40%)"
    assert html == f"<font style='color:{red}'>Cluster 0</font>&nbsp;<font style='color:{blue}'>Cluster 1</font><pre><font style='color:{blue}'>  0</font>: a&lt;b<br/><font style='color:{red}'>  1</font>: c<br/>  2: d</pre>"
    assert render.lines_html(own, escape=False, skip=F.col("line_id") == 1).first()["html"] == "<pre>  0: a<b<br/>  2: d</pre>"


def test_stream_equals_batch(spark, tmp_path):
    own = ["a 1", "b 2", "", "x.y.z", "c 3", "1.2.3.4 5", "", "9.9.9.9 8", "x.y.q", "a 1"]
    for k in range(0, 10, 4):
        frame(spark, own).where(f"line_id >= {k} AND line_id < {k + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line_id long, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = cluster_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress"), threshold=0.05)
    query.awaitTermination()
    assert in_order(StreamingClusters(str(tmp_path / "out")).clusters(spark)) == in_order(cluster.cluster(frame(spark, own), threshold=0.05))


def test_cluster_command(spark, tmp_path):
    (tmp_path / "in.txt").write_text("\n".join(["a 1", "b 2", "1.2.3.4"]))
    main(["cluster", "-i", str(tmp_path / "in.txt"), "-o", str(tmp_path / "out.json"), "-t", "0.05"])
    assert len(json.loads((tmp_path / "out.json").read_text())) == 3
    main(["cluster", "-p", "-H", "-i", str(tmp_path / "in.txt"), "-o", str(tmp_path / "out.html")])
    assert (tmp_path / "out.html").read_text().startswith("<html><body><font")
    main(["cluster", "--with-preprocessing", "--html-file", str(tmp_path / "beside.html"), "--input-file", str(tmp_path / "in.txt"), "--output-file", str(tmp_path / "beside.json")])
    assert (tmp_path / "beside.html").read_text() == (tmp_path / "out.html").read_text().replace("\n", "") and len(json.loads((tmp_path / "beside.json").read_text())) == 3


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def views(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, views, name):
    got = queries()[name](spark, sf)
    if name not in oracle_sql():
        assert got.count() > 0
        return
    want = views.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)


@pytest.fixture(scope="module")
def few_events(sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("few"))
    duckdb.connect().execute(f"COPY (SELECT * FROM '{sf}/events.parquet' WHERE event_id < 30) TO '{path}/events.parquet'")
    return path


def test_queries_without_sql(spark, few_events):
    from logweave.functions import text
    from logweave.plans.queries import ev_lines

    lines, default = ev_lines(spark, few_events), PatternSet.default()
    own = {r["line_id"]: r["line"] for r in lines.collect()}
    want = {i: round(text.cheapest_path(text.automaton(line, default), default.densities())[0], 9) for i, line in own.items()}
    assert {r["line_id"]: r["cost"] for r in queries()["cheapest_path"](spark, few_events).collect()} == want
    got = {r["line_id"]: r["cluster_id"] for r in queries()["stream_leader"](spark, few_events).collect()}
    assert got == {r["line_id"]: r["cluster_id"] for r in cluster.cluster(lines, threshold=0.05).collect()}
    in_turn = cluster.sequential([own[i] for i in sorted(own)], default, 0.03)
    assert in_order(queries()["cluster_leader"](spark, few_events)) == in_turn
    assert {r["cluster_id"]: r["n"] for r in queries()["cluster_sizes"](spark, few_events).collect()} == dict(collections.Counter(in_turn))
    graphs = {i: text.automaton(line, default) for i, line in own.items()}
    firsts = {}
    for i in sorted(own):
        firsts.setdefault(graphs[i].signature, i)
    alone = sorted(firsts.values())
    named = dict(zip(alone, (alone[k] for k in cluster.sequential([own[i] for i in alone], default, 0.03))))
    assert {r["line_id"]: r["cluster_id"] for r in queries()["cluster_preprocessed"](spark, few_events).collect()} == {i: named[firsts[g.signature]] for i, g in graphs.items()}
    kinds = {}
    for r in spark.read.parquet(f"{few_events}/events.parquet").orderBy("event_id").collect():
        kinds.setdefault(r["event_type"], r["event_id"])
    for r in queries()["nearest_representative"](spark, few_events).collect():
        found = [(text.normalised_distance(graphs[k], graphs[r["line_id"]], default.densities(), 0.3), k) for k in kinds.values()]
        d, leader = min((x for x in found if x[0] is not None), default=(None, None))
        assert (r["leader"], r["d"]) == (leader, d if d is None else round(d, 9))


def test_render_hooks(spark):
    own, found = frame(spark, ["a", "b"]), spark.createDataFrame([(0, 5), (1, 3)], "line_id long, cluster_id long")
    names = spark.createDataFrame([(5, "five")], "cluster_id long, name string")
    html = render.clustered_html(own, found, row_to_html=lambda i, line: F.concat(F.lit("#"), i.cast("string")), line_to_html=lambda i, line: F.upper(line), names=names).first()["html"]
    assert ">Cluster 0</font>" in html and ">five</font>" in html and html.endswith("<pre>#0: A<br/>#1: B</pre>")
    assert render.lines_html(own, line_to_html=lambda i, line: F.concat(line, F.lit("!"))).first()["html"] == "<pre>a!<br/>b!</pre>"


def test_experiment(spark, tmp_path):
    for log, kinds in (("Apache", ["run 1", "run 22", "stop"]), ("Zoo", ["x 1", "x 2"])):
        (tmp_path / log).mkdir()
        (tmp_path / log / f"{log}_2k.log").write_text("\n".join(kinds))
        (tmp_path / log / f"{log}_2k.log_templates.csv").write_text("EventId,EventTemplate\nE1,run <*>\nE2,stop\nE3,x <*>\n")
    logs, templates = experiment.load_data(spark, str(tmp_path))
    assert {(r["log"], r["n"]) for r in logs.groupBy("log").agg(F.count("*").alias("n")).collect()} == {("Apache", 3), ("Zoo", 2)}
    assert {(r["log"], r["template_id"], tuple(r["parts"])) for r in templates.collect()} == {(x, i, (p,)) for x in ("Apache", "Zoo") for i, p in enumerate(["run", "stop", "x"])}
    found = experiment.grid(logs, templates, [0.05, 0.6])
    assert found.count() == 2 * 2 * 4
    best = {r["log"]: r["value"] for r in evaluate.best_with_time(found, "parsing accuracy").collect()}
    assert best == {"Apache": 1.0, "Zoo": 1.0}
    experiment.write_results(found, str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results")).count() == 16
    (tmp_path / "Zoo" / "Zoo_2k.log").write_text("unknown")
    with pytest.raises(ValueError, match="no template of Zoo"):
        experiment.load_data(spark, str(tmp_path))
    html = experiment.demo(spark, str(tmp_path / "Apache" / "Apache_2k.log"), 2, threshold=0.05).first()["html"]
    assert "run 22" in html and "stop" not in html


def test_release_empties_the_shared_folder(spark, sf):
    root = storage.scratch_root(spark)
    os.makedirs(root, exist_ok=True)
    storage.release(spark)
    before = set(os.listdir(root))
    for name in ("cluster_suppliers", "automaton_signature_groups", "row_html", "stream_leader"):
        queries()[name](spark, sf).count()
    assert set(os.listdir(root)) - before
    storage.release(spark)
    assert set(os.listdir(root)) == before


def test_no_machine_local_folder_on_a_cluster():
    far = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default: None), sparkContext=types.SimpleNamespace(master="spark://far:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.scratch_root(far)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
