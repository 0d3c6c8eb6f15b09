"""Queries of the library's own operators over whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.patterns import PatternSet, density_vector, language_density
from logweave.operators import automaton, cluster, distance, evaluate, experiment, grouping, matching, render
from logweave.operators.storage import new_path, settled, tasks
from logweave.plans.table_functions import grep
from logweave.sources import lines as sources
from logweave.streaming.leaders import StreamingClusters, cluster_stream


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Lines dealt out for work that takes long on few bytes."""
    return df.repartition(tasks(df))


def _ev_line() -> Column:
    return F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("user="), F.col("user_id")), "event_type", F.format_string("%.2f", "value"), "props")


def ev_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a line of a log."""
    return _spread(_read(spark, d, "events").select(F.col("event_id").alias("line_id"), _ev_line().alias("line")))


def part_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every part as a line."""
    line = F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_size", F.format_string("%.2f", "p_retailprice"))
    return _spread(_read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("line_id"), line.alias("line")))


def supplier_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier as a line; few enough that SQL can compare all of them."""
    line = F.concat_ws(" ", "s_name", "s_nationkey", F.format_string("%.2f", "s_acctbal"))
    return _read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("line_id"), line.alias("line"))


def lines_scan(spark, d):
    docs = _read(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))


def lines_strip(spark, d):
    return lines_scan(spark, d).select("doc_id", "place", sources.strip("line").alias("line"))


def lines_dense(spark, d):
    numbered = sources.dense(_read(spark, d, "events").select("event_id"))
    return numbered.agg(F.count("*").alias("n"), F.countDistinct("line_id").alias("ids"), F.min("line_id").alias("first"), F.max("line_id").alias("last"))


def lines_head(spark, d):
    return sources.head(ev_lines(spark, d), 1000)


def log_names(spark, d):
    return _read(spark, d, "pages").select("page_id", sources.log_name("url").alias("log"))


def template_parts(spark, d):
    return _read(spark, d, "pages").select("page_id", F.array_join(sources.template_parts("html"), "|").alias("parts"))


def _event_types(spark, d) -> list[str]:
    return sorted(r["event_type"] for r in _read(spark, d, "events").select("event_type").distinct().collect())


def _with_event_types(spark, d, patterns: PatternSet) -> PatternSet:
    """A collection for this table's lines: a word of its own for each type of event."""
    return patterns.with_patterns({f"is_{t}": t for t in _event_types(spark, d)})


def pattern_collection(spark, d):
    merged = _with_event_types(spark, d, PatternSet.default()).with_patterns({"small_letters": "[a-z]+", "uint": "[0-9]{1,9}"})
    return spark.createDataFrame(list(merged.regexes), "name string, regex string")


def mkconf(spark, d):
    config = _with_event_types(spark, d, PatternSet.full()).to_json()
    return spark.createDataFrame([(config,)], "config string").select(F.from_json("config", "threshold double, patterns map<string,string>").alias("c")).select("c.threshold", F.explode("c.patterns").alias("name", "regex"))


def pattern_accepts(spark, d):
    words = ev_lines(spark, d).select(F.explode(F.split("line", " ")).alias("word")).distinct()
    return matching.accepted(words, PatternSet.full()).select("word", F.array_join("accepted", ",").alias("names"))


def density_runs(spark, d):
    letters = {f"letters_of_{t}": f"[{''.join(sorted(set(t)))}]+" for t in _event_types(spark, d)}
    found = [(n, round(language_density(dfa), 9)) for n, dfa in PatternSet.full().with_patterns(letters).dfas().items() if dfa.run_of]
    return spark.createDataFrame(found, "name string, density double")


def density_all(spark, d):
    found = [(n, round(x, 9), round(math.log10(x), 9)) for n, x in sorted(_with_event_types(spark, d, PatternSet.full()).densities().items())]
    return spark.createDataFrame(found, "name string, density double, magnitude double")


def density_order(spark, d):
    own = density_vector(_with_event_types(spark, d, PatternSet.default()).densities())
    return spark.createDataFrame([(i, round(x, 9)) for i, x in enumerate(own)], "place int, density double")


def match_all(spark, d):
    return matching.matches(part_lines(spark, d), PatternSet.default(), "all")


def match_largest(spark, d):
    return matching.matches(ev_lines(spark, d), PatternSet.default(), "largest")


def match_reduced(spark, d):
    return matching.reduced(match_all(spark, d), "largest")


def match_greedy(spark, d):
    return matching.matches(ev_lines(spark, d), PatternSet.default(), "greedy")


def match_delimited(spark, d):
    return matching.delimited_matches(ev_lines(spark, d), PatternSet.default(), ["spaces"], strategy="all")


def match_table_function(spark, d):
    return grep(part_lines(spark, d), PatternSet.default())


def match_dict(spark, d):
    return matching.matched_texts(ev_lines(spark, d), PatternSet.default()).select("line_id", "name", F.array_join("texts", "|").alias("texts"))


def match_string(spark, d):
    return matching.reports(ev_lines(spark, d), PatternSet.named(["float", "spaces", "word"]))


def automaton_arcs(spark, d):
    return automaton.arcs(ev_lines(spark, d), PatternSet.default()).drop("infix")


def automaton_infix(spark, d):
    return automaton.arcs(ev_lines(spark, d), PatternSet.default())


def automaton_filtered(spark, d):
    return automaton.arcs(ev_lines(spark, d), PatternSet.default(), filtered=["spaces", "hexa"]).drop("infix")


def automaton_delta(spark, d):
    names = F.explode(F.array(*[F.lit(n) for n in PatternSet.default().names])).alias("name")
    asked = ev_lines(spark, d).select("line_id", "line", names).withColumn("src", F.locate("user=", "line") - 1)
    found = asked.select("line_id", "name", "src", automaton.delta("line", "src", "name", PatternSet.default()).alias("dst"))
    return found.where("dst IS NOT NULL")


def automaton_counts(spark, d):
    return automaton.automata(ev_lines(spark, d), PatternSet.default()).select("line_id", "n_vertices", "n_arcs")


def automaton_signature_groups(spark, d):
    return automaton.signature_groups(ev_lines(spark, d), PatternSet.default())


def automaton_similar_groups(spark, d):
    sizes = automaton.automata(part_lines(spark, d), PatternSet.default()).select("line_id", "n_vertices", "n_arcs")
    brands = _read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("line_id"), "p_brand")
    near = lambda a, b: ((a["n_vertices"] - b["n_vertices"]).abs() <= 1) & ((a["n_arcs"] - b["n_arcs"]).abs() <= 2)
    return grouping.group_by_relation(sizes.join(brands, "line_id"), near, "p_brand")


def automaton_slices(spark, d):
    return automaton.slices(ev_lines(spark, d), PatternSet.default())


def cheapest_path(spark, d):
    found = automaton.paths(ev_lines(spark, d), PatternSet.default())
    return found.select("line_id", F.round("cost", 9).alias("cost"), "path")


def _line_pairs(own: DataFrame) -> DataFrame:
    """Each line and the next."""
    after = own.select((F.col("line_id") - 1).alias("line_id"), F.col("line").alias("next"))
    return _spread(own.join(after, "line_id"))


def lcs(spark, d):
    pairs = _line_pairs(ev_lines(spark, d))
    return pairs.select("line_id", distance.lcs_length(F.col("line"), F.col("next")).alias("lcs_length"), distance.lcs_distance(F.col("line"), F.col("next")).alias("lcs_distance"))


def pattern_distance(spark, d):
    return _line_pairs(supplier_lines(spark, d)).select("line_id", F.round(distance.pattern_distance(F.col("line"), F.col("next")), 9).alias("d"))


def pattern_distance_normalized(spark, d):
    found = _line_pairs(ev_lines(spark, d)).select("line_id", distance.pattern_distance(F.col("line"), F.col("next"), normalized=True).alias("whole"))
    return found.select("line_id", F.round("whole", 9).alias("d"), F.when(F.col("whole") < 0.05, F.round("whole", 9)).alias("d_below"))


def pattern_distance_cutoff(spark, d):
    near = distance.pattern_distance(F.col("line"), F.col("next"), normalized=True, limit=0.05)
    return _line_pairs(ev_lines(spark, d)).select("line_id", F.round(near, 9).alias("d"))


def nearest_representative(spark, d):
    own = ev_lines(spark, d)
    kinds = _read(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("line_id"))
    return cluster.nearest_representative(own, own.join(kinds, "line_id", "left_semi"), threshold=0.3).select("line_id", "leader", F.round("d", 9).alias("d"))


def nearest_supplier(spark, d):
    own = supplier_lines(spark, d)
    firsts = _read(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("line_id"))
    return cluster.nearest_representative(own, own.join(firsts, "line_id", "left_semi"), threshold=0.009).select("line_id", "leader", F.round("d", 9).alias("d"))


def cluster_leader(spark, d):
    return cluster.cluster(ev_lines(spark, d), threshold=0.03)


def cluster_sizes(spark, d):
    return cluster_leader(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n"))


def cluster_preprocessed(spark, d):
    return cluster.cluster_preprocessed(ev_lines(spark, d), threshold=0.03)


def cluster_suppliers(spark, d):
    return cluster.cluster(supplier_lines(spark, d), threshold=0.009)


def cluster_suppliers_preprocessed(spark, d):
    return cluster.cluster_preprocessed(supplier_lines(spark, d), threshold=0.009)


def _templates(spark, d):
    kinds = sources.dense(settled(_read(spark, d, "events").select("event_type").distinct().orderBy("event_type")), "template_id")
    return kinds.select(F.col("template_id").cast("int").alias("template_id"), F.array(F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))).alias("parts"))


def template_match(spark, d):
    return evaluate.template_match(ev_lines(spark, d), _templates(spark, d))


def template_groups(spark, d):
    return evaluate.groups(template_match(spark, d), "template_id").select("template_id", F.array_join(F.transform("line_ids", lambda x: x.cast("string")), ",").alias("line_ids"))


def template_integrity(spark, d):
    return evaluate.unmatched(ev_lines(spark, d), _templates(spark, d).where("template_id > 0"))


def line_self_match(spark, d):
    own = ev_lines(spark, d)
    return evaluate.line_indices(own, own)


def _judged(spark, d):
    found = F.when(F.col("value") < 40, F.concat_ws("/", F.floor(F.col("value") / 10), F.when(F.col("event_type") == "view", "v")))
    return _read(spark, d, "events").select(F.col("event_id").alias("line_id"), F.concat_ws("/", "event_type", F.when(F.col("value") < 20, F.floor(F.col("value") / 10))).alias("truth"), found.alias("found"))


def parsing_accuracy(spark, d):
    rows = _judged(spark, d).withColumn("found", F.when(F.col("truth").startswith("view"), F.col("truth")).otherwise(F.col("found")))
    return evaluate.parsing_accuracy(rows).select(F.round("parsing_accuracy", 9).alias("parsing_accuracy"))


def adjusted_rand_index(spark, d):
    return evaluate.adjusted_rand_index(_judged(spark, d)).select(F.round("adjusted_rand_index", 9).alias("adjusted_rand_index"))


def evaluation_grid(spark, d):
    own = settled(supplier_lines(spark, d).withColumn("log", F.lit("suppliers")))
    kinds = _read(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("template_id")).distinct()
    kinds = kinds.select("template_id", F.array(F.concat(F.lit(" "), F.col("template_id"), F.lit(" "))).alias("parts"), F.lit("suppliers").alias("log"))
    return experiment.grid(own, kinds, [0.004, 0.009]).where("metric != 'time'").select("max_dist", "metric", F.round("value", 9).alias("value"))


def _results(spark, d):
    runs = _read(spark, d, "events").groupBy(F.col("event_type").alias("algo"), F.concat(F.lit("log"), F.col("user_id") % 10).alias("log"), F.col("user_id").alias("run"))
    runs = runs.agg(F.max("value").alias("ari"), F.count("*").cast("double").alias("time"))
    return runs.select("algo", "log", "run", F.explode(F.create_map(F.lit("adjusted rand index"), F.col("ari"), F.lit("time"), F.col("time"))).alias("metric", "value"))


def best_param(spark, d):
    return evaluate.best_with_time(_results(spark, d), "adjusted rand index")


def metric_projection(spark, d):
    return evaluate.project_metric(_results(spark, d), "time")


def log_order(spark, d):
    return evaluate.log_order(_results(spark, d), "view", "adjusted rand index")


def html_colors(spark, d):
    return render.html_colors(_read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))).select("s_nationkey", "i", "color")


def values_to_colors(spark, d):
    return render.values_to_colors(_read(spark, d, "events"), "user_id")


def row_html(spark, d):
    return render.row_html(settled(cluster_suppliers(spark, d)))


def clustered_rows(spark, d):
    return render.clustered_rows(supplier_lines(spark, d), settled(cluster_suppliers(spark, d)))


def lines_html(spark, d):
    return render.lines_html(supplier_lines(spark, d), skip=F.col("line_id") == 3)


def clustered_html(spark, d):
    return render.clustered_html(supplier_lines(spark, d), settled(cluster_suppliers(spark, d)))


def result_json(spark, d):
    return sources.clusters_json(cluster_suppliers(spark, d))


def stream_leader(spark, d):
    root = new_path(spark, "stream")
    schema = _read(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    query = cluster_stream(rows.select(F.col("event_id").alias("line_id"), _ev_line().alias("line")), root, f"{root}/progress", threshold=0.05)
    query.awaitTermination()
    return StreamingClusters(root).clusters(spark)


_ALL = (
    lines_scan, lines_strip, lines_dense, lines_head, log_names, template_parts, pattern_collection, mkconf, pattern_accepts, density_runs, density_all, density_order,
    match_all, match_largest, match_reduced, match_greedy, match_delimited, match_table_function, match_dict, match_string, automaton_arcs, automaton_infix, automaton_filtered, automaton_delta, automaton_counts,
    automaton_signature_groups, automaton_similar_groups, automaton_slices, cheapest_path, lcs, pattern_distance, pattern_distance_normalized, pattern_distance_cutoff, nearest_representative, nearest_supplier,
    cluster_leader, cluster_sizes, cluster_preprocessed, cluster_suppliers, cluster_suppliers_preprocessed,
    template_match, template_groups, template_integrity, line_self_match, parsing_accuracy, adjusted_rand_index, evaluation_grid, best_param, metric_projection, log_order, html_colors,
    values_to_colors, row_html, clustered_rows, lines_html, clustered_html, result_json, stream_leader,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
