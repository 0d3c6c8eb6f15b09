"""Experiments: logs with templates, clusterings over a grid of thresholds judged against them, and a demonstration."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.patterns import DEFAULT_THRESHOLD, PatternSet
from logweave.operators.cluster import cluster, cluster_preprocessed
from logweave.operators.evaluate import adjusted_rand_index, parsing_accuracy, template_match, unmatched
from logweave.operators.render import clustered_html
from logweave.operators.storage import settled
from logweave.sources.lines import head, read_lines, read_logs, template_parts

RESULT = "algo string, log string, max_dist double, run long, metric string, value double"


def read_log_templates(spark: SparkSession, paths: str) -> DataFrame:
    """``(log, template_id, parts)`` of CSV files with a header, one for each log; ids count from 0 in the order of a file's rows."""
    rows = read_logs(spark, paths).withColumn("first", F.min("line_id").over(Window.partitionBy("log"))).where("line_id > first")
    return rows.select("log", (F.col("line_id") - F.col("first") - 1).cast("int").alias("template_id"), template_parts(F.regexp_replace("line", "^[^,]*,?", "")).alias("parts"))


def load_data(spark: SparkSession, folder: str, modified: bool = False) -> tuple[DataFrame, DataFrame]:
    """Logs ``(log, line_id, line)`` of ``folder/*/*.log`` and their templates ``(log, template_id, parts)`` from the CSV files beside them.

    A line that no template of its log fits raises an error; an empty folder is an error of
    the reader; a log without lines has none to check.
    """
    logs = settled(read_logs(spark, f"{folder}/*/*.log"))
    templates = settled(read_log_templates(spark, f"{folder}/*/*_templates{'_modified' * modified}.csv"))
    for r in logs.select("log").distinct().orderBy("log").collect():
        own = F.col("log") == r["log"]
        missing = unmatched(logs.where(own).select("line_id", "line"), templates.where(own).select("template_id", "parts")).first()
        if missing is not None:
            raise ValueError(f"no template of {r['log']} for line: {missing['line']}")
    return logs, templates


def evaluated(lines: DataFrame, templates: DataFrame, patterns: PatternSet | None = None, threshold: float = DEFAULT_THRESHOLD, preprocessed: bool = False) -> DataFrame:
    """``(metric, value)`` of one clustering: parsing accuracy, adjusted rand index, number of clusters, and the seconds that it took."""
    began = time.time()
    found = settled((cluster_preprocessed if preprocessed else cluster)(lines, patterns, threshold))
    took = time.time() - began
    rows = found.join(template_match(lines, templates), "line_id").select(F.col("template_id").alias("truth"), F.col("cluster_id").alias("found"))
    row = parsing_accuracy(rows).crossJoin(adjusted_rand_index(rows)).crossJoin(found.agg(F.countDistinct("cluster_id").cast("double").alias("clusters")))
    values = {"parsing accuracy": "parsing_accuracy", "adjusted rand index": "adjusted_rand_index", "clusters": "clusters"}
    metrics = F.create_map(*[x for name, column in values.items() for x in (F.lit(name), F.col(column))], F.lit("time"), F.lit(took))
    return row.select(F.explode(metrics).alias("metric", "value"))


def grid(logs: DataFrame, templates: DataFrame, thresholds: Iterable[float], collections: Mapping[str, PatternSet] | None = None, algo: str = "PC", preprocessed: bool = False) -> DataFrame:
    """``(algo, log, max_dist, run, metric, value)``: ``evaluated`` for each log and threshold, in the form that ``best_with_time`` takes.

    ``collections`` has the patterns of a log, the default ones where it has none. Each
    clustering is a job over the whole log; the driver goes through logs and thresholds.
    """
    out = logs.sparkSession.createDataFrame([], RESULT)
    for r in logs.select("log").distinct().orderBy("log").collect():
        own = F.col("log") == r["log"]
        lines, kinds = logs.where(own).select("line_id", "line"), templates.where(own).select("template_id", "parts")
        for run, threshold in enumerate(thresholds):
            found = evaluated(lines, kinds, (collections or {}).get(r["log"]), threshold, preprocessed)
            named = [F.lit(algo).alias("algo"), F.lit(r["log"]).alias("log"), F.lit(float(threshold)).alias("max_dist"), F.lit(run).cast("long").alias("run")]
            out = out.unionByName(found.select(*named, "metric", "value"))
    return out


def runtimes(lines: DataFrame, sizes: Iterable[int], patterns: PatternSet | None = None, threshold: float = DEFAULT_THRESHOLD, preprocessed: bool = False) -> DataFrame:
    """``(lines, seconds, clusters)``: how long the clustering of the first so many lines takes, a job for each size."""
    spark, own, rows = lines.sparkSession, settled(lines), []
    for n in sizes:
        began = time.time()
        found = settled((cluster_preprocessed if preprocessed else cluster)(head(own, n), patterns, threshold))
        rows.append((n, time.time() - began, found.select("cluster_id").distinct().count()))
    return spark.createDataFrame(rows, "lines long, seconds double, clusters long")


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    results.write.json(path)


def demo(spark: SparkSession, path: str, max_lines: int | None = None, patterns: PatternSet | None = None, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``(html)``: the clustered lines of a text file, or of its first ``max_lines``."""
    lines = settled(read_lines(spark, path))
    lines = lines if max_lines is None else head(lines, max_lines)
    return clustered_html(lines, settled(cluster(lines, patterns, threshold)))
