"""Sources and sinks of lines."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.storage import new_path

#: Blocks of files whose first numbers may be broadcast.
BLOCKS = 200_000
#: Lines of an iterable that the driver holds at a time.
BLOCK = 100_000
#: What is stripped off both ends of a line.
STRIPPED = " \t\n\r\x0b\x0c"


def strip(line: Column | str) -> Column:
    return F.regexp_replace(line, "^[ \\t\\n\\r\\x0B\\f]+|[ \\t\\n\\r\\x0B\\f]+$", "")


def dense(df: DataFrame, name: str = "line_id") -> DataFrame:
    """``df`` with numbers from 0 in the order of its rows.

    A row's number is its place in its partition plus the sizes of the partitions before;
    only these sizes are gathered, so no partition is a bottleneck.
    """
    rows = df.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).collect()
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["__part"]):
        starts += [(r["__part"], before)]
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __before long")
    numbered = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__before")


def _numbered(spark: SparkSession, paths: str) -> DataFrame:
    """``(path, line_id, value)`` of text files: numbers from 0 in the order of the paths and of the lines in them, however Spark deals the files to tasks.

    A line's number is its place in its block of a file plus the sizes of the blocks before;
    what is gathered is a row for each block.
    """
    rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    blocks = rows.groupBy("path", "__block").agg(F.min("__at").alias("first"), F.count("*").alias("n")).collect()
    before, starts = 0, []
    for r in sorted(blocks, key=lambda r: (r["path"], r["__block"])):
        starts.append((r["path"], r["__block"], before - r["first"]))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "path string, __block long, __add long")
    if len(starts) <= BLOCKS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, ["path", "__block"]).select("path", (F.col("__at") + F.col("__add")).alias("line_id"), "value")


def read_lines(spark: SparkSession, path: str, stripped: bool = True) -> DataFrame:
    """``(line_id, line)`` of a text file or folder."""
    line = strip("value") if stripped else F.col("value")
    return _numbered(spark, path).select("line_id", line.alias("line"))


def from_strings(spark: SparkSession, lines: Iterable[str], block: int = BLOCK) -> DataFrame:
    """``(line_id, line)`` of an iterable, such as standard input: the driver holds ``block`` lines, and what is longer goes block by block to a table."""
    schema, rows, path = "line_id long, line string", enumerate(lines), None
    while own := list(itertools.islice(rows, block)):
        frame = spark.createDataFrame(own, schema)
        if path is None and len(own) < block:
            return frame
        path = path or new_path(spark, "lines")
        frame.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def log_name(path: Column | str) -> Column:
    """A log's name: its file name without suffix, up to ``_2k``."""
    return F.split(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "\\.[^.]*$", ""), "_2k")[0]


def read_logs(spark: SparkSession, paths: str) -> DataFrame:
    """``(log, line_id, line)`` of log files, not stripped; ids count through all of them."""
    return _numbered(spark, paths).select(log_name("path").alias("log"), "line_id", F.col("value").alias("line"))


def head(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines by id."""
    return lines.where(F.col("line_id") < n)


def template_parts(template: Column | str) -> Column:
    """The fixed parts of a template: what stands between wildcards (``<*>``) and quotes, stripped, if it has a letter."""
    parts = F.split(F.replace(template, F.lit('"'), F.lit("<*>")), "<\\*>", -1)
    return F.filter(F.transform(parts, strip), lambda p: p.rlike("[a-zA-Z]"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """``(template_id, parts)`` of a CSV file with a header, an id, and a template that may hold commas."""
    rows = _numbered(spark, path).where("line_id > 0")
    return rows.select((F.col("line_id") - 1).cast("int").alias("template_id"), template_parts(F.regexp_replace("value", "^[^,]*,?", "")).alias("parts"))


def result_json(clusters: DataFrame) -> str:
    """The cluster ids as a JSON array in the order of the lines; for results that one file is to hold."""
    return json.dumps([r["cluster_id"] for r in clusters.orderBy("line_id").select("cluster_id").toLocalIterator()])


def clusters_json(clusters: DataFrame) -> DataFrame:
    """``(json)``: ``result_json`` as a row."""
    rows = clusters.agg(F.array_sort(F.collect_list(F.struct("line_id", "cluster_id"))).alias("rows"))
    return rows.select(F.to_json(F.transform("rows", lambda r: r["cluster_id"])).alias("json"))


def write_clusters(clusters: DataFrame, path: str, kind: str = "parquet") -> None:
    """Clusters as a table of any size."""
    clusters.write.format(kind).save(path)
