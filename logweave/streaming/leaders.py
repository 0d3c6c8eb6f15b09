"""Leader clustering of a stream of lines, a micro-batch at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.patterns import DEFAULT_THRESHOLD, PatternSet
from logweave.operators.cluster import closest, few, find_leaders, nearest_leaders, prepared
from logweave.operators.storage import drop, table
from logweave.sources.lines import dense


class StreamingClusters:
    """For ``foreachBatch``: assigns lines to leaders of this and earlier batches, and keeps both as tables.

    State is the table of leaders under ``path``, which the driver never holds; it has one
    folder for each batch, so a batch that is done again after a failure replaces its own. Lines are taken in the order of
    their ids within a batch, and batches in their order: the result over all batches is
    that of one pass over the lines in that order.
    """

    def __init__(self, path: str, patterns: PatternSet | None = None, threshold: float = DEFAULT_THRESHOLD):
        self.path, self.patterns, self.threshold = path, patterns or PatternSet.default(), threshold

    def leaders(self, spark: SparkSession, upto: int) -> DataFrame:
        """``(leader, line_id, line)`` of the batches up to a number; ``leader`` counts them in the order of their making."""
        rows = spark.read.schema("leader long, line_id long, line string, batch long").option("recursiveFileLookup", "true").parquet(f"{self.path}/leaders")
        return rows.where(F.col("batch") <= upto).select("leader", "line_id", "line")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        lines, lines_path = table(batch.select("line_id", F.coalesce("line", F.lit("")).alias("line")))
        left = lines
        if number:
            before = self.leaders(spark, number - 1).select("leader", "line")
            if (some := few(before)) is not None:
                left = lines.join(closest(lines, some, self.patterns, self.threshold).where("leader IS NULL").select("line_id"), "line_id", "left_semi")
            else:
                known = nearest_leaders(lines, before, self.patterns, self.threshold)
                left = lines.join(known.select("line"), "line", "left_anti")
        own, own_path = prepared(left, self.patterns)
        new, _, paths = find_leaders(own, self.patterns, self.threshold)
        # a batch's leaders have the numbers from batch * 2**40 on, in the order of their ids
        made = dense(new.orderBy("line_id"), "place").select((F.col("place") + (number << 40)).alias("leader"), "line_id", "line", F.lit(number).cast("long").alias("batch"))
        made.write.mode("overwrite").parquet(f"{self.path}/leaders/part-batch-{number}")
        for done in (own_path, *paths):
            drop(spark, done)
        leaders = self.leaders(spark, number)
        names = leaders.select("leader", F.col("line_id").alias("cluster_id"))
        if (some := few(leaders.select("leader", "line"))) is not None:
            numbered = sorted((r["leader"], r["cluster_id"]) for r in names.where(F.col("leader") >= number << 40).join(spark.createDataFrame(some, "leader long, line string"), "leader", "left_semi").collect())
            ids, numbers = np.array([i for _, i in numbered], np.int64), np.array([*(n for n, _ in numbered), np.iinfo(np.int64).max])
            # the leaders of this batch are open to lines with larger ids, and are numbered in the order of theirs
            best = closest(lines, some, self.patterns, self.threshold, until=lambda own: numbers[np.searchsorted(ids, own)])
            out = best.join(F.broadcast(names), "leader", "left").select("line_id", F.coalesce("cluster_id", "line_id").alias("cluster_id"))
            out.write.mode("overwrite").parquet(f"{self.path}/clusters/part-batch-{number}")
            drop(spark, lines_path)
            return
        found = nearest_leaders(lines, leaders.select("leader", "line"), self.patterns, self.threshold)
        steps = lines.join(found.select("line", F.explode("stairs").alias("s")), "line").select("line_id", F.col("s.leader").alias("leader"), F.col("s.d").alias("d"))
        steps = steps.join(names, "leader").where((F.col("leader") < number << 40) | (F.col("cluster_id") < F.col("line_id")))
        best = steps.groupBy("line_id").agg(F.min_by("cluster_id", F.struct("d", "leader")).alias("cluster_id"))
        out = lines.join(best, "line_id", "left").select("line_id", F.coalesce("cluster_id", "line_id").alias("cluster_id"))
        out.write.mode("overwrite").parquet(f"{self.path}/clusters/part-batch-{number}")
        drop(spark, lines_path)

    def clusters(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("line_id long, cluster_id long").option("recursiveFileLookup", "true").parquet(f"{self.path}/clusters")


def cluster_stream(lines: DataFrame, path: str, checkpoint: str, patterns: PatternSet | None = None, threshold: float = DEFAULT_THRESHOLD):
    """Starts clustering of a streaming ``lines(line_id, line)``; takes what is available, then ends."""
    return lines.writeStream.foreachBatch(StreamingClusters(path, patterns, threshold)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

