"""Ordered grouping of rows by a relation of one's own between two rows, which need not be transitive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.operators.cluster import independent
from logweave.operators.storage import drop, new_path, settled, table, tasks

#: Undecided rows of a key that a round settles at first.
BLOCK = 32

Equal = Callable[[pd.DataFrame, pd.DataFrame], pd.Series]


def _equal_pairs(rows: DataFrame, firsts: DataFrame, columns: list[str], equal: Equal) -> DataFrame:
    """``(line_id, leader)``: of pairs with one key and the smaller id in ``firsts`` those that ``equal`` holds for, taken in batches."""
    theirs = firsts.select("__key", F.struct("line_id", *columns).alias("first"))
    pairs = rows.select("__key", F.struct("line_id", *columns).alias("own")).join(theirs, "__key").where("first.line_id < own.line_id")
    flat = pairs.select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("own", "first") for c in ("line_id", *columns)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, first = (b[[f"{side}_{c}" for c in columns]].set_axis(columns, axis=1) for side in ("own", "first"))
            held = equal(first, own).to_numpy(dtype=bool)
            yield pd.DataFrame({"line_id": b["own_line_id"].to_numpy()[held], "leader": b["first_line_id"].to_numpy()[held]})

    return flat.repartition(tasks(rows)).mapInPandas(run, "line_id long, leader long")


def group_by_relation(rows: DataFrame, equal: Equal, key: str | None = None, block: int = BLOCK) -> DataFrame:
    """``(line_id, group_id)``: one pass over ``rows(line_id, ...)`` in the order of ids, in which each row joins the earliest group whose first row it equals, else it begins one.

    ``equal`` gets two frames of as many rows, the columns of earlier rows and of later ones,
    and tells for each pair whether they are equal; it is asked about pairs with the same
    ``key`` only, and null keys are one key. It need not be transitive or symmetric. Ids must be distinct.

    A round takes the undecided rows up to the id at which some key has ``block`` of them,
    finds the first rows among them as an independent set, and compares all undecided rows
    with these. Those are the earliest undecided ones, so what a row meets first is its
    group. Blocks grow while most of their rows begin groups.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c != "line_id"]
    keyed = rows.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit(""))
    left, left_path = table(keyed)
    kinds = T.StructType([T.StructField("line_id", T.LongType()), T.StructField("group_id", T.LongType())])
    path = new_path(spark, "groups")
    spark.createDataFrame([], kinds).write.parquet(path)
    rank = F.row_number().over(Window.partitionBy("__key").orderBy("line_id"))
    while True:
        ranked = left.select("line_id", "__key").withColumn("rank", rank).where(F.col("rank") <= block)
        there, last = ranked.agg(F.count("*"), F.min(F.when(F.col("rank") == block, F.col("line_id")))).first()
        if not there:
            break
        own, own_path = table(left if last is None else left.where(F.col("line_id") <= last))
        inner, inner_path = table(_equal_pairs(own, own, columns, equal))
        chosen, chosen_path = independent(own, inner)
        firsts, firsts_path = table(own.join(chosen, "line_id", "left_semi"))
        met = _equal_pairs(left, firsts, columns, equal).groupBy("line_id").agg(F.min("leader").alias("group_id"))
        found, found_path = table(met.unionByName(firsts.select("line_id", F.col("line_id").alias("group_id"))))
        found.write.mode("append").parquet(path)
        if 2 * firsts.count() > own.count():
            block *= 4
        rest, rest_path = table(left.join(found, "line_id", "left_anti"))
        for done in (own_path, inner_path, chosen_path, firsts_path, found_path, left_path):
            drop(spark, done)
        left, left_path = rest, rest_path
    drop(spark, left_path)
    out = settled(spark.read.schema(kinds).parquet(path))
    drop(spark, path)
    return out
