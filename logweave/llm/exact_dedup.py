"""Exact dedup by progressive refinement, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import cut, if_small, rebalanced

#: Characters that normalisation deletes: space, and tab to carriage return.
BLANK = "[\\x20\\x09-\\x0D]+"
#: Characters of the normalised text that the prefix hash covers.
PREFIX = 64


def normalised(text: Column | str) -> Column:
    """The text without blanks; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, hash_col: str | None = None) -> DataFrame:
    """Every row of ``df`` with ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when they are identical without blanks; null counts as empty, and all
    empty texts form a group. Of a group the row with the most code points in its original
    text stays, then the smallest id, a null id last. Rows that tie in both (repeated rows)
    leave one, any of them. Rows are counted as they come, repeated ids too. An empty table
    gives an empty result. Columns of ``df`` named as a new column are replaced by it; any
    other column is carried along (own working columns start with ``__d_``).

    Ids are numbers other than the least of their type, which has no negative.

    Refinement: the first pass counts lengths; the second hashes a prefix of the texts whose
    length occurs more than once; the third hashes whole texts only where length and prefix
    hash occur more than once. Groups are met by joins with pre-aggregated counts, which
    are broadcast if few, so a hot group is never gathered: adaptive execution splits it.

    ``hash_col`` names a column of ``df`` that has a full hash of the normalised text already;
    it is then not made again, and where ``text_col`` is not read from the result, joins move
    rows without their texts.
    """
    names = [c for c in df.columns if c not in ("keep_id", "group_size", "kept")]
    base = df.select(*[df[c] for c in names])
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base.withColumn("__d_norm", normalised(text_col)).withColumn("__d_len", F.length("__d_norm"))

    lengths = base.groupBy("__d_len").agg(F.count("*").alias("n")).where("n > 1").select("__d_len")
    lengths = if_small(cut(rebalanced(lengths)))
    hashed = base.join(lengths, "__d_len", "left_semi").withColumn("__d_prefix", F.xxhash64(F.substring("__d_norm", 1, prefix)))
    heads = hashed.groupBy("__d_len", "__d_prefix").agg(F.count("*").alias("n")).where("n > 1")
    heads = if_small(cut(rebalanced(heads.select("__d_len", "__d_prefix", F.lit(True).alias("__d_met")))))

    rows = (
        base.withColumn("__d_prefix", F.xxhash64(F.substring("__d_norm", 1, prefix)))
        .withColumn("__d_points", F.length(text))
        .join(heads, ["__d_len", "__d_prefix"], "left")
        .withColumn("__d_hash", F.when(F.col("__d_met"), F.col(hash_col) if hash_col else F.sha2(F.encode("__d_norm", "UTF-8"), 256)))
    )
    order = F.struct(F.col("__d_points"), F.col(id_col).isNotNull().alias("has"), F.negative(F.col(id_col)).alias("neg"))
    same = ["__d_points", id_col, "__d_len", "__d_hash"]
    exact = rows.where(F.col("__d_hash").isNotNull()).groupBy(*same).agg(F.count("*").alias("ties"))
    groups = (
        exact.groupBy(F.col("__d_hash"), F.col("__d_len"))
        .agg(F.max_by(F.struct(F.col(id_col).alias("keep_id"), F.col("__d_points").alias("__d_best"), F.col("ties").alias("__d_ties")), order).alias("k"), F.sum("ties").alias("group_size"))
        .where("group_size > 1")
        .select("__d_hash", "__d_len", "k.*", "group_size")
    )
    groups = if_small(cut(rebalanced(groups)))
    met = rows.join(groups, ["__d_hash", "__d_len"], "left").withColumn(
        "__d_first",
        F.col("group_size").isNull() | (F.col("keep_id").eqNullSafe(F.col(id_col)) & (F.col("__d_best") == F.col("__d_points"))),
    )
    met = met.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    columns = [*names, "keep_id", "group_size"]
    if groups.where("__d_ties > 1").limit(1).count() == 0:
        return met.select(*columns, F.col("__d_first").alias("kept"))
    # Only repeated rows come here: of the rows that tie for first place the one numbered least stays.
    tied = F.col("__d_first") & (F.coalesce("__d_ties", F.lit(1)) > 1)
    ties = cut(met.where(tied).withColumn("__d_row", F.monotonically_increasing_id()))
    chosen = if_small(cut(rebalanced(ties.groupBy("__d_hash", "__d_len").agg(F.min("__d_row").alias("__d_chosen")))))
    rest = met.where(~tied).select(*columns, F.col("__d_first").alias("kept"))
    return rest.unionByName(ties.join(chosen, ["__d_hash", "__d_len"]).select(*columns, (F.col("__d_row") == F.col("__d_chosen")).alias("kept")))
