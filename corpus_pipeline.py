"""The corpus pipeline: from raw documents to packed training sequences, each stage on all that its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.exact_dedup import exact_dedup
from logweave.llm.langid import UNKNOWN, fit, held_out, predict
from logweave.llm.packing import pack
from logweave.llm.shared import BROADCAST_ROWS, Sieve, batches_within, cut, drop, keep_until_release, scope, scratch_root
from logweave.llm.simhash import simhash_dedup
from logweave.llm.substring_dedup import substring_dedup

#: A language is taken for known from this calibrated probability on.
LEAST_SCORE = 0.5
#: SimHash of the near-dedup stage: five words, and fingerprints of 256 bits, since at 0.8 of
#: common shingles 64 bits do not tell near copies from chance. Documents that share 0.8 of their
#: shingles differ in 39 of the bits on average, with a deviation of 6; 56 is three deviations more.
#: Many that share less are within it too, so texts within the radius are compared by their shingles.
WIDTH, SEEDS, RADIUS, SIMILAR = 5, (42, 43, 44, 45), 56, 0.8


def _apart(docs: DataFrame, names: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``operator`` makes of ``docs``, whose own columns of the names that it adds keep their values."""
    own = {n: f"__own_{n}" for n in names if n in docs.columns}
    found = operator(docs.withColumnsRenamed(own))
    return found.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labels know; no letter or a doubtful language goes.

    Null and empty texts have no letter. Without a single label there is nothing to judge by,
    and all documents stay. Repeated rows are judged alike; an empty table stays empty;
    columns named ``held_out``, ``lang_pred`` or ``score`` keep their values.
    """
    if not docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).limit(1).count():
        return docs
    model = fit(docs.where(~held_out()).select("text", "lang"))
    found = predict(docs, model, names=("__lang", "__score"))
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without blanks the one with the most code points, then the smallest id.

    Null texts count as empty; of repeated rows one stays; an empty table stays empty;
    columns named as the operator's own keep their values.
    """
    return _apart(docs, ("keep_id", "group_size", "kept"), lambda own: exact_dedup(own).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the document with the smallest id.

    A row goes by its id and text together: other texts under one id, and all documents
    without an id, stay. Texts without words, null ones too, are copies of each other;
    repeated rows stay or go together; an empty table stays empty; columns named as the
    operator's own keep their values; ``__id``, ``__mark`` and ``__met`` are working columns that ``docs`` must not have.
    """
    found = simhash_dedup(docs.select("doc_id", "text"), width=WIDTH, seeds=SEEDS, radius=RADIUS, exact=False, similar=SIMILAR)
    others = cut(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__mark")).distinct())
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__mark"))
    if others.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(others), same, "left_anti")
    # documents that surely stay do not move
    marked = docs.withColumn("__met", Sieve(others, "__id", "__mark").passes("doc_id", F.xxhash64("text")))
    met = marked.where("__met").join(others, same, "left_anti")
    return marked.where(~F.col("__met")).unionByName(met).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in another document too; one that holds nothing else goes.

    ``n_chars`` of a changed text is its new length. Null and empty texts stay as they are;
    repeated rows are treated alike; an empty table stays empty; columns named ``removed``
    or ``kept_in`` keep their values.
    """
    def operator(own: DataFrame) -> DataFrame:
        found = substring_dedup(own)
        found = found.where((F.size("removed") == 0) | (F.trim("text") != ""))
        return found.withColumn("n_chars", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))

    return _apart(docs, ("removed", "kept_in"), operator)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null text counts as empty and has the one id that ends a document; repeated rows are
    documents like any other; an empty table has no pieces; other columns are not read.
    """
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("exact", exact), ("near", near), ("passages", passages), ("packing", packing)]

#: SQL can't express the language model, so there is none; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet in the shared folder and read back.

    A stage's input and what its operators left are deleted when its result is written, and
    nothing else is: results that the caller holds keep their tables, and the session its settings. The last
    result stays until its reader calls ``shared.release``. An empty table gives an
    empty result; nulls, ties and repeated rows are as the stages have them.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
        with scope(spark), batches_within(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            drop(spark, before)
        before = path
    keep_until_release(before)
    return docs
