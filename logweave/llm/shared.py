"""Helpers of the operators: shared scratch tables, checked broadcasts, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.storage import drop, keep_until_release, new_path, release, scope, scratch_root, table  # noqa: F401
from logweave.operators.storage import settled as cut  # noqa: F401

#: Rows of a narrow relation (some tens of bytes a row) that may be broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of texts that go to a Python worker at a time.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets few bytes go to a Python worker at a time, so that its memory does not follow the length of the texts.

    For operators whose result is computed by its reader, which the session's setting has to
    outlive; operators that compute theirs themselves take ``in_small_batches``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


@contextlib.contextmanager
def batches_within(spark: SparkSession, size: int = BATCH) -> Iterator[None]:
    """``small_batches`` for what runs inside; then the session is as before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def in_small_batches(operator: Callable) -> Callable:
    """An operator of a DataFrame, computed in ``batches_within``."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **options):
        with batches_within(df.sparkSession):
            return operator(df, *args, **options)

    return run


_kept: list = []


def kept_for_a_task(maxsize: int) -> Callable:
    """``functools.lru_cache`` whose values a worker forgets at the end of a task (``tidy``), since workers live on from stage to stage."""

    def keep(function: Callable) -> Callable:
        _kept.append(functools.lru_cache(maxsize=maxsize)(function))
        return _kept[-1]

    return keep


def tidy(run: Callable) -> Callable:
    """A function for ``mapInPandas``, after which the worker gives memory back: workers live on from stage to stage, and keep it otherwise."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        for cache in _kept:
            cache.cache_clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def rebalanced(df: DataFrame) -> DataFrame:
    """``df`` without a known partitioning, so that a later join has an exchange on both sides and a hot key can be split."""
    return df.hint("rebalance")


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already cut) with a broadcast hint if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60, once: bool = False) -> DataFrame:
    """The smallest node that each node of ``edges`` reaches: ``(node, root)``, without the roots themselves.

    Edges are kept as (node, smaller node). A round links a node's smaller neighbours to the
    smallest of them, then replaces each target by its own smallest neighbour, so paths
    halve. It ends when a round changes nothing, which is when every component is a star.
    Null ends, loops and repeated edges count for nothing. ``once``: the first half of a round
    is written before the second reads it twice, for many edges; else it is computed twice, in one job. Tables go to the shared folder;
    the driver sees one row of checksums a round.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("p")).distinct()
    state, path = table(pairs)
    before = None
    for _ in range(rounds):
        seen = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "p")).alias("x")).first()
        if (now := (seen["n"], seen["x"])) == before or not seen["n"]:
            break
        before = now
        least = state.groupBy("v").agg(F.min("p").alias("m"), F.count("*").alias("n"))
        several = least.where("n > 1").select("v", "m")
        star = least.select("v", F.col("m").alias("p")).unionByName(
            state.join(several, "v").where(F.col("p") != F.col("m")).select(F.col("p").alias("v"), F.col("m").alias("p"))
        )
        middle, written = table(star.distinct()) if once else (star.distinct(), None)
        up = middle.groupBy("v").agg(F.min("p").alias("up")).select(F.col("v").alias("p"), "up")
        jumped = middle.join(up, "p", "left").select("v", F.coalesce("up", "p").alias("p"))
        state, new = table(jumped.distinct())
        if written:
            drop(spark, written)
        drop(spark, path)
        path = new
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    out = cut(state.groupBy("v").agg(F.min("p").alias("root")).select(F.col("v").alias("node"), "root"))
    drop(spark, path)
    return out


class Sieve:
    """Tells rows whose key is surely not among given keys, so that they need not move to a join.

    Keys are hashed to the bits of a bitmap of fixed size (8 MB), which is built by partial
    aggregation and goes to the tasks. Some rows without a partner pass; the join drops them.
    ``hashed``: the one column is a hash already, and its low bits are taken.
    """

    BITS = 1 << 26

    def __init__(self, keys: DataFrame, *columns: str, hashed: bool = False):
        self.spark, self.hashed = keys.sparkSession, hashed
        bit = self._bit(*columns) + 1
        parts = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        full = np.zeros(self.BITS >> 3, np.uint8)
        for r in parts.collect():
            own = np.frombuffer(r["bits"], np.uint8)
            full[(r["part"] - 1) * 4096 : (r["part"] - 1) * 4096 + len(own)] = own
        self.bitmap = self.spark.sparkContext.broadcast(full)

    def _bit(self, *columns: Column | str) -> Column:
        return F.pmod(F.col(columns[0]) if self.hashed else F.xxhash64(*columns), F.lit(self.BITS))

    @classmethod
    def found(cls, bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """In a task, which of the 64-bit hashes may be among the keys of a ``hashed`` sieve's bitmap."""
        at = hashes.astype(np.int64) & (cls.BITS - 1)
        return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def passes(self, *columns: Column | str) -> Column:
        bitmap = self.bitmap

        @F.pandas_udf("boolean")
        def look(bit: pd.Series) -> pd.Series:
            at = bit.to_numpy()
            return pd.Series((bitmap.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

        return look(self._bit(*columns))


def keep_met(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows of ``df`` whose columns ``on`` may be among ``keys`` (already cut), so that the others need not move to a join: exactly these where keys are few, else what a ``Sieve`` passes."""
    keys = keys.select(*on)
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(keys), list(on), "left_semi")
    return df.where(Sieve(keys, *on).passes(*on))


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """``df`` dealt out by a hash of ``keys`` over the session's shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def hash_bound(share: float) -> int:
    """The signed 64-bit hash up to which a ``share`` of all hashes lies."""
    return min(int(min(1.0, share) * 2**64) - 2**63, 2**63 - 1)
