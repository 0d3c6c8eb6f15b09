"""Tables between the rounds of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables and checkpoints that operators wrote and that their results may still read, by scope; this is the scope around all others.
_all_left: set[str] = set()
_scope: contextvars.ContextVar[set[str]] = contextvars.ContextVar("scope", default=_all_left)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[set[str]]:
    """What operators leave inside belongs to this scope and is deleted at its end; results made outside keep their tables.

    A result that is to outlive the scope has to be written inside; ``keep_until_release`` hands
    its path to the scope around.
    """
    own: set[str] = set()
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        for path in list(own):
            drop(spark, path)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session gets one on this machine; a cluster, whose machines do
    not share that, gets an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints/logweave"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path of its own in the shared folder, which ``release`` deletes."""
    path = f"{scratch_root(spark)}/{kind}-{uuid.uuid4().hex}"
    _scope.get().add(path)
    return path


def table(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read back, and its path, to be given to ``drop``.

    What is read back has no lineage and no known partitioning, so joins on it have an
    exchange on both sides and adaptive execution can split a hot key.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder as a checkpoint, until ``release``, or where Spark is set to clean checkpoints until nothing refers to it."""
    scratch_root(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _scope.get().add(file.get())
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``table``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    for own in (_all_left, _scope.get()):
        own.discard(path)


def keep_until_release(path: str) -> None:
    """Leaves a table for its reader; the end of the scope or ``release`` deletes it."""
    _scope.get().add(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that operators left in this scope for their results; to be called when all of these are written or no longer needed."""
    for path in list(_scope.get()):
        drop(spark, path)


def tasks(df: DataFrame) -> int:
    """Partitions for work that takes long on few bytes, which adaptive execution would put together."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
