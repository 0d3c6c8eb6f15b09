"""Documents of any size: pieces in order, written as many parts or passed on one partition at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of a section's parts, 0 for as many as the session's shuffles have.
PARTS = 0


@dataclass(frozen=True)
class Section:
    """``pieces(place, piece)`` in the order of their places with ``join`` between them, after ``head`` and before ``tail``."""

    pieces: DataFrame
    head: str = ""
    join: str = "\n"
    tail: str = ""


def json_of(clusters: DataFrame) -> list[Section]:
    """The cluster ids as a JSON array in the order of the lines."""
    return [Section(clusters.select(F.col("line_id").alias("place"), F.col("cluster_id").cast("string").alias("piece")), "[", ", ", "]")]


def write_document(sections: list[Section], path: str, parts: int = PARTS) -> None:
    """Writes each section under ``path``: a text file for its head, parts of its body that a range of places each has, one for its tail.

    Files follow each other by name; each piece of a body is followed by its ``join``, and
    readers leave out the last one (``pieces_of``). No task holds more than a part.
    """
    spark = sections[0].pieces.sparkSession
    for n, s in enumerate(sections):
        for kind, text in (("0-head", s.head), ("2-tail", s.tail)):
            spark.createDataFrame([(text,)] if text else [], "piece string").coalesce(1).write.option("lineSep", "\0").text(f"{path}/{n:04d}-{kind}")
        body = s.pieces.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "place").sortWithinPartitions("place")
        body.select("piece").write.option("lineSep", s.join).text(f"{path}/{n:04d}-1-body")


def pieces_of(sections: list[Section]) -> Iterator[str]:
    """The document's texts in order; the driver holds a partition at a time."""
    for s in sections:
        yield s.head
        for k, row in enumerate(s.pieces.orderBy("place").toLocalIterator()):
            yield (s.join if k else "") + (row["piece"] or "")
        yield s.tail


def stream_document(sections: list[Section], out: TextIO) -> None:
    """Writes the document to one open file, piece by piece."""
    for text in pieces_of(sections):
        out.write(text)


def read_document(spark: SparkSession, path: str, join: list[str]) -> Iterator[str]:
    """The texts of a document that ``write_document`` left, in order; ``join`` is that of each section."""
    for n, between in enumerate(join):
        for kind, sep in (("0-head", "\0"), ("1-body", between), ("2-tail", "\0")):
            rows = spark.read.option("lineSep", sep).text(f"{path}/{n:04d}-{kind}")
            placed = rows.select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
            for k, row in enumerate(placed.orderBy("f", "b", "i").toLocalIterator()):
                yield (between if k and kind == "1-body" else "") + row["value"]
