"""Media columns: texts stored as lossless WebP, read back as pixel arrays, with features of the pixels."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import cut, drop, in_small_batches, table, tidy
from logweave.llm.webp import decode_bytes, encode


def payload(text: str | None) -> tuple[int, bytes]:
    """The text's length in UTF-8, and its bytes with bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode("utf-8")
    return len(data), data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def feature(data: bytes, images: list[np.ndarray]) -> str:
    """Size, mean, deviation, entropy in bits, and share of equal neighbours of the pixels' grey."""
    grey = np.frombuffer(data, np.uint8)
    shares = np.bincount(grey, minlength=256) / len(grey)
    entropy = -float(np.sum(shares[shares > 0] * np.log2(shares[shares > 0]))) + 0.0
    level = np.arange(256)
    mean = float(shares @ level)
    deviation = float(shares @ (level - mean) ** 2) ** 0.5
    same = float(np.mean(grey[1:] == grey[:-1]))
    return f"{len(images)}x{images[0].shape[1]}x{sum(len(i) for i in images)} mean={mean:.4f} dev={deviation:.4f} entropy={entropy:.4f} same={same:.4f}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, media)``: every whole text as lossless WebP; null counts as empty."""
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(n, encode(data)) for n, data in map(payload, b["text"])]
            yield pd.DataFrame({"id": b["id"], "n_bytes": [n for n, _ in made], "media": [m for _, m in made]})

    out = rows.mapInPandas(tidy(run), "id string, n_bytes long, media binary")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "media")


def read(stored: DataFrame, id_col: str = "doc_id", pixels: bool = False) -> DataFrame:
    """Stored media decoded: sizes and digests of payload and media, a feature, and the grey pixels if asked for."""
    kind = stored.schema[id_col].dataType
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, n, media in zip(b["id"], b["n_bytes"], b["media"]):
                data, images = decode_bytes(media)
                row = (key, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(data, images))
                out.append((*row, data) if pixels else row)
            yield pd.DataFrame(out, columns=names + ["pixels"] * pixels)

    schema = "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pixels binary" * pixels
    out = stored.select(F.col(id_col).cast("string").alias("id"), "n_bytes", "media").mapInPandas(tidy(run), schema)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


@in_small_batches
def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as WebP in a table of the shared folder, read back and described: see ``read``.

    A null text counts as empty and is 64 bytes 0; null and repeated ids are rows like any
    other; other columns are not read; an empty table gives an empty result. Texts of more
    than a million bytes are several images, so memory follows one text. There is no shuffle.
    """
    stored, path = table(store(df, id_col, text_col))
    out = cut(read(stored, id_col))
    drop(df.sparkSession, path)
    return out
