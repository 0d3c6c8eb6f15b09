"""WARC archives: a writer, and a reader that proves each record boundary by the chain from the file's start."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.shared import BROADCAST_ROWS, cut, drop, if_small, rebalanced, scratch_root, table, tidy

#: What a record begins with, and what stands between its block and the next record.
MAGIC, END = "WARC/1.", "\r\n\r\n"
#: Payloads shorter than this are never replaced by a revisit.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a header at most.
HEADER = 1 << 16
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of ``df`` to WARC 1.1 files in the folder ``path``.

    The payload is the UTF-8 of a string or the bytes of a binary column; null counts as
    empty. Of equal payloads of at least ``least`` bytes the row with the smallest id is a
    response, others are revisits that refer to it; rows that share that smallest id, and
    rows of a group without any id, are all responses. Null ids and urls leave their header
    out; line breaks and the magic in a url are percent-encoded.

    A record is a row of Spark's text writer, whose line separator is the four bytes that
    end a record, so commits and lost tasks are Spark's business and any file system will
    do. Payload digests are grouped before they are joined, and only those that occur twice
    are joined, so copies of one payload never meet in one task.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    shared = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(if_small(cut(rebalanced(shared))), "digest", "left")
    revisit = F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull())
    rows = rows.withColumn("revisit", revisit)
    url = F.col("url")
    for a, b in (("\r", "%0D"), ("\n", "%0A"), (MAGIC, "WARC%2F1.")):
        url = F.replace(url, F.lit(a), F.lit(b))
    block = F.concat(F.lit(HTTP), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload").cast("string")))
    record = F.uuid()
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), record, F.lit(f">\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("X-Row-ID: "), F.col("id"), F.lit("\r\n")), F.lit("")),
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nX-Refers-To-Row-ID: "), F.col("first"), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nContent-Length: "), F.octet_length(block), F.lit(END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics of a file, in order within (file, block); a chunk's own magic stands before it."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("chunk"))


def _head(data: bytes) -> tuple[dict[str, str], int] | None:
    """The header fields after the magic, and where the block begins in ``data``; None if the header isn't whole."""
    if (stop := data.find(b"\r\n\r\n")) < 0:
        return None
    fields = {}
    for line in data[:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields, stop + 4


def _successor(at: int, data: bytes) -> int:
    """Where the record after that at ``at`` begins if one begins at ``at``, else -1."""
    head = _head(data)
    if head is None or not head[0].get("content-length", "").isdigit():
        return -1
    return at + len(MAGIC) + head[1] + int(head[0]["content-length"]) + len(END)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[tuple[int, bytes]]]]:
    """Of each block in turn (file, block, base and further facts) and its (offset, chunk) pairs; -1 for what stands before the first magic."""
    key, own, at = None, [], 0
    for b in batches:
        facts = [c for c in b.columns if c != "chunk"]
        for now, chunk in zip(b[facts].itertuples(index=False, name=None), b["chunk"]):
            if now != key:
                if own:
                    yield key, own
                key, own, at = now, [], now[2]
            own.append((at - len(MAGIC), bytes(chunk)))
            at += len(chunk) + len(MAGIC)
    if own:
        yield key, own


#: A line of a header that tells a record's length.
LENGTH = re.compile(rb"\r\n[ \t]*content-length[ \t]*:([^\r\n]*)(?=\r\n)", re.I)
#: What follows the magic in the first line of a record.
VERSION = re.compile(rb"\d+[ \t]*\r\n")


def successors(offsets: list[int], chunks: list[bytes]) -> dict[int, int]:
    """For each offset where a record may begin, where the next one does; -1 if none begins here.

    ``chunks`` are what follows each magic. The ends of headers and the lines with lengths
    are looked up once for all; a header that holds the magic goes on in the next chunks, up to ``HEADER`` bytes.
    """
    data = MAGIC.encode().join([b"", *chunks])
    ends = [m.start() for m in re.finditer(rb"\r\n\r\n", data)]
    lengths = [(m.start(), m[1].strip()) for m in LENGTH.finditer(data)]
    places = [place for place, _ in lengths]
    out, at = {}, 0
    for offset, chunk in zip(offsets, chunks):
        at += len(MAGIC)
        out[offset] = -1
        k = bisect_left(ends, at)
        if k < len(ends) and ends[k] < max(at + len(chunk), at + HEADER) and VERSION.match(data, at):
            stop = ends[k]
            n = bisect_left(places, stop) - 1
            if n >= 0 and places[n] >= at and lengths[n][1].isdigit():
                out[offset] = offset + len(MAGIC) + stop + 4 - at + int(lengths[n][1]) + len(END)
        at += len(chunk)
    return out


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each offset where a record may begin, where its chain leaves the block, and the last offset before that."""
    for (file, block, _), chunks in _blocks(batches):
        own = [(at, data) for at, data in chunks if at >= 0]
        follows = successors([at for at, _ in own], [data for _, data in own])
        leaves: dict[int, int] = {}
        last: dict[int, int] = {}
        for at in sorted(follows, reverse=True):
            leaves[at], last[at] = leaves.get(follows[at], follows[at]), last.get(follows[at], at)
        yield pd.DataFrame({"file": file, "block": block, "at": list(leaves), "leaves": list(leaves.values()), "last": list(last.values())}, columns=["file", "block", "at", "leaves", "last"])


def _reach(jumps: DataFrame) -> DataFrame:
    """``(file, at)`` of the offsets on the chain from 0, by pointer jumping: each round doubles what a pointer spans."""
    reached = cut(jumps.where("at = 0").select("file", "at"))
    n = reached.count()
    while True:
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reached = cut(reached.unionByName(step).distinct())
        if (now := reached.count()) == n:
            return reached
        n = now
        far = jumps.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("further"))
        jumps = cut(jumps.join(far, ["file", "leaves"]).select("file", "at", F.col("further").alias("leaves")))


def _attach(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """``facts`` of each (file, block), already cut, beside its chunks, in their order."""
    if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return chunks.join(F.broadcast(facts), ["file", "block"])
    placed = chunks.withColumn("place", F.monotonically_increasing_id()).join(facts, ["file", "block"])
    return placed.sortWithinPartitions("file", "block", "place").drop("place")


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of the chain: whole ones, and pieces of those that began in an earlier block or go on in a later one."""
    for (file, _, _, entry, owner), chunks in _blocks(batches):
        out: list[tuple] = []
        start, stop, held, begun = owner, entry, [], True

        def close() -> None:
            if held:
                data = b"".join(x for _, x in held)
                whole = not begun and stop - start == len(data)
                out.append((file, start, held[0][0], whole, data))

        for at, data in chunks:
            if at < 0:
                continue
            if at == stop:
                close()
                start, stop, held, begun = at, -1, [], False
            held.append((at, MAGIC.encode() + data))
            if stop < 0:
                stop = _successor(start, b"".join(x for _, x in held)[len(MAGIC) :])
        close()
        yield pd.DataFrame(out, columns=["file", "at", "piece", "whole", "data"])


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = lambda x: None if x is None else int(x)
    for b in batches:
        out = []
        for file, at, data in zip(b["file"], b["at"].tolist(), b["data"]):
            fields, start = _head(data[len(MAGIC) :])
            body = data[len(MAGIC) + start :][: int(fields["content-length"])]
            revisit = fields.get("warc-type") == "revisit"
            payload = None if revisit else body[body.find(b"\r\n\r\n") + 4 :]
            digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
            out.append((file, at, fields.get("warc-type"), number(fields.get("x-row-id")), fields.get("warc-target-uri"), number(fields.get("x-refers-to-row-id")), digest, payload))
        made = pd.DataFrame(out, columns=["file", "at", "type", "id", "url", "refers_to", "digest", "payload"])
        yield made.astype({"id": "Int64", "refers_to": "Int64"})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, type, id, url, refers_to, digest, payload)`` of the records in the WARC files of a folder.

    Files are read in splits at the magic. Every magic is a candidate; its header gives the
    offset of its successor. Tasks follow links within their split and emit where each chain
    leaves it; pointer jumping from offset 0 of each file then tells at which offset each
    split is entered, and only records on that chain are read, so a magic inside a payload
    is payload. A chain that does not end at its file's end raises an error, as does a
    header that holds the magic itself and lies across two splits. Empty files give no
    rows. Payloads are the bytes after the HTTP header; a revisit's is null, and so are
    ids, urls and references that a record does not have.
    """
    chunks = _chunks(spark, path)
    sums = cut(chunks.groupBy("file", "block").agg(F.sum(F.octet_length("chunk") + len(MAGIC)).alias("size")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(sums.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")))
    found, found_path = table(_attach(chunks, bases).mapInPandas(tidy(_candidates), "file string, block long, at long, leaves long, last long"))
    targets = found.select("file", F.col("leaves").alias("at")).distinct()
    entered = found.join(targets, ["file", "at"], "left_semi").unionByName(found.where("at = 0"))
    reached = _reach(cut(entered.select("file", "at", "leaves").distinct()))
    ends = sums.groupBy("file").agg((F.sum("size") - len(MAGIC)).alias("end"))
    broken = ends.where("end > 0").join(reached.select("file", F.col("at").alias("end")).unionByName(found.join(reached, ["file", "at"]).select("file", F.col("leaves").alias("end"))), ["file", "end"], "left_anti").limit(3).collect()
    if broken:
        raise ValueError(f"the chain of records does not reach the end of {[r['file'] for r in broken]}")
    entries = found.join(reached, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"), F.max("last").alias("last"))
    facts = bases.join(entries, ["file", "block"], "left")
    facts = cut(facts.select("file", "block", "base", F.coalesce("entry", F.lit(-2)).alias("entry"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("owner")))
    drop(spark, found_path)
    pieces = _attach(chunks, facts).mapInPandas(tidy(_records), "file string, at long, piece long, whole boolean, data binary")
    rows = pieces.where("whole").select("file", "at", "data")
    # a block is not entered at its first magic only if a record that holds the magic goes on from an earlier block
    if facts.where(f"entry != greatest(base - {len(MAGIC)}, 0)").limit(1).count():
        joined = pieces.where("NOT whole").groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("piece", "data"))).alias("p"))
        rows = rows.unionByName(joined.select("file", "at", F.expr("aggregate(p, cast('' AS binary), (a, x) -> concat(a, x.data))").alias("data")))
    return rows.mapInPandas(tidy(_parse), "file string, at long, type string, id long, url string, refers_to long, digest string, payload binary")


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``df`` written as archives in the shared folder and read back: ``(id, url, type, refers_to, bytes, digest)``.

    Size and digest are those of the payload as read; a revisit has those of the response
    that it refers to. Null ids, repeated rows and empty payloads: see ``write_warc``. An
    empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(df, path, id_col, url_col, payload_col, least)
    read = read_warc(spark, path)
    rows, rows_path = table(read.select("id", "url", "type", "refers_to", F.octet_length("payload").alias("bytes"), F.sha2("payload", 256).alias("own"), "digest"))
    drop(spark, path)
    wanted = rows.where("type = 'revisit'").select(F.col("refers_to").alias("id"), F.col("digest").alias("own")).distinct()
    full = rows.where("type = 'response'").join(wanted, ["id", "own"], "left_semi").groupBy(F.col("id").alias("refers_to"), F.col("own").alias("digest")).agg(F.min("bytes").alias("full_bytes"))
    full = if_small(cut(rebalanced(full)))
    out = rows.join(full, ["refers_to", "digest"], "left").select("id", "url", "type", "refers_to", F.coalesce("bytes", "full_bytes").cast("long").alias("bytes"), F.when(F.col("type") == "revisit", F.when(F.col("full_bytes").isNotNull(), F.col("digest"))).otherwise(F.col("own")).alias("digest"))
    out = cut(out)
    drop(spark, rows_path)
    return out
