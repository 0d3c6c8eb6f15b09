"""Ranked lexical search: shards of compressed postings, merged document at a time by a heap of cursors."""

from __future__ import annotations

import contextlib
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heappushpop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.shared import BROADCAST_ROWS, batches_within, cut, drop, new_path, table
from logweave.sources.lines import dense

#: Postings after which a shard is closed; a document is never split.
SHARD = 1 << 19
#: Items that are searched in one pass over the shards.
BLOCK = 1024
#: Bytes as they stand in terms: A-Z as a-z; all but digits, letters and what is not ASCII are blanks.
TERM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()

SHARDS = "docs array<long>, lengths array<long>, n_docs long, n_terms long, terms array<binary>, dfs array<int>, postings array<binary>"


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of digits, letters and characters beyond ASCII, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM).split()


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Whole numbers in bytes of seven bits, the low ones first, all but a number's last with the high bit; and where each number ends."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[ends[own] - size[own] + k] = values[own] >> 7 * k & 127 | (size[own] > k + 1) << 7
    return out.tobytes(), ends


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([np.zeros(1, np.int64), ends + 1])[: len(ends)]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127) << 7 * place, starts) if len(starts) else raw


class Shard:
    """Postings of documents as they come; closing sorts the documents by id and compresses a list for each term."""

    def __init__(self):
        self.ids, self.lengths, self.n_docs, self.n_terms = [], [], 0, 0
        self.numbers: dict[bytes, int] = {}
        self.doc, self.term, self.tf = array("i"), array("i"), array("i")

    def add(self, doc_id: int | None, words: list[bytes], wanted: frozenset[bytes] | None) -> None:
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        own = Counter(words if wanted is None else filter(wanted.__contains__, words))
        if own:
            self.doc.extend([len(self.ids)] * len(own))
            self.term.extend([self.numbers.setdefault(w, len(self.numbers)) for w in own])
            self.tf.extend(own.values())
            self.ids.append(doc_id)
            self.lengths.append(len(words))

    def close(self) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.zeros(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, term, tf = place[np.array(self.doc, np.int64)], np.array(self.term, np.int64), np.array(self.tf, np.int64)
        by = np.lexsort((doc, term))
        doc, term, tf = doc[by], term[by], tf[by]
        new = np.diff(term, prepend=-1) != 0
        gap = np.where(new, doc, np.diff(doc, prepend=0))
        data, ends = packed(np.stack([gap, tf], axis=1).ravel())
        first = np.flatnonzero(new)
        bounds = np.concatenate([np.zeros(1, np.int64), ends[1::2]])[np.append(first, len(doc))].tolist()
        names = list(self.numbers)
        row = {
            "docs": [self.ids[i] for i in order],
            "lengths": [self.lengths[i] for i in order],
            "n_docs": self.n_docs,
            "n_terms": self.n_terms,
            "terms": [names[t] for t in term[first].tolist()],
            "dfs": np.diff(np.append(first, len(doc))).tolist(),
            "postings": [data[a:b] for a, b in zip(bounds, bounds[1:])],
        }
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_pylist([row], pa.schema(list(zip(row, kinds))))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: Broadcast | None = None, most: int = SHARD) -> DataFrame:
    """The shards of an index, a row each, made where the texts are read: no shuffle, and a shard never outgrows ``most`` postings and a document.

    A shard has its documents in the order of their ids (null ids last), and for each term
    the places of its documents as gaps, each with its number of occurrences. ``wanted``, a
    broadcast set of terms, leaves other terms out of the lists but not out of the counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                shard.add(doc_id, terms(text.as_py()), wanted and wanted.value)
                if len(shard.doc) >= most:
                    yield shard.close()
                    shard = Shard()
        if shard.n_docs:
            yield shard.close()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SHARDS)


def merge(lists: list[tuple[np.ndarray, np.ndarray]], docs: list[int | None], k: int, best: list[tuple[int, float]]) -> None:
    """Puts the ``k`` highest scores into the heap ``best`` of (score, -id), of equal scores the smaller ids.

    A heap holds the next document of each list; all lists that stand at the least one add
    to its score and move on.
    """
    n, width = len(docs), len(lists)
    keys = [[*(places * width + t).tolist(), n * width + t] for t, (places, _) in enumerate(lists)]
    adds = [a.tolist() for _, a in lists]
    at = [0] * width
    heads = [own[0] for own in keys]
    heapify(heads)
    least = best[0][0] if len(best) == k else 0
    while (head := heads[0]) < n * width:
        doc, t = divmod(head, width)
        end, score = head - t + width, 0
        while head < end:
            t = head % width
            score += adds[t][at[t]]
            at[t] += 1
            heapreplace(heads, keys[t][at[t]])
            head = heads[0]
        if score < least or not score:
            continue
        own = (score, -math.inf if docs[doc] is None else -docs[doc])
        if len(best) < k:
            heappush(best, own)
        else:
            heappushpop(best, own)
        if len(best) == k:
            least = best[0][0]


def search(index: DataFrame, items: list[tuple[int, list[tuple[bytes, int]]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(item, doc_id, score)``: the ``k`` highest of each task for items of (term, weight), whose results alone a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {i: [] for i, _ in items}
        weights = {term: w for _, own in items for term, w in own}
        for b in batches:
            for r in range(b.num_rows):
                docs, lengths, names, postings = (b.column(c)[r].as_py() for c in ("docs", "lengths", "terms", "postings"))
                m = np.array([100 - 50 + 50 * n * n_docs // n_terms for n in lengths], np.int64)
                lists = {}
                for term, data in zip(names, postings):
                    if w := weights.get(term, 0):
                        pairs = unpacked(data).reshape(-1, 2)
                        places, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
                        lists[term] = places, w * (1_000_000_000 * tf // (1000 * tf + 20 * m[places]))
                for i, own in items:
                    if found := [lists[t] for t, _ in own if t in lists]:
                        merge(found, docs, k, best[i])
        rows = [(i, None if d == -math.inf else -d, s) for i, heap in best.items() for s, d in heap]
        yield pa.RecordBatch.from_pylist([dict(zip(("item", "doc_id", "score"), x)) for x in rows], pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return index.select("docs", "lengths", "terms", "postings").mapInArrow(run, "item long, doc_id long, score long")


def _item_terms(items: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in sorted(set(terms(text)))]
            yield pa.RecordBatch.from_pydict({"item": pa.array([i for i, _ in rows], pa.int64()), "term": pa.array([t for _, t in rows], pa.binary())})

    return items.select("__item", F.col(text_col).alias("__text")).mapInArrow(run, "item long, term binary")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(item_col, rank, doc_id, score)``: the ``k`` documents with the highest scores above 0 for each row of ``items``.

    A term weighs floor(1000 ln((2N + 2) / (2df + 1))), N being the documents with a term and
    df those with this one; with tf occurrences it adds weight * (10**9 tf div (1000 tf + 20 m)),
    where m is 50 + 50 n N div L for a document of n of all L terms. Equal scores go by
    ascending id, null ids last. Null and empty texts have no terms and are found by nothing.
    Repeated rows of ``docs`` are documents like any other; repeated rows of ``items`` are each
    answered. An empty table on either side gives an empty result; other columns are not read.

    The items' terms go to the tasks that build the shards if they are few (``BROADCAST_ROWS``),
    and the index has those alone; else it has all terms. Items are searched in blocks, so that
    the driver and a task hold a block of them. Each task sends its ``k`` best for an item, which Spark ranks.
    """
    spark = docs.sparkSession
    numbered, items_path = table(items.select(F.col(item_col), F.col(item_text_col)).toDF("__id", "__text"))
    numbered, numbered_path = table(dense(numbered, "__item"))
    drop(spark, items_path)
    wanted, wanted_path = table(_item_terms(numbered, "__text"))
    names = wanted.select("term").distinct().limit(BROADCAST_ROWS + 1).collect()
    known = spark.sparkContext.broadcast(frozenset(bytes(r["term"]) for r in names)) if len(names) <= BROADCAST_ROWS else None
    with batches_within(spark):
        index, index_path = table(build_index(docs, id_col, text_col, known))
    sums = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    pairs = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.dfs").alias("df"))
    weighed, weighed_path = table(wanted.join(pairs, "term"))
    found_path = new_path(spark, "found")
    spark.createDataFrame([], "item long, doc_id long, score long").write.parquet(found_path)
    with contextlib.ExitStack() as stack:
        stack.callback(known.destroy if known else lambda: None)
        # a batch of shards is a few of them, however large they are
        stack.enter_context(batches_within(spark))
        for at in range(0, numbered.count(), block):
            own: dict[int, list[tuple[bytes, int]]] = {}
            for r in weighed.where((F.col("item") >= at) & (F.col("item") < at + block)).orderBy("item", "term").collect():
                if (w := math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * r["df"] + 1)))) > 0:
                    own.setdefault(r["item"], []).append((bytes(r["term"]), w))
            if own:
                search(index, list(own.items()), sums["docs"], sums["terms"], k).write.mode("append").parquet(found_path)
    found = spark.read.schema("item long, doc_id long, score long").parquet(found_path)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    out = cut(best.join(numbered.select(F.col("__item").alias("item"), F.col("__id").alias(item_col)), "item").select(item_col, "rank", "doc_id", "score"))
    for path in (numbered_path, wanted_path, index_path, weighed_path, found_path):
        drop(spark, path)
    return out
