"""Substring dedup: repeated paragraphs found by MinHash banding, verified by exact Jaccard, clustered by components; then runs of words that repeat anywhere."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.shared import Sieve, connected_components, cut, drop, if_small, keep_met, rebalanced, small_batches, spread, table, tidy
from logweave.llm.simhash import merge
from logweave.llm.words import INVERSE, LINE_BREAK, Words, in_groups, mixed, powers, sliding

#: Words of a shingle, similarity of a repeat, and words that a paragraph has at least.
WIDTH, SIMILAR, LEAST = 5, 0.8, 50
#: Chance that a pair of just that similarity meets in a band.
RECALL = 0.999
#: Most paragraphs of a bucket that are compared as one unit.
BUCKET = 512
#: Marks that may go to all tasks as a bitmap, an eighth of its bits; more are met by a join.
MARKS = 1 << 25
#: Values of removals that may go to all tasks.
VALUES = 1 << 20
#: Words between blanks, as ``bytes.split`` has them.
WORD = re.compile("[^ \\t\\n\\r\\x0b\\x0c]+")


def bands(similar: float = SIMILAR, recall: float = RECALL, rows: int = 3) -> tuple[int, int]:
    """(bands, rows a band): the fewest bands of ``rows`` hashes in which a pair of similarity ``similar`` meets with probability ``recall``.

    What meets is verified, so bands of few rows cost some comparisons and no precision, and fewer keys move.
    """
    return (math.ceil(math.log(1 - recall) / math.log(1 - similar**rows)) if similar < 1 else 1), rows


@functools.lru_cache(maxsize=4)
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(20).integers(1, 2**32, (2, n), dtype=np.uint32)
    return a | np.uint32(1), b


def signatures(w: Words, first: np.ndarray, last: np.ndarray, width: int, n: int, rows: int) -> np.ndarray:
    """``n`` 64-bit keys of each paragraph ``first[i]:last[i]`` of the words: bands of ``rows`` minimum hashes over its shingles."""
    shingles = np.append(w.runs(width) >> np.uint64(32), [0]).astype(np.uint32)
    edges = np.stack([first, last - width + 1], axis=1).ravel()
    a, b = _hashes(n * rows)
    keys = np.zeros((len(first), n), np.uint64)
    for k in range(n * rows):
        own = (shingles ^ b[k]) * a[k]
        own ^= own >> np.uint32(15)
        keys[:, k // rows] = mixed(keys[:, k // rows] ^ np.minimum.reduceat(own, edges)[::2], k // rows)
    return keys.view(np.int64)


def _digests(w: Words, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """128 bits of each paragraph's words."""
    out = []
    for seed in (1, 2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(w.hashes, seed) * powers(len(w.hashes)))])
        out.append(mixed((sums[last] - sums[first]) * powers(len(w.hashes) + 1, INVERSE)[first] + (last - first).astype(np.uint64), seed))
    return [x.tobytes() for x in np.stack(out, axis=1)]


def _paragraphs(batches: Iterator[pd.DataFrame], least: int, width: int, shape: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """The lines of at least ``least`` words: where they stand, their digests, texts and band keys."""
    for b in batches:
        ids, of = b["id"].to_numpy(), b["mark"].to_numpy()
        for before, w in in_groups(b["text"]):
            breaks = np.flatnonzero(np.frombuffer(w.data, np.uint8) == LINE_BREAK)
            begins = np.append(0, breaks[:-1] + 1)
            edges = np.searchsorted(w.starts, np.append(begins, len(w.data)))
            long = np.flatnonzero(np.diff(edges) >= max(1, least))
            if not len(long):
                continue
            first, last = edges[long], edges[long + 1]
            text = np.searchsorted(w.begins, begins[long], "right") - 1
            yield pd.DataFrame(
                {
                    "id": ids[before + text],
                    "mark": of[before + text],
                    "place": (long - np.searchsorted(breaks, w.begins)[text]).astype(np.int32),
                    "digest": _digests(w, first, last),
                    "paragraph": [w.data[x:y].decode("utf-8", "surrogatepass") for x, y in zip(begins[long].tolist(), breaks[long].tolist())],
                    "keys": list(signatures(w, first, last, min(width, max(1, least)), *shape)),
                }
            )


def _shared_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by key those whose key occurs more than once; the last row waits for the next batch."""
    held, held_shared = None, False
    for b in batches:
        if not len(b):
            continue
        rows = b if held is None else pd.concat([held, b], ignore_index=True)
        keys = rows["key"].to_numpy()
        same = keys[1:] == keys[:-1]
        shared = np.append(same, False) | np.concatenate([[held_shared], same])
        yield rows[:-1][shared[:-1]]
        held, held_shared = rows[-1:], bool(shared[-1])
    if held is not None and held_shared:
        yield held


def _shingle_sets(paragraphs: pd.Series, width: int) -> Iterator[set[int]]:
    """The distinct shingles of each paragraph as 64-bit hashes; all its words are one if they are fewer."""
    for _, w in in_groups(paragraphs):
        shingles = w.runs(width)
        for a, b in zip(w.edges[:-1].tolist(), w.edges[1:].tolist()):
            yield set(shingles[a : b - width + 1].tolist()) if b - a >= width else {int(mixed(w.hashes[a:b]).sum())}


def _similar(batches: Iterator[pd.DataFrame], width: int, similar: float) -> Iterator[pd.DataFrame]:
    """Of each unit a spanning forest of the pairs that are similar; pairs that are connected already aren't compared."""
    unit, digests, sets, sides = None, [], [], []

    def close() -> Iterator[pd.DataFrame]:
        parent, src, dst = np.arange(len(digests)), [], []
        two = 1 in sides
        for i, own in enumerate(sets):
            for j in range(i):
                if parent[i] == parent[j] or two and sides[i] == sides[j]:
                    continue
                a, b = (own, sets[j]) if len(own) <= len(sets[j]) else (sets[j], own)
                if len(a) >= similar * len(b) and (both := len(a & b)) >= similar * (len(a) + len(b) - both):
                    merge(parent, np.array([i]), np.array([j]))
                    src.append(digests[i])
                    dst.append(digests[j])
        if src:
            yield pd.DataFrame({"src": src, "dst": dst})

    for b in batches:
        for key, side, digest, own in zip(b["unit"].tolist(), b["side"].tolist(), b["digest"], _shingle_sets(b["paragraph"], width)):
            if key != unit:
                yield from close()
                unit, digests, sets, sides = key, [], [], []
            digests.append(bytes(digest))
            sets.append(own)
            sides.append(side)
    yield from close()


def similar_paragraphs(found: DataFrame, texts: DataFrame, width: int = WIDTH, similar: float = SIMILAR, most: int = BUCKET) -> DataFrame:
    """``(node, root)`` over the digests of ``found(digest, keys)``, each digest once; ``texts(digest, paragraph)`` has each once at least.

    Buckets of band keys with more than one paragraph are told by a scan of the sorted
    keys; buckets with the same members count once; the paragraphs of what is left are
    compared within their bucket. A bucket with more than ``most`` members is compared
    as pairs of parts.
    """
    spark = found.sparkSession
    keys = spread(found.select("digest", F.explode("keys").alias("key")), "key").sortWithinPartitions("key")
    met, met_path = table(keys.mapInPandas(tidy(_shared_keys), "digest binary, key long"))
    buckets = met.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "digest"), 20)).alias("s"))
    buckets, buckets_path = table(buckets.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    units = met.join(buckets, "key").withColumn("own", F.pmod(F.xxhash64("digest", F.lit(2)), F.col("parts")).cast("int"))
    units = units.select("key", "digest", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = units.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "digest", (F.col("own") > F.col("other")).cast("int").alias("side"))
    own = keep_met(texts, units, "digest").dropDuplicates(["digest"])
    units = units.join(own, "digest")
    units = spread(units, "unit").sortWithinPartitions("unit", "digest")
    pairs = cut(units.mapInPandas(tidy(lambda batches: _similar(batches, width, similar)), "src binary, dst binary").distinct())
    drop(spark, met_path)
    drop(spark, buckets_path)
    return connected_components(pairs)


class Marks(Sieve):
    """A sieve of hashes, larger since there is one for every few words of repeated text."""

    BITS = 1 << 28

    def _bit(self, *columns: str) -> Column:
        return F.pmod(F.col(columns[0]), F.lit(self.BITS))


def marks(w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The mark of each run of ``least`` words, the least hash of the shorter runs in it (0 for a run across texts); and the hashes that are marks, once for each place.

    A mark is a minimum hash over the shorter runs of a window: one band of one row. It depends
    on the window's words alone, so equal windows have equal marks wherever they stand.
    """
    size = max(1, least // 2)
    short, span = w.runs(size), least - size + 1
    if len(short) < span:
        return short[:0], short[:0]
    lowest = np.where(w.same_text(least), sliding(short, span, np.minimum), np.uint64(0))
    edge = np.zeros(span - 1, np.uint64)
    reached = sliding(np.concatenate([edge, lowest, edge]), span, np.maximum)
    return lowest, short[(short == reached) & (reached > 0)]


def _marks_of(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [marks(w, least)[1] for _, w in in_groups(b["text"])]
        hashes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        yield pd.DataFrame({"hash": hashes.view(np.int64), "n": n})


def _hashed(b: pd.DataFrame, before: int, w: Words, at: np.ndarray, least: int) -> Iterator[pd.DataFrame]:
    """The runs of ``least`` words at some places of the words: two hashes of its words, and its start."""
    if len(at):
        text = np.searchsorted(w.edges, at, "right") - 1
        one, two = (w.runs(least, seed)[at].view(np.int64) for seed in (1, 2))
        yield pd.DataFrame({"id": b["id"].to_numpy()[before + text], "mark": b["mark"].to_numpy()[before + text], "at": (at - w.edges[text]).astype(np.int32), "one": one, "two": two})


def _runs_of(batches: Iterator[pd.DataFrame], least: int, shared: Broadcast) -> Iterator[pd.DataFrame]:
    """The runs of ``least`` words whose mark is in the bitmap."""
    full = shared.value
    for b in batches:
        for before, w in in_groups(b["text"]):
            lowest = marks(w, least)[0]
            bit = (lowest & np.uint64(Marks.BITS - 1)).astype(np.int64)
            yield from _hashed(b, before, w, np.flatnonzero((full[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) & (lowest > 0)), least)


def _stretches(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Of each text the stretches of runs with one mark: the mark, and the first and last start."""
    for b in batches:
        for before, w in in_groups(b["text"]):
            lowest = marks(w, least)[0]
            begin = np.flatnonzero((lowest > 0) & np.append(True, lowest[1:] != lowest[:-1])[: len(lowest)])
            if len(begin):
                # a text's last runs have no mark, so no stretch goes on into the next text
                end = np.flatnonzero((lowest > 0) & np.append(lowest[1:] != lowest[:-1], True)[: len(lowest)])
                text = np.searchsorted(w.edges, begin, "right") - 1
                first = w.edges[text]
                yield pd.DataFrame({"id": b["id"].to_numpy()[before + text], "mark": b["mark"].to_numpy()[before + text], "hash": lowest[begin].view(np.int64), "a": (begin - first).astype(np.int32), "b": (end - first).astype(np.int32)})


def _runs_in(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The runs of ``least`` words that start within the ``ranges`` of their text."""
    for b in batches:
        ranges = b["ranges"].tolist()
        for before, w in in_groups(b["text"]):
            change = np.zeros(len(w.hashes) + 1, np.int64)
            for k, first in enumerate(w.edges[:-1].tolist()):
                for r in ranges[before + k]:
                    change[first + r["a"]] += 1
                    change[first + r["b"] + 1] -= 1
            yield from _hashed(b, before, w, np.flatnonzero(np.cumsum(change)[:-1]), least)


def _repeatable_runs(texts: DataFrame, least: int, most: int) -> tuple[DataFrame, str]:
    """``(id, mark, at, one, two)``: the runs of ``least`` words whose mark occurs more than once.

    Up to ``most`` such marks go to all tasks as a bitmap of fixed size, and texts do not
    move. More would fill it; then stretches of runs meet them in a join, and texts with
    such stretches meet these.
    """
    schema = "id string, mark long, at int, one long, two long"
    found = texts.select("text").mapInPandas(tidy(lambda batches: _marks_of(batches, least)), "hash long, n long")
    shared, path = table(found.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"))
    if shared.limit(most + 1).count() <= most:
        bitmap = Marks(shared, "hash").bitmap
        at = table(texts.mapInPandas(tidy(lambda batches: _runs_of(batches, least, bitmap)), schema))
    else:
        own = texts.mapInPandas(tidy(lambda batches: _stretches(batches, least)), "id string, mark long, hash long, a int, b int").distinct()
        wanted = own.join(shared, "hash", "left_semi").groupBy("id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
        wanted, wanted_path = table(wanted)
        at = table(texts.join(wanted, ["id", "mark"]).select("id", "mark", "text", "ranges").mapInPandas(tidy(lambda batches: _runs_in(batches, least)), schema))
        drop(texts.sparkSession, wanted_path)
    drop(texts.sparkSession, path)
    return at


def without_runs(text: str, removed: list[int], starts: list[int], least: int) -> tuple[str, list[int]]:
    """``text`` without the words of the runs of ``least`` words at ``starts``; ``removed`` with the places of the lines they stand in.

    ``removed`` has the places of lines that are not in ``text`` any more. A line that loses
    all its words goes; where blanks stand on both sides of what goes, those after it go too.
    """
    spans = [m.span() for m in WORD.finditer(text)]
    change = np.zeros(len(spans) + 1, np.int64)
    np.add.at(change, np.array(starts), 1)
    np.add.at(change, np.array(starts) + least, -1)
    lost = np.cumsum(change)[:-1] > 0
    breaks = [m.start() for m in re.finditer("\n", text)]
    before = set(removed)
    places = [x for x in range(len(breaks) + 1 + len(before)) if x not in before]
    touched = {places[i] for i in np.searchsorted(breaks, [spans[i][0] for i in np.flatnonzero(lost).tolist()]).tolist()}
    edges = np.flatnonzero(np.diff(np.concatenate([[0], lost, [0]]))).reshape(-1, 2).tolist()
    ends = [(spans[a][0], spans[b - 1][1]) for a, b in edges]
    out = text[: ends[0][0]]
    for (_, start), stop in zip(ends, [*(a for a, _ in ends[1:]), len(text)]):
        rest = text[start:stop].lstrip(" \t")
        opens = not out.rpartition("\n")[2].strip(" \t")
        closes = not rest or rest.startswith(("\n", "\r\n"))
        if closes:
            out = out.rstrip(" \t")
        if opens and closes and rest:
            rest = rest.partition("\n")[2]
        elif opens and closes:
            out = out.removesuffix("\n")
        elif not opens and not closes and out[-1] not in " \t":
            rest = text[start:stop]
        out += rest
    return out, sorted(before | touched)


def substring_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, width: int = WIDTH, similar: float = SIMILAR, most: int = BUCKET, most_marks: int = MARKS
) -> DataFrame:
    """``df`` with repeated passages taken out of the text, and ``removed`` and ``kept_in``.

    Paragraphs are the lines of a text; those of ``least`` words and more are compared by
    the Jaccard similarity of their shingles of ``width`` words (between blanks, A-Z
    lower-cased). Similar ones are linked, and of each component of links the occurrence
    with the smallest (id, place) stays, a null id last; every other one is removed from its
    text. From what is left, runs of ``least`` words and more that have an earlier occurrence
    (in the order of id and place in the text; in the same document one that does not overlap) are
    removed word by word, wherever they stand: inside a line, or across lines. ``removed``
    lists the places (from 0) of the lines that lost words, ``kept_in`` the ids of the
    documents in which they stay, both empty where nothing was removed; such texts are
    unchanged, null ones too. Rows with the same id and text count as one document and are
    treated alike. An empty table gives an empty result; columns named as a new column
    are replaced; ``__id``, ``__mark``, ``__met``, ``__cut``, ``__starts`` and ``__kept`` are working columns that ``df`` must not have.

    A run is found by its mark (``marks``), of which a text has one in some 13 words: marks
    that occur more than once go to all tasks as a bitmap (over ``most_marks`` of them by a
    join), and only runs with such a mark are compared, by 128 bits of hashes over their words.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    small_batches(spark)
    names = [c for c in df.columns if c not in ("removed", "kept_in")]
    shape = bands(similar)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = df.select(key.alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    made = rows.mapInPandas(tidy(lambda batches: _paragraphs(batches, least, width, shape)), "id string, mark long, place int, digest binary, paragraph string, keys array<long>")
    made, made_path = table(made)
    order = F.struct((F.col("id") == "").alias("none"), F.when(F.col("id") != "", F.col("id")).cast(kind).alias("who"), "mark", "place")
    places = made.select("digest", "id", "mark", "place", order.alias("order"))
    distinct, distinct_path = table(made.select("digest", "keys").dropDuplicates(["digest"]))
    roots = similar_paragraphs(distinct, made.select("digest", "paragraph"), width, similar, most)
    drop(spark, distinct_path)
    counted = places.groupBy("digest").agg(F.min("order").alias("first"), F.count("*").alias("n")).join(if_small(roots), F.col("digest") == F.col("node"), "left")
    counted, counted_path = table(counted.select("digest", F.coalesce("root", "digest").alias("root"), "first", "n"))
    groups = counted.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("n")).where("n > 1").select("root", "stays")
    groups = if_small(cut(rebalanced(groups)))
    repeated = counted.join(groups, "root").select("digest", "stays")
    repeated = if_small(cut(rebalanced(repeated)))
    gone = places.join(repeated, "digest").where(F.col("order") != F.col("stays"))
    gone = gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("place")).alias("removed"), F.array_sort(F.collect_set(F.col("stays.who"))).alias("kept_in"))
    gone = cut(rebalanced(gone.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "removed", "kept_in")))
    drop(spark, made_path)
    drop(spark, counted_path)
    full = _beside(df.select(*[df[c] for c in names], key.alias("__id"), F.xxhash64(text_col).alias("__mark")), gone, F.size("removed") + F.size("kept_in"))
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, i: ~F.array_contains(F.col("removed"), i))
    text = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    id_type = kind.simpleString()
    left = full.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in names],
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce(F.col("kept_in").cast(f"array<{id_type}>"), F.array().cast(f"array<{id_type}>")).alias("kept_in"),
        "__id",
        "__mark",
    )
    return _without_repeated_runs(left, names, text_col, kind, least, most_marks)


def _without_repeated_runs(left: DataFrame, names: list[str], text_col: str, kind: T.DataType, least: int, most_marks: int) -> DataFrame:
    """The second half of ``substring_dedup``: over texts without repeated paragraphs."""
    spark = left.sparkSession
    texts = left.select(F.col("__id").alias("id"), F.col("__mark").alias("mark"), F.col(text_col).alias("text"))
    texts, texts_path = table(texts)  # read twice, by tasks with one Python worker
    at, at_path = _repeatable_runs(texts, least, most_marks)
    drop(spark, texts_path)
    order = F.struct((F.col("id") == "").alias("none"), F.when(F.col("id") != "", F.col("id")).cast(kind).alias("who"), "mark", "at")
    at = at.withColumn("order", order)
    first = at.groupBy("one", "two").agg(F.min("order").alias("stays"), F.count("*").alias("n")).where("n > 1").select("one", "two", "stays")
    first, first_path = table(first)
    same = F.struct("order.none", "order.who", "order.mark").eqNullSafe(F.struct("stays.none", "stays.who", "stays.mark"))
    gone = at.join(first, ["one", "two"]).where(~same | (F.col("at") - F.col("stays.at") >= least))
    gone = gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("at")).alias("__starts"), F.array_sort(F.collect_set("stays.who")).alias("__kept"))
    gone = cut(rebalanced(gone.withColumnsRenamed({"id": "__id", "mark": "__mark"})))
    drop(spark, at_path)
    drop(spark, first_path)

    @F.pandas_udf("text string, removed array<int>")
    def cut_out(text: pd.Series, removed: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if s is None else without_runs(t, [int(x) for x in r], [int(x) for x in s], least) for t, r, s in zip(text, removed, starts)]
        return pd.DataFrame(rows, columns=["text", "removed"])

    full = _beside(left, gone, F.size("__starts") + F.size("__kept"))
    here = F.col("__starts").isNotNull()
    # texts that lose nothing do not go to a Python worker
    full = full.withColumn("__cut", cut_out(F.when(here, F.col(text_col)), F.when(here, F.col("removed")), F.col("__starts")))
    new = {text_col: F.col("__cut.text"), "removed": F.col("__cut.removed"), "kept_in": F.array_sort(F.array_union("kept_in", "__kept"))}
    return full.select(*[F.when(here, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in [*names, "removed", "kept_in"]])


def _beside(docs: DataFrame, gone: DataFrame, size: Column) -> DataFrame:
    """``docs`` with what ``gone`` (already cut) has for their ``__id`` and ``__mark``, or nulls.

    Few rows of few values, as ``size`` counts them, go to the tasks. Else documents that surely
    have none, which are most, do not move to the join.
    """
    on = ["__id", "__mark"]
    if (gone.agg(F.sum(size + 4)).first()[0] or 0) <= VALUES:
        return docs.join(F.broadcast(gone), on, "left")
    met = docs.withColumn("__met", Sieve(gone, *on).passes(*on))
    rest = met.where(~F.col("__met")).withColumns({c: F.lit(None).cast(gone.schema[c].dataType) for c in gone.columns if c not in on}).drop("__met")
    return met.where("__met").drop("__met").join(gone, on, "left").select(*rest.columns).unionByName(rest)
