"""Jaccard join of shingle sets: candidates by equal parts, then signature trees traversed in pairs, components."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.shared import Sieve, batches_within, connected_components, cut, drop, if_small, rebalanced, spread, table, tidy
from logweave.llm.simhash import merge
from logweave.llm.words import in_groups, mixed, powers
from logweave.sources.lines import dense

#: Parts beyond those that a pair within the limit can differ in.
EXTRA = 2
#: Children of a tree's node.
FAN = 8
#: Most sets, and most shingles, that a task holds of one side of a unit.
SETS, SHINGLES = 512, 1 << 21
#: Names of sets that a task knows as sent already; it forgets them when they are more.
SEEN = 1 << 18
#: Sets of a part that go along to the next one, so that parts of one group are linked at once.
BRIDGE = 32
#: 64-bit words of the bitmaps of whole parts, and most of those in a task; bytes of bitmaps that are compared at a time.
WIDE, WIDEST, COMPARED = 16, 1024, 1 << 22


@functools.cache
def size_class(n: int, percent: int) -> tuple[int, int]:
    """The class of a set's size, and the parts that sets of it are cut into; none if only equal sets of it can link."""
    low, k = 1, 0
    while True:
        high = max(low + 1, int(low * max(1.5, 120 / percent)))
        if n < high:
            differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
            return k, differ + 1 + EXTRA if differ else 0
        low, k = high, k + 1


def part_keys(own: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the parts of a set, such that sets with ``percent`` or more in common have one alike.

    Sets a, b with Jaccard similarity t differ in at most (1 - t) / (1 + t) * (|a| + |b|)
    shingles. Of so many parts and ``EXTRA`` + 1 more, by a hash of the shingles, at least
    ``EXTRA`` + 1 are equal. Empty parts tell nothing and are left out, unless a set has more
    than ``EXTRA`` of them, when they may be all that two sets have alike. A set that can link
    with ones of the next class of sizes has that class's parts too.
    """
    out = []
    classes = {size_class(n, percent) for n in (len(own), len(own) * 100 // percent)}
    for k, parts in classes:
        if not parts:
            continue
        at = ((own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, at, mixed(own, 1))
        full = np.bincount(at, minlength=parts) > 0
        places = np.arange(parts) if parts - full.sum() > EXTRA else np.flatnonzero(full)
        out.append(mixed(sums[places] + mixed((places + (k << 32)).astype(np.uint64), 2), 3))
    return np.concatenate([np.zeros(0, np.uint64), *out])


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; all words are one if there are fewer, and without words there is none."""
    for _, w in in_groups(texts):
        runs = w.runs(width)
        for a, b in zip(w.edges.tolist(), w.edges[1:].tolist()):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                yield mixed((w.hashes[a:b] * powers(width)[: b - a]).sum(dtype=np.uint64, keepdims=True), 4 + b - a)
            else:
                yield runs[:0]


def _name(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _number(name: bytes) -> int:
    """The first 64 bits of a set's name; candidates go by it, links by the whole name."""
    return int.from_bytes(name[:8], "big", signed=True)


def _named_sets(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``(id_col, n, name, number, parts)``, a row for each of ``df``; name and number are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = list(shingle_sets(b.column(1).to_pylist(), width))
            names = [_name(s) if len(s) else None for s in own]
            parts = [part_keys(s, percent).view(np.int64) for s in own]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
            numbers = pa.array([n and _number(n) for n in names], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, own)), pa.int64()), pa.array(names, pa.binary()), numbers, lists], names=[id_col, "n", "name", "number", "parts"])

    kinds = [(id_col, df.schema[id_col].dataType), ("n", T.LongType()), ("name", T.BinaryType()), ("number", T.LongType()), ("parts", T.ArrayType(T.LongType()))]
    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(tidy(run), T.StructType([T.StructField(n, t) for n, t in kinds]))


def _candidates(sets: DataFrame) -> DataFrame:
    """``(node, root)``: sets that share a part, and those that these share parts with; all sets of a group, its root too."""
    parts = sets.where("name IS NOT NULL").select("number", "parts")
    exploded = parts.select(F.explode("parts").alias("part"), "number")
    shared, path = table(exploded.groupBy("part").agg(F.min("number").alias("least"), F.max("number").alias("most")).where("least < most").select("part", "least"))
    bitmap = Sieve(shared, "part", hashed=True).bitmap

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            numbers = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            hit = Sieve.found(bitmap.value, values)
            yield pa.RecordBatch.from_pydict({"part": values[hit], "number": numbers[hit]})

    links = parts.mapInArrow(tidy(met), "part long, number long").join(shared, "part").where("number > least").select(F.col("number").alias("src"), F.col("least").alias("dst")).distinct()
    found = connected_components(links)
    drop(sets.sparkSession, path)
    return cut(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()))


def _members(df: DataFrame, text_col: str, width: int, groups: DataFrame) -> DataFrame:
    """``(group, name, n, low, bits, shingles)``: each set of the candidate groups once, with its shingles and a bitmap of them."""
    bitmap = Sieve(groups, "node", hashed=True).bitmap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            rows = []
            if len(seen) > SEEN:
                seen.clear()
            for own in shingle_sets(b.column(0).to_pylist(), width):
                if len(own):
                    number = _number(name := _name(own))
                    if name not in seen and Sieve.found(bitmap.value, np.array([number]))[0]:
                        seen.add(name)
                        rows.append((number, name, len(own), int(own[0].view(np.int64)), bitmaps([own], WIDE)[0].view(np.int64).tolist(), own.tobytes()))
            kinds = [("node", pa.int64()), ("name", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("bits", pa.list_(pa.int64())), ("shingles", pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    own = df.select(F.col(text_col).alias("__text")).mapInArrow(tidy(run), "node long, name binary, n long, low long, bits array<long>, shingles binary")
    return own.dropDuplicates(["name"]).join(if_small(groups), "node").select(F.col("root").alias("group"), "name", "n", "low", "bits", "shingles")


def bitmaps(sets: list[np.ndarray], words: int) -> np.ndarray:
    """A row of ``words`` 64-bit words for each set: a bit for each shingle, by its hash."""
    out = np.zeros((len(sets), words), np.uint64)
    flat = np.concatenate(sets)
    place = flat >> np.uint64(20) & np.uint64(64 * words - 1)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    np.bitwise_or.at(out, (row, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return out


class SignatureTree:
    """Levels of nodes over sets in a given order: each node has the OR of the bitmaps below it, the range of sizes, and the most shingles that any set has beyond its bits.

    Level 0 are the sets, a node of the next level has ``FAN`` of the level below.
    """

    def __init__(self, sets: list[np.ndarray], words: int):
        size, bits = np.array([len(s) for s in sets]), bitmaps(sets, words)
        self.levels = [(bits, size, size, size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, slack = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))


def _possible(x: tuple, y: tuple, percent: int) -> np.ndarray:
    """Whether sets below two nodes can link: shingles in common have their bits in both bitmaps, all but ``slack`` a bit of their own."""
    common = np.bitwise_count(x[0] & y[0]).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(x[2], common + x[3]), np.minimum(y[2], common + y[3]))
    return (most * (100 + percent) >= percent * (x[1] + y[1])) & (100 * most >= percent * np.maximum(x[1], y[1]))


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, known: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of sets, or within one, beyond those in ``known``.

    ``known`` has an entry for each set, first of ``left`` and then of ``right``; equal ones
    are connected already, and pairs of connected sets are not compared. Pairs of nodes are
    followed from the roots down as long as sets below them can link.
    """
    sets = left + (right or [])
    words = min(WIDEST, 1 << max(0, int(4 * max(map(len, sets)) - 1).bit_length() - 6))
    x = SignatureTree(left, words)
    y = SignatureTree(right, words) if right is not None else x
    shift = len(left) if right is not None else 0
    _, parent = np.unique(known, return_inverse=True)
    first = np.full(parent.max() + 1, len(sets))
    np.minimum.at(first, parent, np.arange(len(sets)))
    parent = first[parent]
    out: list[tuple[int, int]] = []
    at_once = max(FAN * FAN, COMPARED // (8 * words))
    top = max(len(x.levels), len(y.levels)) - 1
    level = lambda tree, k: tree.levels[min(k, len(tree.levels) - 1)]
    todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        k, i, j = todo.pop()
        if len(i) > at_once:
            todo += [(k, i[at_once:], j[at_once:]), (k, i[:at_once], j[:at_once])]
            continue
        if not k:
            apart = parent[i] != parent[j + shift]
            i, j = i[apart], j[apart]
        fits = _possible(tuple(a[i] for a in level(x, k)), tuple(a[j] for a in level(y, k)), percent)
        i, j = i[fits], j[fits]
        if k:
            below = [len(level(t, k - 1)[0]) if k < len(t.levels) else 0 for t in (x, y)]  # a lower tree's root stays until its level comes
            a, b = (np.arange(FAN if n else 1) for n in below)
            i = ((i[:, None] * FAN + a) if below[0] else i[:, None]).repeat(len(b), axis=1).ravel()
            j = np.tile((j[:, None] * FAN + b) if below[1] else j[:, None], (1, len(a))).ravel()
            inside = (i < (below[0] or 1)) & (j < (below[1] or 1))
            if right is None:
                inside &= i < j if k == 1 else i <= j
            todo.append((k - 1, i[inside], j[inside]))
            continue
        j = j + shift
        while len(i):
            linked = 0
            for linked, (p, q) in enumerate(zip(i.tolist(), j.tolist()), 1):
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                    merge(parent, np.array([p]), np.array([q]))
                    out.append((p, q))
                    break
            i, j = i[linked:], j[linked:]
            apart = parent[i] != parent[j]
            i, j = i[apart], j[apart]
    return out


def _links_in_units(units: DataFrame, percent: int) -> DataFrame:
    """``(src, dst)`` of ``units(unit, side, known, n, low, name, shingles)``; a unit with sets on side 1 is compared across sides only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                own = [np.frombuffer(r[2], np.uint64) for r in rows]
                n = sum(r[0] == 0 for r in rows)
                if n:
                    found = tree_links(own[:n], own[n:] or None, percent, np.array([r[3].hex() for r in rows]))
                    yield pa.RecordBatch.from_pydict({"src": pa.array([rows[p][1] for p, _ in found], pa.binary()), "dst": pa.array([rows[q][1] for _, q in found], pa.binary())})

        for b in batches:
            for key, *row in zip(*(b.column(c).to_pylist() for c in ("unit", "side", "name", "shingles", "known"))):
                if key != unit:
                    yield from close()
                    unit, rows = key, []
                rows.append(row)
        yield from close()

    dealt = spread(units, "unit").sortWithinPartitions("unit", "side", "n", "low", "name")
    return dealt.select("unit", "side", "name", "shingles", "known").mapInArrow(tidy(run), "src binary, dst binary")


def _parts(members: DataFrame, large: DataFrame) -> DataFrame:
    """``(name, group, n, bits, part, last)``: the sets of ``large`` groups, too large for a task, in parts by size and least shingle; ``last`` tells the ones that go along to the next part."""
    own = cut(members.select("group", "n", "low", "name", "bits").join(large, "group").orderBy("group", "n", "low", "name"))
    kind = F.ceil(F.log2("n")).cast("int")
    most = F.greatest(F.lit(2), F.least(F.lit(SETS), F.floor(F.lit(SHINGLES) / F.pow(F.lit(2.0), kind)))).cast("long")
    numbered = dense(own, "at").withColumn("most", most)
    return numbered.select("name", "group", "n", "bits", (kind.cast("long") * (1 << 40) + F.floor(F.col("at") / F.col("most"))).alias("part"), (F.col("at") % F.col("most") >= F.col("most") - BRIDGE).alias("last"))


def _node_pairs(parts: DataFrame, percent: int) -> DataFrame:
    """``(group, a, b)``: pairs of parts that can hold links yet, by the bitmaps, sizes and known components of all their sets."""
    ors = [F.bit_or(F.element_at("bits", k + 1)).alias(f"w{k}") for k in range(WIDE)]
    slack = F.col("n") - sum((F.bit_count(F.element_at("bits", k + 1)) for k in range(WIDE)), F.lit(0))
    nodes = cut(parts.groupBy("group", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(slack).alias("slack"), F.min("known").alias("k1"), F.max("known").alias("k2"), *ors))
    a, b = (nodes.select(F.col("group"), *[F.col(c).alias(side + c) for c in nodes.columns if c != "group"]) for side in ("a_", "b_"))
    common = sum((F.bit_count(F.col(f"a_w{k}").bitwiseAND(F.col(f"b_w{k}"))) for k in range(WIDE)), F.lit(0))
    most = F.least("a_high", "b_high", common + F.col("a_slack"), common + F.col("b_slack"))
    fits = (most * (100 + percent) >= percent * (F.col("a_low") + F.col("b_low"))) & (100 * most >= percent * F.greatest("a_low", "b_low"))
    done = (F.col("a_k1") == F.col("a_k2")) & (F.col("b_k1") == F.col("b_k2")) & (F.col("a_k1") == F.col("b_k1"))
    return a.join(b, "group").where((F.col("a_part") < F.col("b_part")) & fits & ~done).select("group", F.col("a_part").alias("a"), F.col("b_part").alias("b"))


def _components(members: DataFrame, percent: int) -> DataFrame:
    """``(name, root)`` of the members that links connect with others, but for the roots themselves.

    First each group, or each part of a large one with the end of the part before, is
    traversed by itself. Then pairs of parts that are not connected throughout are.
    """
    sizes = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("total")).where((F.col("sets") > SETS) | (F.col("total") > SHINGLES))
    large = if_small(cut(sizes.select("group")))
    columns = ["unit", F.lit(0).alias("side"), F.col("name").alias("known"), "n", "low", "name", "shingles"]
    first = members.join(large, "group", "left_anti").withColumn("unit", F.xxhash64("group")).select(columns)
    if there := bool(large.limit(1).count()):
        parts = cut(_parts(members, large))
        rows = members.join(if_small(parts.select("name", "part", "last")), "name")
        rows = rows.withColumn("next", F.explode(F.when(F.col("last"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        first = first.unionByName(rows.withColumn("unit", F.xxhash64("group", F.col("part") + F.col("next"))).select(columns))
    roots = connected_components(_links_in_units(first, percent)).select(F.col("node").alias("name"), "root")
    if not there:
        return roots
    known = cut(parts.join(roots, "name", "left").withColumn("known", F.coalesce("root", "name")).drop("root", "last"))
    pairs = cut(_node_pairs(known, percent))
    if not pairs.limit(1).count():
        return roots
    ends = pairs.select("group", F.col("a").alias("part"), "a", "b", F.lit(0).alias("side")).unionByName(pairs.select("group", F.col("b").alias("part"), "a", "b", F.lit(1).alias("side")))
    met = cut(known.select("name", "group", "part", "known").join(ends, ["group", "part"]).select("name", "known", "side", F.xxhash64("group", "a", "b").alias("unit")))
    units = if_small(met).join(members.select("name", "n", "low", "shingles"), "name")
    # links of components, which are few; a component's own members come along by their root
    of = known.select(F.col("name").alias("src"), F.col("known").alias("a"))
    links = _links_in_units(units, percent).join(of, "src").join(of.withColumnsRenamed({"src": "dst", "a": "b"}), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    above = cut(connected_components(links))
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("name", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(above.select(F.col("node").alias("name"), "root"))


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """``(id_col, n_shingles, component_id)``, a row for each of ``df``.

    A text's set are its distinct shingles of ``width`` words (A-Z lower-cased, between
    blanks), with fewer words the whole sequence as one. Texts link if 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest id that a row reaches over links,
    its own included. A null or blank text has no shingle and links with nothing, not even
    its like. Rows with a null id take part; their component id is null only if no row of the
    component has an id. Repeated rows and ids are rows like any other, ties in size or
    shingles change nothing. An empty table gives an empty result; other columns are not read.

    Equal sets are one set. Sets that share a part (``part_keys``: no pair that links is lost)
    are candidates, and groups of these are the shards; in each the signature trees
    are traversed. Large groups are cut into parts, whose bitmaps and sizes decide which pairs
    of parts meet. Shingles go by hashes of 64 bits, sets by 128 bits.
    """
    spark = df.sparkSession
    with batches_within(spark):
        rows, path = table(_named_sets(df, id_col, text_col, width, percent))
        groups = _candidates(rows)
        members, members_path = table(_members(df, text_col, width, groups))
        roots = _components(members, percent)
    drop(spark, members_path)
    least = rows.where("name IS NOT NULL").groupBy("name").agg(F.min(id_col).alias("least")).join(roots, "name", "left").select("name", "least", F.coalesce("root", "name").alias("root"))
    least, least_path = table(least)
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("name", "component_id")
    named = cut(rebalanced(named))
    own = F.when(F.col("name").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id")
    out = cut(rows.select(id_col, "n", "name").join(named, "name", "left").select(id_col, F.col("n").alias("n_shingles"), own))
    for done in (path, least_path):
        drop(spark, done)
    return out
