"""SimHash near-dedup: fingerprints, shards by shared bits, a BK-tree in each shard, components."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.shared import connected_components, cut, drop, in_small_batches, keep_met, rebalanced, spread, table, tidy

#: Most distinct fingerprints in a tree; a shard with more is dealt out as pairs of such parts.
TREE = 1024
#: Fingerprints in a leaf of a tree.
LEAF = 4
#: Fingerprints that a shard of ``exact_tables`` has on average, at most.
SHARD = 64
#: The same of ``sampled_tables``, whose rows are wider and more: sending one costs about as much as comparing so many.
SAMPLED_SHARD = 128
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: Most texts of a candidate component that are compared as one unit.
UNIT = 512


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word shingles, repeats included: words between blanks, A-Z lower-cased, joined by spaces; all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    return [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), (starts[width:] - 1).tolist())]


def fingerprint(text: str | None, width: int = 4, seeds: tuple[int, ...] = (42,)) -> bytes:
    """64 bits a seed, high bit first: a bit is 1 if set in over half of the shingles' XXH64; all 0 without words."""
    pieces = shingles(text, width)
    out = []
    for seed in seeds:
        ones = np.zeros(64, np.int64)
        for at in range(0, len(pieces), BLOCK):
            h = np.array([xxhash.xxh64_intdigest(x, seed) for x in pieces[at : at + BLOCK]], dtype=">u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(pieces)).tobytes())
    return b"".join(out)


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int, seeds: tuple[int, ...]) -> DataFrame:
    """``(id_col, __mark, fp)``, a row for each of ``df``; ``__mark`` is the text's hash."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "__mark": b["__mark"], "fp": [fingerprint(t, width, seeds) for t in b["__text"]]})

    rows = df.select(F.col(id_col), F.xxhash64(text_col).alias("__mark"), F.col(text_col).alias("__text"))
    if isinstance(kind, T.IntegralType):  # pandas would turn a null id into a float
        rows = rows.withColumn(id_col, F.col(id_col).cast("string"))
    out = rows.mapInPandas(tidy(run), T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("__mark", T.LongType()), T.StructField("fp", T.BinaryType())]))
    return out.withColumn(id_col, F.col(id_col).cast(kind))


def exact_tables(bits: int, radius: int, n: int = 0) -> list[list[int]]:
    """Bit positions such that fingerprints within the radius agree on those of one table at least.

    Of ``b`` blocks of bits ``radius`` differing bits leave ``b - radius`` alike, so there is
    a table for each choice of so many blocks. More blocks make more tables of smaller
    shards; there are as few as leave ``SHARD`` of ``n`` fingerprints in a shard on average.
    """
    blocks = radius + 1
    while blocks < min(bits, 2 * radius + 2) and n >> bits * (blocks - radius) // blocks > SHARD:
        blocks += 1
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    own = [list(range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(chosen, []) for chosen in itertools.combinations(own, blocks - radius)]


def sampled_tables(bits: int, radius: int, n: int = 0, recall: float = 0.99, least: int = 11, seed: int = 7) -> list[list[int]]:
    """Random positions of bits, enough tables that a pair with ``radius`` differing bits agrees in one with probability ``recall``.

    Pairs with fewer differing bits agree with a higher one. Tables have ``least`` positions,
    or as many as leave ``SAMPLED_SHARD`` of ``n`` fingerprints in a shard on average. Each
    further position halves the shards and asks for ``bits / (bits - radius)`` times the
    tables: of 256 bits within 56 the pairs compared grow with n to the power of 1.36, and not
    with its square. The recall is the same whatever ``n`` is.
    """
    k = min(bits - radius, max(least, math.ceil(math.log2(max(1, n) / SAMPLED_SHARD))))
    agree = math.comb(bits - radius, k) / math.comb(bits, k)
    draw = random.Random(seed)
    return [sorted(draw.sample(range(bits), k)) for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - agree)))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the rows of ``a`` to those of ``b``, both (n, lanes)."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16)
    for lane in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, None, lane] ^ b[None, :, lane])
    return out


class BKTree:
    """A tree of fingerprints: a node is one of them, its children are keyed by their Hamming distance to it.

    Small subtrees are leaves, kept as arrays. Building and searching take whole arrays at a
    time, without recursion, so equal or chained inputs can't exhaust the stack.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.nodes: list[tuple[int, np.ndarray | None, dict[int, int]]] = []  # pivot, leaf, children
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(points)), -1, 0)]
        while todo:
            own, parent, key = todo.pop()
            if parent >= 0:
                self.nodes[parent][2][key] = len(self.nodes)
            if len(own) <= leaf:
                self.nodes.append((-1, own, {}))
                continue
            at = len(self.nodes)
            self.nodes.append((int(own[0]), None, {}))
            rest = own[1:]
            far = _distances(points[own[:1]], points[rest])[0]
            for d in np.unique(far).tolist():
                todo.append((rest[far == d], at, d))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query index, point index) within the radius."""
        todo = [(0, np.arange(len(queries)))] if self.nodes else []
        while todo:
            at, q = todo.pop()
            pivot, leaf, children = self.nodes[at]
            if leaf is not None:
                a, b = np.nonzero(_distances(queries[q], self.points[leaf]) <= radius)
                yield q[a], leaf[b]
                continue
            far = _distances(self.points[pivot : pivot + 1], queries[q])[0]
            near = q[far <= radius]
            yield near, np.full(len(near), pivot)
            for d, child in children.items():
                if len(follow := q[np.abs(far - d) <= radius]):
                    todo.append((child, follow))


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of ``a`` and ``b`` in ``parent``, where each index points at its set's least index."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (jumped := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = jumped


def _shard_links(fps: list[bytes], sides: np.ndarray, radius: int) -> tuple[list[bytes], list[bytes]]:
    """A spanning forest of the links between the fingerprints of a shard, or of two of its parts."""
    points = np.frombuffer(b"".join(fps), dtype=">u8").reshape(len(fps), -1).astype(np.uint64)
    own, parent = np.flatnonzero(sides == 0), np.arange(len(fps))
    other = np.flatnonzero(sides == 1)
    other = other if len(other) else own
    # beyond an eighth of the bits the triangle inequality rules out no child, so a tree is one leaf there
    tree = BKTree(points[own], LEAF if radius <= 8 * points.shape[1] else len(own))
    for q, p in tree.search(points[other], radius):
        merge(parent, other[q], own[p])
    moved = np.flatnonzero(parent != np.arange(len(fps)))
    return [fps[i] for i in moved.tolist()], [fps[i] for i in parent[moved].tolist()]


def _links_in_shards(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard and part; a shard is taken when the next begins."""
    unit, fps, sides = None, [], []

    def close() -> Iterator[pd.DataFrame]:
        if len(fps) > 1:
            a, b = _shard_links(fps, np.array(sides), radius)
            if a:
                yield pd.DataFrame({"src": a, "dst": b})

    for batch in batches:
        for key, fp, side in zip(batch["unit"].tolist(), batch["fp"].tolist(), batch["side"].tolist()):
            if key != unit:
                yield from close()
                unit, fps, sides = key, [], []
            fps.append(bytes(fp))
            sides.append(side)
    yield from close()


def links(nodes: DataFrame, radius: int, tables: list[list[int]], most: int = TREE) -> DataFrame:
    """``(src, dst)``: in every shard a spanning forest of its links, from distinct fingerprints ``nodes(fp)``.

    A shard is a table and the bits that a fingerprint has at its positions. A shard of more
    than ``most`` fingerprints is split by a hash into parts, and each pair of parts is a
    unit of its own, so neither memory nor a task's work follows a hot shard's size.
    """
    masks = [tuple(sorted(t)) for t in tables]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(b["fp"]), np.uint8).reshape(len(b), -1), axis=1)
            for t, own in enumerate(masks):
                value = np.zeros(len(b), np.int64)
                for at in own:
                    value = (value << 1) | bits[:, at]
                yield pd.DataFrame({"t": np.full(len(b), t, np.int32), "value": value, "fp": b["fp"]})

    dealt = nodes.select("fp").mapInPandas(tidy(keys), "t int, value long, fp binary")
    sizes = dealt.groupBy("t", "value").agg(F.count("*").alias("size"))
    large, path = table(sizes.where(F.col("size") > most).select("t", "value", F.ceil(F.col("size") / most).cast("int").alias("parts")))
    # a unit's key is a hash; where two shards have one, they are searched together, which loses nothing
    if large.limit(1).count():
        split = dealt.join(large, ["t", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        split = split.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        units = split.select("t", "value", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        units = units.select(F.xxhash64("t", "value", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "fp", (F.col("own") > F.col("other")).cast("int").alias("side"))
    else:
        units = dealt.select(F.xxhash64("t", "value").alias("unit"), "fp", F.lit(0).alias("side"))
    units = spread(units, "unit").sortWithinPartitions("unit", "fp")
    out = cut(units.mapInPandas(tidy(lambda batches: _links_in_shards(batches, radius)), "src binary, dst binary").distinct())
    drop(nodes.sparkSession, path)
    return out


def _similar_texts(batches: Iterator[pd.DataFrame], radius: int, width: int, similar: float) -> Iterator[pd.DataFrame]:
    """Of each unit a spanning forest of the pairs that lie within the radius and are similar; pairs that are connected already aren't compared."""
    unit, marks, fps, sides, sets = None, [], [], [], []

    def close() -> Iterator[pd.DataFrame]:
        if len(marks) < 2:
            return
        points = np.frombuffer(b"".join(fps), dtype=">u8").reshape(len(fps), -1).astype(np.uint64)
        sizes, side, parent = np.array([len(x) for x in sets]), np.array(sides), np.arange(len(marks))
        src, dst, two = [], [], 1 in sides
        for i in range(1, len(marks)):
            least, most = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
            fits = (_distances(points[i : i + 1], points[:i])[0] <= radius) & (least >= similar * most)
            if two:
                fits &= side[:i] != side[i]
            for j in np.flatnonzero(fits).tolist():
                if parent[i] != parent[j] and (both := len(sets[i] & sets[j])) >= similar * (sizes[i] + sizes[j] - both):
                    merge(parent, np.array([i]), np.array([j]))
                    src.append(marks[i])
                    dst.append(marks[j])
        if src:
            yield pd.DataFrame({"src": src, "dst": dst})

    for b in batches:
        for key, mark, fp, side, text in zip(b["unit"].tolist(), b["mark"].tolist(), b["fp"], b["side"].tolist(), b["text"]):
            if key != unit:
                yield from close()
                unit, marks, fps, sides, sets = key, [], [], [], []
            marks.append(mark)
            fps.append(bytes(fp))
            sides.append(side)
            sets.append(set(shingles(text, width)))
    yield from close()


def similar_texts(texts: DataFrame, df: DataFrame, text_col: str, radius: int, width: int, similar: float, most: int = UNIT) -> DataFrame:
    """``(node, root)`` over the marks of ``texts(mark, fp, group)``, each mark once; the texts themselves come from ``df``.

    Texts of a group are linked if their fingerprints lie within the radius and the Jaccard
    similarity of their distinct shingles is at least ``similar``. A group of more than
    ``most`` texts is compared as pairs of parts; texts alone in their group do not move.
    """
    spark = df.sparkSession
    sizes = texts.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    sizes, sizes_path = table(sizes.select("group", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    met, met_path = table(texts.join(sizes, "group"))
    units = met.withColumn("own", F.pmod(F.xxhash64("mark", F.lit(2)), F.col("parts")).cast("int"))
    units = units.select("group", "mark", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = units.select(
        F.concat_ws("/", F.hex("group"), F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "mark", "fp", (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    own = df.select(F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    own = keep_met(own, met, "mark").dropDuplicates(["mark"])
    units = spread(units.join(own, "mark"), "unit").sortWithinPartitions("unit", "mark")
    pairs = cut(units.mapInPandas(tidy(lambda batches: _similar_texts(batches, radius, width, similar)), "src long, dst long").distinct())
    drop(spark, sizes_path)
    drop(spark, met_path)
    return connected_components(pairs, once=True)


@in_small_batches
def simhash_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    seeds: tuple[int, ...] = (42,),
    radius: int = 4,
    exact: bool = True,
    similar: float | None = None,
) -> DataFrame:
    """``(id_col, fp, component_id, text_hash)``, a row for each of ``df``; ``text_hash`` is XXH64 of the text as Spark has it.

    ``fp`` is the fingerprint (``fingerprint``); fingerprints link at ``radius`` or fewer
    differing bits, and ``component_id`` is the smallest id that a row reaches over links,
    its own included. A null or blank text has fingerprint 0 and links like any other. Rows
    with a null id take part; their component id is null only if no row of the component has
    an id. Repeated rows and ids are rows like any other. An empty table gives an empty result.

    ``similar``: links of fingerprints are candidates only; two texts link if besides the
    Jaccard similarity of their distinct shingles is at least this, also where their
    fingerprints are equal.

    ``exact``: shards by blocks of bits (``exact_tables``) lose no link. Otherwise shards by sampled
    bits find a pair at the radius with the probability of ``sampled_tables``; for
    radii too wide for blocks. Trees are built over distinct fingerprints, in the tasks
    that hold a shard: trees of all shards have no size bound, so they are dealt by a
    shuffle and not broadcast.
    """
    rows, path = table(fingerprints(df, id_col, text_col, width, seeds))
    nodes, nodes_path = table(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    bits = 64 * len(seeds)
    tables = (exact_tables if exact else sampled_tables)(bits, radius, nodes.count())
    roots = connected_components(links(nodes, radius, tables), once=True).select(F.col("node").alias("fp"), "root")
    if similar is None:
        named = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        key = "fp"
    else:
        texts, texts_path = table(rows.groupBy("__mark", "fp").agg(F.min(id_col).alias("least")))
        grouped = texts.join(roots, "fp", "left").select(F.col("__mark").alias("mark"), "fp", F.coalesce("root", "fp").alias("group"))
        found = similar_texts(grouped, df, text_col, radius, width, similar).select(F.col("node").alias("__mark"), "root")
        named = texts.join(found, "__mark", "left").select("__mark", "least", F.coalesce("root", "__mark").alias("root"))
        key = "__mark"
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rebalanced(named.join(least, "root").select(key, "component_id")))
    drop(df.sparkSession, nodes_path)
    out = cut(rows.join(named, key).select(id_col, "fp", "component_id", F.col("__mark").alias("text_hash")))
    if similar is not None:
        drop(df.sparkSession, texts_path)
    drop(df.sparkSession, path)
    return out
