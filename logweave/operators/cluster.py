"""Leader clustering of lines by pattern distance, and its variant on classes of equal automata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.bounds import MASSES, Bound
from logweave.functions.distances import PairDistances
from logweave.functions.graphs import graphs
from logweave.functions.near import ALL, FEW as ALONE, Near
from logweave.functions.patterns import DEFAULT_THRESHOLD, PatternSet
from logweave.functions.shapes import Shapes
from logweave.functions.text import automaton, normalised_distance
from logweave.operators.automaton import automata
from logweave.operators.matching import CHARACTERS, LINES, pieces
from logweave.operators.storage import drop, new_path, settled, table, tasks

#: Undecided lines of a cell that a round settles at first; leaders that may go to every task; bytes of their lines that may.
BLOCK, FEW, FEW_BYTES = 64, 50_000, 16 << 20
#: Near pairs for each line of a round up to which the next one takes more lines, and times as many.
DENSE, GROWTH = 16, 8
#: Signs of the masses in the second coordinate of a cell.
SIGNS = [1, -1, -1, 1, 1, -1, 1, -1]

Leader = tuple[int, str]

NEAR = "line_id long, leader long, d double"
PREPARED = "line_id long, last long, line string, size long, kind int, seen long, " + ", ".join(f"m{k} double" for k in range(MASSES))


def prepared(lines: DataFrame, patterns: PatternSet) -> tuple[DataFrame, str]:
    """Distinct lines that are not null, as a table and its path: first and last id, length, its number of bits, and the patterns and masses of ``Bound``."""
    bound = Bound(patterns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes.of(patterns)
        for b in pieces(batches, 4 * LINES, 4 * CHARACTERS):
            size = b["line"].str.len()
            own = {"line_id": b["line_id"], "last": b["last"], "line": b["line"], "size": size, "kind": [n.bit_length() for n in size.tolist()], "seen": shapes.seen(b["line"].tolist())}
            yield pd.DataFrame(own | {f"m{k}": m for k, m in enumerate(bound.masses(b["line"].tolist()).T)})

    distinct = lines.where("line IS NOT NULL").groupBy("line").agg(F.min("line_id").alias("line_id"), F.max("line_id").alias("last"))
    return table(distinct.repartition(tasks(lines)).mapInPandas(run, PREPARED))


def _cells(rows: DataFrame, kinds: list[int], threshold: float, turned: bool) -> DataFrame:
    """``rows`` with the cells where they meet rows of each kind of length; if ``turned``, all cells around them, seen from the other side.

    Rows closer than the threshold differ in each mass coordinate by less than the threshold
    times the most that lengths of their kinds add up to, which is a cell's width.
    """
    own, other = F.col("kind"), F.col("other")
    width = max(threshold, 1e-12) * (F.pow(F.lit(2.0), own) + F.pow(F.lit(2.0), other))
    at = [F.floor(sum((s * F.col(f"m{k}") for k, s in enumerate(signs)), F.lit(0.0)) / width) for signs in ([1] * MASSES, SIGNS)]
    keyed = rows.withColumn("other", F.explode(F.array(*[F.lit(k) for k in kinds]) if kinds else F.array().cast("array<int>")))
    keyed = keyed.withColumns({"c0": at[0], "c1": at[1]})
    if not turned:
        return keyed.withColumns({"ka": own, "kb": other}).drop("other")
    around = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    keyed = keyed.withColumn("d0", F.explode(around)).withColumn("d1", F.explode(around))
    return keyed.withColumns({"ka": other, "kb": own, "c0": F.col("c0") + F.col("d0"), "c1": F.col("c1") + F.col("d1")}).drop("other", "d0", "d1")


def _seen(rows: DataFrame) -> tuple[int, int, list[int]]:
    """How many prepared lines there are, their characters, and their kinds, which are at most 32."""
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.sort_array(F.collect_set("kind")).alias("kinds")).first()
    return r["n"], r["size"], r["kinds"]


def candidate_pairs(lines: DataFrame, leaders: DataFrame, threshold: float, when: Column | None = None, kinds: list[int] | None = None) -> DataFrame:
    """``(line_id, line, leader, leader_line)``: pairs of prepared lines whose masses allow a distance below the threshold.

    Lines meet leaders in cells of the mass coordinates, so that far ones never do; leaders go
    to the tasks if they are few, else both sides are dealt by cell. ``when`` is a further
    condition, on ``leader``, ``line_id`` and ``last``; ``kinds`` are all kinds of ``lines``, where they are known.
    """
    n, size, theirs = _seen(leaders)
    kinds = _seen(lines)[2] if kinds is None else kinds
    left = _cells(lines, theirs, threshold, turned=False)
    right = _cells(leaders, kinds, threshold, turned=True).select("ka", "kb", "c0", "c1", F.col("line_id").alias("leader"), F.col("line").alias("leader_line"), F.col("size").alias("leader_size"), *[F.col(f"m{k}").alias(f"l{k}") for k in range(MASSES)])
    if n <= FEW and 9 * size * max(1, len(kinds)) <= FEW_BYTES:
        right = F.broadcast(right)
    apart = sum((F.abs(F.col(f"m{k}") - F.col(f"l{k}")) for k in range(MASSES)), F.lit(0.0))
    met = left.join(right, ["ka", "kb", "c0", "c1"]).where(apart * (1 - 1e-9) < threshold * (F.col("size") + F.col("leader_size")))
    return (met if when is None else met.where(when)).select("line_id", "line", "leader", "leader_line")


def near_pairs(pairs: DataFrame, patterns: PatternSet, threshold: float) -> DataFrame:
    """``(line_id, leader, d)`` of the pairs that are closer than the threshold.

    A task takes all pairs of a batch together: those whose lower bound reaches the threshold
    go, the others' distances are computed as arrays.
    """
    dfas, densities, bound = patterns.dfas(), patterns.densities(), Bound(patterns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes, lines = pd.factorize(pd.concat([b["line"], b["leader_line"]], ignore_index=True))
            x, y = codes[: len(b)], codes[len(b) :]
            g = graphs(lines.tolist(), patterns, dfas)
            size = np.array([len(w) for w in lines], np.int64)
            norm = (size[x] + size[y]).astype(float)
            rows = np.flatnonzero(bound.least(g, x, y) < threshold * norm)
            d = np.full(len(b), np.nan)
            if len(rows):
                d[rows] = PairDistances(g, densities, bound.weights)(x[rows], y[rows], threshold * norm[rows]) / norm[rows]
            near = np.flatnonzero(d == d)
            yield pd.DataFrame({"line_id": b["line_id"].to_numpy()[near], "leader": b["leader"].to_numpy()[near], "d": d[near]})

    return pairs.mapInPandas(run, NEAR)


def near(lines: DataFrame, leaders: DataFrame, patterns: PatternSet, threshold: float, until: str | None = None, free: str | None = None, kinds: list[int] | None = None) -> DataFrame:
    """``(line_id, leader, d)``: prepared leaders closer to prepared lines than the threshold, those with an id below the column ``until`` of the lines.

    Leaders below the column ``free`` are open to all rows of a line; of these, and those after
    them, it is enough to have the closest. Few leaders go to the tasks, which hold the lines
    against all of them where they are; of more each pair that meets in a cell is compared.
    """
    n, size, _ = _seen(leaders)
    if n > FEW or size > FEW_BYTES:
        return near_pairs(candidate_pairs(lines, leaders, threshold, None if until is None else F.col("leader") < F.col(until), kinds), patterns, threshold)
    known = leaders.select("line_id", "line").orderBy("line_id").collect()
    numbers, texts = [r["line_id"] for r in known], [r["line"] for r in known]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Near(numbers, texts, patterns, threshold)
        for b in pieces(batches, 10 * LINES, 16 * CHARACTERS):
            i, leader, d = of(b["line"].tolist(), b["seen"].to_numpy(), b["until"].to_numpy(), b["free"].to_numpy())
            yield pd.DataFrame({"line_id": b["line_id"].to_numpy()[i], "leader": leader, "d": d})

    bounds = [(F.lit(other) if c is None else F.col(c)).cast("long").alias(to) for c, other, to in ((until, ALL, "until"), (free, -ALL, "free"))]
    return lines.select("line_id", "line", "seen", *bounds).mapInPandas(run, NEAR)


def independent(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, str]:
    """``(line_id)`` and the path of its table: the nodes that no smaller member of this set has an edge to, as one pass in the order of ids would choose them.

    ``edges(line_id, leader)`` has each edge at its larger end. In a round every undecided node
    without an undecided smaller neighbour is chosen, and its neighbours are out; in a random
    order rounds are as many as the logarithm of the nodes.
    """
    spark, path = nodes.sparkSession, new_path(nodes.sparkSession, "decided")
    schema = "line_id long, chosen boolean"
    spark.createDataFrame([], schema).write.parquet(path)
    while True:
        decided = spark.read.schema(schema).parquet(path).select("line_id")
        left = nodes.select("line_id").join(decided, "line_id", "left_anti")
        links = edges.select("line_id", "leader").join(decided, "line_id", "left_anti").join(decided.withColumnRenamed("line_id", "leader"), "leader", "left_anti")
        chosen = left.join(links, "line_id", "left_anti")
        out = links.join(chosen.withColumnRenamed("line_id", "leader"), "leader", "left_semi").select("line_id").distinct()
        new, new_path_ = table(chosen.withColumn("chosen", F.lit(True)).unionByName(out.withColumn("chosen", F.lit(False))))
        if not new.limit(1).count():
            drop(spark, new_path_)
            return spark.read.schema(schema).parquet(path).where("chosen").select("line_id"), path
        new.write.mode("append").parquet(path)
        drop(spark, new_path_)


def _first_in_cells(left: DataFrame, threshold: float, most: int) -> tuple[int, int | None]:
    """Whether there is an undecided line, and the id up to which no cell has more than ``most`` of them; null if none has so many."""
    width = max(threshold, 1e-12) * F.pow(F.lit(2.0), F.col("kind") + 1)
    at = [F.floor(sum((s * F.col(f"m{k}") for k, s in enumerate(signs)), F.lit(0.0)) / width) for signs in ([1] * MASSES, SIGNS)]
    rank = F.row_number().over(Window.partitionBy("kind", "c0", "c1").orderBy("line_id"))
    ranked = left.select("line_id", "kind", at[0].alias("c0"), at[1].alias("c1")).withColumn("rank", rank).where(F.col("rank") <= most)
    return tuple(ranked.agg(F.count("*"), F.min(F.when(F.col("rank") == most, F.col("line_id")))).first())


def _dealt(df: DataFrame) -> DataFrame:
    """Lines of a table for work that takes long on few of them."""
    return df.repartition(tasks(df))


def find_leaders(lines: DataFrame, patterns: PatternSet, threshold: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame, list[str]]:
    """The leaders among prepared ``lines``, as prepared lines; ``(line_id, leader, d)``, leaders below the threshold of each line that are smaller than its last id, without some that are further away than one smaller than its first; and paths to drop.

    A leader is a line that no leader with a smaller id is closer to than the threshold. A
    round takes the undecided lines up to the id at which some cell has ``block`` of them,
    so it holds a few of each dense cell and all of sparse ones; finds the pairs among
    them that are near, and of these lines the leaders as an independent set; and compares all
    lines with these leaders, each pair of line and leader once in all rounds. What they reach
    is decided. Blocks grow while few of their lines are near each other, so rounds stay few
    where leaders are many. The driver sees an id and a few counts a round, and leaders that
    are few enough to go to the tasks.
    """
    spark = lines.sparkSession
    leaders_path, near_path = new_path(spark, "leaders"), new_path(spark, "near")
    spark.createDataFrame([], PREPARED).write.parquet(f"{leaders_path}/round-0")
    spark.createDataFrame([], NEAR).write.parquet(near_path)
    kinds = _seen(lines)[2]
    left, left_path, number = lines, None, 0
    while True:
        there, last = _first_in_cells(left, threshold, block)
        if not there:
            break
        number += 1
        own, own_path = table(left if last is None else left.where(F.col("line_id") <= last))
        inner, inner_path = table(near(_dealt(own), own, patterns, threshold, until="line_id", kinds=kinds))
        chosen, chosen_path = independent(own, inner)
        own.join(chosen, "line_id", "left_semi").write.parquet(f"{leaders_path}/round-{number}")
        new = spark.read.schema(PREPARED).parquet(f"{leaders_path}/round-{number}")
        near(lines, new, patterns, threshold, until="last", free="line_id", kinds=kinds).write.mode("append").parquet(near_path)
        if inner.count() <= DENSE * own.count():
            block = max(block, min(block * GROWTH, FEW // 2))
        found = spark.read.schema(NEAR).parquet(near_path)
        for done in (own_path, inner_path, chosen_path):
            drop(spark, done)
        if last is None:
            break
        covered = found.where(F.col("leader") < F.col("line_id")).select("line_id").distinct()
        rest, rest_path = table(left.where(F.col("line_id") > last).join(covered, "line_id", "left_anti"))
        if left_path:
            drop(spark, left_path)
        left, left_path = rest, rest_path
    if left_path:
        drop(spark, left_path)
    leaders = spark.read.schema(PREPARED).option("recursiveFileLookup", "true").parquet(leaders_path)
    return leaders, spark.read.schema(NEAR).parquet(near_path), [leaders_path, near_path]


def nearest_leaders(lines: DataFrame, leaders: DataFrame, patterns: PatternSet, threshold: float, closest: bool = False) -> DataFrame:
    """``(line, stairs)`` for distinct lines: (leader, distance) of ``leaders(leader, line)`` below the threshold, in the order of their numbers; if ``closest``, further ones may be missing."""
    own, own_path = prepared(lines, patterns)
    theirs, theirs_path = prepared(leaders.select(F.col("leader").alias("line_id"), "line"), patterns)
    found, found_path = table(near(own.withColumn("free", F.lit(ALL)), theirs, patterns, threshold, free="free" if closest else None))
    out = settled(own.select("line_id", "line").join(stairs_of(found), "line_id").select("line", "stairs"))
    for done in (own_path, theirs_path, found_path):
        drop(lines.sparkSession, done)
    return out


def stairs_of(near: DataFrame) -> DataFrame:
    """``(line_id, stairs)`` of ``near(line_id, leader, d)``."""
    return near.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("leader", "d"))).alias("stairs"))


def _closest(stairs: Column | str) -> Column:
    """The step with the least distance, of equals the first leader."""
    return F.try_element_at(F.array_sort(F.transform(stairs, lambda s: F.struct(s["d"].alias("d"), s["leader"].alias("leader")))), F.lit(1))


def few(leaders: DataFrame) -> list[Leader] | None:
    """The first numbers of the distinct lines of ``leaders(leader, line)``, in their order; None if they are more than each line may be held against where it is read."""
    rows = leaders.where("line IS NOT NULL").groupBy("line").agg(F.min("leader").alias("leader")).limit(ALONE + 1).collect()
    return None if len(rows) > ALONE or sum(len(r["line"]) for r in rows) > FEW_BYTES else sorted((r["leader"], r["line"]) for r in rows)


def closest(lines: DataFrame, leaders: list[Leader], patterns: PatternSet, threshold: float, until: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(line_id, leader, d)`` for each row of ``lines(line_id, line)``, null where no leader is near; of leaders numbered below what ``until`` gives for a line's id.

    Lines are held against all leaders where they are read; nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Near([n for n, _ in leaders], [x for _, x in leaders], patterns, threshold)
        for b in pieces(batches, 10 * LINES, 16 * CHARACTERS):
            ids = b["line_id"].to_numpy(np.int64)
            codes, own = pd.factorize(b["line"].to_numpy(object))
            limit = np.full(len(own), ALL)
            if until is not None:  # equal lines have limits of their own
                there = np.flatnonzero(codes >= 0)
                limit, own = until(ids[there]), own[codes[there]]
                codes = np.full(len(b), -1)
                codes[there] = np.arange(len(there))
            i, leader, d = of(own.tolist(), of.shapes.seen(own.tolist()), limit, limit)
            order = np.lexsort((leader, d, i))
            first = order[np.diff(i[order], prepend=-1) != 0]
            found = pd.DataFrame({"leader": pd.Series(leader[first], i[first], "Int64"), "d": pd.Series(d[first], i[first])}).reindex(codes)
            yield pd.DataFrame({"line_id": ids, "leader": found["leader"].array, "d": found["d"].array})

    found = lines.select(F.col("line_id").cast("long").alias("line_id"), "line").mapInPandas(run, NEAR)
    return found.withColumn("line_id", F.col("line_id").cast(lines.schema["line_id"].dataType))


def nearest_representative(lines: DataFrame, leaders: DataFrame | list[Leader], patterns: PatternSet | None = None, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``(line_id, leader, d)``: the closest of ``leaders(line_id, line)`` below the threshold, of equals the first; null if there is none."""
    if isinstance(leaders, list):
        leaders = lines.sparkSession.createDataFrame(leaders, "line_id long, line string")
    patterns, leaders = patterns or PatternSet.default(), leaders.select(F.col("line_id").alias("leader"), "line")
    if (known := few(leaders)) is not None:
        return closest(lines, known, patterns, threshold)
    stairs = nearest_leaders(lines, leaders, patterns, threshold, closest=True)
    best = _closest("stairs")
    return lines.join(stairs, "line", "left").select("line_id", best["leader"].alias("leader"), best["d"].alias("d"))


def cluster(lines: DataFrame, patterns: PatternSet | None = None, threshold: float = DEFAULT_THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(line_id, cluster_id)`` of one pass over the lines in the order of their ids.

    A line joins the closest earlier leader below the threshold (of equals the first), else
    it becomes a leader; ids are those of leaders. Null lines count as empty; empty lines
    are clusters of their own below a threshold of 1. The result equals the sequential pass:
    each row looks among leaders before it only.
    """
    patterns = patterns or PatternSet.default()
    spark = lines.sparkSession
    lines = lines.select("line_id", F.coalesce("line", F.lit("")).alias("line"))
    own, path = prepared(lines, patterns)
    leaders, near, paths = find_leaders(own, patterns, threshold, block)
    if (known := few(leaders.select(F.col("line_id").alias("leader"), "line"))) is not None:
        for done in (path, *paths):
            drop(spark, done)
        found = closest(lines, known, patterns, threshold, until=lambda ids: ids)
        return found.select("line_id", F.coalesce("leader", "line_id").alias("cluster_id"))
    stairs = settled(own.select("line_id", "line").join(stairs_of(near), "line_id").select("line", "stairs"))
    for done in (path, *paths):
        drop(spark, done)
    rows = lines.join(stairs, "line", "left")
    best = _closest(F.filter("stairs", lambda s: s["leader"] < F.col("line_id")))
    return rows.select("line_id", F.coalesce(best["leader"], F.col("line_id")).alias("cluster_id"))


def cluster_preprocessed(lines: DataFrame, patterns: PatternSet | None = None, threshold: float = DEFAULT_THRESHOLD, id_space: str = "row", same: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``cluster`` of the first line of each class of equal automata; the other lines get its cluster.

    ``id_space`` "row" gives ids of lines, "distinct" their ranks among the first lines.
    ``same`` replaces the classes: a function from lines to ``(line_id, signature)``.
    """
    patterns = patterns or PatternSet.default()
    lines = lines.select("line_id", F.coalesce("line", F.lit("")).alias("line"))
    classes = settled((same or (lambda x: automata(x, patterns).select("line_id", "signature")))(lines))
    firsts = classes.groupBy("signature").agg(F.min("line_id").alias("line_id"))
    found = cluster(lines.join(firsts, "line_id", "left_semi"), patterns, threshold)
    if id_space == "distinct":
        ranks = settled(found.select("line_id").orderBy("line_id").withColumn("n", F.monotonically_increasing_id()))
        from logweave.sources.lines import dense

        ranks = dense(ranks.select("line_id"), "rank").select(F.col("line_id").alias("cluster_id"), "rank")
        found = found.join(ranks, "cluster_id").select("line_id", F.col("rank").alias("cluster_id"))
    named = firsts.join(found, "line_id").select("signature", "cluster_id")
    return classes.join(named, "signature").select("line_id", "cluster_id")


def sequential(lines: list[str], patterns: PatternSet, threshold: float) -> list[int]:
    """The one-pass form, a pair at a time, for small lists and tests."""
    dfas, densities = patterns.dfas(), patterns.densities()
    leaders, out = [], []
    for i, line in enumerate(lines):
        g = automaton(line, patterns, dfas)
        found = [(d, j) for j, leader in leaders if (d := normalised_distance(leader, g, densities, threshold)) is not None]
        out.append(min(found)[1] if found else i)
        if not found:
            leaders.append((i, g))
    return out
