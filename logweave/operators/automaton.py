"""Pattern automata of lines as rows: vertices, arcs, sizes and a signature."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.graphs import Graphs, graphs
from logweave.functions.paths import cheapest_paths, weights_by_name
from logweave.functions.patterns import PatternSet
from logweave.operators.matching import pieces
from logweave.operators.storage import settled


def automata(lines: DataFrame, patterns: PatternSet, strategy: str | Callable = "largest", filtered: Iterable[str] = ()) -> DataFrame:
    """``(line_id, n_vertices, n_arcs, signature)``; lines with equal signatures have equal automata. Null counts as an empty line."""
    dfas, filtered = patterns.dfas(), tuple(filtered)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            found = graphs(b["line"], patterns, dfas, strategy, filtered)
            vertices, arcs = found.counts()
            yield pd.DataFrame({"line_id": b["line_id"], "n_vertices": vertices.astype(np.int32), "n_arcs": arcs.astype(np.int32), "signature": found.signatures()})

    return lines.select("line_id", "line").mapInPandas(run, "line_id long, n_vertices int, n_arcs int, signature string")


def arcs(lines: DataFrame, patterns: PatternSet, strategy: str | Callable = "largest", filtered: Iterable[str] = ()) -> DataFrame:
    """``(line_id, src, dst, name, infix)``, a row for each arc."""
    dfas, filtered = patterns.dfas(), tuple(filtered)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            found = graphs(b["line"], patterns, dfas, strategy, filtered)
            infix = [found.lines[i][j:k] for i, j, k in zip(found.line.tolist(), found.src.tolist(), found.dst.tolist())]
            names = np.array(found.names, object)[found.name]
            yield pd.DataFrame({"line_id": b["line_id"].to_numpy()[found.line], "src": found.src.astype(np.int32), "dst": found.dst.astype(np.int32), "name": names, "infix": infix})

    return lines.select("line_id", "line").mapInPandas(run, "line_id long, src int, dst int, name string, infix string")


def delta(line: Column | str, src: Column | str, name: Column | str, patterns: PatternSet) -> Column:
    """Where the arc of a name leads from a vertex of a line's automaton; null if there is none, and for nulls."""
    dfas = patterns.dfas()

    @F.pandas_udf("int")
    def run(lines: pd.Series, places: pd.Series, names: pd.Series) -> pd.Series:
        there = np.flatnonzero(lines.notna() & places.notna() & names.notna())
        at, distinct = pd.factorize(lines.iloc[there])
        g = graphs(distinct.tolist(), patterns, dfas)
        wide, many = 1 + max((len(x) for x in g.lines), default=0), len(g.names) + 1
        key = lambda i, u, n: (i * wide + u) * many + n
        known = key(g.line, g.src, g.name)
        order = np.argsort(known)
        u = places.iloc[there].to_numpy(np.int64)
        number = pd.Index(g.names).get_indexer(names.iloc[there])
        asked = key(at, np.clip(u, 0, wide - 1), np.where(number < 0, many - 1, number))
        found = order[np.minimum(np.searchsorted(known, asked, sorter=order), max(0, len(known) - 1))] if len(known) else np.zeros(len(asked), np.int64)
        hit = (known[found] == asked) & (u >= 0) & (u < wide) if len(known) else np.zeros(len(asked), bool)
        out = pd.Series(pd.NA, lines.index, "Int32")
        out.iloc[there[hit]] = g.dst[found[hit]].astype(np.int32)
        return out

    return run(*(F.col(c) if isinstance(c, str) else c for c in (line, src, name)))


def paths(lines: DataFrame, patterns: PatternSet, weights: Mapping[str, float] | None = None, weigh: Callable[[Graphs], np.ndarray] | None = None) -> DataFrame:
    """``(line_id, cost, path)``: the cheapest decomposition of a line, as names joined by spaces.

    An arc weighs its pattern's density, or what ``weights`` has for its name (1 for a name
    that is missing there), or what ``weigh`` gives for each arc of the automata of a batch.
    Null counts as an empty line, whose path has no arcs.
    """
    dfas, known = patterns.dfas(), patterns.densities() if weights is None else dict(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            g = graphs(b["line"], patterns, dfas)
            found = cheapest_paths(g, weights_by_name(g, known) if weigh is None else weigh(g))
            names = np.array(g.names, object)[g.name[found.arc]]
            ends = np.cumsum(np.bincount(found.line, minlength=len(b)))[:-1]
            yield pd.DataFrame({"line_id": b["line_id"], "cost": found.cost, "path": [" ".join(own) for own in np.split(names, ends)]})

    return lines.select("line_id", "line").mapInPandas(run, "line_id long, cost double, path string")


def slices(lines: DataFrame, patterns: PatternSet, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``(line_id, place, name, j, k, text)``: the arcs of each line's cheapest path, in order."""
    dfas, known = patterns.dfas(), patterns.densities() if weights is None else dict(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            g = graphs(b["line"], patterns, dfas)
            found = cheapest_paths(g, weights_by_name(g, known))
            j, k = g.src[found.arc], g.dst[found.arc]
            place = np.arange(len(found.line)) - np.searchsorted(found.line, found.line)
            text = [g.lines[i][a:b] for i, a, b in zip(found.line.tolist(), j.tolist(), k.tolist())]
            names = np.array(g.names, object)[g.name[found.arc]]
            yield pd.DataFrame({"line_id": b["line_id"].to_numpy()[found.line], "place": place.astype(np.int32), "name": names, "j": j.astype(np.int32), "k": k.astype(np.int32), "text": text})

    return lines.select("line_id", "line").mapInPandas(run, "line_id long, place int, name string, j int, k int, text string")


def signature_groups(lines: DataFrame, patterns: PatternSet) -> DataFrame:
    """``(line_id, group_id)``: lines with equal automata, by the smallest line id of the group."""
    found = settled(automata(lines, patterns).select("line_id", "signature"))
    groups = found.groupBy("signature").agg(F.min("line_id").alias("group_id"))
    return found.join(groups, "signature").select("line_id", "group_id")
