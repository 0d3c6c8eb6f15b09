"""Distances of two string columns: all pairs of an Arrow batch at a time, as arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.bounds import Bound
from logweave.functions.distances import PairDistances, lcs_distances, lcs_lengths
from logweave.functions.graphs import graphs
from logweave.functions.patterns import PatternSet
from logweave.functions.shapes import Shapes

#: Costs from here on count as out of reach.
INFINITY = 100_000.0
#: Pairs whose automata are held at a time.
TOGETHER = 4096


def _of_pairs(a: pd.Series, b: pd.Series, measure: Callable[[list[str], np.ndarray, np.ndarray], np.ndarray]) -> tuple[pd.Series, np.ndarray]:
    """Where both sides are given, and the measure of each pair of strings there, taken once for equal pairs."""
    there = a.notna() & b.notna()
    codes, strings = pd.factorize(pd.concat([a[there], b[there]], ignore_index=True))
    n = len(codes) // 2
    at, pairs = pd.factorize(codes[:n].astype(np.int64) * len(strings) + codes[n:])
    return there, measure(strings.tolist(), pairs // max(1, len(strings)), pairs % max(1, len(strings)))[at] if n else np.zeros(0)


def _whole(a: pd.Series, b: pd.Series, measure: Callable) -> pd.Series:
    out = pd.Series(pd.NA, a.index, "Int32")
    there, found = _of_pairs(a, b, measure)
    out[there] = found.astype(np.int32)
    return out


@F.pandas_udf(T.IntegerType())
def _lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return _whole(a, b, lcs_lengths)


@F.pandas_udf(T.IntegerType())
def _lcs_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return _whole(a, b, lcs_distances)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; null if a side is."""
    return _lcs_length(a, b)


def lcs_distance(a: Column, b: Column) -> Column:
    """Deletions and insertions that turn one string into the other; null if a side is."""
    return _lcs_distance(a, b)


def pattern_distance(a: Column, b: Column, patterns: PatternSet | None = None, normalized: bool = False, limit: float = INFINITY) -> Column:
    """Pattern distance of two lines; null if a side is, and where the cost reaches ``limit`` (times the summed lengths if normalised)."""
    patterns = patterns or PatternSet.default()
    dfas, densities, bound = patterns.dfas(), patterns.densities(), Bound(patterns)

    def measure(lines: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size = np.array([len(x) for x in lines], np.int64)
        norm = (size[i] + size[j]).astype(float) if normalized else np.ones(len(i))
        # two empty lines have no normalised distance: their limit is 0
        most, out = limit * norm, np.full(len(i), np.nan)
        # whole lines cost their lengths at most, so only lower limits are worth a bound
        low = most <= size[i] + size[j]
        near = ~low
        near[low] = bound.least_of_seen(lines, bound.seen(lines, dfas), i[low], j[low]) < most[low] if low.any() else False
        shapes, rows = Shapes.of(patterns), np.flatnonzero(near)
        own = shapes.lines(lines)
        place = shapes.known(own.shape[i[rows]], own.shape[j[rows]])
        rest, rows, place = rows[place < 0], rows[place >= 0], place[place >= 0]
        out[rows] = shapes.distances(own, own, i[rows], j[rows], place, most[rows])
        for rows in np.split(rest, np.arange(TOGETHER, len(rest), TOGETHER)):
            if len(rows):
                own, at = np.unique(np.concatenate([i[rows], j[rows]]), return_inverse=True)
                of = PairDistances(graphs([lines[k] for k in own.tolist()], patterns, dfas), densities, bound.weights)
                out[rows] = of(at[: len(rows)], at[len(rows) :], most[rows])
        return out / np.where(norm > 0, norm, 1.0)

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, x.index)
        there, found = _of_pairs(x, y, measure)
        out[there] = found
        return out

    return run(a, b)
