"""Near pairs of many lines and many leaders: lower bounds as arrays over all pairs, exact distances of the pairs they leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from logweave.functions.bounds import LETTERS, Bound
from logweave.functions.distances import PairDistances, lcs_distances
from logweave.functions.graphs import graphs
from logweave.functions.patterns import PatternSet
from logweave.functions.scan import CODES
from logweave.functions.shapes import Lines, Shapes

#: Lines and leaders whose characters are compared in one array; lines whose exact distances are taken together.
ROWS, COLUMNS, TOGETHER = 512, 2048, 2048
#: Leaders that lines may be held against by their shapes alone, lines that are taken together then, and pairs there are at least for each pair of shapes.
FEW, MANY, EACH = 64, 8192, 16
#: Beyond all numbers of leaders.
ALL = np.iinfo(np.int64).max


class Near:
    """The leaders ``(numbers, lines)`` that lines are held against.

    Few leaders and lines of few shapes are compared by these. Else a pair goes where its characters alone cost the limit, or else where what their common
    subsequences leave does; the distances of the rest are computed, a line's most
    promising leaders first.
    """

    def __init__(self, numbers: list[int], leaders: list[str], patterns: PatternSet, threshold: float):
        self.patterns, self.dfas, self.densities, self.threshold = patterns, patterns.dfas(), patterns.densities(), threshold
        self.bound = Bound(patterns)
        self.numbers, self.leaders = np.array(numbers, np.int64), leaders
        self.counts, self.seen = self.bound.counts(leaders).astype(np.int32), self.bound.seen(leaders, self.dfas)
        self.shapes = Shapes.of(patterns)
        self._theirs = self.shapes.lines(leaders)
        self.size = np.array([len(x) for x in leaders], np.int64)
        self._kept: dict[tuple, tuple[np.ndarray, list[str]]] = {}

    def _alike(self, lines: list[str], seen: np.ndarray, size: np.ndarray, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(lines, leaders, lower bounds, weights of characters) of the pairs that the numbers of their characters leave, of leaders numbered below ``until``."""
        counts = self.bound.counts(lines).astype(np.int32)
        for x in np.unique(seen):
            for y in np.unique(self.seen):
                weights = self.bound.weights_of_seen(int(x & y))
                mine, theirs = np.flatnonzero(seen == x), np.flatnonzero(self.seen == y)
                for at in np.array_split(theirs, 1 + len(theirs) // COLUMNS):
                    there = np.concatenate([counts[mine], self.counts[at]])
                    varied = np.flatnonzero(there.max(axis=0, initial=0) != there.min(axis=0, initial=1 << 30))
                    for own in np.array_split(mine, 1 + len(mine) // ROWS):
                        low = np.zeros((len(own), len(at)))
                        for w in np.unique(weights[varied]):
                            each = np.zeros(low.shape, np.int32)
                            for c in varied[weights[varied] == w]:
                                each += np.abs(counts[own, c][:, None] - self.counts[at, c][None, :])
                            low += w * each
                        low *= 1 - 1e-9  # sums of many terms may round up
                        i, j = np.nonzero((low < self.threshold * (size[own][:, None] + self.size[at][None, :])) & (self.numbers[at][None, :] < until[own][:, None]))
                        if len(i):
                            yield own[i], at[j], low[i, j], weights

    def _layers(self, weights: np.ndarray) -> list[tuple[float, dict[int, None]]]:
        """Steps of weight, the highest first, and the characters to leave out that weigh less.

        A character weighs the sum of the steps up to its weight, and what a path leaves of
        the characters that weigh so much at least is no less than their own common subsequence leaves.
        """
        levels: list[float] = []
        for w in np.unique(weights[weights > 0]).tolist():
            if not levels or w > 1.1 * levels[-1]:
                levels.append(w)
        while len(levels) > 1 and levels[0] < levels[1] / 4:
            levels.pop(0)
        lighter = [{p: None for p in range(128) if weights[CODES[p]] < w} for w in levels]
        if levels and weights[0] < levels[-1]:
            return []  # other characters are to be left out too, which no table lists
        return list(zip(np.diff(levels, prepend=0.0).tolist(), lighter))[::-1]

    def pairs(self, lines: list[str], seen: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines, leaders, lower bounds) of the pairs that may be closer than the threshold."""
        size = np.array([len(x) for x in lines], np.int64)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        kept: dict[tuple, tuple[np.ndarray, list[str]]] = {}
        for i, j, low, weights in self._alike(lines, seen, size, until):
            limit, layered = self.threshold * (size[i] + self.size[j]), np.zeros(len(i))
            for step, lighter in self._layers(weights):
                key = tuple(lighter)
                (mine, own), (theirs, other) = (x.get(key) or x.setdefault(key, _without(lighter, y)) for x, y in ((kept, lines), (self._kept, self.leaders)))
                at, both = pd.factorize(mine[i] * len(other) + theirs[j])
                (x, x_at), (y, y_at) = (np.unique(c, return_inverse=True) for c in (both // len(other), both % len(other)))
                strings = [*(own[k] for k in x.tolist()), *(other[k] for k in y.tolist())]
                layered += step * (1 - 1e-9) * lcs_distances(strings, x_at, len(x) + y_at)[at]
                low = np.maximum(low, layered)
                left = low < limit
                i, j, low, limit, layered = (v[left] for v in (i, j, low, limit, layered))
                if not len(i):
                    break
            out.append((i, j, low))
        return tuple(np.concatenate(c) for c in zip(*out))

    def __call__(self, lines: list[str], seen: np.ndarray, until: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines, numbers of leaders, distances) of the pairs closer than the threshold, of leaders numbered below ``until``.

        Of the leaders numbered below ``free``, which are open to a line anyway, and those
        further on, none has to be there that is further away than one below ``free``.
        """
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        together = MANY if len(self.leaders) <= FEW else TOGETHER
        for at in range(0, len(lines), together):
            own = slice(at, at + together)
            i, j, d = self._some(lines[own], seen[own], until[own], free[own])
            out.append((i + at, self.numbers[j], d))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _by_shape(self, own: Lines, size: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``pairs`` of the lines that have a shape, and which lines these are; none where leaders or shapes are too many."""
        theirs = self._theirs
        plain = np.flatnonzero(own.shape >= 0)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(len(size), bool)
        if len(self.leaders) > FEW or (theirs.shape < 0).any() or not len(plain):
            return none
        shapes, at = np.unique(own.shape[plain], return_inverse=True)
        others, to = np.unique(theirs.shape, return_inverse=True)
        if len(shapes) * len(others) * EACH > len(plain) * len(self.leaders):
            return none
        place = self.shapes.known(np.repeat(shapes, len(others)), np.tile(others, len(shapes)), find=True).reshape(len(shapes), len(others))
        low = self.shapes.least(place)[:, to] * (1 - 1e-9)
        # the lines of a shape have one length
        lengths = np.array([len(self.shapes.shapes[k]) for k in shapes.tolist()], np.int64)
        near = low < self.threshold * (lengths[:, None] + self.size[None, :])
        i, j = np.nonzero(near[at] & (self.numbers[None, :] < until[plain][:, None]))
        return plain[i], j, low[at[i], j], own.shape >= 0

    def _some(self, lines: list[str], seen: np.ndarray, until: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = self.shapes.lines(lines)
        if self._theirs.generation != own.generation:
            self._theirs = self.shapes.lines(self.leaders)
        size = np.array([len(x) for x in lines], np.int64)
        i, j, low, done = self._by_shape(own, size, until)
        rest = np.flatnonzero(~done)
        if len(rest):
            x, y, least = self.pairs([lines[k] for k in rest.tolist()], seen[rest], until[rest])
            i, j, low = (np.concatenate(c) for c in ((i, rest[x]), (j, y), (low, least)))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        place = self.shapes.known(own.shape[i], self._theirs.shape[j])
        known = place >= 0
        low[known] = np.maximum(low[known], self.shapes.least(place[known]) * (1 - 1e-9))
        if len(i):
            mine, theirs = np.unique(i[~known]), np.unique(j[~known])
            of = PairDistances(graphs([*(lines[k] for k in mine), *(self.leaders[k] for k in theirs)], self.patterns, self.dfas), self.densities, self.bound.weights) if len(mine) else None
            order = np.lexsort((low, i))
            i, j, low, place = i[order], j[order], low[order], place[order]
            best, turn = np.full(len(lines), np.inf), 1
            while len(i):
                now = np.arange(len(i)) - np.searchsorted(i, i) < turn
                x, y, at = i[now], j[now], place[now]
                norm = (size[x] + self.size[y]).astype(float)
                limit, d = self.threshold * norm, np.full(len(x), np.nan)
                one, other = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                # what is further away than the best so far need not be there
                d[one] = self.shapes.distances(own, self._theirs, x[one], y[one], at[one], np.minimum(limit, best[x] * norm * (1 + 1e-9) + 1e-9)[one])
                if len(other):
                    d[other] = of(np.searchsorted(mine, x[other]), len(mine) + np.searchsorted(theirs, y[other]), limit[other])
                d /= norm
                near = d == d
                out.append((x[near], y[near], d[near]))
                open_ = near & (self.numbers[y] < free[x])
                np.minimum.at(best, x[open_], d[open_])
                i, j, low, place = (v[~now] for v in (i, j, low, place))
                left = low <= best[i] * (size[i] + self.size[j])
                i, j, low, place, turn = i[left], j[left], low[left], place[left], 2 * turn
        return tuple(np.concatenate(c) for c in zip(*out))


def _without(lighter: dict[int, None], lines: list[str]) -> tuple[np.ndarray, list[str]]:
    """Each line's number among the distinct ones, and these, without some characters."""
    codes, strings = pd.factorize(np.array([x.translate(lighter) for x in lines], object))
    return codes.astype(np.int64), strings.tolist()
