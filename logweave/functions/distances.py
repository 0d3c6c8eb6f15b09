"""Distances of many pairs at a time: longest common subsequences and pattern distances as arrays over all pairs of a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd

from logweave.functions.graphs import Graphs
from logweave.functions.scan import CODES
from logweave.functions.text import Automaton, pattern_distance

#: Bytes of the tables of characters, pairs of vertices, and pairs of arcs that are taken together.
TABLE, STATES, STEPS = 1 << 25, 1 << 20, 1 << 20
#: Pairs of vertices or of arcs from which on a pair of lines is taken alone, best first.
HUGE = 1 << 22


def lcs_lengths(strings: Sequence[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``strings[i]`` and ``strings[j]``, pair by pair.

    A row of the table is kept as bits, in as many 64-bit words as the shorter string needs;
    all pairs take a character of their longer string at a time, and a carry goes from word to word.
    """
    size = np.array([len(s) for s in strings], np.int64)
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    known, code = np.unique(points, return_inverse=True)
    offset = np.cumsum(size) - size
    turn = size[i] > size[j]
    a, b = np.where(turn, j, i), np.where(turn, i, j)
    out = np.zeros(len(a), np.int64)
    words = (size[a] + 63) // 64
    for width in np.unique(words[words > 0]).tolist():
        rows = np.flatnonzero(words == width)
        rows = rows[np.argsort(a[rows], kind="stable")]
        number = np.cumsum(np.diff(a[rows], prepend=-1) != 0) - 1
        for part in np.split(rows, np.flatnonzero(np.diff(number // max(1, TABLE // (8 * width * len(known))))) + 1):
            out[part] = _lcs_of_width(a[part], b[part], width, size, offset, code, len(known))
    return out


def _lcs_of_width(a: np.ndarray, b: np.ndarray, width: int, size: np.ndarray, offset: np.ndarray, code: np.ndarray, letters: int) -> np.ndarray:
    order = np.argsort(-size[b], kind="stable")
    a, b = a[order], b[order]
    own, at = np.unique(a, return_inverse=True)
    place = np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
    where = np.zeros((len(own), width, letters), np.uint64)
    row = np.repeat(np.arange(len(own)), size[own])
    np.bitwise_or.at(where, (row, place >> 6, code[offset[own][row] + place]), np.uint64(1) << (place & 63).astype(np.uint64))
    state = np.full((width, len(a)), 2**64 - 1, np.uint64)
    active = np.searchsorted(-size[b], -np.arange(size[b].max(initial=0)), "left")  # pairs whose longer string has a further character
    for t, n in enumerate(active.tolist()):
        c, carry = code[offset[b[:n]] + t], np.zeros(n, np.uint64)
        for w in range(width):
            v = state[w, :n]
            hit = v & where[at[:n], w, c]
            low = v + hit
            high = low + carry
            carry = ((low < v) | (high < low)).astype(np.uint64)
            state[w, :n] = high | (v - hit)
    last = (size[a] - 1 & 63).astype(np.uint64)
    state[width - 1] &= np.uint64(2**64 - 1) >> (np.uint64(63) - last)
    out = np.empty(len(a), np.int64)
    out[order] = size[a] - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
    return out


def lcs_distances(strings: Sequence[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Deletions and insertions between ``strings[i]`` and ``strings[j]``."""
    size = np.array([len(s) for s in strings], np.int64)
    return size[i] + size[j] - 2 * lcs_lengths(strings, i, j)


class PairDistances:
    """Pattern distances of pairs of the lines of some ``Graphs``.

    The product of two graphs is passed in the order of the first one's vertices, all pairs
    of a group of lines at once: a row holds the least costs at a vertex of the first line
    and all of the second. ``weights`` of characters, where they are given, are what each costs
    at least that only one of two lines has (``Bound``): steps between places whose
    characters before and after differ by the limit are left out.
    """

    def __init__(self, g: Graphs, densities: Mapping[str, float], weights: np.ndarray | None = None):
        self.g, self.known = g, dict(densities)
        self.size = np.array([len(x) for x in g.lines], np.int64)
        self.vertices, _ = g.counts()
        self.first = np.cumsum(self.vertices) - self.vertices
        wide = 1 + int(self.size.max(initial=0))
        keys = g.vertex_line * wide + g.vertex
        src, dst = (np.searchsorted(keys, g.line * wide + x) for x in (g.src, g.dst))
        names = len(g.names)
        by = np.lexsort((dst, g.name, g.line))
        line, name = g.line[by], g.name[by]
        self.src, self.dst = (x[by] - self.first[line] for x in (src, dst))
        self.name, self.place = name, g.src[by]
        self.count = np.bincount(line * names + name, minlength=len(g.lines) * names).reshape(-1, names)
        self.start = (np.cumsum(self.count) - self.count.ravel()).reshape(-1, names)
        seen: dict[str, int] = {}
        self.infix = np.array([seen.setdefault(g.lines[n][j:k], len(seen)) for n, j, k in zip(line.tolist(), g.src[by].tolist(), g.dst[by].tolist())], np.int64)
        self.strings = list(seen)
        self.length = np.array([len(s) for s in self.strings], np.int64)
        self.density = np.array([self.known.get(x, 1.0) for x in g.names])
        # a column for each arc into a vertex, whatever its name: where it comes from and how long it is
        self.back, self.gap = self._into(src, dst)
        self._automata: list[Automaton] | None = None
        self.mass = None
        if weights is not None:
            points = np.frombuffer("".join(g.lines).encode("utf-32-le", "surrogatepass"), "<u4")
            sums = np.concatenate([[0.0], np.cumsum(weights[np.where(points < 128, CODES[points & 127], 0)])])
            offset = np.cumsum(self.size) - self.size
            self.mass = sums[offset + self.size] - sums[offset]
            self.before, self.after = sums[offset[line] + g.src[by]] - sums[offset[line]], sums[(offset + self.size)[line]] - sums[offset[line] + g.dst[by]]

    def _into(self, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, keys = self.g, len(self.g.vertex)
        into, out_of = np.divmod(np.unique(dst * keys + src), max(1, keys))
        column = np.arange(len(into)) - np.searchsorted(into, into)
        back = np.full((keys, 1 + int(column.max(initial=-1))), -1, np.int64)
        gap = np.full(back.shape, np.inf)
        back[into, column] = out_of - self.first[g.vertex_line[into]]
        gap[into, column] = g.vertex[into] - g.vertex[out_of]
        return back, gap

    def turned(self) -> tuple[np.ndarray, np.ndarray]:
        """``back`` and ``gap`` of the same graphs from their ends, vertices counted from the last one of each line."""
        line = np.repeat(np.arange(len(self.vertices)), self.vertices)
        at = np.arange(len(line)) - self.first[line]
        row, column = np.nonzero(self.back >= 0)
        end = self.vertices[line[row]] - 1
        into, out_of = self.first[line[row]] + end - self.back[row, column], end - at[row]
        order = np.argsort(into, kind="stable")
        into, out_of, length = into[order], out_of[order], self.gap[row, column][order]
        place = np.arange(len(into)) - np.searchsorted(into, into)
        back = np.full((len(line), 1 + int(place.max(initial=-1))), -1, np.int64)
        gap = np.full(back.shape, np.inf)
        back[into, place], gap[into, place] = out_of, length
        return back, gap

    def __call__(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The least cost of a common path through both automata of each pair; NaN if it is not below its limit."""
        out = np.full(len(a), np.nan)
        states = self.vertices[a] * self.vertices[b]
        steps = (self.count[a] * self.count[b]).sum(axis=1)
        alone = (states > HUGE) | (steps > HUGE)
        for p in np.flatnonzero(alone & (limit > 0)).tolist():
            self._automata = self._automata or self.g.automata()
            d = pattern_distance(self._automata[a[p]], self._automata[b[p]], self.known, limit[p])
            out[p] = np.nan if d is None else d
        order = np.flatnonzero(~alone & (limit > 0))
        order = order[np.lexsort((self.vertices[b[order]], self.vertices[a[order]]))]
        begin, wide, high, sum_of_steps = 0, 0, 0, 0
        for end, p in enumerate(order.tolist()):
            wide, high, sum_of_steps = max(wide, self.vertices[b[p]]), max(high, self.vertices[a[p]]), sum_of_steps + steps[p]
            if end > begin and (wide * high * (end - begin + 1) > STATES or sum_of_steps > STEPS):
                own = order[begin:end]
                out[own] = self._group(a[own], b[own], limit[own])
                begin, wide, high, sum_of_steps = end, self.vertices[b[p]], self.vertices[a[p]], steps[p]
        if begin < len(order):
            own = order[begin:]
            out[own] = self._group(a[own], b[own], limit[own])
        return np.where(out < limit, out, np.nan)

    def joint(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pairs of arcs of one name that cost less than the limit: (pair, first arc, second arc, cost)."""
        names = self.count.shape[1]
        each = (self.count[a] * self.count[b]).ravel()
        cell = np.repeat(np.arange(len(each)), each)
        place = np.arange(len(cell)) - np.repeat(np.cumsum(each) - each, each)
        width = self.count[b].ravel()[cell]
        x = self.start[a].ravel()[cell] + place // width
        y = self.start[b].ravel()[cell] + place % width
        pair, density = cell // names, np.tile(self.density, len(a))[cell]
        s, t = self.infix[x], self.infix[y]
        least, most = np.abs(self.length[s] - self.length[t]) * density, limit[pair]
        if self.mass is not None and (limit < self.mass[a] + self.mass[b]).any():
            least += np.abs(self.before[x] - self.before[y]) + np.abs(self.after[x] - self.after[y])
            least -= 1e-6 + 1e-9 * least  # long sums are rounded
        near = least < most
        if not near.all():
            pair, x, y, s, t, density = (v[near] for v in (pair, x, y, s, t, density))
        cost = np.zeros(len(pair))
        differ = np.flatnonzero(s != t)
        which, both = pd.factorize(s[differ] * len(self.strings) + t[differ])
        apart = lcs_distances(self.strings, both // len(self.strings), both % len(self.strings)) if len(both) else np.zeros(0, np.int64)
        cost[differ] = apart[which] * density[differ]
        return pair, x, y, cost

    def _group(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        pair, x, y, cost = self.joint(a, b, limit)
        best = self.passed(a, b, pair, self.src[x], self.src[y], self.dst[x], self.dst[y], cost, self.back, self.gap)
        return best[self.vertices[a] - 1, self.vertices[b] - 1, np.arange(len(a))]

    def passed(self, a: np.ndarray, b: np.ndarray, pair: np.ndarray, s1: np.ndarray, s2: np.ndarray, d1: np.ndarray, d2: np.ndarray, cost: np.ndarray, back_of: np.ndarray, gap_of: np.ndarray) -> np.ndarray:
        """The least costs of paths to each pair of vertices: (vertex of the first line, vertex of the second, pair); common steps go from ``(s1, s2)`` to ``(d1, d2)``."""
        n, high, wide = len(a), int(self.vertices[a].max()), int(self.vertices[b].max())
        order = np.argsort(d1.astype(np.int16) if high < 1 << 15 else d1, kind="stable")
        bounds = np.searchsorted(d1[order], np.arange(high + 1))
        # rows are (vertex of the first line, vertex of the second, pair): what one operation takes lies together
        best = np.full((high, wide, n), np.inf)
        best[0, 0] = 0.0
        every = np.arange(n)
        source = ((s1 * wide + s2) * n + pair)[order]
        target = (d2 * n + pair)[order]
        cost = cost[order]
        columns = []
        for k in range(1, wide):
            at = self.first[b] + np.minimum(k, self.vertices[b] - 1)
            columns.append([(back, gap) for back, gap in zip(back_of[at].T, np.where((k < self.vertices[b])[:, None], gap_of[at], np.inf).T) if np.isfinite(gap).any()])
        flat = best.reshape(-1)
        for i in range(high):
            row = best[i]
            if i:
                at = self.first[a] + np.minimum(i, self.vertices[a] - 1)
                for back, gap in zip(back_of[at].T, np.where((i < self.vertices[a])[:, None], gap_of[at], np.inf).T):
                    if np.isfinite(gap).any():
                        np.minimum(row, best[back, :, every].T + gap, out=row)
                here = slice(bounds[i], bounds[i + 1])
                np.minimum.at(row.reshape(-1), target[here], flat[source[here]] + cost[here])
            for k, arcs in enumerate(columns, 1):
                for back, gap in arcs:
                    np.minimum(row[k], row[back, every] + gap, out=row[k])
        return best
