"""Pattern distances of many pairs whose lines differ in digits only from a few shapes.

No pattern that can match in a plain line tells digits apart, so lines that are equal with all
digits made alike have the same automaton. What a distance is made of is found once for a
pair of such shapes: the steps that can be on a cheapest path, and the least that any path
through each of them costs. A pair of lines then takes only the steps below the cost of one good path.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

from logweave.functions.bounds import Bound
from logweave.functions.distances import PairDistances, lcs_distances
from logweave.functions.graphs import graphs
from logweave.functions.patterns import PatternSet
from logweave.functions.regex_dfa import Dfa

DIGITS = "0123456789"
ALIKE = str.maketrans(DIGITS, "0" * 10)
#: The longest line that is taken by its shape.
LONG = 255
#: Pairs of one pair of shapes in all batches from which on its steps are found; pairs of shapes that are taken together.
OFTEN, TOGETHER = 3, 256
#: Steps and pairs of shapes that are kept in all; beyond, they are found again.
KEPT, COUNTED = 1 << 22, 1 << 17
#: Pairs of lines whose steps are taken together.
PAIRS = 4096
#: Sums of costs are rounded.
ABOVE, MORE = 1 + 1e-9, 1e-6

#: Masks over the eight bytes of a word.
EACH, SEVENS, EIGHTS, GATHER = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080), np.uint64(0x0102040810204080)

COLUMNS = {"slack": float, "cost": float, "density": float, "source": np.int32, "target": np.int32, "level": np.int16, "x": np.uint8, "y": np.uint8, "m": np.uint8, "n": np.uint8}
PLACES = {"steps_at": np.int64, "steps_n": np.int64, "first_at": np.int64, "first_n": np.int64, "states": np.int64, "low": float}


def least_counts(dfa: Dfa) -> dict[str, int]:
    """How often each character that is no digit occurs at least in all words of a language, where that is not 0."""
    out = {}
    for c in sorted({c for moves in dfa.moves for c in moves} - set(DIGITS)):
        least = {0: 0}
        todo = [0]
        for q in todo:
            for to, n in {(r, least[q] + (a == c)) for a, r in dfa.moves[q].items()}:
                if n < least.get(to, n + 1):
                    least[to] = n
                    todo.append(to)
        n = min((least[q] for q in dfa.accepting if q in least), default=0)
        if n:
            out[c] = n
    return out


class Rows:
    """Columns that grow."""

    def __init__(self, kinds: dict[str, type]):
        self.n, self.columns = 0, {c: np.empty(1024, kind) for c, kind in kinds.items()}

    def __getitem__(self, column: str) -> np.ndarray:
        return self.columns[column]

    def add(self, columns: dict[str, np.ndarray]) -> None:
        n = self.n + len(next(iter(columns.values())))
        for c, new in columns.items():
            if n > len(self.columns[c]):
                self.columns[c] = np.concatenate([self.columns[c][: self.n], np.empty(2 * n - self.n, self.columns[c].dtype)])
            self.columns[c][self.n : n] = new
        self.n = n


class Lines:
    """Lines with the numbers of their shapes, -1 where they are not plain, and their bytes."""

    def __init__(self, of: Shapes, lines: Sequence[str]):
        codes, shapes = pd.factorize(np.array([x.translate(ALIKE) for x in lines], object))
        numbers = np.array([of.number(s) for s in shapes], np.int64)
        self.generation = of.generation
        self.shape = numbers[codes] if len(codes) else np.zeros(0, np.int64)
        plain = (self.shape >= 0).tolist()
        kept = [x if there else "" for x, there in zip(lines, plain)]
        self.bytes = np.frombuffer("".join(kept).encode("ascii") or b"\0", np.uint8)
        size = np.array([len(x) for x in kept], np.int64)
        self.offset = np.cumsum(size) - size


class Shapes:
    """Distances of pairs of lines by their shapes; what is found of pairs of shapes is kept for later batches."""

    _of: dict[PatternSet, Shapes] = {}

    @classmethod
    def of(cls, patterns: PatternSet) -> Shapes:
        """The one of this process, so that a worker's tasks find pairs of shapes once."""
        if patterns not in cls._of:
            cls._of.clear()
            cls._of[patterns] = cls(patterns)
        return cls._of[patterns]

    def __init__(self, patterns: PatternSet):
        self.patterns, self.dfas, self.densities, self.bound = patterns, patterns.dfas(), patterns.densities(), Bound(patterns)
        self.fussy = [least_counts(d) for d in self.dfas.values() if any(len({moves.get(c, -1) for c in DIGITS}) > 1 for moves in d.moves)]
        self.generation = 0
        self._forget()

    def _forget(self) -> None:
        self.generation += 1
        self.numbers: dict[str, int] = {}
        self.shapes: list[str] = []
        self.patterns_of: dict[str, int] = {}
        self.counts: dict[int, int] = {}
        self.at: dict[int, int] = {}
        self.steps, self.first, self.places = Rows(COLUMNS), Rows(COLUMNS), Rows(PLACES)

    def number(self, shape: str) -> int:
        """The number of a shape; -1 if lines of it are not plain."""
        if not 0 < len(shape) <= LONG or not shape.isascii() or not all(any(shape.count(c) < n for c, n in least.items()) for least in self.fussy):
            return -1
        n = self.numbers.setdefault(shape, len(self.shapes))
        if n == len(self.shapes):
            self.shapes.append(shape)
        return n

    def lines(self, lines: Sequence[str]) -> Lines:
        if len(self.shapes) > COUNTED or len(self.counts) > 4 * COUNTED or self.steps.n > KEPT:
            self._forget()
        return Lines(self, lines)

    def seen(self, lines: Sequence[str]) -> np.ndarray:
        """``Bound.seen``, once for lines of one shape."""
        own = self.lines(lines)
        out = np.zeros(len(lines), np.int64)
        odd = np.flatnonzero(own.shape < 0)
        if len(odd):
            out[odd] = self.bound.seen([lines[k] for k in odd.tolist()], self.dfas)
        plain = np.flatnonzero(own.shape >= 0)
        numbers, back = np.unique(own.shape[plain], return_inverse=True)
        shapes = [self.shapes[k] for k in numbers.tolist()]
        new = [s for s in shapes if s not in self.patterns_of]
        if new:
            self.patterns_of.update(zip(new, self.bound.seen(new, self.dfas).tolist()))
        if len(plain):
            out[plain] = np.array([self.patterns_of[s] for s in shapes], np.int64)[back]
        return out

    def known(self, a: np.ndarray, b: np.ndarray, find: bool = False) -> np.ndarray:
        """Places of pairs of shapes, -1 of those that are not plain or were met too seldom; if ``find``, all plain ones are found."""
        out = np.full(len(a), -1, np.int64)
        plain = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(plain):
            return out
        keys, back, n = np.unique(a[plain] << 32 | b[plain], return_inverse=True, return_counts=True)
        places, todo = [], []
        for key, many in zip(keys.tolist(), n.tolist()):
            place = self.at.get(key, -1)
            if place < 0:
                many += self.counts.get(key, 0)
                self.counts[key] = many
                if find or many >= OFTEN:
                    todo.append(key)
            places.append(place)
        for begin in range(0, len(todo), TOGETHER):
            self._find(todo[begin : begin + TOGETHER])
        if todo:
            places = [self.at.get(key, -1) for key in keys.tolist()]
        out[plain] = np.array(places, np.int64)[back]
        return out

    def _find(self, keys: list[int]) -> None:
        """Keeps the steps of some pairs of shapes, those of the lowest sums first, and the steps of the path that is cheapest when no digits are equal."""
        a, b = np.array(keys, np.int64) >> 32, np.array(keys, np.int64) & (1 << 32) - 1
        own, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        g = graphs([self.shapes[k] for k in own.tolist()], self.patterns, self.dfas)
        of = PairDistances(g, self.densities)
        states = of.vertices[at[: len(a)]] * of.vertices[at[len(a) :]]
        order = np.argsort(states, kind="stable")
        for part in np.array_split(order, 1 + int(states.sum()) // (1 << 17)):
            if len(part):
                self._keep([keys[k] for k in part.tolist()], of, at[: len(a)][part], at[len(a) :][part])

    def _keep(self, keys: list[int], of: PairDistances, a: np.ndarray, b: np.ndarray) -> None:
        n = len(a)
        pair, x, y, cost = of.joint(a, b, np.full(n, np.inf))
        s, t = of.infix[x], of.infix[y]
        varied = np.array(["0" in w for w in of.strings], bool)
        open_ = varied[s] & varied[t]
        dear = cost.copy()
        which, both = pd.factorize(s[open_] * len(of.strings) + t[open_])
        apart = [*of.strings, *(w.replace("0", "\0") for w in of.strings)]
        dear[open_] = (lcs_distances(apart, both // len(of.strings), len(of.strings) + both % len(of.strings)) * 1.0)[which] * of.density[of.name[x[open_]]] if len(both) else 0.0
        s1, s2, d1, d2 = of.src[x], of.src[y], of.dst[x], of.dst[y]
        twice = lambda v: np.concatenate([v, v])
        pairs, costs = np.concatenate([pair, pair + n]), np.concatenate([cost, dear])
        va, vb = of.vertices[a], of.vertices[b]
        there = of.passed(twice(a), twice(b), pairs, twice(s1), twice(s2), twice(d1), twice(d2), costs, of.back, of.gap)
        ea, eb = va[pair] - 1, vb[pair] - 1
        back = of.passed(twice(a), twice(b), pairs, twice(ea - d1), twice(eb - d2), twice(ea - s1), twice(eb - s2), costs, *of.turned())
        high, wide = there.shape[:2]
        every = np.arange(2 * n)
        i, k = (np.maximum(twice(v)[:, None] - 1 - np.arange(m)[None, :], 0) for v, m in ((va, high), (vb, wide)))
        there = np.ascontiguousarray(there.transpose(2, 0, 1))
        inside = (np.arange(high)[None, :, None] < twice(va)[:, None, None]) & (np.arange(wide)[None, None, :] < twice(vb)[:, None, None])
        back = np.where(inside, back.transpose(2, 0, 1)[every[:, None, None], i[:, :, None], k[:, None, :]], np.inf)
        low, high_cost = there[np.arange(n), va - 1, vb - 1], there[n + np.arange(n), va - 1, vb - 1]
        most = high_cost * ABOVE + MORE

        def kept(pair, s1, s2, d1, d2, cost, dear, density, arc, other):
            slack = there[pair, s1, s2] + cost + back[pair, d1, d2]
            on = np.flatnonzero(slack < most[pair])
            pair, s1, s2, d1, d2, cost, dear, density, slack = (v[on] for v in (pair, s1, s2, d1, d2, cost, dear, density, slack))
            first = there[n + pair, s1, s2] + dear + back[n + pair, d1, d2] < most[pair]
            spans = [np.zeros(len(on), np.int64)] * 4 if arc is None else [of.place[arc[on]], of.place[other[on]], of.length[of.infix[arc[on]]], of.length[of.infix[other[on]]]]
            return pair, s1, s2, d1, d2, cost, density, slack, first, *spans

        density = of.density[of.name[x]]
        parts = [kept(pair, s1, s2, d1, d2, cost, dear, np.where(open_, density, 0.0), x, y)]
        for mine, theirs, turned in ((a, b, False), (b, a, True)):
            m = int(of.vertices[mine].max())
            rows = of.first[mine][:, None] + np.minimum(np.arange(m)[None, :], of.vertices[mine][:, None] - 1)
            source, gap = of.back[rows], np.where((np.arange(m)[None, :] < of.vertices[mine][:, None])[:, :, None], of.gap[rows], np.inf)
            p, d, c = np.nonzero(np.isfinite(gap))
            s, gap = source[p, d, c], gap[p, d, c]
            many = of.vertices[theirs][p]
            up = np.repeat(np.arange(len(p)), many)
            k = np.arange(len(up)) - np.repeat(np.cumsum(many) - many, many)
            p, d, s, gap = p[up], d[up], s[up], gap[up]
            ends = (k, s, k, d) if turned else (s, k, d, k)
            parts.append(kept(p, *ends, gap, gap, np.zeros(len(p)), None, None))
        pair, s1, s2, d1, d2, cost, density, slack, first, *spans = (np.concatenate(v) for v in zip(*parts))
        # of steps between the same places the cheapest name's is enough
        source, target = s1 * wide + s2, d1 * wide + d2
        order = np.lexsort((cost, density, target, source, pair))
        kept_ = order[np.diff((pair[order] * high * wide + source[order]) * high * wide + target[order], prepend=-1) != 0]
        pair, source, target, cost, density, slack, first, level, *spans = (v[kept_] for v in (pair, source, target, cost, density, slack, first, d1 + d2, *spans))
        states, number = np.unique(np.concatenate([pair, pair]) * (high * wide) + np.concatenate([source, target]), return_inverse=True)
        begin = np.searchsorted(states, np.arange(n + 1) * (high * wide))
        source, target = number[: len(pair)] - begin[pair], number[len(pair) :] - begin[pair]
        order = np.lexsort((slack, pair))
        also = np.flatnonzero(first)
        columns = dict(zip(COLUMNS, (slack, cost, density, source, target, level, *spans)))
        many = len(self.at)
        self.at.update((key, many + k) for k, key in enumerate(keys))
        n_steps, n_first = np.bincount(pair, minlength=n), np.bincount(pair[also], minlength=n)
        starts = {"steps_at": self.steps.n + np.cumsum(n_steps) - n_steps, "first_at": self.first.n + np.cumsum(n_first) - n_first}
        self.places.add(starts | {"steps_n": n_steps, "first_n": n_first, "states": np.diff(begin), "low": low})
        self.steps.add({c: v[order] for c, v in columns.items()})
        self.first.add({c: v[also] for c, v in columns.items()})

    def least(self, place: np.ndarray) -> np.ndarray:
        """A lower bound of the distances of lines of known pairs of shapes."""
        return self.places["low"][place]

    def distances(self, x: Lines, y: Lines, i: np.ndarray, j: np.ndarray, place: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The pattern distances of lines of known pairs of shapes, bit for bit; NaN where it is not below the limit."""
        out = np.full(len(i), np.nan)
        rows = np.flatnonzero(self.least(place) < limit * ABOVE) if len(i) else np.zeros(0, np.int64)
        rows = rows[np.argsort(place[rows], kind="stable")]
        for begin in range(0, len(rows), PAIRS):
            own = rows[begin : begin + PAIRS]
            out[own] = self._some(x, y, i[own], j[own], place[own], limit[own])
        return np.where(out < limit, out, np.nan)

    def _some(self, x: Lines, y: Lines, i: np.ndarray, j: np.ndarray, place: np.ndarray, limit: np.ndarray) -> np.ndarray:
        t = self.places
        best = self._path(x, y, i, j, place, self.first, t["first_at"][place], t["first_n"][place])
        most = np.minimum(best, limit) * ABOVE + MORE
        # rows of a pair of shapes lie together, their steps by their sums
        n = np.zeros(len(i), np.int64)
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(place)]):
            at = t["steps_at"][place[a]]
            n[a:b] = np.searchsorted(self.steps["slack"][at : at + t["steps_n"][place[a]]], most[a:b])
        return self._path(x, y, i, j, place, self.steps, t["steps_at"][place], n)

    def _path(self, x: Lines, y: Lines, i: np.ndarray, j: np.ndarray, place: np.ndarray, steps: Rows, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The least cost of a path over the first ``n`` steps of each pair."""
        states = self.places["states"][place]
        base = np.cumsum(states) - states
        row = np.repeat(np.arange(len(i)), n)
        step = np.arange(len(row)) + np.repeat(at - (np.cumsum(n) - n), n)
        order = np.argsort(steps["level"][step], kind="stable")
        row, step = row[order], step[order]
        level = steps["level"][step]
        cost, density = steps["cost"][step], steps["density"][step]
        open_ = np.flatnonzero(density)
        p, q = row[open_], step[open_]
        apart = _apart(x.bytes, y.bytes, x.offset[i[p]] + steps["x"][q], y.offset[j[p]] + steps["y"][q], steps["m"][q].astype(np.int64), steps["n"][q].astype(np.int64))
        cost[open_] = apart * density[open_]
        best = np.full(int(states.sum()), np.inf)
        best[base] = 0.0
        source, target = base[row] + steps["source"][step], base[row] + steps["target"][step]
        cuts = np.flatnonzero(np.diff(level, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(level)]):
            np.minimum.at(best, target[a:b], best[source[a:b]] + cost[a:b])
        return best[base + states - 1]


def _apart(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Deletions and insertions between ``a[x:x + m]`` and ``b[y:y + n]``, row by row.

    Eight characters are a word, in which a character is found by arithmetic; a row of the
    table is kept as bits, and all rows take a character of their longer side at a time.
    """
    out = np.zeros(len(x), np.int64)
    text = np.concatenate([a, b, np.zeros(8 * 9, np.uint8)])
    words = np.ndarray(len(text) - 7, "<u8", text, 0, (1,))
    y, turn = y + len(a), m > n
    x, y, m, n = np.where(turn, y, x), np.where(turn, x, y), np.where(turn, n, m), np.where(turn, m, n)
    order = np.argsort(LONG + ((m + 7) // 8) * (LONG + 1) - n, kind="stable")
    width = (m[order] + 7) // 8
    cuts = np.flatnonzero(np.diff(width, prepend=-1)).tolist()
    for begin, end in zip(cuts, [*cuts[1:], len(order)]):
        rows, many = order[begin:end], int(width[begin])
        left, right, longest = x[rows], y[rows], n[rows]
        if many > 8:
            strings = [text[at : at + k].tobytes().decode("ascii") for at, k in zip([*left.tolist(), *right.tolist()], [*m[rows].tolist(), *longest.tolist()])]
            out[rows] = lcs_distances(strings, np.arange(len(rows)), len(rows) + np.arange(len(rows)))
            continue
        own = [words[left + 8 * k] for k in range(many)]
        state = np.full(len(rows), 2**64 - 1, np.uint64)
        active = np.searchsorted(-longest, -np.arange(longest.max(initial=0)), "left").tolist()
        for t, k in enumerate(active):
            each = text[right[:k] + t] * EACH
            hit = _found(own[0][:k] ^ each)
            for w in range(1, many):
                hit |= _found(own[w][:k] ^ each) << np.uint64(8 * w)
            v = state[:k]
            hit &= v
            state[:k] = (v + hit) | (v - hit)
        state &= np.uint64(2**64 - 1) >> (64 - m[rows]).astype(np.uint64)
        out[rows] = longest - m[rows] + 2 * np.bitwise_count(state).astype(np.int64)
    return out


def _found(differ: np.ndarray) -> np.ndarray:
    """The places of the bytes that are 0, as eight bits; all bytes are below 128."""
    differ += SEVENS
    np.bitwise_and(~differ, EIGHTS, out=differ)
    differ >>= np.uint64(7)
    differ *= GATHER
    differ >>= np.uint64(56)
    return differ
