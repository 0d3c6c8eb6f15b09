"""Pattern automata of many lines at a time, as arrays of vertices and arcs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np

from logweave.functions.patterns import PatternSet
from logweave.functions.regex_dfa import Dfa
from logweave.functions.scan import SCANS, scan
from logweave.functions.text import Automaton


@dataclass
class Graphs:
    """Arcs and vertices in the order of lines and places; ``names`` are those that ``name`` counts."""

    lines: Sequence[str]
    names: list[str]
    line: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    name: np.ndarray
    vertex_line: np.ndarray
    vertex: np.ndarray

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Vertices and arcs of each line."""
        n = len(self.lines)
        return np.bincount(self.vertex_line, minlength=n), np.bincount(self.line, minlength=n)

    def signatures(self) -> list[str]:
        """Equal for automata with as many vertices and arcs that accept the same sequences of names.

        A vertex is digested with its names and their targets' digests, the last of each line
        first; since the graphs have no cycles and are deterministic, equal digests mean
        equal languages.
        """
        n = len(self.lines)
        vertices, arcs = self.counts()
        first = np.cumsum(vertices) - vertices
        wide = 1 + max((len(x) for x in self.lines), default=0)
        keys = self.vertex_line * wide + self.vertex
        src, dst = (np.searchsorted(keys, self.line * wide + x) for x in (self.src, self.dst))
        back = first[self.vertex_line] + vertices[self.vertex_line] - 1 - np.arange(len(keys))
        order = np.argsort(back[src], kind="stable")
        steps = np.searchsorted(back[src][order], np.arange(1, 2 + (back.max() if len(back) else 0)))
        digests = []
        for seed in (1, 2):
            label = np.array([_hash(x, seed) for x in self.names], np.uint64)[self.name]
            own = np.where(back == 0, _mixed(np.full(len(keys), seed, np.uint64)), np.uint64(0))
            for a, b in zip(steps, steps[1:]):
                at = order[a:b]
                np.add.at(own, src[at], _mixed(label[at] + own[dst[at]]))
                own[np.unique(src[at])] = _mixed(own[np.unique(src[at])])
            digests.append(own[first] if n else own)
        return [f"{v}.{e}.{x:016x}{y:016x}" for v, e, x, y in zip(vertices.tolist(), arcs.tolist(), *(d.tolist() for d in digests))]

    def automata(self) -> list[Automaton]:
        """One by one, each pattern name of a vertex with its arc."""
        vertices, arcs = self.counts()
        points = np.split(self.vertex, np.cumsum(vertices)[:-1])
        rows = list(zip(self.src.tolist(), self.dst.tolist(), map(self.names.__getitem__, self.name.tolist())))
        ends = np.cumsum(arcs).tolist()
        return [Automaton(w, tuple(v.tolist()), tuple(rows[b - n : b])) for w, v, n, b in zip(self.lines, points, arcs.tolist(), ends)]


def _mixed(h: np.ndarray) -> np.ndarray:
    out = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _hash(name: str, seed: int) -> int:
    out = seed
    for byte in name.encode():
        out = (out * 0x100000001B3 ^ byte) & (1 << 64) - 1
    return int(_mixed(np.array([out], np.uint64))[0])


def graphs(lines: Sequence[str | None], patterns: PatternSet, dfas: dict[str, Dfa] | None = None, strategy: str | Callable = "largest", filtered: Iterable[str] = ()) -> Graphs:
    """The automata of the lines as ``text.automaton`` has them; null counts as an empty line."""
    lines, dfas, filtered = [x or "" for x in lines], dfas or patterns.dfas(), set(filtered)
    names = sorted({*dfas, "any"})
    number = {x: i for i, x in enumerate(names)}
    if strategy in SCANS:
        found = scan(lines, dfas, strategy)
    else:
        rows = {x: [(i, j, k) for i, line in enumerate(lines) for _, j, k in strategy(line, x, dfa)] for x, dfa in dfas.items()}
        found = {x: tuple(np.array(r, np.int64).reshape(-1, 3).T) for x, r in rows.items()}
    kept = [(x, f) for x, f in found.items() if x not in filtered]
    line, src, dst = (np.concatenate([np.zeros(0, np.int64), *(f[c] for _, f in kept)]) for c in range(3))
    name = np.concatenate([np.zeros(0, np.int64), *(np.full(len(f[0]), number[x]) for x, f in kept)])
    size = np.array([len(x) for x in lines], np.int64)
    wide = 1 + int(size.max(initial=0))
    left, entered = line * wide + src, line * wide + dst
    own = np.arange(len(lines)) * wide
    vertices = np.unique(np.concatenate([left, entered, own, own + size]))
    at, place = vertices // wide, vertices % wide
    gap = np.flatnonzero((at[1:] == at[:-1]) & ~(np.isin(vertices[1:], entered) & np.isin(vertices[:-1], left)))
    line, src, dst = (np.concatenate([x, y]) for x, y in ((line, at[gap]), (src, place[gap]), (dst, place[gap + 1])))
    name = np.concatenate([name, np.full(len(gap), number["any"])])
    # of arcs with one name from one vertex the last stays; gaps come last, or first where matched arcs are to be kept
    rank = np.arange(len(line))
    if patterns.any_collision != "overwrite":
        rank[len(rank) - len(gap) :] = -1
    order = np.lexsort((rank, name, src, line))
    line, src, dst, name = line[order], src[order], dst[order], name[order]
    last = np.append((line[1:] != line[:-1]) | (src[1:] != src[:-1]) | (name[1:] != name[:-1]), True)[: len(line)]
    line, src, dst, name = line[last], src[last], dst[last], name[last]
    order = np.lexsort((name, dst, src, line))
    return Graphs(lines, names, line[order], src[order], dst[order], name[order], at, place)
