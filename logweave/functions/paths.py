"""Cheapest paths through the automata of many lines at a time."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np

from logweave.functions.graphs import Graphs


def weights_by_name(g: Graphs, densities: Mapping[str, float]) -> np.ndarray:
    """For each arc the density of its name, 1 for an unknown name."""
    return np.array([densities.get(x, 1.0) for x in g.names])[g.name]


@dataclass
class Paths:
    """The least cost of each vertex (infinite where no path leads), that of each line, and the arcs of the cheapest paths in order."""

    vertex_cost: np.ndarray
    cost: np.ndarray
    line: np.ndarray
    arc: np.ndarray


def cheapest_paths(g: Graphs, weight: np.ndarray) -> Paths:
    """For each line the path to its end with the least sum of the arcs' weights, then the fewest arcs, then the first names.

    Costs and numbers of arcs are minima over the arcs into the vertices, taken place by
    place over all lines. Arcs that reach them are tight; of the tight arcs that lead on to
    the end, a path takes the one with the first name at each vertex. Weights must not be negative.
    """
    vertices, _ = g.counts()
    first = np.cumsum(vertices) - vertices
    last = first + vertices - 1
    wide = 1 + max((len(x) for x in g.lines), default=0)
    keys = g.vertex_line * wide + g.vertex
    src, dst = (np.searchsorted(keys, g.line * wide + x) for x in (g.src, g.dst))
    place = dst - first[g.line]
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(1, 2 + place.max(initial=0)))
    cost, steps = np.full(len(keys), np.inf), np.full(len(keys), len(keys) + 1)
    cost[first], steps[first] = 0.0, 0
    for a, b in zip(bounds, bounds[1:]):
        arcs = order[a:b]
        new = cost[src[arcs]] + weight[arcs]
        np.minimum.at(cost, dst[arcs], new)
        least = arcs[new == cost[dst[arcs]]]
        np.minimum.at(steps, dst[least], steps[src[least]] + 1)
    tight = np.isfinite(cost[src]) & (cost[src] + weight == cost[dst]) & (steps[src] + 1 == steps[dst])
    leads = np.zeros(len(keys), bool)
    leads[last] = True
    for a, b in zip(bounds[-2::-1], bounds[:0:-1]):
        arcs = order[a:b]
        arcs = arcs[tight[arcs] & leads[dst[arcs]]]
        leads[src[arcs]] = True
    on = np.flatnonzero(tight & leads[dst])
    on = on[np.lexsort((g.name[on], src[on]))]
    chosen = np.full(len(keys), -1)
    chosen[src[on][::-1]] = on[::-1]  # of a vertex's arcs the first stays
    lines, at, taken = np.arange(len(g.lines)), first.copy(), []
    while len(lines := lines[at[lines] != last[lines]]):
        arcs = chosen[at[lines]]
        taken.append((lines, arcs))
        at[lines] = dst[arcs]
    line, arc = (np.concatenate([np.zeros(0, np.int64), *(t[k] for t in taken)]) for k in (0, 1))
    by = np.argsort(line, kind="stable")
    return Paths(cost, cost[last], line[by], arc[by])
