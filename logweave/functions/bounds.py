"""A lower bound of the pattern distance from the characters of two lines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from logweave.functions.graphs import Graphs
from logweave.functions.patterns import PatternSet
from logweave.functions.regex_dfa import Dfa
from logweave.functions.scan import CODES, scan

#: Characters that are told apart: those of the alphabet, and 0 for all others.
LETTERS = int(CODES.max()) + 1
#: Sums of weighted characters that stand for a line in a join.
MASSES = 8
#: Patterns whose presence in a line is looked at; further ones count as present.
LOOKED_AT = 60


class Bound:
    """Lower bounds of costs: each character that one line has more often than the other costs its weight at least.

    A path deletes a character at cost 1, or has it in a step of a pattern that both lines
    match. That step costs the density for each character that is not common to both sides,
    so a character's weight is the least density of the patterns that can hold it, and 1 at
    most. ``any`` holds every character, since it stands for gaps too.
    """

    def __init__(self, patterns: PatternSet):
        densities = patterns.densities()
        self.names = sorted({*patterns.names, "any"})
        self.weights_of = np.ones((len(self.names), LETTERS))
        for row, name in zip(self.weights_of, self.names):
            if name == "any":
                row[:] = min(1.0, densities["any"])
            else:
                held = sorted({c for moves in patterns.dfas()[name].moves for c in moves})
                row[CODES[[ord(c) for c in held]]] = min(1.0, densities[name])
        self.weights = self.weights_of.min(axis=0)
        order = np.argsort(-self.weights, kind="stable")
        self.mass_of = np.zeros((LETTERS, MASSES))
        self.mass_of[order, np.arange(LETTERS) % MASSES] = self.weights[order]

    def counts(self, lines: Sequence[str]) -> np.ndarray:
        """How often each line has each character."""
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(points < 128, CODES[points & 127], 0).astype(np.int64)
        line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        return np.bincount(line * LETTERS + codes, minlength=len(lines) * LETTERS).reshape(-1, LETTERS)

    def masses(self, lines: Sequence[str]) -> np.ndarray:
        """``MASSES`` sums for each line; the differences of two lines' sums are together at most their distance."""
        return self.counts(lines) @ self.mass_of

    def seen(self, lines: Sequence[str], dfas: dict[str, Dfa]) -> np.ndarray:
        """The patterns that each line matches, as bits."""
        at = self.names.index("any")
        out = np.full(len(lines), 1 << at if at < LOOKED_AT else 0, np.int64)
        for name, (line, _, _) in scan(lines, dfas, "largest").items():
            if self.names.index(name) < LOOKED_AT:
                out[line] |= 1 << self.names.index(name)
        return out

    def weights_of_seen(self, both: int) -> np.ndarray:
        """What each character weighs for two lines that both match these patterns."""
        kept = [i for i in range(len(self.names)) if i >= LOOKED_AT or both >> i & 1]
        return self.weights_of[kept].min(axis=0, initial=1.0)

    def least(self, g: Graphs, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A lower bound of the cost for pairs of the lines of ``g``, by the patterns that both lines match."""
        number = np.array([self.names.index(x) for x in g.names])
        low = number[g.name] < LOOKED_AT
        present = np.full(len(g.lines), 1 << self.names.index("any") if self.names.index("any") < LOOKED_AT else 0)
        np.bitwise_or.at(present, g.line[low], 1 << number[g.name[low]])
        return self.least_of_seen(g.lines, present, a, b)

    def least_of_seen(self, lines: Sequence[str], seen: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for pairs of ``lines``, whose patterns are known as ``seen`` gives them."""
        counts, out = self.counts(lines), np.zeros(len(a))
        both = seen[a] & seen[b]
        for mask in np.unique(both).tolist():
            rows = np.flatnonzero(both == mask)
            weights = self.weights_of_seen(mask)
            for part in np.array_split(rows, 1 + len(rows) * LETTERS // (1 << 20)):
                out[part] = np.abs(counts[a[part]] - counts[b[part]]) @ weights
        # sums of many terms may round up
        return out * (1 - 1e-9)
