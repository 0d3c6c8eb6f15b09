"""Words of many texts at a time, as arrays of hashes: one pass over their bytes, no Python object for a word."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from logweave.llm.shared import kept_for_a_task

#: Bytes of text that are taken together; a longer text is taken alone.
TOGETHER = 1 << 18
#: Bytes between words: those that ``bytes.split`` splits at.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LINE_BREAK = 10
#: A base of polynomials modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A random value for each byte; A-Z have those of a-z.
VALUE = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
VALUE[65:91] = VALUE[97:123]


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Each 64-bit value spread over all bits; another function for each seed."""
    out = (h ^ (h >> np.uint64(32))) + np.uint64(0xD6E8FEB86659FD93 * (2 * seed + 1) & (1 << 64) - 1)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


@kept_for_a_task(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """The first ``n`` powers of a base, from 1 on."""
    return _powers(max(TOGETHER, 1 << n.bit_length()) + 1, base)[:n]


@dataclass
class Words:
    """The words of some texts in a row, A-Z counting as a-z."""

    data: bytes
    hashes: np.ndarray  # of each word
    starts: np.ndarray  # of each word in ``data``
    begins: np.ndarray  # of each text in ``data``, and the end of ``data``
    edges: np.ndarray  # the number of words before each text, and before the end

    def same_text(self, n: int) -> np.ndarray:
        """For each place of a run of ``n`` words whether it lies in one text."""
        total = max(0, len(self.hashes) - n + 1)
        ends = np.repeat(self.edges[1:], np.diff(self.edges))[:total]
        return np.arange(n, n + total) <= ends

    def runs(self, n: int, seed: int = 0) -> np.ndarray:
        """A hash of each run of ``n`` words, those across texts too."""
        total = len(self.hashes) - n + 1
        if total <= 0:
            return self.hashes[:0]
        own = mixed(self.hashes, seed) if seed else self.hashes
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * powers(len(own)))])
        return mixed((sums[n:] - sums[:-n]) * powers(total, INVERSE), seed)


def words(texts: Sequence[bytes]) -> Words:
    data = b"\n".join([*texts, b""])
    raw = np.frombuffer(data, np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    edge = np.flatnonzero(np.diff(BLANK.take(raw), prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE.take(raw) * powers(len(raw)))])
    hashes = mixed((sums.take(ends) - sums.take(starts)) * powers(len(raw), INVERSE).take(starts))
    return Words(data, hashes, starts, begins, np.searchsorted(starts, begins))


def in_groups(texts: Sequence[str | None]) -> Iterator[tuple[int, Words]]:
    """The texts' words, some texts at a time, with the number of texts before; null counts as empty."""
    group, size, before = [], 0, 0
    for i, text in enumerate(texts):
        own = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(own) > TOGETHER:
            yield before, words(group)
            group, size, before = [], 0, i
        group.append(own)
        size += len(own) + 1
    if group:
        yield before, words(group)


def sliding(values: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``n`` values in a row."""
    length = 1
    while 2 * length <= n:
        values = best(values[:-length], values[length:])
        length *= 2
    return best(values[: len(values) - (n - length)], values[n - length :]) if n > length else values
