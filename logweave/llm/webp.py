"""Lossless WebP: an encoder for byte payloads and a decoder for any VP8L image, to and from pixel arrays."""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np

#: Code length codes come in this order in the stream (fixed by the format).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (dx, dy) of the short distance codes 1 to 120, in order: by distance from the current pixel, fixed by the format.
PLANE = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_HASH = 0x1E35A7BD
#: Longest prefix code, literal symbols of the green alphabet, length symbols, distance symbols.
LONGEST, LITERALS, LENGTHS, DISTANCES = 15, 256, 24, 40
#: Bits of a stream that the fast path looks at in one go.
WINDOW = 1 << 19


class Bits:
    """Reads a VP8L bit stream, least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.end = 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image data ends early")
        return value


class Writer:
    """Writes a VP8L bit stream: fields one by one, then symbols from arrays."""

    def __init__(self):
        self.head, self.bits = 0, 0
        self.out: list[bytes] = []

    def put(self, value: int, n: int) -> None:
        self.head |= value << self.bits
        self.bits += n

    def extend(self, values: np.ndarray, counts: np.ndarray) -> None:
        for at in range(0, len(values), WINDOW >> 4):
            v, n = values[at : at + (WINDOW >> 4)].astype(np.uint32), counts[at : at + (WINDOW >> 4)]
            places = np.arange(int(n.max(initial=0)), dtype=np.uint32)
            bits = ((v[:, None] >> places) & np.uint32(1)).astype(np.uint8)[places < n[:, None]]
            self.put(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), len(bits))
            whole = self.bits >> 3
            self.out.append((self.head & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
            self.head >>= 8 * whole
            self.bits &= 7

    def bytes(self) -> bytes:
        return b"".join(self.out) + self.head.to_bytes((self.bits + 7) >> 3, "little")


def code_lengths(counts: dict[int, int], longest: int) -> dict[int, int]:
    """Lengths of a prefix code for the symbols' counts, none longer than ``longest``."""
    if len(counts) < 2:
        return {s: 1 for s in counts}
    least = 1
    while True:
        leaves = sorted((n if n > least else least, s) for s, n in counts.items())
        # Two queues: leaves by weight, and inner nodes, which are made in order of weight.
        weights = [n for n, _ in leaves]
        size = len(weights)
        above = [0] * (2 * size - 1)
        leaf, inner = 0, size
        for node in range(size, 2 * size - 1):
            total = 0
            for _ in range(2):
                if leaf < size and (inner >= node or weights[leaf] <= weights[inner]):
                    low, leaf = leaf, leaf + 1
                else:
                    low, inner = inner, inner + 1
                above[low] = node
                total += weights[low]
            weights.append(total)
        depth = [0] * (2 * size - 1)
        for node in range(2 * size - 3, -1, -1):
            depth[node] = depth[above[node]] + 1
        if max(depth[:size]) <= longest:
            return {s: depth[i] for i, (_, s) in enumerate(leaves)}
        least = max(2 * least, max(counts.values()) >> longest)


def canonical(lengths: dict[int, int]) -> dict[int, int]:
    """Codes as they stand in the stream: canonical by (length, symbol), most significant bit first, so reversed."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - before
        before = n
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


class Prefix:
    """A prefix code as a table over the next bits: symbol and length. A single symbol takes no bits."""

    def __init__(self, lengths: dict[int, int]):
        own = {s: n for s, n in lengths.items() if n}
        if not own:
            own = {0: 0}
        if len(own) == 1:
            self.bits, self.symbols, self.lengths = 0, np.array([next(iter(own))]), np.zeros(1, int)
            return
        if sum(1 << (LONGEST - n) for n in own.values()) != 1 << LONGEST:
            raise ValueError("a prefix code that is not complete")
        self.bits = max(own.values())
        self.symbols, self.lengths = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int64)
        for s, code in canonical(own).items():
            self.symbols[code :: 1 << own[s]] = s
            self.lengths[code :: 1 << own[s]] = own[s]

    def read(self, bits: Bits) -> int:
        at = bits.peek(self.bits) if self.bits else 0
        bits.at += int(self.lengths[at])
        if bits.at > bits.end:
            raise ValueError("the image data ends early")
        return int(self.symbols[at])


def _read_prefix(bits: Bits, alphabet: int) -> Prefix:
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        own = [bits.take(8 if wide else 1)] + ([bits.take(8)] if two else [])
        return Prefix({s: 1 for s in own})
    given = 4 + bits.take(4)
    outer = Prefix({CODE_LENGTH_ORDER[i]: bits.take(3) for i in range(given)})
    most = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    lengths: dict[int, int] = {}
    at, before = 0, 8
    while at < alphabet and most > 0:
        most -= 1
        n = outer.read(bits)
        if n < 16:
            if n:
                lengths[at] = before = n
            at += 1
            continue
        again, value = _again(bits, n, before)
        if value:
            lengths |= dict.fromkeys(range(at, at + again), value)
        at += again
    if at > alphabet:
        raise ValueError("more code lengths than symbols")
    return Prefix(lengths)


def _again(bits: Bits, n: int, before: int) -> tuple[int, int]:
    if n == 16:
        return 3 + bits.take(2), before
    return (3 + bits.take(3), 0) if n == 17 else (11 + bits.take(7), 0)


def _write_prefix(out: Writer, lengths: dict[int, int], alphabet: int) -> None:
    own = sorted(s for s, n in lengths.items() if n)
    if len(own) <= 2 and all(s < 256 for s in own):
        own = own or [0]
        out.put(1, 1)
        out.put(len(own) - 1, 1)
        out.put(int(own[0] > 1), 1)
        out.put(own[0], 8 if own[0] > 1 else 1)
        if len(own) == 2:
            out.put(own[1], 8)
        return
    out.put(0, 1)
    symbols: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    at = 0
    for s in [*own, alphabet]:
        while at < s:
            run = min(s - at, 138)
            if run < 3:
                symbols += [(0, 0, 0)] * run
            else:
                symbols.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
            at += run
        if s < alphabet:
            symbols.append((lengths[s], 0, 0))
            at += 1
    outer = code_lengths(Counter(s for s, _, _ in symbols), 7)
    codes = canonical(outer)
    given = max(4, 1 + max(i for i, s in enumerate(CODE_LENGTH_ORDER) if outer.get(s)))
    out.put(given - 4, 4)
    for s in CODE_LENGTH_ORDER[:given]:
        out.put(outer.get(s, 0), 3)
    out.put(0, 1)
    single = len(outer) == 1
    for s, extra, n in symbols:
        if not single:
            out.put(codes[s], outer[s])
        if n:
            out.put(extra, n)


def _split_value(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance from 1 on."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    extra = high - 1
    return 2 * high + second, v & ((1 << extra) - 1), extra


def _joined_value(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.take(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(PLANE):
        return code - len(PLANE)
    dx, dy = PLANE[code - 1]
    return max(1, dx + dy * width)


def _fast_green(bits: Bits, code: Prefix, distance: Prefix, out: np.ndarray, width: int) -> None:
    """Green symbols of an image whose other channels take no bits: literals in bulk, back-references one by one.

    For each bit of a window the literal that would begin there is looked up at once. These
    steps are doubled three times, a walk takes eight literals at a time, and the places
    between are filled in from the single steps. Other symbols and the window's end hold
    the walk.
    """
    steps = np.where(code.symbols < LITERALS, code.lengths, 0)
    data = np.frombuffer(bits.data + b"\0\0\0\0", np.uint8)
    at, mask, total = 0, np.uint32((1 << code.bits) - 1), len(out)
    places = np.arange(8, dtype=np.uint32)
    while at < total:
        first = bits.at >> 3
        block = data[first : first + (WINDOW >> 3) + 3].astype(np.uint32)
        words = block[:-2] | block[1:-1] << np.uint32(8) | block[2:] << np.uint32(16)
        peeked = ((words[:, None] >> places) & mask).ravel().astype(np.intp)
        ends = min(len(peeked) - 16, bits.end - 8 * first)
        one = steps[peeked]
        one[ends:] = 0
        one += np.arange(len(one))
        two = one[one]
        four = two[two]
        eight = four[four]
        here = bits.at - 8 * first
        while at < total:
            stops, far = [], here
            while len(stops) * 8 < total - at + 8 and (ahead := eight.item(far)) != far:
                stops.append(far)
                far = ahead
            if stops:
                path = np.empty((8, len(stops)), np.intp)
                path[0] = stops
                for k in range(1, 8):
                    path[k] = one[path[k - 1]]
                path = path.T.ravel()
                path = path[one[path] != path][: total - at]
                out[at : at + len(path)] = code.symbols[peeked[path]]
                at += len(path)
                here = int(one[path[-1]])
            if at == total or here >= ends:
                break
            bits.at = 8 * first + here
            length = _joined_value(code.read(bits) - LITERALS, bits)
            back = _distance(_joined_value(distance.read(bits), bits), width)
            if back > at or at + length > total:
                raise ValueError("a back-reference out of the image")
            _copy(out, at, back, length)
            at += length
            here = bits.at - 8 * first
            if here >= ends:
                break
        bits.at = 8 * first + here
        if at < total and bits.at >= bits.end:
            raise ValueError("the image data ends early")


def _copy(out: np.ndarray, at: int, back: int, length: int) -> None:
    if back >= length:
        out[at : at + length] = out[at - back : at - back + length]
    else:
        out[at : at + length] = np.resize(out[at - back : at], length)


def _read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB pixels of an entropy-coded image."""
    cache_bits = 0
    if bits.take(1):
        cache_bits = bits.take(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("a colour cache of a size that the format does not have")
    tile_bits, groups, tiles = 0, 1, None
    if top and bits.take(1):
        tile_bits = 2 + bits.take(3)
        across = (width + (1 << tile_bits) - 1) >> tile_bits
        tiles = ((_read_image(bits, across, (height + (1 << tile_bits) - 1) >> tile_bits, False) >> 8) & 0xFFFF).tolist()
        groups = max(tiles) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[_read_prefix(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, far = codes[0]
    if groups == 1 and not cache_bits and red.bits == blue.bits == alpha.bits == 0 and green.bits:
        values = np.zeros(total, np.uint32)
        _fast_green(bits, green, far, values, width)
        return np.uint32(alpha.symbols[0] << 24 | red.symbols[0] << 16 | blue.symbols[0]) | values << np.uint32(8)
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    shift, at, cached = 32 - cache_bits, 0, 0
    while at < total:
        if tiles is not None:
            green, red, blue, alpha, far = codes[tiles[(at // width >> tile_bits) * across + (at % width >> tile_bits)]]
        symbol = green.read(bits)
        if symbol < LITERALS:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = a << 24 | r << 16 | symbol << 8 | b
            at += 1
        elif symbol < LITERALS + LENGTHS:
            length = _joined_value(symbol - LITERALS, bits)
            back = _distance(_joined_value(far.read(bits), bits), width)
            if back > at or at + length > total:
                raise ValueError("a back-reference out of the image")
            for i in range(at, at + length):
                out[i] = out[i - back]
            at += length
        else:
            while cached < at:  # the cache holds all pixels up to this one
                cache[(CACHE_HASH * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[at] = cache[symbol - LITERALS - LENGTHS]
            at += 1
    return np.array(out, np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) of blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, 4)


def _predicted(mode: int, left: list[int], top: list[int], corner: list[int], right: list[int]) -> list[int]:
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clip = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode == 11:
        near_left = sum(abs(t - c) for t, c in zip(top, corner))
        near_top = sum(abs(x - c) for x, c in zip(left, corner))
        return left if near_left < near_top else top
    if mode == 12:
        return [clip(x + t - c) for x, t, c in zip(left, top, corner)]
    if mode == 13:
        mean = half(left, top)
        return [clip(m + int((m - c) / 2)) for m, c in zip(mean, corner)]
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: half(half(left, right), top), 6: lambda: half(left, corner), 7: lambda: half(left, top), 8: lambda: half(corner, top),
        9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right)),
    }[mode]()


def _undo_predictor(pixels: np.ndarray, width: int, height: int, tile_bits: int, modes: np.ndarray) -> np.ndarray:
    rows = _channels(pixels).reshape(height, width, 4).astype(np.int64).tolist()
    across = (width + (1 << tile_bits) - 1) >> tile_bits
    kinds = ((modes >> 8) & 15).tolist()
    for y in range(height):
        row, above = rows[y], rows[y - 1]
        for x in range(width):
            if not x and not y:
                by = [0, 0, 0, 255]
            elif not y:
                by = row[x - 1]
            elif not x:
                by = above[0]
            else:
                # the pixel right above the last one of a row is the first of this row
                by = _predicted(kinds[(y >> tile_bits) * across + (x >> tile_bits)], row[x - 1], above[x], above[x - 1], above[x + 1] if x + 1 < width else row[0])
            row[x] = [(a + b) & 255 for a, b in zip(row[x], by)]
    return np.array(rows, np.uint8).reshape(-1, 4).view("<u4").ravel().astype(np.uint32)


def _undo_cross_colour(pixels: np.ndarray, width: int, height: int, tile_bits: int, factors: np.ndarray) -> np.ndarray:
    c = _channels(pixels).astype(np.int64)
    across = (width + (1 << tile_bits) - 1) >> tile_bits
    y, x = np.divmod(np.arange(width * height), width)
    f = _channels(factors).view(np.int8).astype(np.int64)[(y >> tile_bits) * across + (x >> tile_bits)]
    signed = lambda v: ((v & 255) ^ 128) - 128
    green = signed(c[:, 1])
    red = (c[:, 2] + ((f[:, 0] * green) >> 5)) & 255  # green to red is the factors' blue
    blue = (c[:, 0] + ((f[:, 1] * green) >> 5) + ((f[:, 2] * signed(red)) >> 5)) & 255
    c[:, 2], c[:, 0] = red, blue
    return c.astype(np.uint8).view("<u4").ravel().astype(np.uint32)


def _undo_green(pixels: np.ndarray) -> np.ndarray:
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    red = ((pixels >> np.uint32(16)) + green) & np.uint32(255)
    blue = (pixels + green) & np.uint32(255)
    return (pixels & np.uint32(0xFF00FF00)) | red << np.uint32(16) | blue


def _undo_palette(pixels: np.ndarray, width: int, packed: int, height: int, shift: int, palette: np.ndarray) -> np.ndarray:
    index = ((pixels >> np.uint32(8)) & np.uint32(255)).reshape(height, packed)
    if shift:
        each = 8 >> shift
        parts = (index[:, :, None] >> (np.arange(1 << shift, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)
        index = parts.reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index.ravel()]


def decode(data: bytes) -> np.ndarray:
    """The (height, width) ARGB pixels, unsigned 32-bit, of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at, end = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    while at + 8 <= end and data[at : at + 4] != b"VP8L":
        at += 8 + (n := int.from_bytes(data[at + 4 : at + 8], "little")) + (n & 1)
    if data[at : at + 4] != b"VP8L":
        raise ValueError("no lossless image in the file")
    bits = Bits(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    if bits.take(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = 1 + bits.take(14), 1 + bits.take(14)
    bits.take(1)  # a hint whether alpha is used
    if bits.take(3):
        raise ValueError("a VP8L version that is not known")
    steps: list[tuple] = []
    coded = width
    while bits.take(1):
        kind = bits.take(2)
        if kind in [s[0] for s in steps]:
            raise ValueError("a transform that occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = 2 + bits.take(3)
            size = [(n + (1 << tile) - 1) >> tile for n in (coded, height)]
            steps.append((kind, coded, tile, _read_image(bits, *size, False)))
        elif kind == PALETTE:
            n = 1 + bits.take(8)
            palette = np.cumsum(_channels(_read_image(bits, n, 1, False)), axis=0).astype(np.uint8).view("<u4").ravel().astype(np.uint32)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, coded, shift, palette))
            coded = (coded + (1 << shift) - 1) >> shift
        else:
            steps.append((kind, coded, 0, None))
    pixels = _read_image(bits, coded, height, True)
    for kind, wide, n, own in reversed(steps):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, wide, height, n, own)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, wide, height, n, own)
        elif kind == SUBTRACT_GREEN:
            pixels = _undo_green(pixels)
        else:
            pixels = _undo_palette(pixels, wide, len(pixels) // height, height, n, own)
    return pixels.reshape(height, width)


#: Pixels of a row, and rows of an image at most; longer payloads are stored as several images.
WIDTH, ROWS = 64, 16_000
#: A line, or a run of bytes 0, of so many bytes is taken from an earlier place if there is one.
COPIED = 24
#: Longest prefix code written; shorter ones make smaller tables for readers.
LONGEST_WRITTEN = 11
#: Longest length of one back-reference.
LONGEST_COPY = 4096


def _copies(data: bytes) -> list[tuple[int, int, int]]:
    """(place, length, distance) of lines that occurred before and of the bytes 0 at the end, in order, none overlapping."""
    found, seen, at = [], {}, 0
    end = len(data.rstrip(b"\0"))
    for line in data[:end].split(b"\n"):
        n = len(line)
        if n >= COPIED and (before := seen.setdefault(line, at)) != at:
            found.append((at, n, at - before))
        at += n + 1
    if len(data) - end > 4:
        found.append((end + 1, len(data) - end - 1, 1))
    return [(at + k, min(LONGEST_COPY, n - k), far) for at, n, far in found for k in range(0, n, LONGEST_COPY)]


def encode_image(data: bytes) -> bytes:
    """A lossless WebP file of grey pixels, one a byte, for a positive multiple of 64 bytes up to ``WIDTH * ROWS``.

    Red and blue are the green channel (subtract-green transform), so only green takes
    bits: prefix codes fitted to the bytes, and back-references for what occurred before.
    """
    values = np.frombuffer(data, np.uint8)
    copies = _copies(data)
    symbols, bits_of = values.astype(np.int32), np.ones(len(values), bool)
    lengths, distances = [], []
    for at, n, far in copies:
        bits_of[at + 1 : at + n] = False
        lengths.append(_split_value(n))
        distances.append(_split_value(far + len(PLANE)))
        symbols[at] = LITERALS + lengths[-1][0]
    kept = symbols[bits_of]
    counts = np.bincount(kept, minlength=LITERALS + LENGTHS)
    green = code_lengths({int(s): int(counts[s]) for s in np.flatnonzero(counts)}, LONGEST_WRITTEN)
    far = code_lengths(Counter(d[0] for d in distances), LONGEST_WRITTEN)
    out = Writer()
    for value, n in ((0x2F, 8), (WIDTH - 1, 14), (len(data) // WIDTH - 1, 14), (0, 1), (0, 3), (1, 1), (SUBTRACT_GREEN, 2), (0, 1), (0, 1), (0, 1)):
        out.put(value, n)
    for lengths_of, n in ((green, LITERALS + LENGTHS), ({0: 1}, 256), ({0: 1}, 256), ({255: 1}, 256), (far, DISTANCES)):
        _write_prefix(out, lengths_of, n)
    code, size = np.zeros(LITERALS + LENGTHS, np.uint32), np.zeros(LITERALS + LENGTHS, np.uint8)
    if len(green) > 1:
        for s, c in canonical(green).items():
            code[s], size[s] = c, green[s]
    v, n = code[kept], size[kept]
    if copies:
        # after its symbol a copy has the length's extra bits, the distance's symbol and its extra bits
        codes = canonical(far) if len(far) > 1 else {s: 0 for s in far}
        places = np.flatnonzero(kept >= LITERALS) + 1
        more = [x for a, b in zip(lengths, distances) for x in ((a[1], a[2]), (codes[b[0]], far[b[0]] if len(far) > 1 else 0), (b[1], b[2]))]
        v = np.insert(v, np.repeat(places, 3), np.array([x for x, _ in more], np.uint32))
        n = np.insert(n, np.repeat(places, 3), np.array([x for _, x in more], np.uint8))
    out.extend(v, n)
    image = out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(image)) + image + b"\0" * (len(image) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def encode(data: bytes) -> bytes:
    """One WebP file after the other for a payload of a positive multiple of 64 bytes."""
    step = WIDTH * ROWS
    return b"".join(encode_image(data[at : at + step]) for at in range(0, len(data), step))


def files(media: bytes) -> list[bytes]:
    """The single WebP files of stored media."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at:end])
        at = end
    return out


def decode_bytes(media: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The payload and the pixel arrays of stored media."""
    images = [decode(x) for x in files(media)]
    return b"".join(((p >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes() for p in images), images
