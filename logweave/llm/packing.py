"""Best-fit packing: token pieces packed by length patterns whose repeats are fitted by non-negative least squares."""

from __future__ import annotations

import bisect
import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.shared import cut, drop, if_small, in_small_batches, kept_for_a_task, rebalanced, table, tidy

#: Tokens of a sequence.
SEQUENCE = 2048
#: Vocabulary file, a name of the public tokenizers or a path.
VOCABULARY = "byte_bpe_50k.json"
#: Sweeps of the least-squares fit at most, and the share of the residual at which it ends.
SWEEPS, SETTLED = 25, 1e-3
#: Steps of the shorter documents' lengths in patterns of three and four.
STEPS = 40


@kept_for_a_task(maxsize=2)
def encoder(vocabulary: str):
    """The vocabulary file's byte-level BPE.

    Ids are those of ``tokenizers.Tokenizer.from_file(...).encode(text, add_special_tokens=False)``,
    added tokens included; the same merges run in tiktoken, which is four times as fast here. A test
    holds both against each other.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        spec = json.load(file)
    # The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for code points from 256.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The text's ids and an id 0 after them, as little-endian unsigned 32-bit."""
    ids = encoder(vocabulary).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, 0).astype("<u4")


def pieces(df: DataFrame, id_col: str, text_col: str, size: int, vocabulary: str, keep_ids: bool) -> DataFrame:
    """Pieces of every document, numbered within (task, length): ``part`` and ``place``."""
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            out = []
            for key, text in zip(b["id"], b["text"]):
                ids = token_ids(text, vocabulary)
                edges = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                for n, (a, z) in enumerate(zip(edges, edges[1:])):
                    own = ids[a:z]
                    out.append((key, n, a, z - a, zlib.crc32(own.tobytes()), part, seen[z - a], *([own.astype(np.int64)] if keep_ids else [])))
                    seen[z - a] += 1
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", "part", "place", *(["ids"] if keep_ids else [])])

    schema = "id string, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids array<long>" * keep_ids
    return rows.mapInPandas(tidy(run), schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def patterns(lengths: list[int], size: int, steps: int = STEPS) -> list[tuple[int, ...]]:
    """Multisets of two to four lengths with the sum ``size``.

    All pairs; triples and quadruples whose shorter members are any of ``steps`` of the
    lengths, spread over them evenly, while the two longest members are free.
    """
    have = set(lengths)
    short = [x for x in lengths if x <= size // 2]
    grid = sorted({short[round(i * (len(short) - 1) / max(1, steps - 1))] for i in range(steps)}) if short else []
    few = grid[:: max(1, len(grid) // 8)]
    out = [(size - b, b) for b in lengths if 2 * b <= size and size - b in have]
    rests = [(c,) for c in grid] + [(c, d) for c in few for d in few if d <= c]
    for rest in rests:
        left = size - sum(rest)
        out += [(left - b, b, *rest) for b in short if rest[0] <= b and 2 * b <= left and left - b in have]
    return out


def fit(columns: list[tuple[int, ...]], histogram: dict[int, int], size: int, sweeps: int = SWEEPS) -> list[float]:
    """Repeat counts x >= 0 that minimise the squares of histogram - sum of x * column, by coordinate descent from zero."""
    left = [0.0] * (size + 1)
    for length, n in histogram.items():
        left[length] = float(n)
    members = [list(Counter(c).items()) for c in columns]
    norms = [sum(k * k for _, k in m) for m in members]
    x, total = [0.0] * len(columns), sum(histogram.values()) or 1
    for _ in range(sweeps):
        moved = 0.0
        for j, own in enumerate(members):
            step = 0.0
            for length, k in own:
                step += k * left[length]
            step = max(-x[j], step / norms[j])
            if step:
                x[j] += step
                moved += abs(step)
                for length, k in own:
                    left[length] -= k * step
        if moved < SETTLED * total:
            break
    return x


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal bins are filled together, so the work follows the lengths and not the documents."""
    spaces: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        if not groups[space]:
            bisect.insort(spaces, space)
        groups[space].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                each = size // length
                if n >= each:
                    put(size - each * length, (length,) * each, n // each)
                    n %= each
                else:
                    put(size - n * length, (length,) * n, 1)
                    n = 0
                continue
            space = spaces[at]
            pattern, have = groups[space].pop()
            if not groups[space]:
                spaces.pop(at)
            # a bin that got one takes the next too, as long as it is the tightest: all that fit
            each = min(space // length, max(1, n)) if space // length > 1 and have * (space // length) >= n else 1
            used = min(have, max(1, n // each))
            put(space - each * length, pattern + (length,) * each, used)
            if have > used:
                put(space, pattern, have - used)
            n -= used * each
    return [g for own in groups.values() for g in own]


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly.

    Full pieces stand alone. Patterns of few documents are fitted to the histogram; counts
    are rounded, the most frequent first and no more than what is left; the rest is packed
    by best fit.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    out = [((size,), left.pop(size))] if size in left else []
    columns = patterns(sorted(left), size)
    x = fit(columns, left, size)
    for j in sorted(range(len(columns)), key=lambda j: -x[j]):
        want = int(x[j] + 0.5)
        if not want:
            break
        own = Counter(columns[j])
        if (n := min(want, min(left[length] // k for length, k in own.items()))) > 0:
            out.append((columns[j], n))
            for length, k in own.items():
                left[length] -= n * k
    return out + best_fit({k: n for k, n in left.items() if n}, size)


def runs(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: from which rank on, the number to add to a rank to get its sequence, and the offset in the sequence."""
    taken: Counter = Counter()
    found = defaultdict(list)
    sequence = 0
    for pattern, n in packed:
        offset = 0
        for length in pattern:
            found[length].append((taken[length], sequence - taken[length], offset))
            taken[length] += n
            offset += length
        sequence += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*own)) for length, own in found.items()}


@in_small_batches
def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` if asked for.

    A document is its token ids and an id 0; a null text counts as empty and is the one id
    0. Documents longer than ``size`` are cut into pieces of ``size``, the first of which
    may be shorter; pieces of a document may stand in any sequences. Repeated rows and ids
    and null ids are documents like any other; other columns are not read. An empty table
    gives an empty result.

    Tokens are made once, in the tasks that read the text, and kept as a narrow table. Only
    the histogram of lengths (``size`` rows at most) reaches the driver. A piece's rank
    within its length is its place within (task, length) plus the sum of earlier tasks'
    counts, so a length that a third of all pieces share is never sorted in one task. The
    plan that goes to the tasks has a row for each pattern member: its patterns are those of
    ``patterns`` and one or two a length from the best fit, whatever the number of documents.
    """
    spark = df.sparkSession
    made, path = table(pieces(df, id_col, text_col, size, vocabulary, keep_ids))
    counts = cut(made.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    from pyspark.sql import Window

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    bases = if_small(cut(rebalanced(bases)))
    lookup = spark.sparkContext.broadcast(runs(plan(histogram, size)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lengths, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(b) else []:
                first, add, place = lookup.value[int(lengths[own[0]])]
                at = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = rank[own] + add[at], place[at]
            yield b.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    kind = df.schema[id_col].dataType
    ranked = made.join(bases, ["length", "part"]).select(F.col(id_col).cast("string").alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), (F.col("base") + F.col("place")).alias("rank"))
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    out = cut(ranked.mapInPandas(tidy(assign), schema).withColumn(id_col, F.col(id_col).cast(kind)))
    drop(spark, path)
    return out
