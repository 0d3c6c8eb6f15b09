"""Toxicity: a classifier chain over label columns, each link a sparse linear model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.langid import _letters
from logweave.llm.linear import Row, probability, train
from logweave.llm.shared import cut, hash_bound, in_small_batches, small_batches, tidy

#: Buckets of the hashed features; letters of a word's beginning that are features beside the word.
BUCKETS, BEGINNINGS = 1 << 18, (3, 4, 5, 6)
#: Labelled rows that a chain is fitted on, about.
SAMPLE = 8000
#: How each link is trained.
HOW = {"rate": 0.3, "l1": 4.0, "l2": 0.01, "epochs": 4}
#: Rows of the sample that have a feature at least.
RARE = 3
#: Folds of the out-of-fold probabilities.
FOLDS = 3


def features(text: str | None) -> np.ndarray:
    """Buckets of the words of the whole text and of their first letters, with repeats; a word is a run of letters, lower-cased."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.int64)
    letters = points[letter].astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    place = (np.arange(len(letters)) - np.repeat(first, sizes)).astype(np.uint64)
    # a letter counts with its place, so a word's hash is a sum, and so is that of its beginning
    mixed = (letters * np.uint64(0x9E3779B97F4A7C15)) ^ ((place + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * np.uint64(0xBF58476D1CE4E5B9))])
    out = [sums[first + sizes] - sums[first] + np.uint64(1)]
    for n in BEGINNINGS:
        long = first[sizes > n]
        out.append(sums[long + n] - sums[long] + np.uint64(n << 8))
    h = np.concatenate(out)
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - 18)).astype(np.int64)


def row(text: str | None, earlier: list[float] = ()) -> Row:
    """Each bucket once with value 1, then the earlier categories' probabilities as features of their own."""
    at = np.unique(features(text))
    return np.append(at, BUCKETS + np.arange(len(earlier))).astype(np.int64), np.append(np.ones(len(at)), earlier)


@dataclass
class Chain:
    categories: list[str]
    weights: list[np.ndarray]
    thresholds: list[float]

    def __post_init__(self):
        self.used = [w[:BUCKETS, 0] != 0 for w in self.weights]

    def predict(self, text: str | None) -> list[float]:
        found = features(text)
        out: list[float] = []
        for w, used in zip(self.weights, self.used):
            at = np.unique(found[used[found]])
            full = np.append(at, BUCKETS + np.arange(len(out))).astype(np.int64)
            out.append(probability(w, (full, np.append(np.ones(len(at)), out))))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds with the best F1; one half if nothing is positive."""
    if not y.any():
        return 0.5
    grid = np.linspace(0.02, 0.98, 97)
    f1 = np.array([2 * ((p >= t) & (y == 1)).sum() / ((p >= t).sum() + y.sum()) for t in grid])
    best = grid[f1 >= f1.max() - 1e-9]
    return float(best[len(best) // 2])


def fit_chain(rows: list[Row], targets: list[list[int]], categories: list[str], folds: int = FOLDS) -> Chain:
    """Each link learns from the features and the earlier links' out-of-fold probabilities.

    A link that is asked at prediction time is fitted on all rows; what later links learn
    from, and what its threshold is set on, are probabilities of models that have not seen
    the row. Features that fewer than ``RARE`` rows have are left out.
    """
    often = np.zeros(BUCKETS, np.int64)
    for at, _ in rows:
        often[at] += 1
    rows = [(at[often[at] >= RARE], x[often[at] >= RARE]) for at, x in rows]
    earlier: list[list[float]] = [[] for _ in rows]
    weights, thresholds = [], []
    for k in range(len(categories)):
        size = BUCKETS + k
        full = [(np.append(at, BUCKETS + np.arange(k)).astype(np.int64), np.append(x, e)) for (at, x), e in zip(rows, earlier)]
        own = [t[k] for t in targets]
        weights.append(train(full, own, size, 1, **HOW))
        unseen = np.zeros(len(rows))
        for f in range(folds):
            part = train([r for i, r in enumerate(full) if i % folds != f], [t for i, t in enumerate(own) if i % folds != f], size, 1, **HOW)
            for i in range(f, len(rows), folds):
                unseen[i] = probability(part, full[i])
        earlier = [[*e, p] for e, p in zip(earlier, unseen.tolist())]
        thresholds.append(best_threshold(unseen, np.array(own)))
    return Chain(categories, weights, thresholds)


@in_small_batches
def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """A chain over ``categories``, 0/1 columns of ``labels``, in their order.

    Labels with a null id or category are left out, of several for one id the largest
    counts, and so do all documents of a repeated id. Of the labels those whose id hashes
    below a bound are taken, about ``sample``; that many can be broadcast to the documents.
    Their features are made where they are read; the chain is fitted on them in one task, in
    the order of their hashes. Without labels
    every probability is 0.
    """
    full = labels.where(F.col(id_col).isNotNull())
    for c in categories:
        full = full.where(F.col(c).isNotNull())
    full = cut(full.groupBy(F.col(id_col).alias("__id")).agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories]))
    n = full.count()
    if not n:
        return Chain(categories, [], [])
    order = F.xxhash64(F.col("__id"))
    chosen = F.broadcast(full.withColumn("__order", order).where(order <= F.lit(hash_bound(sample / n))))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(chosen, "__id").select("__order", "text", F.array(*categories).alias("target"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"order": b["__order"], "at": [np.unique(features(t)).astype(np.int32) for t in b["text"]], "target": b["target"]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [(o, at, t) for b in batches for o, at, t in zip(b["order"].tolist(), b["at"], b["target"])]
        made.sort(key=lambda m: (m[0], m[1].tobytes()))
        rows = [(np.asarray(at, np.int64), np.ones(len(at), np.float32)) for _, at, _ in made]
        chain = fit_chain(rows, [[int(v) for v in t] for _, _, t in made], categories)
        for k, w in enumerate(chain.weights):
            used = np.flatnonzero(w[:, 0])
            yield pd.DataFrame({"k": [k], "at": [used.tolist()], "weights": [w[used, 0].tobytes()], "threshold": [chain.thresholds[k]]})

    made = cut(rows.mapInPandas(tidy(vectors), "order long, at array<int>, target array<int>").repartition(1).mapInPandas(tidy(learn), "k int, at array<int>, weights binary, threshold double")).collect()
    weights, made = [], sorted(made, key=lambda r: r["k"])
    for r in made:
        w = np.zeros((BUCKETS + r["k"] + 1, 1), np.float32)
        w[r["at"], 0] = np.frombuffer(r["weights"], np.float32)
        weights.append(w)
    return Chain(categories, weights, [r["threshold"] for r in made])


def predict(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with columns ``<category>_score``, a probability from the whole text, and ``<category>``, whether it reaches the threshold.

    A null or empty text has no features and gets what the intercepts say; columns of the
    new names are replaced, and ``__found`` is a working column that ``docs`` must not have;
    repeated rows get the same; an empty table stays empty. The chain has a fixed size and goes
    along to the tasks. A chain without links, fitted without labels, says 0 and false.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain.categories

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.predict(t) or [0.0] * len(names) for t in texts], dtype=object)

    kept = [c for c in docs.columns if c not in {*names, *(f"{n}_score" for n in names)}]
    found = docs.withColumn("__found", run(F.col(text_col)))
    limits = chain.thresholds or [2.0] * len(names)
    new = [x for i, n in enumerate(names) for x in (F.col("__found")[i].alias(f"{n}_score"), (F.col("__found")[i] >= limits[i]).alias(n))]
    return found.select(*kept, *new)
