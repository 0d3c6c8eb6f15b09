"""Language ID: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.linear import Row, scores, softmax, temperature, train
from logweave.llm.shared import cut, hash_bound, in_small_batches, small_batches, tidy

#: Buckets of the hashed n-grams, and the longest n.
BUCKETS, LONGEST = 1 << 15, 3
#: Labelled rows that the weights are fitted on, about; document frequencies are those of all labelled rows.
SAMPLE = 6000
#: Most labels that a model has; more are an error, as the weights grow with them.
LANGUAGES = 200
#: Share of the sample kept back for the temperature.
CALIBRATION = 0.2
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8).astype(bool)


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur in the whole text, letters lower-cased and all else one space; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.uint32)
    points = points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]
    found = []
    h = np.zeros(len(points), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] * np.uint32(0x01000193)) ^ (points[n - 1 :] * np.uint32(0x9E3779B1))
        found.append(((h ^ np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15))
    return np.bincount(np.concatenate(found), minlength=BUCKETS)


def features(found: np.ndarray, idf: np.ndarray) -> Row:
    """TF-IDF of the buckets that occur, of length 1."""
    at = np.flatnonzero(found)
    x = found[at] / found.sum() * idf[at]
    return at, x / (np.sqrt(x @ x) or 1.0)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        p = softmax(scores(self.weights, features(found, self.idf)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


@in_small_batches
def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the languages in ``lang_col``, from rows where text and label are not null.

    Document frequencies and the list of languages cover all those rows: tasks add theirs
    up, and what reaches the driver is a number for each bucket. The rows whose text hashes
    below a bound that lets about ``sample`` through are chosen where they are read, and the
    weights are fitted on them in one task.
    Of these a fifth sets the temperature. Without labelled rows every prediction is ``und``.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df_, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for text in b["text"]:
                if (found := counts(text)) is not None:
                    df_ += found > 0
                    n += 1
        at = np.flatnonzero(df_)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df_[at], n)})

    totals = rows.select("text").mapInPandas(tidy(frequencies), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels in {lang_col}")
    n = sum(r["n"] for r in totals if r["bucket"] == -1)
    idf = np.zeros(BUCKETS)
    for r in totals:
        if r["bucket"] >= 0:
            idf[r["bucket"]] = np.log((1 + n) / (1 + r["n"])) + 1.0
    if not n or not languages:
        return Model([], idf, np.zeros((BUCKETS + 1, 0), np.float32), 1.0)
    number = {x: i for i, x in enumerate(languages)}

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[tuple[Row, int, int]] = []
        for b in batches:
            for text, lang, order in zip(b["text"], b["lang"], b["order"].tolist()):
                if (found := counts(text)) is not None:
                    at, x = features(found, idf)
                    made.append(((at.astype(np.int32), x.astype(np.float32)), number[lang], order))
        made.sort(key=lambda m: (m[2], m[1]))
        kept = len(made) - int(len(made) * CALIBRATION)
        weights = train([m[0] for m in made[:kept]], [m[1] for m in made[:kept]], BUCKETS, len(languages), l1=0.02)
        rest = made[kept:]
        t = temperature(np.array([scores(weights, m[0]) for m in rest]).reshape(len(rest), len(languages)), np.array([m[1] for m in rest], int))
        yield pd.DataFrame({"weights": [weights.tobytes()], "t": [t]})

    order = F.xxhash64("text")
    chosen = rows.withColumn("order", order).where(order <= F.lit(hash_bound(sample / n)))
    # of a repeated text one row: all its copies are in the sample or out of it together
    chosen = chosen.groupBy("order", "lang").agg(F.first("text").alias("text"))
    model = cut(chosen.repartition(1).mapInPandas(tidy(learn), "weights binary, t double")).first()
    weights = np.frombuffer(model["weights"], np.float32).reshape(BUCKETS + 1, len(languages))
    return Model(languages, idf, weights, model["t"])


def predict(df: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the language of each whole text and the calibrated probability of it.

    A null text, an empty one and one without a letter is ``und`` with score 0. Only the
    text is an input, so repeated rows get the same; an empty table stays empty; columns of
    the new names are replaced, and ``__found`` is a working column that ``df`` must not have. The model has a fixed size and goes along to the tasks.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from judge(batches)

    @tidy
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    found = df.withColumn("__found", run(F.col(text_col)))
    kept = [c for c in df.columns if c not in names]
    return found.select(*kept, F.col("__found.lang").alias(names[0]), F.col("__found.score").alias(names[1]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is none to learn from: crc32 of the id as text, modulo 3, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``df`` with ``held_out``, ``lang_pred`` and ``score``; learns from rows that are not held out and have a label.

    Without such rows every prediction is ``und``; an empty table stays empty; of repeated texts one row is learnt from.
    """
    model = fit(df.where(~held_out(id_col)), text_col, lang_col, sample)
    return predict(df.withColumn("held_out", held_out(id_col)), model, text_col)
