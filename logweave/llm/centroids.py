"""Centroid clustering of vectors in whole numbers: rounds of assignment by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.shared import cut, drop, table

#: Components after scaling lie within this; then squared distances of 64 of them fit 64 bits.
LARGEST = 1 << 27
#: Dimensions that are added before a centroid is looked at again.
STEP = 8
#: Vectors that are compared at a time.
ROWS = 1 << 13


def quantised(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``(id_col, v)``: vectors of exactly ``dims`` finite components, each as floor(scale * x) of the double x."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.transform(x, lambda y: F.when(F.abs(y * scale) < LARGEST, F.floor(y * scale)).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {LARGEST}")).cast("bigint")).cast("int"))
    finite = F.forall(x, lambda y: F.coalesce(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    return df.where((F.size(vector_col) == dims) & finite).select(F.col(id_col), whole.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def nearest(points: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point, of equals the smaller number, and the squared distance.

    Squared differences are added ``STEP`` dimensions at a time in the given order. The
    centroid that is nearest over the first ones is finished first; each other one is left
    for the points whose sum has come strictly above their best so far.
    """
    x, c = points[:, order], centroids[:, order]
    best, own = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(c))

    def added(rows: np.ndarray | slice, j: int, at: int) -> np.ndarray:
        apart = x[rows, at : at + STEP] - c[j, at : at + STEP]
        return np.einsum("ij,ij->i", apart, apart)

    first = np.stack([added(slice(None), j, 0) for j in range(len(c))])
    guess = first.argmin(axis=0)
    for turn in (True, False):
        for j in range(len(c)):
            rows = np.flatnonzero((guess == j) == turn)
            d = first[j, rows]
            for at in range(STEP, x.shape[1], STEP):
                on = d <= best[rows]
                rows, d = rows[on], d[on]
                d = d + added(rows, j, at)
            better = (d < best[rows]) | (d == best[rows]) & (j < own[rows])
            best[rows[better]], own[rows[better]] = d[better], j
    return own, best


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part.column(0), _matrix(part.column(1), dims)


def _spread_of(kept: DataFrame, dims: int) -> np.ndarray:
    """Dimensions, that of the highest variance first; it decides the order of work only."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((2, dims))
        for _, points in _blocks(batches, dims):
            n += len(points)
            sums += points.sum(axis=0), (points.astype(float) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"place": np.arange(dims, dtype=np.int32), "n": np.full(dims, n), "s": sums[0], "s2": sums[1]})

    rows = kept.mapInArrow(moments, "place int, n long, s double, s2 double").groupBy("place").agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")])
    variance = {r["place"]: (r["s2"] - r["s"] ** 2 / r["n"]) / r["n"] for r in rows.collect() if r["n"]}
    return np.array(sorted(range(dims), key=lambda i: (-variance.get(i, 0.0), i)))


def _means(kept: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of means, exact; one without vectors stays."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for _, points in _blocks(batches, dims):
            own, _ = nearest(points, centroids, order)
            for j in range(k):
                mine = points[own == j]
                total[j, :dims] += mine.sum(axis=0)
                total[j, dims] += len(mine)
        j, place = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"cluster": j.astype(np.int32), "place": place.astype(np.int32), "total": total[j, place]})

    out, found = centroids.copy(), {}
    for r in kept.mapInArrow(sums, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        found[r["cluster"], r["place"]] = int(r["total"])
    for j in range(k):
        if n := found.get((j, dims), 0):
            out[j] = [found.get((j, i), 0) // n for i in range(dims)]
    return out


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3") -> DataFrame:
    """``(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, a row for each vector that is kept.

    Kept are vectors of exactly ``dims`` components, none null or not finite, as whole numbers
    (``quantised``); one of 2**27 or more is an error, since its distances don't fit 64 bits.
    The first centroids are those with the smallest SHA-256 of ``salt:id``, then the
    smallest vector (a null id comes last); repeated rows are vectors like any other, and with
    fewer than ``k`` vectors there are as many centroids. Equal distances go to the smaller
    number. An empty table gives an empty result; other columns are not read.

    A round is one pass over the vectors: tasks assign them and add them up, and the driver
    sees k * (dims + 1) sums, however many vectors there are.
    """
    spark = df.sparkSession
    kept, path = table(quantised(df, id_col, vector_col, dims, scale))
    firsts = kept.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")).cast("binary"), 256).asc_nulls_last(), "v").limit(k)
    centroids = np.array([r["v"] for r in firsts.collect()], np.int64).reshape(-1, dims)
    order = _spread_of(kept, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _means(kept, centroids, order)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in _blocks(batches, dims):
            own, far = nearest(points, centroids, order)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(far)], names=[id_col, "cluster", "distance"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    found = cut(kept.mapInArrow(assign, schema))
    drop(spark, path)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(j, s, sum(sums.values()), digests[j]) for j, s in sums.items()]
    # at most k rows
    return found.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
