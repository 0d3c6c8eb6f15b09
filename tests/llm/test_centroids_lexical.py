"""Centroid clustering and lexical search against brute force, on odd inputs and against their SQL."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from logweave.llm import centroids, lexical, queries
from logweave.operators.storage import release

VECTORS = "vec_id long, embedding array<float>, v string, cluster int, distance string, place int"


def plain_clusters(vectors, k, rounds):
    """``vectors``: (id, whole numbers)."""
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    first = sorted(vectors, key=lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1]))
    own = [v for _, v in first[:k]]
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in vectors:
            groups[min(range(len(own)), key=lambda c: (apart(v, own[c]), c))].append(v)
        own = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else own[c] for c in range(len(own))]
    rows = [(i, *min((apart(v, z), c) for c, z in enumerate(own))) for i, v in vectors]
    total = collections.Counter()
    for _, d, c in rows:
        total[c] += d
    digest = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in own]
    return sorted(((i, c, d, total[c], sum(total.values()), digest[c]) for i, d, c in rows), key=repr)


@pytest.mark.parametrize("n", [0, 1, 5, 60])
def test_clusters_equal_brute_force(spark, n):
    draw = random.Random(n)
    rows = [(i, [draw.choice([-1.5, -0.001, 0.0, 0.25, 0.7501, 3.0]) for _ in range(4)]) for i in range(n)]
    rows += rows[:3] + [(None, [0.5, 0.5, 0.5, 0.5])] * (n > 0)
    bad = [(90, None), (91, []), (92, [1.0, 2.0, 3.0]), (93, [1.0, None, 3.0, 4.0]), (94, [1.0, float("nan"), 3.0, 4.0]), (95, [float("inf"), 1.0, 1.0, 1.0]), (96, [1.0] * 5)]
    frame = spark.createDataFrame([(i, v, "v", 1, "d", 2) for i, v in rows + bad], VECTORS).repartition(3)
    got = centroids.centroid_clusters(frame, k=8, rounds=4, dims=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(whole, 8, 4)
    release(spark)


def test_a_component_too_large_is_an_error(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="reaches"):
        centroids.centroid_clusters(frame, dims=2).collect()


@pytest.mark.parametrize("dims", [1, 8, 20, 64])
def test_partial_distances_are_whole_in_the_end(dims):
    draw = np.random.default_rng(dims)
    points, own = draw.integers(-3, 4, (500, dims)), draw.integers(-3, 4, (9, dims))
    points[:50] = own[draw.integers(0, 9, 50)]
    own[5] = own[2]
    far = ((points[:, None] - own[None]) ** 2).sum(axis=2)
    cluster, d = centroids.nearest(points, own, draw.permutation(dims))
    assert (d == far.min(axis=1)).all() and (cluster == far.argmin(axis=1)).all()


# lexical search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TEXTS = [None, "", " .,-", "a", "A b, c-d; a a", "É é É e", "x_y`z{w}~\x7f\x80 \xa0", "漢字 a🙂b 漢字", "long " * 3000 + "a", "a", "b b b c", "d" * 5000, "\0a\0"]
QUERIES = [None, "", "...", "a b c", "a A a", "É 漢字", "nothing here", "long d", "z w \x80"]
DOCS = "doc_id long, text string, id string, item long, rank int, score string, terms int, item_id int"


def low(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_search(docs, items, k):
    counts = [(i, collections.Counter(low(t))) for i, t in docs]
    n, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(low(text)) if w in c)
            if score > 0:
                found.append((-score, math.inf if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    left = spark.createDataFrame([(i, t, "i", 1, 2, "s", 3, 4) for i, t in docs], DOCS).repartition(3)
    return left, spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int").coalesce(1)


@pytest.mark.parametrize(("k", "known"), [(50, 1 << 20), (2, 1 << 20), (3, 0)])
def test_search_equals_brute_force(spark, monkeypatch, k, known):
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", known)
    monkeypatch.setattr(lexical.build_index, "__defaults__", ("doc_id", "text", None, 4))
    draw = random.Random(k)
    docs = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "a b"), (None, "a b")] + [(100 + i, " ".join(draw.choices("abcdefgh", k=draw.randint(1, 9)))) for i in range(60)]
    items = [*enumerate(QUERIES), (3, QUERIES[3]), (None, "a b")]
    got = lexical.lexical_search(*frames(spark, docs, items), k=k, block=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, k)


def test_search_of_nothing(spark):
    assert lexical.lexical_search(*frames(spark, [], [(1, "a")])).count() == 0
    assert lexical.lexical_search(*frames(spark, [(1, "a b"), (2, "c")], [])).count() == 0
    assert lexical.lexical_search(*frames(spark, [(1, None), (2, "")], [(1, "a")])).count() == 0


def test_postings_round_trip():
    draw = np.random.default_rng(1)
    for values in ([], [0], [127, 128, 0, 1 << 14, (1 << 14) - 1, 1 << 40], draw.integers(0, 1 << 20, 1000)):
        data, ends = lexical.packed(np.array(values, np.int64))
        assert lexical.unpacked(data).tolist() == list(values) and len(ends) == len(values)
        assert len(data) == sum(max(1, -(-int(v).bit_length() // 7)) for v in values)


def test_session_settings_stay(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    lexical.lexical_search(*frames(spark, [(1, "a b"), (2, "c")], [(1, "a")])).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


@pytest.mark.parametrize("name", ["op12_lexical", "op13_centroids"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries.queries()[name](spark, sf).select(*columns).collect()]
    assert got and sorted(got) == sorted(want.fetchall())
