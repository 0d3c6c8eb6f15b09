"""The Jaccard join against brute force, in one unit and in many parts, and against its SQL."""

import random
import re

import duckdb
import numpy as np
import pytest

from logweave.llm import jaccard_join as jj
from logweave.llm import queries

SCHEMA = "doc_id long, text string, n long, name string, number int, parts int, unit string, known string, part int, root string, component_id string"


def shingle_set(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain(rows, percent=90):
    """(id, size, component) of (id, text) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        own = least.setdefault(root(i), [])
        own += [k] if k is not None else []
    return sorted(((k, len(sets[i]), min(least[root(i)], default=None)) for i, (k, _) in enumerate(rows)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n", 2, 3, "u", "k", 4, "r", "c") for i, t in rows], SCHEMA).repartition(3)


def copies(seed, n=60):
    """Texts and their near copies, some in chains, at similarities around the limit."""
    draw = random.Random(seed)
    out = []
    while len(out) < n:
        words = [f"W{draw.randrange(10**6)}" for _ in range(draw.choice([3, 9, 12, 25, 40, 90, 300]))]
        for _ in range(draw.randint(1, 6)):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                at = draw.randrange(len(words))
                words[at : at + draw.randint(0, 1)] = [f"w{draw.randrange(10**6)}"]
    draw.shuffle(out)
    return out


ODD = [None, "", " ", "a", "A", "a b", "a  B ", "a b c", "A\tb\nc\x0b", "a b c d", "é É e", "é é e", "\0 ", "\0", "long " * 9000, "long " * 8000 + "x", "a\xa0b c"]


@pytest.mark.parametrize("most", [512, 3])
def test_components_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(jj, "SETS", most)
    monkeypatch.setattr(jj, "BRIDGE", 1)
    texts = [*ODD, *copies(most, 150)]
    rows = [*enumerate(texts), (None, "a b"), (None, texts[-1] + " x"), (None, None), (3, texts[3]), (5, texts[-2])]
    got = jj.jaccard_join(frame(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_empty(spark):
    assert jj.jaccard_join(frame(spark, [])).count() == 0
    assert [tuple(r) for r in jj.jaccard_join(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_sets_that_link_share_a_part(percent):
    draw = random.Random(percent)
    word = lambda: draw.getrandbits(64)
    linked = 0
    for _ in range(1500):
        n = draw.choice([1, 2, 3, 9, 10, 11, 12, 13, 18, 19, 20, 27, 40, 60, 100, 333])
        a = {word() for _ in range(n)}
        b = set(a)
        for _ in range(draw.randint(0, 1 + n * (100 - percent) // 90)):
            if draw.random() < 0.5 and len(b) > 1:
                b.discard(draw.choice(sorted(b)))
            else:
                b.add(word())
        if a != b and 100 * len(a & b) >= percent * len(a | b):
            linked += 1
            x, y = (set(jj.part_keys(np.array(sorted(s), np.uint64), percent).tolist()) for s in (a, b))
            assert x & y
    assert linked > 100


def test_parts_of_other_sets_differ():
    draw = np.random.default_rng(1)
    keys = [set(jj.part_keys(np.unique(draw.integers(0, 2**64, n, np.uint64)), 90).tolist()) for n in draw.integers(100, 900, 60)]
    assert sum(bool(a & b) for i, a in enumerate(keys) for b in keys[:i]) == 0


@pytest.mark.parametrize("two", [False, True])
def test_trees_lose_no_link(two):
    sets = []
    for t in copies(7, 90):
        own = {hash((two, x)) % 2**64 for x in shingle_set(t)}
        sets.append(np.array(sorted(own), np.uint64))
    n = 37
    known = np.array([str(i if i % 9 else 0) for i in range(len(sets))])
    found = jj.tree_links(sets[:n], sets[n:], 90, known) if two else jj.tree_links(sets, None, 90, known)
    parent = list(range(len(sets)))

    def connect(pairs):
        own = list(parent)

        def root(i):
            while own[i] != i:
                i = own[i]
            return i

        for a, b in pairs:
            own[root(a)] = root(b)
        return [root(i) for i in range(len(sets))]

    same = [(0, i) for i in range(0, len(sets), 9)]
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
    want = [(i, j) for i in range(len(sets)) for j in range(i) if (not two or (i < n) != (j < n)) and near(sets[i], sets[j])]
    mine, all_of_it = connect(same + found), connect(same + want)
    classes = lambda roots: {tuple(i for i, r in enumerate(roots) if r == k) for k in set(roots)}
    assert classes(mine) == classes(all_of_it) and set(found) <= {x for p in want for x in (p, p[::-1])}


def test_inner_nodes_rule_out_pairs():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 2**64, 200, np.uint64)) for _ in range(64)]
    tree = jj.SignatureTree(sets, 256)
    assert [len(x[0]) for x in tree.levels] == [64, 8, 1]
    i, j = (a.ravel() for a in np.triu_indices(8, 1))
    kept = jj._possible(tuple(a[i] for a in tree.levels[1]), tuple(a[j] for a in tree.levels[1]), 90)
    assert kept.mean() < 0.1


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op11_jaccard_join"])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries.queries()["op11_jaccard_join"](spark, sf).select(*columns).collect()]
    assert got and sorted(got) == sorted(want.fetchall())
