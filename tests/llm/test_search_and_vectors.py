"""Ranked search, whitening and linked vectors against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from shiftlens.llm import dual_tree, lattice, whitening

ITEMS = [
    (1, "The quick brown fox, the lazy DOG"), (2, None), (3, ""), (4, "... !!"), (5, "word word word"), (6, "w1 w2 w3 w299"), (6, "w1 w2 w3 w299"),
    (None, "one two"), (7, "İ 日本 it's x"), (8, "nowhere at_all"), (9, "a b c d e f g h i j k l m n o p"),
]


def ranked(docs, items, k):
    """Every score of every item, as the contract says it."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    held = [(i, Counter(term.findall(low(t)))) for i, t in docs]
    count, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc, c in held:
            score = 0
            for t in set(term.findall(low(text))):
                if c[t]:
                    m = 100 - 50 + (50 * sum(c.values()) * count) // length
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0 and doc is not None:
                rows.append((-score, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, doc) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "sizes"), [(50, {}), (3, {"item_bytes": 40, "tree_bytes": 20}), (2, {"tree_bytes": 30})])
def test_ranked_documents(spark, odd, sf, k, sizes):
    docs = odd.select("doc_id", "text").unionByName(sf("documents").selectExpr("doc_id + 100 AS doc_id", "text").limit(60))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").unionByName(sf("benchmark").selectExpr("item_id + 100 AS item_id", "text"))
    got = dual_tree.ranked_documents(docs, items, k=k, **sizes)
    want = ranked([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], k)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == want


def test_walk_of_the_trees_keeps_the_best():
    """Batches one after the other give what all scores at once give, ties by id, and whole groups are left out."""
    rng = np.random.default_rng(3)
    width, k = 60, 5
    weights = rng.integers(1, 40, width)
    items = [sorted(rng.choice(width, rng.integers(1, 9), replace=False).tolist()) for _ in range(37)]
    tree = dual_tree.ItemTree(items, weights, rng.integers(1, 9, width))
    search = dual_tree.Search(tree, k, np.zeros(len(items), np.int64))
    values = np.where(rng.random((3000, width)) < 0.1, rng.integers(1, 5, (3000, width)), 0) * weights
    values[100:] = values[100:] * (rng.random(2900) < 0.2)[:, None]
    ids = rng.permutation(3000)
    for at in range(0, 3000, 700):
        search.see(ids[at : at + 700], values[at : at + 700].astype(float))
    for place, item in enumerate(tree.order):
        scores = values[:, items[item]].sum(1)
        order = [i for i in np.lexsort((ids, -scores)) if scores[i] > 0][:k]
        assert search.best[place][0].tolist() == ids[order].tolist()
        assert search.best[place][1].tolist() == scores[order].tolist()


def test_search_without_rows(empty, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dual_tree.ranked_documents(empty, items).count() == 0
    assert dual_tree.ranked_documents(items.selectExpr("item_id AS doc_id", "text"), items.limit(0)).count() == 0


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, component int, node string").repartition(3)


@pytest.mark.parametrize("size", [1, 3, 24, 90])
def test_whitened(spark, size):
    rng = np.random.default_rng(size)
    plain = (rng.standard_normal((150, size)) * np.linspace(1, 3, size)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(plain)]
    odd = [(900, None), (901, [None] * size), (902, [math.nan] * size), (903, [math.inf] * size), (904, []), (905, [0.5] * (size + 1))]
    again = [(None, rows[0][1]), (1, rows[1][1])]
    got = whitening.whitened(vectors(spark, rows + odd + again)).collect()
    x = np.floor(64 * plain.astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, found = np.linalg.eigh(centred.T @ centred / n)
    values, found = values[::-1][:16], found[:, ::-1][:, :16]
    count = min(16, size)
    assert len(got) == 152 * count
    assert {(r["vec_id"]) for r in got} == {None, *range(150)}
    white = np.zeros((150, count))
    for r in got:
        if r["vec_id"] is not None:
            white[r["vec_id"], r["component"] - 1] = r["whitened"]
            assert r["n"] == n and r["deviation"] == int(((n * x[r["vec_id"]] - sums) ** 2).sum())
            assert abs(r["explained"] - values[r["component"] - 1] / np.trace(centred.T @ centred / n)) < 1e-10
            assert r["identity_error"] < 1e-10
    want = (x - sums / n) @ found / np.sqrt(values)
    assert np.abs(np.abs(white) - np.abs(want)).max() < 1e-8
    assert np.allclose(white * np.sign((white * want).sum(0)), want, atol=1e-8)  # one sign for all rows


def test_tasks_of_a_product_follow_the_vectors(spark):
    """Vectors come in 40 partitions, held at 40 by the shuffle; they still are one block, whose sum is one task's."""
    from shiftlens.session import beside

    many = beside(spark, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    rows = vectors(many, [(i, [float(i), float(i % 7)]) for i in range(400)]).repartition(40)
    blocks = whitening.blocks_of(rows.select(rows["embedding"].alias("vector")), 2)
    assert [r["n"] for r in blocks.collect()] == [400]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance_no_components(spark, rows):
    assert whitening.whitened(vectors(spark, rows)).collect() == []


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i % 5), 1.0, float(i % 3), 1e300]) for i in range(30)]
    got = whitening.whitened(vectors(spark, rows, "double")).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-10


@pytest.mark.parametrize("size", [40, 200])
def test_leading_pairs_of_close_and_equal_values(size):
    rng = np.random.default_rng(size)
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = np.sort(np.r_[[5.0] * 3, 4 + 1e-6 * np.arange(6), 3.0, rng.uniform(0, 2.9, size - 10)])[::-1]
    matrix = turn * values @ turn.T
    found, vectors_ = whitening.leading_pairs(lambda u: matrix @ u, size, 16)
    assert np.abs(found - values[:16]).max() < 1e-12
    assert np.linalg.norm(matrix @ vectors_ - vectors_ * found, axis=0).max() < 1e-12
    assert np.abs(vectors_.T @ vectors_ - np.eye(16)).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    right = rng.standard_normal((30, 3))
    right[:, 2] = 0
    assert np.abs(a @ whitening.minres(lambda u: a @ u, right, 60, np.zeros(3)) - right).max() < 1e-8


def linked(rows, least=0.95):
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if g else None for g, (_, v) in zip(good, rows, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    group, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                group[top(i)] = top(j)
    ids = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            ids[top(i)] = min(ids.get(top(i), own), own)
    return [(own, links[i], ids.get(top(i)), own == ids.get(top(i))) for i, (own, _) in enumerate(rows)]


def near(rng, v, cosine):
    z = rng.standard_normal(len(v))
    z -= (z @ v) * v / (v @ v)
    return (cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)).tolist()


@pytest.mark.parametrize("run", [1024, 16])
def test_linked_vectors(spark, monkeypatch, run):
    """Copies, tight and loose clusters, one larger than a block, chains, and rows that have no direction."""
    monkeypatch.setattr(lattice, "RUN", run)
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(200)]
    for c, (size, cosine) in enumerate([(90, 0.995), (60, 0.978), (40, 0.96), (3, 0.99), (2, 0.951)]):
        rows += [(1000 * (c + 1) + i, near(rng, np.array(rows[c][1]), cosine)) for i in range(size)]
    chain = np.array(rows[50][1])
    for i in range(12):
        chain = np.array(near(rng, chain, 0.97))
        rows.append((7000 + i, chain.tolist()))
    rows += [(8000 + i, rows[0][1]) for i in range(50)] + [(8100, (3 * np.array(rows[1][1])).tolist()), (None, rows[2][1]), (7, rows[3][1]), (7, rows[3][1])]
    rows += [(9000, None), (9001, [0.0] * 64), (9002, [None] * 64), (9003, [math.nan] * 64), (9004, [math.inf] * 64), (9005, []), (9006, [1e-300] * 64), (9007, [1e300] * 64)]
    rows += [(9100, [1.0, 0.0]), (9101, [1.0, 0.1]), (9102, [-1.0, 0.0]), (None, [0.0, 5.0]), (None, None)]
    got = lattice.linked_vectors(vectors(spark, rows, "double")).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, linked(rows)))


def test_recall_at_the_threshold(spark):
    """Pairs barely alike enough, each on its own: nothing else leads from one to the other."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        v = rng.standard_normal(64)
        rows += [(2 * i, v.tolist()), (2 * i + 1, near(rng, v, 0.9501))]
    got = lattice.linked_vectors(vectors(spark, rows, "double"))
    assert got.filter("n_links > 0").count() >= 0.97 * len(rows)
    assert got.filter("n_links > 1").count() == 0
    assert got.filter("component_id <> vec_id AND component_id <> vec_id - 1").count() == 0


def test_linked_vectors_of_whole_table(spark, sf):
    rows = [tuple(r) for r in sf("embeddings").select("vec_id", "embedding").collect()]
    got = lattice.linked_vectors(sf("embeddings")).collect()
    assert sorted(tuple(r) for r in got) == sorted(linked(rows))
    assert lattice.linked_vectors(sf("embeddings").limit(0)).collect() == []


def test_e8_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(2)
    y = rng.uniform(-3, 3, (400, 8))
    point = lattice.nearest_e8(y)
    twice = (2 * point).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(1)).all() and (point.sum(1) % 2 == 0).all()
    assert (np.linalg.norm(y - point, axis=1) <= 1 + 1e-12).all()  # no point of space is further than 1 from E8
    minimal = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    minimal.append(v)
    for bits in range(256):
        v = np.array([0.5 - (bits >> k & 1) for k in range(8)])
        if v.sum() % 2 == 0:
            minimal.append(v)
    minimal = np.array(minimal)
    assert len(minimal) == 240
    around = ((y[:, None, :] - point[:, None, :] - minimal) ** 2).sum(2)
    own = ((y - point) ** 2).sum(1)
    assert (around.min(1) >= own - 1e-12).all()
    further = np.stack([f for f, _ in lattice.neighbours(y, point)], 1).min(1)
    assert np.allclose(further, around.min(1) - own)
