import numpy as np
import pytest

from layoutcheck.llm import mips, nearvec
from layoutcheck.llm.mips import top_inner_products
from layoutcheck.llm.nearvec import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None), (9002, [None, 1.0] + [0.0] * 14), (9003, [float("nan")] * 16), (9004, [float("inf")] * 16), (9005, [0.0] * 16), (9006, [])]


def vectors(n=300, dim=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dim))
    x = centres[r.integers(0, 12, n)] + r.standard_normal((n, dim)) * r.choice([0.05, 0.25, 1.0], (n, 1))
    x[: n // 4] = x[0] * r.uniform(0.5, 3, (n // 4, 1))  # many on one ray
    return [(int(i), [float(v) for v in row]) for i, row in zip(r.permutation(n), x.astype(np.float32))]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)


def brute_links(rows, least=0.9):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    n, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(ok):
        for j, b in ok[:k]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, n[i], find(i), find(i) == i) for i in n)


def links(df):
    return sorted((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "interval", "leaf"), [(1, 4096, 128), (2, 40, 8), (3, 17, 3)])
def test_near_duplicates_are_the_brute_force(spark, monkeypatch, seed, interval, leaf):
    monkeypatch.setattr(nearvec, "INTERVAL_BYTES", interval * 16 * 8)
    monkeypatch.setattr(nearvec, "FANOUT", 2)
    monkeypatch.setattr(nearvec, "LEAF", leaf)
    rows = vectors(seed=seed) + ODD + [(9010, [1.0, 0.0]), (9011, [2.0, 0.0]), (9012, [0.0, 1.0])]
    assert links(near_duplicates(frame(spark, rows))) == brute_links(rows)


def test_ranges_of_many_intervals_are_the_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearvec, "INTERVAL_BYTES", 9 * 16 * 8)
    monkeypatch.setattr(nearvec, "MOST_RANGES", 2)
    monkeypatch.setattr(nearvec, "FANOUT", 3)
    rows = vectors(seed=4)
    assert links(near_duplicates(frame(spark, rows))) == brute_links(rows)


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(frame(spark, []).where("false")).count() == 0
    assert links(near_duplicates(frame(spark, ODD))) == [(i, 0, i, True) for i, _ in ODD]
    same = near_duplicates(frame(spark, [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.1]), (None, [1.0, 0.0])]).selectExpr("*", "1 AS id", "2 AS v", "3 AS dim"))
    assert sorted((r["id"] or 0, r["component_id"] or 0, r["kept"]) for r in same.collect()) == [(0, 0, False), (3, 3, True), (5, 3, False), (5, 3, False)]


def test_very_large_and_small_lengths(spark):
    rows = [(1, [1e38, 1e38]), (2, [1e-38, 1e-38]), (3, [1.0, -1.0])]
    assert links(near_duplicates(frame(spark, rows))) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def brute_top(rows, every, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    out = []
    for i, q in ok:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i and len(c) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "block", "head"), [(1, 1024, 2048), (2, 16, 20), (3, 7, 1)])
def test_top_products_are_the_brute_force(spark, monkeypatch, seed, block, head):
    monkeypatch.setattr(mips, "BLOCK", block)
    monkeypatch.setattr(mips, "HEAD", head)
    monkeypatch.setattr(mips, "LEVELS", (2, 5))
    rows = vectors(seed=seed) + ODD + [(9050, [3.0, 4.0]), (9051, [1.0, 1.0])]
    got = sorted(tuple(r) for r in top_inner_products(frame(spark, rows), every=10).collect())
    assert got == brute_top(rows, 10, 5)


def test_many_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(mips, "QUERIES", 5)
    rows = vectors(80, seed=4)
    assert sorted(tuple(r) for r in top_inner_products(frame(spark, rows), every=2, k=3).collect()) == brute_top(rows, 2, 3)


def test_candidates_too_short_for_a_block_are_not_needed():
    axes = np.eye(3)
    q = mips.Turned.of(np.array([0, 1]), np.array([[2.0, 0, 0], [0, 4.0, 0]]), axes)
    best = mips._Best(2, 1)
    assert mips.least_length(best, q) == 0.0
    best.kth[:] = [10.5, 16.5]
    assert 3.99 < mips.least_length(best, q) <= 4.0
    assert mips.least_length(best, mips.Turned.of(np.array([0, 1]), np.array([[2.0, 0, 0], [0, 0, 0]]), axes)) == 0.0


def test_ties_few_candidates_and_large_numbers(spark):
    rows = [(0, [1.0]), (3, [2.0]), (1, [2.0]), (2, [2.0])]
    assert sorted(tuple(r) for r in top_inner_products(frame(spark, rows)).collect()) == [(0, 1, 1, 131072), (0, 2, 2, 131072), (0, 3, 3, 131072)]
    big = [(0, [3e15, 1.0]), (1, [3e15, 1.0]), (2, [1.0, 2.0]), (3, [-3e15, 0.0])]
    got = {r["vec_id"]: r["score"] for r in top_inner_products(frame(spark, big)).collect()}
    assert got[1] == 2**63 - 1 and got[3] == -(2**63) and got[2] > 0
    assert top_inner_products(frame(spark, []).where("false")).count() == 0
    assert top_inner_products(frame(spark, ODD)).count() == 0
    own = top_inner_products(frame(spark, [(50, [1.0]), (50, [1.0]), (7, [5.0])]).selectExpr("*", "1 AS score", "2 AS id"))
    assert [(r["query_id"], r["vec_id"]) for r in own.collect()] == [(50, 7)]
