import random

import pytest

from layoutcheck.llm import ngram_join as nj
from layoutcheck.llm.ngram_join import jaccard_components


def brute(rows, n=3):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().translate(bytes(range(256)).lower()).split()
        own = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets[i] = own
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 60))
    rows, passage = [], [word() for _ in range(40)]
    for i in range(60):
        rows.append((i, " ".join(word() for _ in range(r.randint(1, 80)))))
    base = [word() for _ in range(120)]
    for i in range(60, 100):  # near copies, from none to many edits
        own = list(base)
        for _ in range(r.randint(0, 7)):
            own[r.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))
    for i in range(100, 115):  # a passage that many share
        rows.append((i, " ".join(passage + [word() for _ in range(r.randint(0, 10))])))
    for i in range(115, 125):  # copies, also in other case
        rows.append((i, r.choice([str.upper, str.lower])(rows[5][1])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_the_brute_force(documents, seed):
    rows = corpus(seed)
    assert result(jaccard_components(documents(rows))) == brute(rows)


def test_longer_prefixes_lose_nothing(documents, monkeypatch):
    monkeypatch.setattr(nj, "matches", lambda estimates, base, documents: len(estimates) - base + 1)
    rows = corpus(3)
    assert result(jaccard_components(documents(rows))) == brute(rows)


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, " "), (9, " "), (10, None)]
    assert result(jaccard_components(documents(rows))) == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 7), 8: (1, 8), 9: (1, 8), 10: (0, 10)}
    again = documents([(7, "a b c d"), (7, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "x y z"), (9, "other words here")])
    got = sorted(map(repr, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(again).collect())))
    assert got == sorted(map(repr, [(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 2, 3), (None, 1, None), (9, 1, 9)]))
    assert jaccard_components(documents([(1, "a")]).where("false")).count() == 0
    clash = documents([(1, "a b c"), (2, "a b c")]).selectExpr("*", "1 AS class", "'x' AS token", "2 AS n", "3 AS mark")
    assert result(jaccard_components(clash)) == {1: (1, 1), 2: (1, 1)}


def test_the_threshold_is_exact(documents):
    base = [f"w{i}" for i in range(21)]  # 19 elements; one more word makes 20: 19 / 20, two more 19 / 21
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x"])), (3, " ".join([*base, "y", "z"])), (4, " ".join([*base, "p", "q", "r"]))]
    assert result(jaccard_components(documents(rows))) == brute(rows)


def test_different_long_words_are_different_sets(documents):
    one, two = ("".join(ab[i.bit_count() & 1] for i in range(2048)) for ab in ("ab", "ba"))
    rows = [(1, one), (2, two), (3, one.upper()), (4, f"{one} x y z"), (5, f"{two} x y z"), (6, " ".join(["w"] * 100_000 + [f"v{i}" for i in range(50_000)])), (7, " ".join(["w"] * 90_000 + [f"v{i}" for i in range(50_000)]))]
    assert result(jaccard_components(documents(rows))) == brute(rows)


def test_small_buckets_and_blocks_change_nothing(documents, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 50)
    monkeypatch.setattr(nj, "BUCKET_BYTES", 200)
    rows = corpus(4)
    assert result(jaccard_components(documents(rows))) == brute(rows)


def test_cost_asks_for_more_where_lists_are_long():
    import numpy as np

    assert nj.matches(np.array([1.0, 50_000, 50_000, 50_000]), 1, 100_000) == 1
    assert nj.matches(np.array([2000.0, 2000, 2000, 2000]), 1, 100_000) > 1
