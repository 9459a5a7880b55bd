import numpy as np
import pytest

from plain_mix import targets
from pyspark.sql import functions as F

from layoutcheck.llm.mixing import fit, mix_sources, source_targets
from layoutcheck.llm.shared import Scratch


def test_targets():
    assert targets({"a": 100, "b": 100, "c": 100, "d": 100}) == pytest.approx({"a": 400 * 5 / 13, "b": 400 * 2 / 13, "c": 400 / 13, "d": 400 * 5 / 13})
    capped = targets({"a": 10, "b": 100, "c": 100, None: 0})
    assert capped == pytest.approx({"a": 30, "b": 120, "c": 60, None: 0})
    assert targets({"z": 5}) == {"z": 5.0}
    assert targets({}) == {}
    assert targets({None: 7, "": 7}) == pytest.approx({"": 10, None: 4})
    assert sum(targets({f"s{i}": 3**i for i in range(9)}).values()) == pytest.approx(sum(3**i for i in range(9)))


def test_targets_of_tables(spark):
    r = np.random.default_rng(4)
    many = {f"{'aZé😀'[i % 4]}{i}": int(10 ** r.uniform(0, 6)) for i in range(300)} | {None: 50, "empty": 0}
    for sizes in ({"a": 100, "b": 100, "c": 100, "d": 100}, {"a": 10, "b": 100, "c": 100, None: 0}, {"z": 5}, {None: 7, "": 7}, {f"s{i}": 3**i for i in range(9)}, {"x": 0}, many):
        df = spark.createDataFrame([(s, "n" if s is None else f"s{s}", n) for s, n in sizes.items()], "__source string, __skey string, words long")
        got = {r["__skey"]: r["target"] for r in source_targets(df, Scratch(spark, "test")).collect()}
        assert got == pytest.approx({"n" if s is None else f"s{s}": t for s, t in targets(sizes).items()})
    assert source_targets(df.where("false"), Scratch(spark, "test")).count() == 0


def test_rows_that_differ_in_text_alone_go_in_alike_each_time(documents):
    rows = [(1, f"{w} {w}") for w in "abcdefghij"] + [(2, "x " * 10)]
    runs = [sorted((r["text"], r["times"]) for r in mix_sources(documents(some).withColumn("source", F.when(F.col("doc_id") == 1, "a").otherwise("b"))).collect()) for some in (rows, rows[::-1], rows[3:] + rows[:3])]
    assert runs[0] == runs[1] == runs[2] and len({t for _, t in runs[0]}) > 1


def test_a_very_long_text_counts_whole(documents):
    got = mix_sources(documents([(1, "w " * 300_000), (2, "x")]), carry=["doc_id"]).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {1: 300_000, 2: 1}


def _best(lengths, counts, budget):
    reached = {0}
    for n, c in zip(lengths, counts):
        for _ in range(c):
            reached |= {s + n for s in reached if s + n <= budget}
    return max(reached)


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_the_best_subset(seed):
    r = np.random.default_rng(seed)
    lengths = np.unique(r.integers(1, 60, 6))
    counts = r.integers(0, 4, len(lengths))
    budget = int(r.integers(0, max(1, (lengths * counts).sum())))
    take = fit(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    # each length first gets its even share; of the rest the knapsack is exact
    share = counts * budget // max(1, (lengths * counts).sum())
    assert int((take * lengths).sum()) == int((share * lengths).sum()) + _best(lengths, counts - share, budget - int((share * lengths).sum()))


def test_large_budgets_are_met():
    r = np.random.default_rng(1)
    lengths = np.unique(r.integers(1, 20_000, 3000))
    counts = r.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (total // 3, total - 1, 17, 0):
        take = fit(lengths, counts, budget, knapsack=4096)
        assert (take <= counts).all() and 0 <= budget - int((take * lengths).sum()) <= 32


def _rows(n=400, seed=2):
    r = np.random.default_rng(seed)
    names = ["a", "B", "é", None, "z"]
    return [(i, " ".join(["w"] * int(r.integers(0, 40))) or None, "en", names[int(r.choice(5, p=[0.35, 0.2, 0.2, 0.15, 0.1]))], 0) for i in range(n)]


def test_a_mix_meets_its_targets_and_reruns_agree(documents):
    rows = _rows()
    got = mix_sources(documents(rows), carry=["doc_id", "source"]).collect()
    sizes = {s: sum(len((t or "").split()) for _, t, _, o, _ in rows if o == s) for s in {r[3] for r in rows}}
    want = targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
        assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in own)
    again = mix_sources(documents(rows[::-1]), carry=["doc_id", "source"]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x")]
    got = sorted((r["doc_id"] or 0, r["size"], r["source_size"], r["taken"]) for r in mix_sources(documents(rows), carry=["doc_id"]).collect())
    assert got == [(0, 1, 5, 1), (1, 0, 5, 0), (2, 0, 5, 0), (3, 2, 5, 2), (3, 2, 5, 2)]
    empty = mix_sources(documents([(1, None), (2, " ")]), carry=["doc_id"]).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in empty] == [(0, 0, 0.0)] * 2
    assert mix_sources(documents([(1, "a")]).where("false")).count() == 0
    clash = mix_sources(documents([(1, "a b")]).selectExpr("*", "7 AS size", "8 AS n", "9 AS range", "1 AS times"))
    assert clash.first()["size"] == 2 and {"n", "range", "text"} <= set(clash.columns)
