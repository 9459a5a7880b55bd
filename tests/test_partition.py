import random

import pytest
from layouts import build, rect
from pyspark.sql import functions as F

from layoutcheck.operators import join, partition, spatial


def _groups(intervals):
    """Sort and merge."""
    out, reach, n = {}, None, -1
    for k, l, r in sorted(intervals, key=lambda i: (i[1], i[2])):  # noqa: E741
        if reach is None or l > reach:
            n, reach = n + 1, r
        reach = max(reach, r)
        out[k] = n
    return out


@pytest.mark.parametrize("seed", range(3))
def test_coalescing_is_sort_and_merge(spark, seed):
    r = random.Random(seed)
    intervals = [(k, l, l + r.randint(0, 30)) for k, l in enumerate(r.randint(-4000, 4000) for _ in range(400))]  # noqa: E741
    intervals += [(1000, 5, 5), (1001, 5, 5), (1002, 5, 9)]
    got = partition.coalesce_intervals(spark.createDataFrame(intervals, "k long, l long, r long")).collect()
    assert {x["k"]: x["row_id"] for x in got} == _groups(intervals)


def test_touching_intervals_are_one_group_and_none_none(spark):
    df = spark.createDataFrame([(1, 0, 5), (2, 5, 6), (3, 7, 8)], "k long, l long, r long")
    assert {x["k"]: x["row_id"] for x in partition.coalesce_intervals(df).collect()} == {1: 0, 2: 0, 3: 1}
    assert partition.coalesce_intervals(df.where("false")).count() == 0


def test_rows_of_a_layout(spark):
    layout = build(spark, {1: [(1, rect(0, 0, 5, 10))]}, [(1, 0, -500), (1, 0, -473), (1, 0, 0), (1, 0, 28)])
    assert sorted(tuple(r) for r in partition.rows(layout, [1], 18).collect()) == [(0, 0), (1, 0), (2, 1), (3, 2)]
    assert partition.rows(layout, [9], 18).count() == 0


def test_sweeps(spark):
    df = spark.createDataFrame([(i, 0, i) for i in range(4)], "at long, g long, v long")
    assert [r["status"] for r in partition.sweepline(df, ["at"], F.sum("v")).orderBy("at").collect()] == [0, 1, 3, 6]
    assert [r["status"] for r in partition.sweepline(df, ["at"], F.last("v")).orderBy("at").collect()] == [0, 1, 2, 3]
    assert [r["prefix"] for r in partition.prefix_sum(df, "at", "v", "g").orderBy("at").collect()] == [0, 1, 3, 6]
    folded = partition.fold(df, ["at"], lambda s, r: s * 2 + r.v, 0, "at long, g long, v long, status long")
    assert [r["status"] for r in folded.orderBy("at").collect()] == [0, 1, 4, 11]


def test_compression(spark):
    df = spark.createDataFrame([(v,) for v in (30, -5, 30, 7, None)], "v long")
    assert sorted(tuple(r) for r in partition.compress(df, "v").collect()) == [(-5, 0), (7, 1), (30, 2)]


@pytest.mark.parametrize("tile", [3, 50, 5000])
def test_interval_join_is_the_brute_force(spark, tile):
    r = random.Random(4)
    make = lambda n: [(k, l, l + r.randint(0, 200)) for k, l in enumerate(r.randint(-300, 300) for _ in range(n))]  # noqa: E731, E741
    a, b = make(40), make(30)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2])
    frames = [spark.createDataFrame(v, "k long, l long, r long") for v in (a, b)]
    assert sorted((x["a_k"], x["b_k"]) for x in join.interval_overlap(*frames, tile=tile).collect()) == want


def _lengths(r, n, far=1000):
    """Mostly short lengths, some very long and some void or null."""
    out = []
    for k in range(n):
        low = r.randint(-far, far)
        out.append((k, low, low + r.choice([0, 1, 3, 9, 40, 300, 5000, 10**7, -2])))
    return out + [(n, None, 5), (n + 1, 5, None)]


@pytest.mark.parametrize(("seed", "tile"), [(1, 4), (2, 16), (3, 256)])
def test_lengths_of_many_levels_meet_once(spark, seed, tile):
    r = random.Random(seed)
    a, b = _lengths(r, 50), _lengths(r, 40)
    ok = lambda x: None not in x and x[1] <= x[2]
    want = sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] <= y[2] and y[1] <= x[2])
    frames = [spark.createDataFrame(v, "k long, l long, r long") for v in (a, b)]
    assert sorted((x["a_k"], x["b_k"]) for x in join.interval_overlap(*frames, tile=tile).collect()) == want
    boxes = [[(*x, *y[1:]) for x, y in zip(v, r.sample(_lengths(r, len(v) - 2), len(v))) if ok(x) and ok(y)] for v in (a, b)]
    frames = [spark.createDataFrame(v, "k long, x_min long, x_max long, y_min long, y_max long") for v in boxes]
    meet = lambda p, q: p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]
    want = sorted((p[0], q[0]) for p in boxes[0] for q in boxes[1] if meet(p, q))
    assert sorted((x["a_k"], x["b_k"]) for x in join.box_overlap(*frames, tile=tile).collect()) == want
    t = 30
    edges = [[(k, low, high, r.randint(-60, 60)) for k, low, high in v if ok((k, low, high))] for v in (a, b)]
    frames = [spark.createDataFrame(v, "k long, p_start long, p_end long, intercept long") for v in edges]
    faces = lambda p, q: 0 < p[3] - q[3] < t and p[1] < q[2] and q[1] < p[2]
    want = sorted((p[0], q[0]) for p in edges[0] for q in edges[1] if faces(p, q))
    assert sorted((x["a_k"], x["b_k"]) for x in join.facing_edges(*frames, t, tile=tile).collect()) == want


def test_a_very_long_edge_is_few_rows(spark):
    rows = [(k, 50 * k, 50 * k + 40) for k in range(2000)] + [(2000, 0, 10**7)]
    a = spark.createDataFrame(rows, "k long, l long, r long")
    ends = F.col("l"), F.col("r")
    one, two = join._lay(a, a, "__t", ends, ends, join.TILE, *join._levels(a, a, (ends, ends), size=join.TILE))
    assert max(one.where("k = 2000").count(), two.where("k = 2000").count()) <= 2 * (join.STEP + 1)
    assert one.count() < 4 * len(rows) and two.count() < 4 * len(rows)
    assert join.interval_overlap(a, a).count() == 2000 * 3 + 1
    empty = a.where("false")
    assert join.interval_overlap(a, empty).count() == join.interval_overlap(empty, a).count() == 0


def test_range_query_over_boxes(spark):
    boxes = spark.createDataFrame([(k, x, x + 2, 0, 2) for k, x in enumerate((0, 3, 6))], "k long, x_min long, x_max long, y_min long, y_max long")
    assert sorted(r["k"] for r in spatial.query(boxes, 1, 4, 0, 2).collect()) == [0, 1]
    assert spatial.query(boxes, 2, 3, 0, 2).count() == 0
    assert spatial.overlapping(boxes.union(boxes.select(F.col("k") + 10, F.col("x_min") + 1, F.col("x_max") + 1, "y_min", "y_max")), "k").count() == 3
    assert spatial.join(boxes, boxes).count() == 3


def test_a_far_value_leaves_the_ranges_filled(spark):
    from layoutcheck.operators import partition

    rows = [(i, i // 2) for i in range(4000)] + [(4000, 10**12), (4001, -(10**12)), (4002, 7)]
    df = spark.createDataFrame(rows, "k long, v long")
    ranged = partition._ranged(df, df["v"], 64).select("v", "__range").distinct().orderBy("v").collect()
    found = [r["__range"] for r in ranged]
    assert found == sorted(found) and len(set(found)) >= 32 and len(ranged) == 2002
    index = {r["v"]: r["index"] for r in partition.compress(df, "v").collect()}
    assert index == {v: i for i, v in enumerate(sorted({v for _, v in rows}))}
    assert partition.compress(df.where("false"), "v").count() == 0
