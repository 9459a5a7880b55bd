"""Queries over every row."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_entry import SF, _rows

import __spark_entry__ as entry
from layoutcheck.operators import join

tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_counts_of_overlaps_are_the_brute_force(spark):
    r = random.Random(3)
    make = lambda n: [(k, l, l + r.randint(-2, 60)) for k, l in enumerate(r.randint(-90, 90) for _ in range(n))]  # noqa: E731, E741
    a, b = make(60), make(50)
    got = join.overlap_counts(*(spark.createDataFrame(x, "k long, l long, r long") for x in (a, b))).collect()
    ok = lambda x, y: x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]
    assert sorted(tuple(x) for x in got) == sorted((*x, sum(ok(x, y) for y in b)) for x in a)


def _compare(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = entry.queries()[name](spark, SF)
    con.execute(entry.oracle_sql()[name])
    got = df.collect()
    assert _rows(df.columns, got) == _rows([c[0] for c in con.description], con.fetchall())
    return got


@tables
@pytest.mark.parametrize("name", ["interval_overlap_counts", "interval_stabbing_counts"])
def test_all_intervals(spark, name):
    got = _compare(spark, name)
    every = spark.read.parquet(f"{SF}/orders.parquet").join(spark.read.parquet(f"{SF}/lineitem.parquet"), F.expr("o_orderkey = l_orderkey AND CAST(o_orderdate AS DATE) <= CAST(l_shipdate AS DATE)"))
    assert sum(x["copies"] for x in got) == every.count()


@tables
@pytest.mark.parametrize("name", ["point_dominance", "point_add", "box_overlap_corners"])
def test_all_cells(spark, name):
    assert len(_compare(spark, name)) == len(_compare(spark, "cell_mbr"))


@tables
def test_all_intervals_coalesce(spark):
    got = _compare(spark, "interval_coalesce")
    assert sum(x["n"] for x in got) == sum(x["copies"] for x in entry.queries()["interval_overlap_counts"](spark, SF).collect())
    assert len(got) > 1 and max(x["r"] - x["l"] for x in got) > 121
