import random

from layoutcheck.llm.graph import components
from layoutcheck.llm.shared import Scratch


def test_chains_stars_and_rings(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (202, 202)] + [(-5, -9)]
    nodes = {x for e in links for x in e}
    r.shuffle(links)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {n: -9 if n < 0 else 0 if n <= 40 else 100 if n < 200 else 200 for n in nodes}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
