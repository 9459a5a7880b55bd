"""Connected components by alternating large and small stars, with written tables between rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutcheck.llm.shared import Scratch


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (u, v) with v below u. Large: a node's larger neighbours go to its least one. Small: it and its smaller ones do."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; the component is its least node. links: a, b, integers."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, print_before = scratch.keep(edges, f"{name}-0"), None
    for i in range(1, rounds):
        after = scratch.keep(_star(_star(edges, small=False), small=True), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        print_now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        edges = after
        if print_now == print_before:
            break
        print_before = print_now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
