"""Two results compared: exactly as bags, or edge by edge within a tolerance."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layoutcheck.operators import join
from layoutcheck.sources.violations import EDGES

TOLERANCE = 1


def exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (a or b), the edges and n of violations that the other side lacks, counted as bags."""
    count = lambda df, name: df.groupBy(*EDGES).agg(F.count("*").alias(name))
    met = count(a.select(*EDGES), "na").join(count(b.select(*EDGES), "nb"), list(EDGES), "full")
    n = F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))
    return met.where(n != 0).select(F.when(n > 0, "a").otherwise("b").alias("side"), *EDGES, F.abs(n).alias("n"))


def canonical(violations: DataFrame) -> DataFrame:
    """The two edges chosen anew from the four end points, so that tools that pair them differently agree.

    By x the lower two and the upper two points may form upright edges, by y flat
    ones. If both do, the way with the smaller extent is taken; if neither does,
    the edges stay.
    """
    ends = F.array(*(F.struct(F.col(f"{e}x{k}").alias("x"), F.col(f"{e}y{k}").alias("y"), F.lit(i).alias("i")) for i, (e, k) in enumerate((e, k) for e in ("e1", "e2") for k in (1, 2))))

    def ordered(axis: str) -> Column:
        return F.array_sort(F.transform(ends, lambda p: F.struct(p[axis].alias("k"), p["i"].alias("i"), p["x"].alias("x"), p["y"].alias("y"))))

    df = violations.withColumn("__x", ordered("x")).withColumn("__y", ordered("y"))
    at = lambda c, i: F.element_at(c, i + 1)
    upright = at("__x", 0)["x"] == at("__x", 1)["x"]
    flat = at("__y", 0)["y"] == at("__y", 1)["y"]
    extent = lambda c: at(c, 3)["k"] - at(c, 0)["k"]
    by_x = upright & (~flat | (extent("__x") < extent("__y")))
    pick = F.when(by_x, F.col("__x")).when(flat, F.col("__y"))
    df = df.withColumn("__p", pick)
    value = lambda c, i, axis: F.when(F.col("__p").isNull(), F.col(c)).otherwise(at("__p", i)[axis])
    return df.withColumns({c: value(c, i // 2, "xy"[i % 2]) for i, c in enumerate(EDGES)}).drop("__x", "__y", "__p")


def _edges_agree(a: str, b: str, tolerance: int) -> Column:
    """Edge b lies within the tolerance of edge a, across it, and their projections share a point."""
    p = {k: F.col(f"a_{a}{k}") for k in ("x1", "y1", "x2", "y2")}
    q = {k: F.col(f"b_{b}{k}") for k in ("x1", "y1", "x2", "y2")}

    def along(u: str, v: str) -> Column:
        low, high = F.least(p[f"{u}1"], p[f"{u}2"]), F.greatest(p[f"{u}1"], p[f"{u}2"])
        return (F.abs(p[f"{v}1"] - q[f"{v}1"]) <= tolerance) & (low <= F.greatest(q[f"{u}1"], q[f"{u}2"])) & (F.least(q[f"{u}1"], q[f"{u}2"]) <= high)

    same = lambda i, j: (F.abs(p[f"x{i}"] - q[f"x{j}"]) <= tolerance) & (F.abs(p[f"y{i}"] - q[f"y{j}"]) <= tolerance)
    slanted = (same(1, 1) & same(2, 2)) | (same(1, 2) & same(2, 1))
    return F.when(p["y1"] == p["y2"], along("x", "y")).when(p["x1"] == p["x2"], along("y", "x")).otherwise(slanted)


def _numbered(df: DataFrame, tolerance: int) -> DataFrame:
    """Distinct violations with their count, a key and a box that reaches the tolerance out on the lower sides.

    Persisted, for the optimizer would carry each column's expression into every condition of the join.
    """
    df = canonical(df.select(*EDGES)).persist().groupBy(*EDGES).agg(F.count("*").alias("n"))
    low = lambda axis: F.least(*(F.col(c) for c in EDGES if c[2] == axis)) - tolerance
    high = lambda axis: F.greatest(*(F.col(c) for c in EDGES if c[2] == axis))
    return df.withColumns({"key": F.struct(*EDGES), "x_min": low("x"), "x_max": high("x"), "y_min": low("y"), "y_max": high("y")}).persist()


def candidates(a: DataFrame, b: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Pairs of distinct violations (a_*, b_*) whose edges agree in one order or the other, with their distance."""
    one, two = _numbered(a, tolerance), _numbered(b, tolerance)
    agree = lambda i, j: _edges_agree("e1", f"e{i}", tolerance) & _edges_agree("e2", f"e{j}", tolerance)
    off = reduce(lambda s, c: s + F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")), EDGES, F.lit(0).cast("long"))
    return join.box_overlap(one, two, tolerance, apart=agree(1, 2) | agree(2, 1)).withColumn("off", off)


def match(a: DataFrame, b: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """side, status (matched or missing), the edges and n: both sides matched one to one, nearest first.

    In each round a violation and its nearest free partner are matched if they
    choose each other; rounds go on until no free pair agrees.
    """
    spark = a.sparkSession
    left, right = _numbered(a, tolerance).select("key", "n"), _numbered(b, tolerance).select("key", "n")
    pairs = candidates(a, b, tolerance).select("a_key", "b_key", "off").persist()
    free_a, free_b, taken = left, right, None
    while True:
        open_pairs = pairs.join(free_a.select(F.col("key").alias("a_key"), F.col("n").alias("na")), "a_key").join(free_b.select(F.col("key").alias("b_key"), F.col("n").alias("nb")), "b_key")
        best = lambda side: F.row_number().over(Window.partitionBy(side).orderBy("off", "a_key", "b_key"))
        chosen = open_pairs.withColumn("ra", best("a_key")).withColumn("rb", best("b_key")).where("ra = 1 AND rb = 1").select("a_key", "b_key", F.least("na", "nb").alias("k"))
        chosen = chosen.checkpoint() if _can_checkpoint(spark) else chosen.persist()
        if chosen.isEmpty():
            break
        taken = chosen if taken is None else taken.union(chosen)
        less = lambda free, side: free.join(chosen.select(F.col(side).alias("key"), "k"), "key", "left").select("key", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")).where("n > 0")
        free_a, free_b = less(free_a, "a_key"), less(free_b, "b_key")
    rows = lambda df, side, status: df.select(F.lit(side).alias("side"), F.lit(status).alias("status"), "key.*", F.col("n").cast("long").alias("n"))
    out = rows(free_a, "a", "missing").union(rows(free_b, "b", "missing"))
    for side in ("a", "b") if taken is not None else ():
        out = out.union(rows(taken.groupBy(F.col(f"{side}_key").alias("key")).agg(F.sum("k").alias("n")), side, "matched"))
    return out


def _can_checkpoint(spark) -> bool:
    return spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def summary(matched: DataFrame) -> DataFrame:
    """side, n_matched, n_missing: what one side has that the other lacks, both ways."""
    total = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0)).cast("long")
    return matched.groupBy("side").agg(total("matched").alias("n_matched"), total("missing").alias("n_missing"))
