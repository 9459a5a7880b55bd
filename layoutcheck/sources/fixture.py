"""A layout derived from the tables supplier, part and customer by integer arithmetic.

Cells are suppliers, polygons are parts on layers 19, 20 and 25, references are
customers; each customer also has a via on layer 21 in the top cell.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutcheck.functions.geometry import points
from layoutcheck.sources.layout import Layout, make

TOP = -1
PROMOTED = 1_000_000
METAL, VIA = 19, 21


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_layout(spark: SparkSession, sf_dir: str) -> Layout:
    supplier, part, customer = (_read(spark, sf_dir, n) for n in ("supplier", "part", "customer"))
    s = supplier.count()
    cells = supplier.select(F.col("s_suppkey").cast("long").alias("cell_id"), F.col("s_name").alias("cell_name")).union(spark.sql(f"SELECT {TOP}L, 'TOP'"))
    shape = (
        part.select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("p_size"))
        .withColumn("slot", F.expr(f"k div {s}"))
        .selectExpr("k", "p_size", "slot", f"k % {s} AS cell_id", "(slot % 5) * 60 + p_size % 13 AS x0", "(slot div 5) * 60 + k % 11 AS y0", "20 + p_size AS w", "20 + (k * 7) % 31 AS h")
    )
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.expr("x0 + w"), F.expr("y0 + h")
    xa, xb, ym = F.expr("x0 + w div 3"), F.expr("x0 + w - w div 3"), F.expr("y0 + h div 2")
    notch = points((x0, y0), (x0, y1), (xa, y1), (xa, ym), (xb, ym), (xb, y1), (x1, y1), (x1, y0), (x0, y0))
    rectangle = points((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))
    parts = shape.select(
        F.col("k").alias("poly_id"),
        "cell_id",
        F.expr(f"CASE slot div 5 WHEN 1 THEN 20 WHEN 2 THEN 25 ELSE {METAL} END").alias("layer"),
        F.when(F.expr("p_size % 10 = 0"), notch).otherwise(rectangle).alias("pts"),
    )
    place = customer.select(F.col("c_custkey").cast("long").alias("k")).selectExpr("k", "(k % 100) * 290 - 1000 AS rx", "(k div 100) * 250 + (k div 300) * 100 - 1000 AS ry")
    refs = place.selectExpr("k AS ref_id", f"{TOP}L AS parent_cell_id", f"k % {s} AS cell_id", "rx", "ry")
    via = place.selectExpr("k", "rx + 10 + k % 9 AS x0", "ry + 8 + k % 7 AS y0").selectExpr("*", "x0 + 8 AS x1", "y0 + 8 AS y1")
    a, b, c, d = (F.col(n) for n in ("x0", "y0", "x1", "y1"))
    vias = via.select((F.col("k") + PROMOTED).alias("poly_id"), F.lit(TOP).cast("long").alias("cell_id"), F.lit(VIA).alias("layer"), points((a, b), (a, d), (c, d), (c, b), (a, b)).alias("pts"))
    return make(cells, parts.union(vias), refs, top=TOP)
