"""Orders that look global, in parallel: interval coalescing, running folds, coordinate compression.

A window over a whole table would be one task. Here the order is cut into ranges;
each range is summed up, the few sums are accumulated, and every range goes on
from what came before it.
"""

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layoutcheck.functions import geometry as g
from layoutcheck.operators import hierarchy
from layoutcheck.sources.layout import Layout

#: Ranges that a global order is cut into; as many rows are accumulated in one task.
RANGES = 1024


def _ranged(df: DataFrame, by: Column, ranges: int = RANGES) -> DataFrame:
    """df with ``__range``, which ascends with ``by``; equal values share one.

    The cuts are quantiles, so that a far value does not push all others into one range.
    """
    shares = ", ".join(f"{i / ranges}D" for i in range(1, ranges))  # as text, for a literal apiece is a call apiece
    cuts = df.select(by.cast("long").alias("__by")).agg(F.expr(f"percentile_approx(__by, array({shares}), {4 * ranges})")).first()[0]
    cuts = sorted(set(cuts or ()))
    if not cuts:
        return df.withColumn("__range", F.lit(0))
    step = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda values: "array(" + ", ".join(f"{v}L" for v in values) + ")"
    reached = lambda values: F.size(F.filter(values, lambda c: c <= by))
    group = F.greatest(reached(F.expr(longs([own[0] for own in groups]))), F.lit(1))
    inside = F.element_at(F.expr(f"array({', '.join(map(longs, groups))})"), F.col("__group"))
    return df.withColumn("__group", group).withColumn("__range", (F.col("__group") - 1) * step + reached(inside)).drop("__group")


def _carry(df: DataFrame, value: Column, fold, start) -> DataFrame:
    """__range, __before: the fold of all earlier ranges."""
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy("__range").agg(fold(value).alias("__v")).select("__range", F.coalesce(fold("__v").over(earlier), F.lit(start)).alias("__before"))


def prefix_sum(df: DataFrame, order: str, value: str, tie: str, out: str = "prefix") -> DataFrame:
    """Running sum by (order, tie), which together are unique; order is an integer."""
    ranged = _ranged(df, F.col(order))
    own = Window.partitionBy("__range").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    met = ranged.withColumn("__own", F.sum(value).over(own)).join(F.broadcast(_carry(ranged, F.col(value), F.sum, 0)), "__range")
    return met.withColumn(out, F.col("__own") + F.col("__before")).drop("__range", "__own", "__before")


def sweepline(df: DataFrame, order: Sequence[str], aggregate: Column, partition_by: Sequence[str] = (), out: str = "status") -> DataFrame:
    """The aggregate over all rows up to each one; independent sweeps by ``partition_by``.

    Without ``partition_by`` this is one task; ``prefix_sum`` is the parallel form for sums.
    """
    w = Window.partitionBy(*partition_by).orderBy(*order) if partition_by else Window.orderBy(*order)
    return df.withColumn(out, aggregate.over(w.rowsBetween(Window.unboundedPreceding, 0)))


def fold(df: DataFrame, order: Sequence[str], step: Callable[[object, object], object], start: object, schema: str, partition_by: Sequence[str] = (), out: str = "status") -> DataFrame:
    """A sweep with any Python step(status, row) -> status; its status after each row goes to ``out``.

    schema: the result's, partition and other columns of df and out. A sweep is
    one task, as its order asks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        status, statuses = start, []
        pdf = pdf.sort_values(list(order), kind="stable")
        for row in pdf.itertuples(index=False):
            status = step(status, row)
            statuses.append(status)
        return pdf.assign(**{out: statuses})

    return df.groupBy(*partition_by).applyInPandas(run, schema)


def active_count(intervals: DataFrame) -> DataFrame:
    """at, n_active: how many closed intervals (l, r) hold each end point, once both its kinds of events are in."""
    starts = intervals.select(F.col("l").alias("at"), F.lit(1).cast("long").alias("d"))
    stops = intervals.select((F.col("r") + 1).alias("at"), F.lit(-1).cast("long").alias("d"))
    steps = starts.union(stops).groupBy("at").agg(F.sum("d").alias("d"))
    return prefix_sum(steps, "at", "d", "at", "n_active").select("at", "n_active")


def coalesce_intervals(intervals: DataFrame) -> DataFrame:
    """All columns and row_id: connected groups of closed intervals (l, r), numbered from 0 by position.

    Intervals that share a point are one group, chains of them too.
    """
    df = _ranged(intervals, F.col("l"))
    reach = F.broadcast(_carry(df, F.col("r"), F.max, -(1 << 62)))
    earlier = Window.partitionBy("__range").orderBy("l", "r").rowsBetween(Window.unboundedPreceding, -1)
    met = df.join(reach, "__range").withColumn("__reach", F.greatest("__before", F.coalesce(F.max("r").over(earlier), F.col("__before")))).drop("__before")
    marked = met.withColumn("__new", (F.col("l") > F.col("__reach")).cast("long"))
    so_far = Window.partitionBy("__range").orderBy("l", "r", F.desc("__new")).rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("__n", F.sum("__new").over(so_far)).join(F.broadcast(_carry(marked, F.col("__new"), F.sum, 0)), "__range")
    return numbered.withColumn("row_id", F.col("__n") + F.col("__before") - 1).select(*intervals.columns, "row_id")


def rows(layout: Layout, layers: Sequence[int], t: int = 18) -> DataFrame:
    """ref_id, row_id: top-level references on the layers, in rows whose y ranges, t - 1 added on top, do not meet."""
    refs = hierarchy.refs_on(layout, *layers).select("ref_id")
    boxes = hierarchy.ref_mbrs(layout).join(refs, "ref_id", "left_semi")
    return coalesce_intervals(boxes.select("ref_id", F.col("y_min").alias("l"), (F.col("y_max") + (t - 1)).alias("r"))).select("ref_id", "row_id")


def compress(df: DataFrame, column: str, out: str = "index") -> DataFrame:
    """Distinct values of an integer column with their dense index from 0."""
    values = df.select(F.col(column).cast("long").alias(column)).where(F.col(column).isNotNull()).distinct().withColumn("__one", F.lit(1).cast("long"))
    return prefix_sum(values, column, "__one", column, "__n").select(column, (F.col("__n") - 1).alias(out))


def refs_in_rows(layout: Layout, layers: Sequence[int], t: int = 18) -> DataFrame:
    """row_id, n_refs and the box's y range of each row."""
    met = rows(layout, layers, t).join(hierarchy.ref_mbrs(layout).select("ref_id", *g.BOX[2:]), "ref_id")
    return met.groupBy("row_id").agg(F.count("*").alias("n_refs"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))
