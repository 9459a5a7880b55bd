"""Theta joins as equi-joins on a grid, each result exactly once.

Spark has no join by range, so both sides are laid on tiles and meet on tile
numbers. A pair that shares several tiles is kept on one only, which both sides
know without asking: the tile where the later of the two starts. A hot tile is
an equi-join key with many rows, which AQE splits.

Tiles grow with what lies on them: a length has a level, whose tiles are
``STEP`` times as wide as those of the level below, so that it covers few of
them. A pair meets on the tiles of the longer one; the shorter one goes there
only if there is anything of that level at all.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layoutcheck.functions import geometry as g
from layoutcheck.operators import partition

TILE = 256
#: Ratio of the widths of tiles of neighbouring levels; a length covers STEP + 1 tiles of its level at most.
STEP = 4


def tile_of(c: Column, size: Column | int) -> Column:
    return F.floor(c / size).cast("long")


def tiles(low: Column, high: Column, size: Column | int) -> Column:
    """Tile numbers from low to high, both in; none if low is above high."""
    a, b = tile_of(low, size), tile_of(high, size)
    return F.when(low <= high, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))


def level_of(low: Column, high: Column, size: int) -> Column:
    """The least level whose tiles a length covers STEP + 1 of at most; 0 if low is above high."""
    tiles_long = F.greatest((high - low) / F.lit(float(size)), F.lit(1.0))
    return F.coalesce(F.greatest(F.ceil(F.log(float(STEP), tiles_long)).cast("int") - 1, F.lit(0)), F.lit(0))


Ends = tuple[Column, Column]


def _levels(a: DataFrame, b: DataFrame, *dimensions: tuple[Ends, Ends], size: int) -> list[Column]:
    """The levels of either side, a handful in each dimension, by one scalar subquery."""
    every = [df.select(*(level_of(*ends[side], size).alias(f"n{k}") for k, ends in enumerate(dimensions))) for side, df in enumerate((a, b))]
    sets = F.struct(*(F.collect_set(f"n{k}").alias(f"n{k}") for k in range(len(dimensions))))
    found = every[0].union(every[1]).agg(sets).scalar()
    return [found.getField(f"n{k}") for k in range(len(dimensions))]


def _lay(a: DataFrame, b: DataFrame, name: str, a_range: Ends, b_range: Ends, size: int, levels: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides on tiles of one dimension: a row a tile, as a struct ``name`` of level and role, tile and width.

    Role 0 is for pairs whose first is at least as long by level, role 1 for the others.
    """

    def places(ends: tuple[Column, Column], level: Column, role: int) -> Column:
        width = (F.pow(F.lit(float(STEP)), level) * size).cast("long")
        return F.transform(tiles(*ends, width), lambda t: F.struct((2 * level + role).alias("level"), t.alias("tile"), width.alias("width")))

    def longer(ends: tuple[Column, Column], levels: Column, role: int) -> Column:
        return F.flatten(F.transform(F.filter(levels, lambda n: n > F.col("__own")), lambda n: places(ends, n, role)))

    own = F.col("__own")
    a = a.withColumn("__own", level_of(*a_range, size)).withColumn("__levels", levels)
    a = a.withColumn(name, F.explode(F.concat(places(a_range, own, 0), longer(a_range, F.col("__levels"), 1)))).drop("__own", "__levels")
    b = b.withColumn("__own", level_of(*b_range, size)).withColumn("__levels", levels)
    first = F.concat(places(b_range, own, 0), longer(b_range, F.col("__levels"), 0))
    second = F.when(F.exists("__levels", lambda n: n < own), places(b_range, own, 1)).otherwise(F.slice(places(b_range, own, 1), 1, 0))
    return a, b.withColumn(name, F.explode(F.concat(first, second))).drop("__own", "__levels")


def _meet(name: str) -> list[Column]:
    return [F.col(f"x.{name}.level") == F.col(f"y.{name}.level"), F.col(f"x.{name}.tile") == F.col(f"y.{name}.tile")]


def _once(name: str, a_low: Column, b_low: Column) -> Column:
    """Of the tiles that a pair shares, the one where the later of the two starts."""
    return F.col(f"x.{name}.tile") == tile_of(F.greatest(a_low, b_low), F.col(f"x.{name}.width"))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns))


def facing_edges(e1: DataFrame, e2: DataFrame, t: int, keys: Sequence[str] = (), tile: int = TILE, apart: Column | None = None) -> DataFrame:
    """Pairs of edges with ``0 < i1 - i2 < t`` whose projections overlap: all columns of both, as a_* and b_*.

    keys: columns that must be equal. apart: a further condition on a_* and b_*.
    """
    size = max(tile, t)
    ends = [(F.col(f"{p}p_start"), F.col(f"{p}p_end")) for p in ("a_", "b_")]
    a, b = _renamed(e1, "a_"), _renamed(e2, "b_")
    a, b = _lay(a, b, "__p", *ends, size, *_levels(a, b, ends, size=size))
    a = a.withColumn("__i", F.explode(tiles(F.col("a_intercept") - (t - 1), F.col("a_intercept"), size)))
    b = b.withColumn("__i", tile_of(F.col("b_intercept"), size))
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]
    met = a.alias("x").join(b.alias("y"), [*_meet("__p"), F.col("x.__i") == F.col("y.__i"), *on])
    close = g.faces(F.col("a_intercept"), F.col("b_intercept"), F.col("a_p_start"), F.col("a_p_end"), F.col("b_p_start"), F.col("b_p_end"), t)
    once = _once("__p", F.col("a_p_start"), F.col("b_p_start"))
    found = met.where(close & once if apart is None else close & once & apart)
    return found.select(*a.columns[:-2], *b.columns[:-2])


def box_overlap(a: DataFrame, b: DataFrame, expand: int = 0, strict: bool = False, tile: int = 4 * TILE, apart: Column | None = None) -> DataFrame:
    """Pairs of boxes (x_min, x_max, y_min, y_max) that meet, a's upper sides moved out by ``expand``; columns as a_* and b_*.

    strict: touching boxes do not meet.
    """
    p, q = _renamed(a, "a_"), _renamed(b, "b_")
    right, top = F.col("a_x_max") + expand, F.col("a_y_max") + expand
    names = p.columns, q.columns
    across, along = [(F.col("a_x_min"), right), (F.col("b_x_min"), F.col("b_x_max"))], [(F.col("a_y_min"), top), (F.col("b_y_min"), F.col("b_y_max"))]
    levels = _levels(p, q, across, along, size=tile)
    p, q = _lay(*_lay(p, q, "__x", *across, tile, levels[0]), "__y", *along, tile, levels[1])
    sides = g.box_columns("a_"), g.box_columns("b_")
    meet = g.mbr_overlap([sides[0][0], right, sides[0][2], top], sides[1]) if strict else g.mbr_touch(*sides, expand)
    once = _once("__x", F.col("a_x_min"), F.col("b_x_min")) & _once("__y", F.col("a_y_min"), F.col("b_y_min"))
    found = p.alias("x").join(q.alias("y"), [*_meet("__x"), *_meet("__y")]).where(meet & once if apart is None else meet & once & apart)
    return found.select(*names[0], *names[1])


def interval_overlap(a: DataFrame, b: DataFrame, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of closed intervals (l, r) that share a point; columns as a_* and b_*."""
    p, q = _renamed(a, "a_"), _renamed(b, "b_")
    ends = (F.col("a_l"), F.col("a_r")), (F.col("b_l"), F.col("b_r"))
    p, q = _lay(p, q, "__t", *ends, tile, *_levels(p, q, ends, size=tile))
    on = [*_meet("__t"), *(F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys)]
    meet = (F.col("a_l") <= F.col("b_r")) & (F.col("b_l") <= F.col("a_r")) & _once("__t", F.col("a_l"), F.col("b_l"))
    return p.alias("x").join(q.alias("y"), on).where(meet).select(*p.columns[:-1], *q.columns[:-1])


def stabbing(intervals: DataFrame, points: DataFrame, tile: int = TILE) -> DataFrame:
    """Closed intervals (l, r) that contain a point (p)."""
    at = points.withColumns({"l": F.col("p"), "r": F.col("p")})
    return interval_overlap(intervals, at, tile).drop("b_l", "b_r")


def overlap_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """All columns of a and n: how many closed intervals (l, r) of b share a point with each, without listing the pairs.

    Those that start by its end, less those that end before it starts; none for l above r.
    """
    valid = b.where("l <= r")

    def up_to(points: Column, asked: Column, name: str) -> DataFrame:
        steps = valid.select(points.alias(name), F.lit(1).cast("long").alias("d")).union(a.where("l <= r").select(asked, F.lit(0).cast("long")))
        return partition.prefix_sum(steps.groupBy(name).agg(F.sum("d").alias("d")), name, "d", name, f"{name}_n").select(name, f"{name}_n")

    met = a.join(up_to(F.col("l"), F.col("r"), "__begun").withColumnRenamed("__begun", "r"), "r", "left")
    met = met.join(up_to(F.col("r") + 1, F.col("l"), "__over").withColumnRenamed("__over", "l"), "l", "left")
    return met.select(*(F.col(c) for c in a.columns), F.when(F.col("l") <= F.col("r"), F.col("__begun_n") - F.col("__over_n")).otherwise(0).alias("n"))
