"""Geometry as Column expressions, all inside the JVM.

A point is an array of coordinates (any number of dimensions) or a struct (x, y);
a box is a pair of corner points or a struct (x_min, x_max, y_min, y_max); a
polygon is an array of (x, y); an edge is (p_start, p_end, intercept) and a side.
"""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "STRUCT<x: BIGINT, y: BIGINT>"
POINTS = f"ARRAY<{POINT}>"

# -- points of any dimension (arrays) --------------------------------------


def coordinate(p: Column, i: int) -> Column:
    """Coordinate i from 0; an index out of range is an error."""
    return F.element_at(p, i + 1)


def x(p: Column) -> Column:
    return coordinate(p, 0)


def y(p: Column) -> Column:
    return coordinate(p, 1)


def z(p: Column) -> Column:
    return coordinate(p, 2)


def m(p: Column) -> Column:
    return coordinate(p, 3)


def dominated(a: Column, b: Column) -> Column:
    """Every coordinate of a is less: a partial order, unlike the order of structs."""
    return F.forall(F.zip_with(a, b, lambda p, q: p < q), lambda t: t)


def dominated_or_equal(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda p, q: p <= q), lambda t: t)


def point_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def boxes_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Of boxes by their corners: strict on every axis, touching is no overlap."""
    return dominated(low_a, high_b) & dominated(low_b, high_a)


# -- plane boxes by columns ------------------------------------------------

BOX = ("x_min", "x_max", "y_min", "y_max")


def box_columns(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in BOX]


def mbr_overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Strict overlap of (x_min, x_max, y_min, y_max)."""
    return (a[0] < b[1]) & (b[0] < a[1]) & (a[2] < b[3]) & (b[2] < a[3])


def mbr_touch(a: Sequence[Column], b: Sequence[Column], expand: int | Column = 0) -> Column:
    """Closed overlap, with a's upper sides moved out by ``expand``."""
    return (b[0] <= a[1] + expand) & (a[0] <= b[1]) & (b[2] <= a[3] + expand) & (a[2] <= b[3])


def interval_contains(low: Column, high: Column, p: Column) -> Column:
    return p.between(low, high)


# -- polygons --------------------------------------------------------------


def points(*xy: tuple[Column | int, Column | int]) -> Column:
    """A polygon of given corners."""
    lit = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return F.array(*(F.struct(lit(a).alias("x"), lit(b).alias("y")) for a, b in xy))


def polygon_size(pts: Column) -> Column:
    return F.size(pts)


def polygon_point(pts: Column, i: int) -> Column:
    return F.element_at(pts, i + 1)


def polygon_append(pts: Column, p: Column) -> Column:
    return F.array_append(pts, p)


def polygon_clear() -> Column:
    return F.array().cast(POINTS)


def translate(pts: Column, dx: Column, dy: Column) -> Column:
    return F.transform(pts, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def polygon_mbr(pts: Column) -> list[Column]:
    """x_min, x_max, y_min, y_max; null for an empty polygon."""
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return [F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max")]


def twice_signed_area(pts: Column) -> Column:
    """The shoelace sum, the last vertex joined to the first; 64-bit."""
    n = F.size(pts)
    term = lambda s, i: s + (F.element_at(pts, i)["x"] * F.element_at(pts, i % n + 1)["y"] - F.element_at(pts, i % n + 1)["x"] * F.element_at(pts, i)["y"])
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0).cast("long"), term)).otherwise(F.lit(0).cast("long"))


def area(pts: Column) -> Column:
    """Whole units of area; half a unit is cut off."""
    return F.shiftright(F.abs(twice_signed_area(pts)), 1)


def pairs(pts: Column) -> Column:
    """Consecutive vertices as (seq, a, b); a ring repeats its first vertex."""
    n = F.size(pts)
    at = F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct((i - 1).alias("seq"), F.element_at(pts, i).alias("a"), F.element_at(pts, i + 1).alias("b")))


def rectilinear(pts: Column) -> Column:
    """Every side is parallel to an axis."""
    return F.forall(pairs(pts), lambda e: (e["a"]["x"] == e["b"]["x"]) | (e["a"]["y"] == e["b"]["y"]))


def clockwise(pts: Column) -> Column:
    """The same polygon with its vertices in clockwise order."""
    return F.when(twice_signed_area(pts) > 0, F.reverse(pts)).otherwise(pts)


# -- edges -----------------------------------------------------------------


def edge_side(a: Column, b: Column) -> Column:
    """L, R, U or D of a side of a clockwise polygon; a slanted one counts as horizontal, one of no length as left."""
    return F.when(a["x"] == b["x"], F.when(a["y"] > b["y"], "R").otherwise("L")).otherwise(F.when(a["x"] < b["x"], "U").otherwise("D"))


def edge_form(a: Column, b: Column) -> list[Column]:
    """side, p_start, p_end, intercept."""
    upright = a["x"] == b["x"]
    return [
        edge_side(a, b).alias("side"),
        F.when(upright, F.least(a["y"], b["y"])).otherwise(F.least(a["x"], b["x"])).alias("p_start"),
        F.when(upright, F.greatest(a["y"], b["y"])).otherwise(F.greatest(a["x"], b["x"])).alias("p_end"),
        F.when(upright, a["x"]).otherwise(a["y"]).alias("intercept"),
    ]


def upright(side: Column) -> Column:
    return side.isin("L", "R")


def edge_points(side: Column, start: Column, end: Column, intercept: Column) -> list[Column]:
    """x1, y1, x2, y2."""
    v = upright(side)
    return [F.when(v, intercept).otherwise(start), F.when(v, start).otherwise(intercept), F.when(v, intercept).otherwise(end), F.when(v, end).otherwise(intercept)]


def faces(i1: Column, i2: Column, s1: Column, e1: Column, s2: Column, e2: Column, t: int) -> Column:
    """Edge 1 lies above (right of) edge 2 by less than t and their projections overlap; all strict."""
    return (i1 > i2) & (i1 - i2 < t) & (s1 < e2) & (s2 < e1)


def too_close(i1: Column, i2: Column, s1: Column, e1: Column, s2: Column, e2: Column, t: int) -> Column:
    """As ``faces``, in either order, distance 0 included."""
    return (F.abs(i1 - i2) < t) & (s1 < e2) & (s2 < e1)
