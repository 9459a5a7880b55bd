import pytest
from layouts import NOTCH, rect
from pyspark.sql import functions as F

from layoutcheck.functions import geometry as g


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, c):
    return one.select(c.alias("v")).first()["v"]


def arr(*v):
    return F.array(*map(F.lit, v))


def poly(pts):
    return g.points(*pts) if pts else g.polygon_clear()


def test_points_have_a_partial_order(one):
    assert value(one, g.dominated(arr(1, 1), arr(2, 2)))
    assert not value(one, g.dominated(arr(1, 2), arr(2, 1)))
    assert not value(one, g.dominated(arr(2, 1), arr(1, 2)))
    assert not value(one, g.dominated(arr(1, 1), arr(1, 2)))
    assert value(one, g.dominated_or_equal(arr(1, 1), arr(1, 2)))
    assert value(one, g.point_add(arr(1, 2, 3, 4, 5), arr(2, 1, 0, -1, 5))) == [3, 3, 3, 3, 10]
    assert value(one, g.m(arr(1, 2, 3, 4, 5))) == 4
    assert value(one, g.point_add(arr(0.5), arr(0.25))) == [0.75]


def test_coordinate_out_of_range_is_an_error(one):
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        value(one, g.z(arr(1, 2)))


@pytest.mark.parametrize(("b", "hit"), [(((3, 3), (4, 4)), False), (((2, 2), (3, 3)), False), (((2, 0), (3, 2)), False), (((1, 1), (3, 3)), True), (((0, 0), (2, 2)), True)])
def test_boxes_overlap_strictly(one, b, hit):
    assert value(one, g.boxes_overlap(arr(0, 0), arr(2, 2), arr(*b[0]), arr(*b[1]))) is hit


def test_boxes_of_other_dimensions(one):
    assert value(one, g.boxes_overlap(arr(0), arr(2), arr(1), arr(3)))
    assert not value(one, g.boxes_overlap(arr(0, 0, 0), arr(2, 2, 2), arr(1, 1, 2), arr(3, 3, 3)))


def test_polygon_functions(one):
    p = g.points((1, 1), (1, 3), (3, 3), (3, 1))
    assert [tuple(v) for v in value(one, g.translate(p, F.lit(1), F.lit(1)))] == [(2, 2), (2, 4), (4, 4), (4, 2)]
    assert value(one, g.polygon_size(g.polygon_append(p, F.struct(F.lit(1).cast("long").alias("x"), F.lit(1).cast("long").alias("y"))))) == 5
    assert value(one, g.polygon_size(g.polygon_clear())) == 0
    assert one.select(*g.polygon_mbr(p)).first() == (1, 3, 1, 3)
    assert one.select(*g.polygon_mbr(poly([]))).first() == (None, None, None, None)


@pytest.mark.parametrize(("pts", "area"), [(rect(0, 0, 10, 30), 300), (NOTCH, 750), ([(0, 0), (0, 3), (4, 3), (4, 0)], 12), ([(0, 0), (0, 3), (1, 0), (0, 0)], 1), ([], 0), ([(5, 5)], 0), (rect(0, 0, 100_000, 100_000), 10**10), (rect(-7, -7, -2, -1), 30)])
def test_area(one, pts, area):
    assert value(one, g.area(poly(pts))) == area


def test_orientation_and_rectilinearity(one):
    assert value(one, g.twice_signed_area(poly(rect(0, 0, 2, 2)))) < 0
    back = value(one, g.clockwise(poly(rect(0, 0, 2, 2)[::-1])))
    assert [tuple(p) for p in back] == rect(0, 0, 2, 2)
    assert value(one, g.rectilinear(poly(NOTCH)))
    assert not value(one, g.rectilinear(poly([(0, 0), (1, 1), (1, 0), (0, 0)])))
    assert value(one, g.rectilinear(poly([])))


def test_edges_and_sides(one):
    got = one.select(F.explode(g.pairs(poly(rect(0, 0, 2, 5)))).alias("e")).select("e.seq", *g.edge_form(F.col("e.a"), F.col("e.b"))).collect()
    assert [tuple(r) for r in got] == [(0, "L", 0, 5, 0), (1, "U", 0, 2, 5), (2, "R", 0, 5, 2), (3, "D", 0, 2, 0)]
    assert value(one, F.size(g.pairs(poly([])))) == 0
    assert value(one, F.size(g.pairs(poly([(1, 1)])))) == 0
    slanted, none = [one.select(g.edge_side(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in e))).first()[0] for e in (((0, 0), (2, 1)), ((1, 1), (1, 1)))]
    assert (slanted, none) == ("U", "L")


def test_too_close_counts_distance_zero(one):
    lit = F.lit
    assert value(one, g.too_close(lit(5), lit(5), lit(0), lit(9), lit(1), lit(2), 3))
    assert not value(one, g.faces(lit(5), lit(5), lit(0), lit(9), lit(1), lit(2), 3))
    assert not value(one, g.too_close(lit(5), lit(8), lit(0), lit(9), lit(1), lit(2), 3))
    assert not value(one, g.too_close(lit(5), lit(7), lit(0), lit(1), lit(1), lit(2), 3))
