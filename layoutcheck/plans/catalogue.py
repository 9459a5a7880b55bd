"""Every query by name over the derived layout and the other tables, and its twin in DuckDB SQL.

The SQL is written in the plain form, theta joins over whole tables, so the tiled
plans are held against another way of saying the same.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutcheck.functions import decode
from layoutcheck.functions import geometry as g
from layoutcheck.operators import checks, compare, hierarchy, join, partition, spatial
from layoutcheck.plans import rules
from layoutcheck.sources import fixture, gdsii, violations
from layoutcheck.sources.layout import Layout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
T, METAL, VIA = 18, fixture.METAL, fixture.VIA

# -- the layout in SQL -----------------------------------------------------

_LAYOUT = """
s AS (SELECT count(*) AS n FROM supplier),
shape AS (
  SELECT k, p_size, slot, k % n AS cell_id, (slot % 5) * 60 + p_size % 13 AS x0, (slot // 5) * 60 + k % 11 AS y0, 20 + p_size AS w, 20 + (k * 7) % 31 AS h
  FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS p_size, CAST(p_partkey AS BIGINT) // n AS slot, n FROM part, s)),
parts AS (
  SELECT k AS poly_id, cell_id, CASE slot // 5 WHEN 1 THEN 20 WHEN 2 THEN 25 ELSE 19 END AS layer,
    CASE WHEN p_size % 10 = 0 THEN
      [{'x': x0, 'y': y0}, {'x': x0, 'y': y0 + h}, {'x': x0 + w // 3, 'y': y0 + h}, {'x': x0 + w // 3, 'y': y0 + h // 2}, {'x': x0 + w - w // 3, 'y': y0 + h // 2},
       {'x': x0 + w - w // 3, 'y': y0 + h}, {'x': x0 + w, 'y': y0 + h}, {'x': x0 + w, 'y': y0}, {'x': x0, 'y': y0}]
    ELSE [{'x': x0, 'y': y0}, {'x': x0, 'y': y0 + h}, {'x': x0 + w, 'y': y0 + h}, {'x': x0 + w, 'y': y0}, {'x': x0, 'y': y0}] END AS pts
  FROM shape),
place AS (
  SELECT k, (k % 100) * 290 - 1000 AS rx, (k // 100) * 250 + (k // 300) * 100 - 1000 AS ry FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer)),
vias AS (
  SELECT k + 1000000 AS poly_id, x0, y0, [{'x': x0, 'y': y0}, {'x': x0, 'y': y0 + 8}, {'x': x0 + 8, 'y': y0 + 8}, {'x': x0 + 8, 'y': y0}, {'x': x0, 'y': y0}] AS pts
  FROM (SELECT k, rx + 10 + k % 9 AS x0, ry + 8 + k % 7 AS y0 FROM place)),
polygons AS (SELECT poly_id, cell_id, layer, pts FROM parts UNION ALL SELECT poly_id, -1, 21, pts FROM vias),
cell_polygons AS (SELECT poly_id, cell_id, layer, pts FROM parts UNION ALL SELECT poly_id, poly_id, 21, pts FROM vias),
top_refs AS (SELECT k AS ref_id, k % n AS cell_id, rx, ry FROM place, s UNION ALL SELECT poly_id, poly_id, 0, 0 FROM vias),
pairs AS (
  SELECT cell_id, poly_id, layer, j - 1 AS seq, pts[j].x AS x1, pts[j].y AS y1, pts[j + 1].x AS x2, pts[j + 1].y AS y2
  FROM (SELECT *, unnest(range(1, len(pts))) AS j FROM cell_polygons)),
edges AS (
  SELECT cell_id, poly_id, layer, seq,
    CASE WHEN x1 = x2 THEN CASE WHEN y1 > y2 THEN 'R' ELSE 'L' END WHEN x1 < x2 THEN 'U' ELSE 'D' END AS side,
    CASE WHEN x1 = x2 THEN least(y1, y2) ELSE least(x1, x2) END AS p_start,
    CASE WHEN x1 = x2 THEN greatest(y1, y2) ELSE greatest(x1, x2) END AS p_end,
    CASE WHEN x1 = x2 THEN x1 ELSE y1 END AS intercept
  FROM pairs),
redges AS (
  SELECT ref_id, e.cell_id, poly_id, layer, seq, side,
    p_start + CASE WHEN side IN ('L', 'R') THEN ry ELSE rx END AS p_start,
    p_end + CASE WHEN side IN ('L', 'R') THEN ry ELSE rx END AS p_end,
    intercept + CASE WHEN side IN ('L', 'R') THEN rx ELSE ry END AS intercept
  FROM edges e JOIN top_refs USING (cell_id)),
mbrs AS (
  SELECT poly_id, cell_id, layer, list_min(list_transform(pts, lambda p: p.x)) AS x_min, list_max(list_transform(pts, lambda p: p.x)) AS x_max,
    list_min(list_transform(pts, lambda p: p.y)) AS y_min, list_max(list_transform(pts, lambda p: p.y)) AS y_max FROM cell_polygons),
cell_mbr AS (SELECT cell_id, min(x_min) AS x_min, max(x_max) AS x_max, min(y_min) AS y_min, max(y_max) AS y_max FROM mbrs GROUP BY cell_id),
ref_mbr AS (SELECT ref_id, cell_id, x_min + rx AS x_min, x_max + rx AS x_max, y_min + ry AS y_min, y_max + ry AS y_max FROM cell_mbr JOIN top_refs USING (cell_id)),
metal AS (SELECT DISTINCT cell_id FROM cell_polygons WHERE layer = 19),
via AS (SELECT DISTINCT cell_id FROM cell_polygons WHERE layer = 21),
metal_ref AS (SELECT * FROM ref_mbr WHERE cell_id IN (SELECT cell_id FROM metal)),
via_ref AS (SELECT * FROM ref_mbr WHERE cell_id IN (SELECT cell_id FROM via) AND cell_id NOT IN (SELECT cell_id FROM metal))
"""


def _points(p: str, n: str, dx: str = "", dy: str = "") -> str:
    """End points of edge p as e1/e2 columns; with an offset where given."""
    up = f"{p}.side IN ('L', 'R')"
    x, y = (f" + {dx}" if dx else ""), (f" + {dy}" if dy else "")
    return (
        f"CASE WHEN {up} THEN {p}.intercept ELSE {p}.p_start END{x} AS {n}x1, CASE WHEN {up} THEN {p}.p_start ELSE {p}.intercept END{y} AS {n}y1, "
        f"CASE WHEN {up} THEN {p}.intercept ELSE {p}.p_end END{x} AS {n}x2, CASE WHEN {up} THEN {p}.p_end ELSE {p}.intercept END{y} AS {n}y2"
    )


def _faces(t: int) -> str:
    return f"a.intercept > b.intercept AND a.intercept - b.intercept < {t} AND a.p_start < b.p_end AND b.p_start < a.p_end"


def _way(first: tuple[str, str], second: tuple[str, str], orientation: str) -> str:
    both = {"h": (first[0], second[0]), "v": (first[1], second[1])}
    return " OR ".join(f"a.side = '{p}' AND b.side = '{q}'" for o, (p, q) in both.items() if orientation in ("both", o))


_NO = "CAST(NULL AS BIGINT)"
_IDS = f"{_NO} AS cell_id, {_NO} AS poly_id"


def _inter_sql(orientation: str, t: int = T) -> str:
    """Edges meet on the side that they face and on bands of t intercepts: an edge's own band and the one below hold all its partners."""
    way = {"h": ["('D', 'U')"], "v": ["('L', 'R')"], "both": ["('D', 'U')", "('L', 'R')"]}[orientation]
    band = f"CAST(floor(intercept / {t}.0) AS BIGINT)"
    return f"""SELECT 'spacing' AS kind, {_points('a', 'e1')}, {_points('b', 'e2')}, {_IDS}, a.ref_id AS ref1, b.ref_id AS ref2
  FROM (SELECT *, unnest([{band}, {band} - 1]) AS band FROM redges JOIN (VALUES {', '.join(way)}) w(side, faced) USING (side) WHERE layer = {METAL}) a
  JOIN (SELECT *, {band} AS band FROM redges WHERE layer = {METAL}) b ON a.faced = b.side AND a.band = b.band AND a.ref_id <> b.ref_id AND {_faces(t)}"""


def _within_sql(kind: str, first, second, orientation: str, t: int = T, layer: int = METAL) -> str:
    return f"""SELECT '{kind}' AS kind, {_points('a', 'e1', 'r.rx', 'r.ry')}, {_points('b', 'e2', 'r.rx', 'r.ry')},
  a.cell_id AS cell_id, a.poly_id AS poly_id, r.ref_id AS ref1, r.ref_id AS ref2
  FROM edges a JOIN edges b ON a.cell_id = b.cell_id AND a.layer = {layer} AND b.layer = {layer} AND ({_way(first, second, orientation)}) AND {_faces(t)}
  JOIN top_refs r ON r.cell_id = a.cell_id"""


def _width_sql(orientation: str = "both", t: int = T, layer: int = METAL) -> str:
    return _within_sql("width", ("U", "R"), ("D", "L"), orientation, t, layer)


def _intra_sql(orientation: str = "both", t: int = T) -> str:
    return _within_sql("spacing", ("D", "L"), ("U", "R"), orientation, t)


def _enclosure_sql(t: int = T) -> str:
    sides = (("U", "m", "v"), ("R", "m", "v"), ("D", "v", "m"), ("L", "v", "m"))
    role = {"m": METAL, "v": VIA}
    near = f"mr.x_min <= vr.x_max + {t - 1} AND vr.x_min <= mr.x_max AND mr.y_min <= vr.y_max + {t - 1} AND vr.y_min <= mr.y_max"
    parts = [
        f"""SELECT 'enclosure' AS kind, {_points('a', 'e1')}, {_points('b', 'e2')}, {_IDS}, a.ref_id AS ref1, b.ref_id AS ref2
  FROM redges a JOIN redges b ON a.side = '{s}' AND b.side = '{s}' AND a.layer = {role[p]} AND b.layer = {role[q]} AND {_faces(t)}
  JOIN metal_ref mr ON mr.ref_id = {'a' if p == 'm' else 'b'}.ref_id JOIN via_ref vr ON vr.ref_id = {'a' if p == 'v' else 'b'}.ref_id WHERE {near}"""
        for s, p, q in sides
    ]
    return "\nUNION ALL ".join(parts)


_AREA = "CAST(abs(list_sum(list_transform(range(1, len(pts) + 1), lambda i: pts[i].x * pts[i % len(pts) + 1].y - pts[i % len(pts) + 1].x * pts[i].y))) AS BIGINT) // 2"
_NO_EDGES = ", ".join(f"{_NO} AS {c}" for c in checks.COLUMNS[1:9])


def _area_sql(where: str, t: int = 900) -> str:
    return f"SELECT 'area' AS kind, {_NO_EDGES}, CAST(cell_id AS BIGINT) AS cell_id, poly_id, {_NO} AS ref1, {_NO} AS ref2 FROM polygons WHERE {where} AND {_AREA} < {t}"


def query(sql: str | None = None, layout: bool = True, recursive: bool = False):
    """Registers a query, with SQL that may use the layout's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{_LAYOUT}\n{sql}" if layout else sql
        return f

    return add


def _flat(spark: SparkSession, sf_dir: str) -> Layout:
    """The derived layout; vias stay in the top cell."""
    return fixture.derived_layout(spark, sf_dir)


def _layout(spark: SparkSession, sf_dir: str) -> Layout:
    """The derived layout with the top cell's vias promoted to cells."""
    return hierarchy.promote_top_polygons(_flat(spark, sf_dir))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# -- checks ----------------------------------------------------------------


@query(_area_sql(f"layer = {METAL}"))
def area_check(spark, sf_dir):
    return checks.area_check(_flat(spark, sf_dir), METAL, 900)


@query("""SELECT layer, CAST(count(*) AS BIGINT) AS n_checked, CAST(sum(coalesce(n_refs, 0)) AS BIGINT) AS n_saved
  FROM cell_polygons LEFT JOIN (SELECT cell_id, count(*) AS n_refs FROM top_refs GROUP BY cell_id) USING (cell_id) GROUP BY layer""")
def reuse_counts(spark, sf_dir):
    """The layout with its vias promoted; the top cell, which holds copies of them, is left out."""
    layout = _layout(spark, sf_dir)
    polygons = layout.polygons.where(F.col("cell_id") != fixture.TOP)
    return checks.reuse_counts(Layout(layout.cells, polygons, layout.refs, layout.library, layout.top))


@query(_area_sql("true", 1200))
def area_all_layers(spark, sf_dir):
    return checks.area_check(_flat(spark, sf_dir), None, 1200)


@query(_width_sql())
def width_check(spark, sf_dir):
    return checks.width_check(_layout(spark, sf_dir), METAL, T)


@query(_width_sql("h"))
def width_h(spark, sf_dir):
    return checks.width_check(_layout(spark, sf_dir), METAL, T, "h")


@query(_width_sql("v"))
def width_v(spark, sf_dir):
    return checks.width_check(_layout(spark, sf_dir), METAL, T, "v")


@query(_width_sql() + " WHERE a.poly_id = b.poly_id")
def width_same_polygon(spark, sf_dir):
    return checks.width_check(_layout(spark, sf_dir), METAL, T, same_polygon=True)


@query(_width_sql(t=10, layer=VIA))
def width_promoted_vias(spark, sf_dir):
    return checks.width_check(_layout(spark, sf_dir), VIA, 10)


@query(_inter_sql("both"))
def space_inter(spark, sf_dir):
    return checks.space_inter(_layout(spark, sf_dir), [METAL], T)


@query(_intra_sql())
def space_intra(spark, sf_dir):
    return checks.space_intra(_layout(spark, sf_dir), [METAL], T)


@query(f"{_inter_sql('both')} UNION ALL {_intra_sql()}")
def space_both(spark, sf_dir):
    return checks.space_check(_layout(spark, sf_dir), [METAL], T)


@query(f"{_inter_sql('h')} UNION ALL {_intra_sql('h')}")
def space_h_edge(spark, sf_dir):
    return checks.space_check(_layout(spark, sf_dir), [METAL], T, "h")


@query(f"{_inter_sql('v')} UNION ALL {_intra_sql('v')}")
def space_v_edge(spark, sf_dir):
    return checks.space_check(_layout(spark, sf_dir), [METAL], T, "v")


@query(f"{_inter_sql('both')} UNION ALL {_intra_sql()}")
def space_multi_layer(spark, sf_dir):
    return checks.space_check(_layout(spark, sf_dir), [METAL, 20], T)


@query(_enclosure_sql())
def enclosure_check(spark, sf_dir):
    return checks.enclosure_check(_layout(spark, sf_dir), METAL, VIA, T)


@query(f"""SELECT vr.ref_id AS via_ref, mr.ref_id AS metal_ref FROM via_ref vr JOIN metal_ref mr
  ON mr.x_min <= vr.x_max + {T - 1} AND vr.x_min <= mr.x_max AND mr.y_min <= vr.y_max + {T - 1} AND vr.y_min <= mr.y_max""")
def enclosure_candidates(spark, sf_dir):
    return checks.enclosure_candidates(_layout(spark, sf_dir), METAL, VIA, T)


def _slanted(layout: Layout) -> DataFrame:
    """Polygons of which every seventh loses its second corner, and so gets a slanted side."""
    cut = F.filter("pts", lambda p, i: (i != 1) | (F.col("poly_id") % 7 != 0))
    return layout.polygons.withColumn("pts", cut)


_RECTILINEAR_SQL = f"""SELECT 'rectilinear' AS kind, {_NO_EDGES}, CAST(cell_id AS BIGINT) AS cell_id, poly_id, {_NO} AS ref1, {_NO} AS ref2
  FROM (SELECT *, unnest(range(1, len(pts))) AS j FROM polygons) WHERE pts[j].x <> pts[j + 1].x AND pts[j].y <> pts[j + 1].y GROUP BY ALL"""


@query(_RECTILINEAR_SQL.replace("FROM polygons)", "FROM (SELECT * EXCLUDE pts, CASE WHEN poly_id % 7 = 0 THEN list_concat(pts[1:1], pts[3:]) ELSE pts END AS pts FROM polygons))"))
def is_rectilinear(spark, sf_dir):
    layout = _flat(spark, sf_dir)
    return checks.rectilinear_check(Layout(layout.cells, _slanted(layout), layout.refs, top=layout.top))


# -- edges, boxes, points --------------------------------------------------


@query("SELECT * FROM edges")
def edge_extract(spark, sf_dir):
    return hierarchy.edges(_layout(spark, sf_dir).polygons.where(F.col("cell_id") != fixture.TOP))


@query("SELECT layer, side, count(*) AS n FROM edges GROUP BY layer, side")
def edge_sides_count(spark, sf_dir):
    return hierarchy.edges(_flat(spark, sf_dir).polygons).groupBy("layer", "side").agg(F.count("*").alias("n"))


@query("SELECT layer, side, count(*) AS n, CAST(sum(intercept) AS BIGINT) AS sum_intercept FROM redges GROUP BY layer, side")
def ref_edges_count(spark, sf_dir):
    return hierarchy.ref_edges(_layout(spark, sf_dir)).groupBy("layer", "side").agg(F.count("*").alias("n"), F.sum("intercept").alias("sum_intercept"))


@query("SELECT * FROM mbrs")
def polygon_mbr(spark, sf_dir):
    return hierarchy.polygon_mbrs(_layout(spark, sf_dir)).where(F.col("cell_id") != fixture.TOP)


@query("SELECT * FROM cell_mbr")
def cell_mbr(spark, sf_dir):
    return hierarchy.cell_mbrs(_layout(spark, sf_dir)).where(F.col("cell_id") != fixture.TOP)


@query("SELECT * FROM ref_mbr")
def ref_mbr(spark, sf_dir):
    return hierarchy.ref_mbrs(_layout(spark, sf_dir))


@query("SELECT poly_id, j AS i, pts[j].x + 7 AS x, pts[j].y - 3 AS y FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS j FROM polygons)")
def polygon_translate(spark, sf_dir):
    moved = _flat(spark, sf_dir).polygons.select("poly_id", g.translate(F.col("pts"), F.lit(7), F.lit(-3)).alias("pts"))
    return moved.select("poly_id", F.posexplode("pts")).select("poly_id", (F.col("pos") + 1).cast("long").alias("i"), "col.x", "col.y")


@query(f"SELECT poly_id, {_AREA} AS area, len(pts) AS n_points FROM polygons")
def polygon_area(spark, sf_dir):
    return _flat(spark, sf_dir).polygons.select("poly_id", g.area(F.col("pts")).alias("area"), g.polygon_size(F.col("pts")).cast("long").alias("n_points"))


def _corners(spark, sf_dir):
    return hierarchy.cell_mbrs(_layout(spark, sf_dir)).where(F.col("cell_id") != fixture.TOP).select("cell_id", F.array("x_min", "y_min").alias("low"), F.array("x_max", "y_max").alias("high"))


@query("""SELECT cell_id, x_min < 40 AND y_min < 6 AS low_less, x_min <= 3 AND y_min <= 3 AS low_le, x_max > 300 AND y_max > 200 AS high_more,
  x_min = 0 AND y_min = 0 AS low_zero FROM cell_mbr""")
def point_dominance(spark, sf_dir):
    at = lambda x, y: F.array(F.lit(x).cast("long"), F.lit(y).cast("long"))
    return _corners(spark, sf_dir).select(
        "cell_id",
        g.dominated(F.col("low"), at(40, 6)).alias("low_less"),
        g.dominated_or_equal(F.col("low"), at(3, 3)).alias("low_le"),
        g.dominated(at(300, 200), F.col("high")).alias("high_more"),
        (F.col("low") == at(0, 0)).alias("low_zero"),
    )


@query("SELECT cell_id, x_min + x_max AS x, y_min + y_max AS y FROM cell_mbr")
def point_add(spark, sf_dir):
    total = g.point_add(F.col("low"), F.col("high"))
    return _corners(spark, sf_dir).select("cell_id", g.x(total).alias("x"), g.y(total).alias("y"))


@query("SELECT cell_id, x_min < 150 AND 50 < x_max AND y_min < 120 AND 60 < y_max AS hit FROM cell_mbr")
def box_overlap_corners(spark, sf_dir):
    at = lambda x, y: F.array(F.lit(x).cast("long"), F.lit(y).cast("long"))
    return _corners(spark, sf_dir).select("cell_id", g.boxes_overlap(F.col("low"), F.col("high"), at(50, 60), at(150, 120)).alias("hit"))


@query("""SELECT a.ref_id AS a_ref, b.ref_id AS b_ref FROM ref_mbr a JOIN ref_mbr b ON a.ref_id < b.ref_id
  AND a.x_min < b.x_max AND b.x_min < a.x_max AND a.y_min < b.y_max AND b.y_min < a.y_max""")
def box_overlap_pairs(spark, sf_dir):
    return spatial.overlapping(hierarchy.ref_mbrs(_layout(spark, sf_dir)), "ref_id").select(F.col("a_ref_id").alias("a_ref"), F.col("b_ref_id").alias("b_ref"))


@query(f"""SELECT a.ref_id AS a_ref, b.ref_id AS b_ref FROM metal_ref a JOIN metal_ref b ON a.ref_id < b.ref_id
  AND b.x_min <= a.x_max + {T - 1} AND a.x_min <= b.x_max + {T - 1} AND b.y_min <= a.y_max + {T - 1} AND a.y_min <= b.y_max + {T - 1}""")
def space_candidates(spark, sf_dir):
    layout = _layout(spark, sf_dir)
    boxes = hierarchy.ref_mbrs(layout).join(hierarchy.cells_on(layout, METAL), "cell_id", "left_semi")
    grown = boxes.withColumns({"x_max": F.col("x_max") + (T - 1), "y_max": F.col("y_max") + (T - 1)})
    pairs = join.box_overlap(grown, grown, apart=F.col("a_ref_id") < F.col("b_ref_id"))
    return pairs.select(F.col("a_ref_id").alias("a_ref"), F.col("b_ref_id").alias("b_ref"))


@query("SELECT * FROM ref_mbr WHERE x_min < 4000 AND 1000 < x_max AND y_min < 900 AND -200 < y_max")
def spatial_range_query(spark, sf_dir):
    return spatial.query(hierarchy.ref_mbrs(_layout(spark, sf_dir)), 1000, 4000, -200, 900)


@query("""SELECT v.ref_id AS via_ref, m.ref_id AS metal_ref FROM via_ref v JOIN metal_ref m ON v.x_min < m.x_max AND m.x_min < v.x_max AND v.y_min < m.y_max AND m.y_min < v.y_max""")
def spatial_join(spark, sf_dir):
    metals, vias = checks.enclosure_sides(_layout(spark, sf_dir), METAL, VIA)
    return spatial.join(vias, metals).select(F.col("a_ref_id").alias("via_ref"), F.col("b_ref_id").alias("metal_ref"))


# -- layers and hierarchy --------------------------------------------------


@query("SELECT ref_id, cell_id FROM top_refs WHERE cell_id IN (SELECT cell_id FROM cell_polygons WHERE layer IN (20, 21))")
def layer_membership_any(spark, sf_dir):
    return hierarchy.refs_on(_layout(spark, sf_dir), 20, 21).select("ref_id", "cell_id")


@query("SELECT DISTINCT cell_id, layer FROM cell_polygons")
def cell_layers(spark, sf_dir):
    return hierarchy.cell_layers(_layout(spark, sf_dir)).where(F.col("cell_id") != fixture.TOP)


@query("SELECT ref_id, cell_id FROM via_ref")
def via_not_metal_refs(spark, sf_dir):
    return hierarchy.refs_on_but_not(_layout(spark, sf_dir), VIA, METAL).select("ref_id", "cell_id")


@query("SELECT CAST(-1 AS BIGINT) AS cell_id, (SELECT count(*) FROM customer) AS n_refs")
def top_cell(spark, sf_dir):
    return hierarchy.top_cell(_flat(spark, sf_dir).with_top(None))


@query("SELECT ref_id, cell_id, rx, ry, CASE WHEN ref_id >= 1000000 THEN 'polygon' || ref_id ELSE (SELECT s_name FROM supplier WHERE s_suppkey = cell_id) END AS cell_name FROM top_refs")
def promote_top_polygons(spark, sf_dir):
    layout = _layout(spark, sf_dir)
    return layout.refs.join(layout.cells, "cell_id").select("ref_id", "cell_id", "rx", "ry", "cell_name")


@query("SELECT cell_id, layer, count(*) AS n_elements FROM polygons GROUP BY cell_id, layer")
def num_elements_by_layer(spark, sf_dir):
    return hierarchy.count_elements(_flat(spark, sf_dir))


@query("""SELECT c.cell_id, coalesce(n_layers, 0) AS n_layers, coalesce(n_elements, 0) AS n_elements, CASE WHEN c.cell_id = -1 THEN (SELECT count(*) FROM customer) ELSE 0 END AS n_refs,
  coalesce(n_elements, 0) + CASE WHEN c.cell_id = -1 THEN (SELECT count(*) FROM customer) ELSE 0 END AS n_objects
  FROM (SELECT CAST(s_suppkey AS BIGINT) AS cell_id FROM supplier UNION ALL SELECT -1) c
  LEFT JOIN (SELECT cell_id, count(DISTINCT layer) AS n_layers, count(*) AS n_elements FROM polygons GROUP BY cell_id) p USING (cell_id)""")
def num_objects_by_cell(spark, sf_dir):
    return hierarchy.count_objects(_flat(spark, sf_dir))


_FLAT = """flat AS (SELECT layer, poly_id, CAST(NULL AS BIGINT) AS ref_id, pts, 0 AS rx, 0 AS ry FROM polygons WHERE cell_id = -1
  UNION ALL SELECT layer, poly_id, ref_id, pts, rx, ry FROM parts JOIN top_refs USING (cell_id))"""


@query(f", {_FLAT} SELECT layer, count(*) AS n_elements, CAST(sum(pts[1].x + rx) AS BIGINT) AS sum_x, CAST(sum(pts[1].y + ry) AS BIGINT) AS sum_y FROM flat GROUP BY layer")
def flatten_layers(spark, sf_dir):
    first = g.polygon_point(F.col("pts"), 0)
    return hierarchy.flatten(_flat(spark, sf_dir)).groupBy("layer").agg(F.count("*").alias("n_elements"), F.sum(first["x"]).alias("sum_x"), F.sum(first["y"]).alias("sum_y"))


@query(f", {_FLAT} SELECT layer, poly_id, ref_id, pts[1].x + rx AS x, pts[1].y + ry AS y FROM flat WHERE layer IN (20, 21)")
def flatten_polygons(spark, sf_dir):
    flat = hierarchy.flatten_named(_flat(spark, sf_dir), "TOP")
    first = g.polygon_point(F.col("pts"), 0)
    return flat.where("layer IN (20, 21)").select("layer", "poly_id", "ref_id", first["x"].alias("x"), first["y"].alias("y"))


@query("SELECT poly_id, cell_id, len(pts) AS n_points FROM polygons WHERE layer = 25")
def elements_on_layer(spark, sf_dir):
    return hierarchy.elements_on_layer(_flat(spark, sf_dir), 25).select("poly_id", "cell_id", F.size("pts").cast("long").alias("n_points"))


@query("SELECT k AS ref_id, k % n + CASE WHEN k % 13 = 0 THEN n + 5 ELSE 0 END AS cell_id FROM place, s WHERE k % 13 = 0")
def dangling_refs(spark, sf_dir):
    layout = _flat(spark, sf_dir)
    n = layout.cells.count() - 1
    lost = layout.refs.withColumn("cell_id", F.when(F.col("ref_id") % 13 == 0, F.col("cell_id") + n + 5).otherwise(F.col("cell_id")))
    return hierarchy.dangling_refs(Layout(layout.cells, layout.polygons, lost, top=layout.top)).select("ref_id", "cell_id")


@query(f"""SELECT CAST(ref1 AS BIGINT) AS ref_id, count(*) AS n, CAST(sum(e1x1) AS BIGINT) AS sum_x, CAST(sum(e2y2) AS BIGINT) AS sum_y FROM ({_width_sql()}) GROUP BY ref1""")
def violation_translate(spark, sf_dir):
    return checks.width_check(_layout(spark, sf_dir), METAL, T).groupBy(F.col("ref1").alias("ref_id")).agg(F.count("*").alias("n"), F.sum("e1x1").alias("sum_x"), F.sum("e2y2").alias("sum_y"))


# -- decks -----------------------------------------------------------------

DECK = (
    rules.layer(METAL).spacing().greater_than(T),
    rules.layer(METAL).width().greater_than(T),
    rules.layer(METAL).with_layer(VIA).enclosure().greater_than(T),
    rules.layer(METAL).area().greater_than(900),
    rules.layer(20).spacing("h").greater_than(T),
    rules.polygons().area().greater_than(700),
    rules.polygons().is_rectilinear(),
)
_DECK_SQL = (
    f"{_inter_sql('both')} UNION ALL {_intra_sql()}",
    _width_sql(),
    _enclosure_sql(),
    _area_sql(f"layer = {METAL}"),
    f"{_inter_sql('h')} UNION ALL {_intra_sql('h')}".replace(f"layer = {METAL}", "layer = 20"),
    _area_sql("true", 700).replace("FROM polygons", "FROM (SELECT * FROM polygons UNION ALL SELECT poly_id, poly_id, 21, pts FROM vias)"),
    _RECTILINEAR_SQL,
)


@query(" UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS rule_id, q.* FROM ({sql}) q" for i, sql in enumerate(_DECK_SQL)))
def rule_deck(spark, sf_dir):
    return rules.run_deck(_layout(spark, sf_dir), DECK)


@query(" UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS rule_id, kind, count(*) AS n FROM ({sql}) q GROUP BY kind" for i, sql in enumerate(_DECK_SQL)))
def violation_counts_by_rule(spark, sf_dir):
    return rules.counts_by_rule(rules.run_deck(_layout(spark, sf_dir), DECK))


# -- rows, sweeps, intervals -----------------------------------------------


def _rows_sql(layers: str) -> str:
    return f"""SELECT ref_id, CAST(sum(fresh) OVER (ORDER BY l, r, ref_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS row_id FROM (
  SELECT ref_id, l, r, CASE WHEN l > coalesce(max(r) OVER (ORDER BY l, r, ref_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l - 1) THEN 1 ELSE 0 END AS fresh
  FROM (SELECT ref_id, y_min AS l, y_max + {T - 1} AS r FROM ref_mbr WHERE cell_id IN (SELECT cell_id FROM cell_polygons WHERE layer IN ({layers}))))"""


@query(_rows_sql("19"))
def row_partition(spark, sf_dir):
    return partition.rows(_layout(spark, sf_dir), [METAL], T)


@query(_rows_sql("20, 21"))
def row_partition_two_layers(spark, sf_dir):
    return partition.rows(_layout(spark, sf_dir), [20, VIA], T)


def _intervals(spark, sf_dir):
    """(k, l, r): the days between an order and the shipping of each of its items."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("l"))
    items = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("r"))
    return orders.join(items, "k").where(F.col("l") <= F.col("r")).select("k", "l", "r")


def _day(c: str) -> str:
    return f"CAST(date_diff('day', DATE '1970-01-01', CAST({c} AS DATE)) AS BIGINT)"


_INTERVALS = f"""(SELECT k, l, r FROM (SELECT o_orderkey AS k, {_day('o_orderdate')} AS l, {_day('l_shipdate')} AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE l <= r)"""
_MONTHS = "(SELECT CAST(m AS BIGINT) AS m, CAST(m * 30 + 8000 AS BIGINT) AS l, CAST(m * 30 + 8002 AS BIGINT) AS r FROM range(0, 100) t(m))"


@query(f"SELECT m.m, count(*) AS n, CAST(sum(i.k) AS BIGINT) AS sum_k, CAST(sum(i.l) AS BIGINT) AS sum_l, CAST(sum(i.r) AS BIGINT) AS sum_r FROM {_MONTHS} m JOIN {_INTERVALS} i ON m.l <= i.r AND i.l <= m.r GROUP BY ALL", layout=False)
def interval_overlap_join(spark, sf_dir):
    """Every interval with each of 100 spans of three days that it meets, summed up by span."""
    spans = spark.range(100).select(F.col("id").alias("m"), (F.col("id") * 30 + 8000).alias("l"), (F.col("id") * 30 + 8002).alias("r"))
    met = join.interval_overlap(spans, _intervals(spark, sf_dir), tile=64)
    return met.groupBy(F.col("a_m").alias("m")).agg(F.count("*").alias("n"), *(F.sum(f"b_{c}").alias(f"sum_{c}") for c in "klr"))


@query(f"SELECT m.m, m.l AS p, count(*) AS n, CAST(sum(i.r - i.l) AS BIGINT) AS days FROM {_MONTHS} m JOIN {_INTERVALS} i ON i.l <= m.l AND m.l <= i.r GROUP BY ALL", layout=False)
def interval_stabbing(spark, sf_dir):
    """Every interval that holds a point, for a point a month, summed up by point."""
    points = spark.range(100).select(F.col("id").alias("m"), (F.col("id") * 30 + 8000).alias("p"))
    found = join.stabbing(_intervals(spark, sf_dir), points, tile=64)
    return found.groupBy(F.col("b_m").alias("m"), F.col("b_p").alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("a_r") - F.col("a_l")).alias("days"))


@query(f"SELECT a.k, a.l, a.r, CAST(a.copies AS BIGINT) AS copies, count(*) AS n FROM (SELECT k, l, r, count(*) AS copies FROM {_INTERVALS} GROUP BY ALL) a JOIN {_INTERVALS} b ON a.l <= b.r AND b.l <= a.r GROUP BY ALL", layout=False)
def interval_overlap_counts(spark, sf_dir):
    """The join of all intervals with all, summed up by interval."""
    every = _intervals(spark, sf_dir)
    return join.overlap_counts(every.groupBy("k", "l", "r").agg(F.count("*").alias("copies")), every)


@query(f"SELECT i.k, i.l, i.r, CAST(i.copies AS BIGINT) AS copies, count(*) AS n FROM (SELECT k, l, r, count(*) AS copies FROM {_INTERVALS} GROUP BY ALL) i JOIN (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS p FROM orders) o ON i.l <= o.p AND o.p <= i.r GROUP BY ALL", layout=False)
def interval_stabbing_counts(spark, sf_dir):
    """All orders as points in all intervals, summed up by interval."""
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    every = _intervals(spark, sf_dir).groupBy("k", "l", "r").agg(F.count("*").alias("copies"))
    return join.overlap_counts(every, _read(spark, sf_dir, "orders").select(day.alias("l"), day.alias("r")))


@query(f"""SELECT row_id, count(*) AS n, min(l) AS l, max(r) AS r FROM (
  SELECT l, r, CAST(sum(fresh) OVER (ORDER BY l, r, k ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS row_id FROM (
    SELECT k, l, r, CASE WHEN l > coalesce(max(r) OVER (ORDER BY l, r, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l - 1) THEN 1 ELSE 0 END AS fresh
    FROM (SELECT k, l + k // 32 * 4000 AS l, r + k // 32 * 4000 AS r FROM {_INTERVALS}))) GROUP BY row_id""", layout=False)
def interval_coalesce(spark, sf_dir):
    """Every interval; each group of 32 order keys has days of its own, so there are gaps."""
    moved = _intervals(spark, sf_dir).selectExpr("k", "l + k div 32 * 4000 AS l", "r + k div 32 * 4000 AS r")
    return partition.coalesce_intervals(moved).groupBy("row_id").agg(F.count("*").alias("n"), F.min("l").alias("l"), F.max("r").alias("r"))


@query(f"""SELECT p AS "at", CAST(sum(d) OVER (ORDER BY p) AS BIGINT) AS n_active FROM (
  SELECT p, sum(d) AS d FROM (SELECT l AS p, 1 AS d FROM {_INTERVALS} UNION ALL SELECT r + 1, -1 FROM {_INTERVALS}) GROUP BY p)""", layout=False)
def sweepline_active_count(spark, sf_dir):
    return partition.active_count(_intervals(spark, sf_dir))


def _events(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.floor("value").cast("long").alias("v"))


@query("SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix FROM events", layout=False)
def sweepline_prefix_sum(spark, sf_dir):
    return partition.prefix_sum(_events(spark, sf_dir), "at", "v", "event_id").select("event_id", "prefix")


@query("""SELECT event_id, max(CAST(floor(value) AS BIGINT)) OVER w AS highest, CAST(count(*) OVER w AS BIGINT) AS n FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""", layout=False)
def sweepline_by_user(spark, sf_dir):
    swept = partition.sweepline(_events(spark, sf_dir), ["at", "event_id"], F.max("v"), ["user_id"], "highest")
    return partition.sweepline(swept, ["at", "event_id"], F.count("*"), ["user_id"], "n").select("event_id", "highest", "n")


@query("""SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT) % 97) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 1009 AS BIGINT) AS status FROM events""", layout=False)
def sweepline_fold(spark, sf_dir):
    step = lambda status, row: (status + (row.v % 97 if row.v >= 0 else -(-row.v % 97))) % 1009
    df = _events(spark, sf_dir)
    return partition.fold(df, ["at", "event_id"], step, 0, "event_id long, user_id long, at long, v long, status long", ["user_id"]).select("event_id", "status")


@query("SELECT x_min AS value, CAST(row_number() OVER (ORDER BY x_min) - 1 AS BIGINT) AS index FROM (SELECT DISTINCT x_min FROM ref_mbr)")
def coordinate_compress(spark, sf_dir):
    boxes = hierarchy.ref_mbrs(_layout(spark, sf_dir)).select(F.col("x_min").alias("value"))
    return partition.compress(boxes, "value")


# -- results compared, text, stream files ----------------------------------


def _two_results(spark, sf_dir):
    """Spacing, and the same without some, with some moved by one unit and some doubled."""
    found = checks.space_intra(_layout(spark, sf_dir), [METAL], T).select(*violations.EDGES, "ref1")
    kept = found.where("ref1 % 11 <> 0")
    moved = kept.withColumns({c: F.col(c) + (F.col("ref1") % 5 == 0).cast("long") for c in violations.EDGES})
    return found.drop("ref1"), moved.union(moved.where("ref1 % 7 = 0")).drop("ref1")


_E = ", ".join(violations.EDGES)
_TWO = f""", found AS (SELECT {_E}, ref1 FROM ({_intra_sql()})),
moved AS (SELECT {', '.join(f'{c} + CASE WHEN ref1 % 5 = 0 THEN 1 ELSE 0 END AS {c}' for c in violations.EDGES)}, ref1 FROM found WHERE ref1 % 11 <> 0),
one AS (SELECT {_E}, count(*) AS na FROM found GROUP BY ALL),
two AS (SELECT {_E}, count(*) AS nb FROM (SELECT {_E} FROM moved UNION ALL SELECT {_E} FROM moved WHERE ref1 % 7 = 0) GROUP BY ALL)"""


@query(f"""{_TWO} SELECT CASE WHEN coalesce(na, 0) > coalesce(nb, 0) THEN 'a' ELSE 'b' END AS side, {_E}, CAST(abs(coalesce(na, 0) - coalesce(nb, 0)) AS BIGINT) AS n
  FROM one FULL JOIN two USING ({_E}) WHERE coalesce(na, 0) <> coalesce(nb, 0)""")
def compare_exact(spark, sf_dir):
    return compare.exact(*_two_results(spark, sf_dir))


def _agree(a: str, b: str) -> str:
    p, q = f"a.{a}", f"b.{b}"
    along = lambda u, v: f"abs({p}{v}1 - {q}{v}1) <= 1 AND least({p}{u}1, {p}{u}2) <= greatest({q}{u}1, {q}{u}2) AND least({q}{u}1, {q}{u}2) <= greatest({p}{u}1, {p}{u}2)"
    return f"(CASE WHEN {p}y1 = {p}y2 THEN {along('x', 'y')} ELSE {along('y', 'x')} END)"


def _canonical_sql(table: str) -> str:
    ends = [(f"{e}x{k}", f"{e}y{k}") for e in ("e1", "e2") for k in (1, 2)]
    ordered = lambda axis: "list_sort([" + ", ".join(f"{{'k': {p[axis]}, 'i': {i}, 'x': {p[0]}, 'y': {p[1]}}}" for i, p in enumerate(ends)) + "])"
    picked = ", ".join(f"coalesce(p[{i // 2 + 1}].{'xy'[i % 2]}, {c}) AS {c}" for i, c in enumerate(violations.EDGES))
    return f"""(SELECT {picked} FROM (SELECT *, CASE WHEN px[1].x = px[2].x AND (py[1].y <> py[2].y OR px[4].k - px[1].k < py[4].k - py[1].k) THEN px WHEN py[1].y = py[2].y THEN py END AS p
  FROM (SELECT *, {ordered(0)} AS px, {ordered(1)} AS py FROM {table})))"""


@query(f"""{_TWO}, three AS (SELECT {_E}, count(*) AS na FROM {_canonical_sql('found')} GROUP BY ALL),
four AS (SELECT DISTINCT {_E} FROM {_canonical_sql('moved')})
SELECT {', '.join(f'a.{c} AS {c}' for c in violations.EDGES)}, a.na, count(b.e1x1) AS partners FROM three a LEFT JOIN four b
  ON ({_agree('e1', 'e1')} AND {_agree('e2', 'e2')}) OR ({_agree('e1', 'e2')} AND {_agree('e2', 'e1')}) GROUP BY ALL""")
def compare_candidates(spark, sf_dir):
    a, b = _two_results(spark, sf_dir)
    pairs = compare.candidates(a, b).groupBy("a_key").agg(F.count("*").alias("partners"))
    one = compare.canonical(a).groupBy(*violations.EDGES).agg(F.count("*").alias("na")).withColumn("a_key", F.struct(*violations.EDGES))
    return one.join(pairs, "a_key", "left").select(*violations.EDGES, "na", F.coalesce("partners", F.lit(0)).alias("partners"))


@query()
def compare_tolerant(spark, sf_dir):
    return compare.summary(compare.match(*_two_results(spark, sf_dir)))


@query(f"SELECT concat_ws(' ', {_E}) AS value FROM ({_inter_sql('both')} UNION ALL {_width_sql()})")
def violation_lines(spark, sf_dir):
    layout = _layout(spark, sf_dir)
    return violations.lines(checks.space_inter(layout, [METAL], T).unionByName(checks.width_check(layout, METAL, T)))


_DECODED = {0: "HEADER", 1: "BGNLIB", 2: "LIBNAME", 3: "UNITS", 4: "ENDLIB", 5: "BGNSTR", 6: "STRNAME", 7: "ENDSTR", 8: "BOUNDARY", 9: "PATH", 10: "SREF"}


@query(
    f"""SELECT k, name, text, CAST((k * 7919) % 65536 - CASE WHEN (k * 7919) % 65536 >= 32768 THEN 65536 ELSE 0 END AS INTEGER) AS short,
  CAST((k * 70001) % 4294967296 - 2147483648 AS BIGINT) AS x, CAST(k - 1000 AS BIGINT) AS y, CASE WHEN k % 2 = 1 THEN -1.0 ELSE 1.0 END * CAST(k * 1000003 AS DOUBLE) * pow(CAST(16.0 AS DOUBLE), k % 5 - 14) AS real,
  (k * 7919) % 65536 >= 32768 AS top_bit, CAST(1 AS INTEGER) AS n_points,
  CAST(1900 + k % 200 AS INTEGER) AS year, CAST(1 + k % 12 AS INTEGER) AS month, CAST(1 + k % 28 AS INTEGER) AS day, CAST(k % 24 AS INTEGER) AS hour, CAST(k % 60 AS INTEGER) AS minute, CAST(k % 59 AS INTEGER) AS second
  FROM (SELECT CAST(p_partkey AS BIGINT) AS k, p_name AS text FROM part) LEFT JOIN (VALUES {', '.join(f"({k}, '{v}')" for k, v in _DECODED.items())}) t(code, name) ON code = k % 11""",
    layout=False,
)
def decode_scalars(spark, sf_dir):
    """Payloads of all kinds made from each part, and decoded: numbers, points, bits, strings with a trailing NUL, names of records, times."""
    k = F.col("k")
    raw = lambda v, digits: F.unhex(F.lpad(F.hex(v), digits, "0"))
    wrapped = lambda v: F.pmod(v, F.lit(1 << 32))
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_name").alias("text"))
    made = parts.select(
        "k",
        raw(k * 7919 % 65536, 4).alias("short"),
        F.concat(raw(wrapped(k * 70001 - (1 << 31)), 8), raw(wrapped(k - 1000), 8)).alias("point"),
        F.concat(raw(k % 2 * 128 + 64 + k % 5, 2), raw(k * 1000003, 14)).alias("real"),
        F.concat(F.encode("text", "ISO-8859-1"), F.unhex(F.lit("00"))).alias("text"),
        F.concat(*(raw(v, 4) for v in (k % 200 + 1900, k % 12 + 1, k % 28 + 1, k % 24, k % 60, k % 59))).alias("time"),
    )
    at = decode.point_col(F.col("point"))
    return made.select(
        "k",
        decode.record_name((k % 11).cast("int")).alias("name"),
        decode.string_col(F.col("text")).alias("text"),
        decode.int16_col(F.col("short")).alias("short"),
        at["x"].alias("x"),
        at["y"].alias("y"),
        decode.real64_col(F.col("real")).alias("real"),
        decode.bit_col(F.col("short"), 15).alias("top_bit"),
        decode.point_count_col(F.col("point")).alias("n_points"),
        *(decode.datetime_col(F.col("time"))[part].alias(part) for part in decode.DATETIME),
    )


_NAME = "CASE WHEN {0} = -1 THEN 'TOP' ELSE (SELECT s_name FROM supplier WHERE s_suppkey = {0}) END"


@query(f"""SELECT 'boundary' AS kind, {_NAME.format('cell_id')} AS cell, CAST(layer AS BIGINT) AS layer, array_to_string(list_transform(pts, lambda p: p.x || ',' || p.y), ' ') AS shape, count(*) AS n FROM polygons GROUP BY ALL
  UNION ALL SELECT 'sref', {_NAME.format('k % n')}, NULL, rx || ',' || ry, count(*) FROM place, s GROUP BY ALL
  UNION ALL SELECT 'cell', s_name, NULL, NULL, 1 FROM supplier UNION ALL SELECT 'cell', 'TOP', NULL, NULL, 1
  UNION ALL SELECT 'width', NULL, NULL, NULL, (SELECT count(*) FROM ({_width_sql()}))""")
def gdsii_roundtrip(spark, sf_dir):
    """The layout written as one stream file and read again: every corner, layer, name and offset, and a check over it."""
    back = gdsii.layout(gdsii.decode(gdsii.encode(_flat(spark, sf_dir))).persist())
    named = back.cells.select("cell_id", F.col("cell_name").alias("cell"))
    none, at = F.lit(None).cast("string"), F.array_join(F.transform("pts", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    rows = lambda df, kind, *columns: df.groupBy(F.lit(kind).alias("kind"), *columns).agg(F.count("*").alias("n"))
    shapes = rows(back.polygons.join(named, "cell_id"), "boundary", "cell", F.col("layer").cast("long").alias("layer"), at.alias("shape"))
    refs = rows(back.refs.join(named, "cell_id"), "sref", "cell", F.lit(None).cast("long").alias("layer"), F.concat_ws(",", "rx", "ry").alias("shape"))
    cells = rows(named, "cell", "cell", F.lit(None).cast("long").alias("layer"), none.alias("shape"))
    found = checks.width_check(back, METAL, T).agg(F.lit("width").alias("kind"), F.first(none).alias("cell"), F.first(F.lit(None).cast("long")).alias("layer"), F.first(none).alias("shape"), F.count("*").alias("n"))
    return shapes.union(refs).union(cells).union(found)
