"""The checks: spacing, width, enclosure, area, rectilinear shapes.

All comparisons are strict and on integers, results are bags. What a cell holds
is checked once and then replicated to the cell's references.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layoutcheck.functions import geometry as g
from layoutcheck.operators import hierarchy, join
from layoutcheck.sources.layout import Layout

COLUMNS = ("kind", "e1x1", "e1y1", "e1x2", "e1y2", "e2x1", "e2y1", "e2x2", "e2y2", "cell_id", "poly_id", "ref1", "ref2")
_SIDES = {"both": ("D", "L", "U", "R"), "h": ("D", "U"), "v": ("L", "R")}


def _result(pairs: DataFrame, kind: str, **ids: Column | str) -> DataFrame:
    """Violations of edge pairs (a_*, b_*); edge 1 is the one with the larger intercept."""
    ends = []
    for n, p in (("e1", "a_"), ("e2", "b_")):
        xy = g.edge_points(*(F.col(f"{p}{c}") for c in ("side", "p_start", "p_end", "intercept")))
        ends += [v.alias(f"{n}{c}") for v, c in zip(xy, ("x1", "y1", "x2", "y2"))]
    id_of = lambda c: (F.col(ids[c]) if c in ids else F.lit(None)).cast("long").alias(c)
    return pairs.select(F.lit(kind).alias("kind"), *ends, *(id_of(c) for c in COLUMNS[9:]))


def _way(edges: DataFrame, sides: Sequence[str], orientation: str) -> DataFrame:
    wanted = [s for s in sides if s in _SIDES[orientation]]
    return edges.where(F.col("side").isin(*wanted)).withColumn("way", g.upright(F.col("side")))


def _edges(layout: Layout, layer: int, edges: DataFrame | None) -> DataFrame:
    """Edges of a layer, out of those that are there already."""
    return (hierarchy.edges(layout.polygons) if edges is None else edges).where(F.col("layer") == layer)


def _within_cells(layout: Layout, layer: int, t: int, first: Sequence[str], second: Sequence[str], kind: str, orientation: str, same_polygon: bool = False, tile: int = join.TILE, edges: DataFrame | None = None) -> DataFrame:
    """Facing edges inside each cell definition but the top's, at each top-level reference."""
    edges = _edges(layout, layer, edges).where(F.col("cell_id") != hierarchy.top_id(layout)).select("cell_id", "poly_id", "side", "p_start", "p_end", "intercept")
    apart = F.col("a_poly_id") == F.col("b_poly_id") if same_polygon else None
    found = join.facing_edges(_way(edges, first, orientation), _way(edges, second, orientation), t, ("cell_id", "way"), tile, apart)
    cells = _result(found, kind, cell_id="a_cell_id", poly_id="a_poly_id")
    placed = hierarchy.replicate(cells, hierarchy.top_refs(layout))
    return placed.withColumn("ref1", F.col("ref_id")).withColumn("ref2", F.col("ref_id")).select(*COLUMNS)


def space_inter(layout: Layout, layers: Sequence[int], t: int, orientation: str = "both", tile: int = join.TILE, edges: DataFrame | None = None) -> DataFrame:
    """Between edges of different references: lower over upper, left over right."""
    edges = hierarchy.move_edges(_edges(layout, layers[0], edges), hierarchy.top_refs(layout)).select("ref_id", "side", "p_start", "p_end", "intercept")
    found = join.facing_edges(_way(edges, ("D", "L"), orientation), _way(edges, ("U", "R"), orientation), t, ("way",), tile, F.col("a_ref_id") != F.col("b_ref_id"))
    return _result(found, "spacing", ref1="a_ref_id", ref2="b_ref_id")


def space_intra(layout: Layout, layers: Sequence[int], t: int, orientation: str = "both", tile: int = join.TILE, edges: DataFrame | None = None) -> DataFrame:
    """Between edges of one cell, notches of a polygon included."""
    return _within_cells(layout, layers[0], t, ("D", "L"), ("U", "R"), "spacing", orientation, tile=tile, edges=edges)


def space_check(layout: Layout, layers: Sequence[int], t: int, orientation: str = "both", tile: int = join.TILE, edges: DataFrame | None = None) -> DataFrame:
    """Spacing below t on the first of the layers. orientation: both, h (horizontal edges) or v.

    Further layers only widen the set of cells looked at, and cells without the
    first layer have no edges to compare.
    """
    return space_inter(layout, layers, t, orientation, tile, edges).unionByName(space_intra(layout, layers, t, orientation, tile, edges))


def width_check(layout: Layout, layer: int, t: int, orientation: str = "both", same_polygon: bool = False, tile: int = join.TILE, edges: DataFrame | None = None) -> DataFrame:
    """Upper over lower and right over left edges closer than t, over all polygons of a cell or those of one polygon."""
    return _within_cells(layout, layer, t, ("U", "R"), ("D", "L"), "width", orientation, same_polygon, tile, edges)


def enclosure_sides(layout: Layout, metal: int, via: int) -> tuple[DataFrame, DataFrame]:
    """References of metal cells, and of cells that have via but no metal, with their boxes."""
    boxes = hierarchy.ref_mbrs(layout)
    is_metal, is_via = hierarchy.cells_on(layout, metal), hierarchy.cells_on(layout, via)
    return boxes.join(is_metal, "cell_id", "left_semi"), boxes.join(is_via, "cell_id", "left_semi").join(is_metal, "cell_id", "left_anti")


def enclosure_candidates(layout: Layout, metal: int, via: int, t: int) -> DataFrame:
    """(via_ref, metal_ref) whose whole-cell boxes meet, the via's upper sides moved out by t - 1."""
    metals, vias = enclosure_sides(layout, metal, via)
    found = join.box_overlap(vias.select("ref_id", *g.BOX), metals.select("ref_id", *g.BOX), t - 1)
    return found.select(F.col("a_ref_id").alias("via_ref"), F.col("b_ref_id").alias("metal_ref"))


def enclosure_check(layout: Layout, metal: int, via: int, t: int, tile: int = join.TILE, edges: DataFrame | None = None) -> DataFrame:
    """Margins of metal around via that are short: above 0 and below t, on any side.

    This is no test of being enclosed: flush and protruding sides and vias
    without metal are not reported, and metal beside the via may be.
    """
    refs = hierarchy.top_refs(layout)
    pairs = enclosure_candidates(layout, metal, via, t)
    of = lambda layer, prefix: hierarchy.move_edges(_edges(layout, layer, edges), refs).select(*(F.col(c).alias(f"{prefix}{c}") for c in ("ref_id", "side", "p_start", "p_end", "intercept")))
    # few pairs of references are near each other; their edges meet by reference, side and band of t intercepts
    band = join.tile_of(F.col("m_intercept"), t)
    metals = of(metal, "m_").withColumn("m_band", F.explode(F.array(band - 1, band, band + 1)))
    vias = of(via, "v_").withColumn("v_band", join.tile_of(F.col("v_intercept"), t))
    both = (F.col("via_ref") == F.col("v_ref_id")) & (F.col("m_side") == F.col("v_side")) & (F.col("m_band") == F.col("v_band"))
    met = pairs.join(metals, F.col("metal_ref") == F.col("m_ref_id")).join(vias, both)
    metal_first = F.col("m_side").isin("U", "R")
    sides = [(a, b, F.when(metal_first, F.col(f"m_{c}")).otherwise(F.col(f"v_{c}")), F.when(metal_first, F.col(f"v_{c}")).otherwise(F.col(f"m_{c}"))) for c in ("ref_id", "side", "p_start", "p_end", "intercept") for a, b in [(f"a_{c}", f"b_{c}")]]
    found = met.select(*(one.alias(a) for a, _, one, _ in sides), *(two.alias(b) for _, b, _, two in sides))
    close = g.faces(F.col("a_intercept"), F.col("b_intercept"), F.col("a_p_start"), F.col("a_p_end"), F.col("b_p_start"), F.col("b_p_end"), t)
    return _result(found.where(close), "enclosure", ref1="a_ref_id", ref2="b_ref_id")


def area_check(layout: Layout, layer: int | None, t: int) -> DataFrame:
    """Polygons of every cell definition, the top's too, whose area is below t; poly_id and cell_id say which."""
    polygons = layout.polygons if layer is None else layout.polygons.where(F.col("layer") == layer)
    return _polygons(polygons.where(g.area(F.col("pts")) < t), "area")


def reuse_counts(layout: Layout) -> DataFrame:
    """layer, n_checked, n_saved: polygons that are looked at once in their cell, and those that its references repeat.

    A reference saves the polygons of its own cell; references inside that cell count for themselves, once.
    """
    own = hierarchy.count_elements(layout)
    placed = layout.refs.groupBy("cell_id").agg(F.count("*").alias("n_refs"))
    saved = F.sum(F.col("n_elements") * F.coalesce("n_refs", F.lit(0)))
    return own.join(placed, "cell_id", "left").groupBy("layer").agg(F.sum("n_elements").alias("n_checked"), saved.alias("n_saved"))


def rectilinear_check(layout: Layout, layer: int | None = None) -> DataFrame:
    """Polygons with a slanted side."""
    polygons = layout.polygons if layer is None else layout.polygons.where(F.col("layer") == layer)
    return _polygons(polygons.where(~g.rectilinear(F.col("pts"))), "rectilinear")


def _polygons(polygons: DataFrame, kind: str) -> DataFrame:
    none = F.lit(None).cast("long")
    return polygons.select(F.lit(kind).alias("kind"), *(none.alias(c) for c in COLUMNS[1:9]), "cell_id", "poly_id", none.alias("ref1"), none.alias("ref2"))


def counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("kind").agg(F.count("*").alias("n"))
