"""Cells, references and what follows from them: top cell, boxes, edges, flattening, replication."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutcheck.errors import HierarchyError
from layoutcheck.functions import geometry as g
from layoutcheck.sources.layout import Layout

PROMOTED = 1_000_000


def reference_counts(layout: Layout) -> DataFrame:
    """cell_id, n_refs of every cell that holds references."""
    return layout.refs.groupBy(F.col("parent_cell_id").alias("cell_id")).agg(F.count("*").alias("n_refs"))


def top_cell(layout: Layout) -> DataFrame:
    """The cell with the most references, the first on a tie: one row (cell_id, n_refs), or none."""
    return reference_counts(layout).orderBy(F.desc("n_refs"), "cell_id").limit(1)


def top_id(layout: Layout) -> int:
    """``layout.top``, or the top cell's id; an error if no cell holds a reference."""
    if layout.top is not None:
        return layout.top
    found = top_cell(layout).first()
    if found is None:
        raise HierarchyError("no top cell: no cell holds a reference")
    return found["cell_id"]


def top_refs(layout: Layout) -> DataFrame:
    return layout.refs.where(F.col("parent_cell_id") == top_id(layout))


def dangling_refs(layout: Layout) -> DataFrame:
    """References to cells that aren't there."""
    return layout.refs.join(layout.cells, "cell_id", "left_anti")


def check_refs(layout: Layout) -> Layout:
    """The same layout, whose references raise when one leads nowhere."""
    known = layout.cells.select("cell_id", F.lit(True).alias("known"))
    ok = F.when(F.col("known"), F.col("cell_id")).otherwise(F.raise_error(F.format_string("reference %d: no cell %d", "ref_id", "cell_id")).cast("long"))
    refs = layout.refs.join(known, "cell_id", "left").withColumn("cell_id", ok).select(layout.refs.columns)
    return Layout(layout.cells, layout.polygons, refs, layout.library, layout.top)


def promote_top_polygons(layout: Layout, offset: int = PROMOTED) -> Layout:
    """Each polygon of the top cell becomes a cell of its own, placed once at the origin; the top cell keeps its copy.

    New cells are named ``polygon<poly_id>``. Ids at or over ``offset`` are taken as they are, others get it added,
    so parts and placed cells must stay below.
    """
    top = top_id(layout)
    own = layout.polygons.where(F.col("cell_id") == top)
    new = F.when(F.col("poly_id") >= offset, F.col("poly_id")).otherwise(F.col("poly_id") + offset)
    cells = own.select(new.alias("cell_id"), F.concat(F.lit("polygon"), F.col("poly_id").cast("string")).alias("cell_name"))
    refs = own.select(new.alias("ref_id"), F.lit(top).cast("long").alias("parent_cell_id"), new.alias("cell_id"), F.lit(0).cast("long").alias("rx"), F.lit(0).cast("long").alias("ry"), F.lit(False).alias("is_reflected"), F.lit(False).alias("is_magnified"), F.lit(False).alias("is_rotated"), F.lit(1.0).alias("mag"), F.lit(0.0).alias("angle"))
    return Layout(
        layout.cells.unionByName(cells, allowMissingColumns=True),
        layout.polygons.union(own.withColumn("cell_id", new).select(layout.polygons.columns)),
        layout.refs.unionByName(refs),
        layout.library,
        top,
    )


# -- layers ----------------------------------------------------------------


def cell_layers(layout: Layout) -> DataFrame:
    """cell_id, layer: which layers a cell has polygons on; any layer number."""
    return layout.polygons.select("cell_id", "layer").distinct()


def cells_on(layout: Layout, *layers: int) -> DataFrame:
    """cell_id of cells with a polygon on any of the layers."""
    return layout.polygons.where(F.col("layer").isin(*layers)).select("cell_id").distinct()


def refs_on(layout: Layout, *layers: int) -> DataFrame:
    """Top-level references whose cell touches any of the layers."""
    return top_refs(layout).join(cells_on(layout, *layers), "cell_id", "left_semi")


def refs_on_but_not(layout: Layout, layer: int, without: int) -> DataFrame:
    return refs_on(layout, layer).join(cells_on(layout, without), "cell_id", "left_anti")


def elements_on_layer(layout: Layout, layer: int) -> DataFrame:
    return layout.polygons.where(F.col("layer") == layer)


def count_elements(layout: Layout) -> DataFrame:
    """cell_id, layer, n_elements."""
    return layout.polygons.groupBy("cell_id", "layer").agg(F.count("*").alias("n_elements"))


def count_objects(layout: Layout) -> DataFrame:
    """cell_id, n_layers, n_elements, n_refs, n_objects of every cell."""
    elements = layout.polygons.groupBy("cell_id").agg(F.count_distinct("layer").alias("n_layers"), F.count("*").alias("n_elements"))
    met = layout.cells.select("cell_id").join(elements, "cell_id", "left").join(reference_counts(layout), "cell_id", "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_layers", "n_elements", "n_refs")}
    return met.select("cell_id", *(v.alias(c) for c, v in n.items()), (n["n_elements"] + n["n_refs"]).alias("n_objects"))


# -- boxes -----------------------------------------------------------------


def polygon_mbrs(layout: Layout) -> DataFrame:
    return layout.polygons.select("poly_id", "cell_id", "layer", *g.polygon_mbr(F.col("pts")))


def cell_mbrs(layout: Layout) -> DataFrame:
    """cell_id and the box of all its polygons, on whatever layer; cells without polygons have none."""
    boxes = polygon_mbrs(layout).groupBy("cell_id").agg(F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))
    return boxes.where("x_min IS NOT NULL")


def ref_mbrs(layout: Layout) -> DataFrame:
    """ref_id, cell_id and the box of each top-level reference."""
    moved = [(F.col(c) + F.col("rx" if c[0] == "x" else "ry")).alias(c) for c in g.BOX]
    return top_refs(layout).join(cell_mbrs(layout), "cell_id").select("ref_id", "cell_id", *moved)


# -- edges -----------------------------------------------------------------


def edges(polygons: DataFrame) -> DataFrame:
    """cell_id, poly_id, layer, seq, side, p_start, p_end, intercept of consecutive vertices."""
    each = polygons.select("cell_id", "poly_id", "layer", F.explode(g.pairs(F.col("pts"))).alias("e"))
    return each.select("cell_id", "poly_id", "layer", "e.seq", *g.edge_form(F.col("e.a"), F.col("e.b")))


def move_edges(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """The edges of each reference's cell where the reference puts them (translation only)."""
    v = g.upright(F.col("side"))
    along, across = F.when(v, F.col("ry")).otherwise(F.col("rx")), F.when(v, F.col("rx")).otherwise(F.col("ry"))
    met = edges.join(refs.select("ref_id", "cell_id", "rx", "ry"), "cell_id")
    return met.select("ref_id", "cell_id", "poly_id", "layer", "seq", "side", (F.col("p_start") + along).alias("p_start"), (F.col("p_end") + along).alias("p_end"), (F.col("intercept") + across).alias("intercept"))


def ref_edges(layout: Layout, *layers: int) -> DataFrame:
    """Edges of all top-level references, on the layers given or on all."""
    polygons = layout.polygons.where(F.col("layer").isin(*layers)) if layers else layout.polygons
    return move_edges(edges(polygons), top_refs(layout))


# -- results and flattening ------------------------------------------------

_XS, _YS = ("e1x1", "e1x2", "e2x1", "e2x2"), ("e1y1", "e1y2", "e2y1", "e2y2")


def translate_violations(violations: DataFrame, dx="rx", dy="ry") -> DataFrame:
    return violations.withColumns({c: F.col(c) + F.col(dx) for c in _XS} | {c: F.col(c) + F.col(dy) for c in _YS})


def replicate(violations: DataFrame, refs: DataFrame) -> DataFrame:
    """A cell's violations at each reference of the cell: a cell is checked once, however often it is placed."""
    return translate_violations(violations.join(refs.select("ref_id", "cell_id", "rx", "ry"), "cell_id")).drop("rx", "ry")


def flatten(layout: Layout, top: int | None = None) -> DataFrame:
    """layer, poly_id, ref_id (null for the top cell's own), pts of the whole design.

    References of references are followed, all the way down, by translation.
    A cell that holds itself is an error.
    """
    layout = layout if top is None else layout.with_top(top)
    root = top_id(layout)
    level = layout.refs.where(F.col("parent_cell_id") == root).select("ref_id", "cell_id", "rx", "ry")
    own = layout.polygons.where(F.col("cell_id") == root).select("layer", "poly_id", F.lit(None).cast("long").alias("ref_id"), "pts")
    inner = layout.refs.where(F.col("parent_cell_id") != root).select(F.col("parent_cell_id").alias("cell_id"), F.col("cell_id").alias("to"), F.col("rx").alias("dx"), F.col("ry").alias("dy"))
    out, depth, most = own, 0, layout.cells.count() if not inner.isEmpty() else 1
    while True:
        placed = layout.polygons.join(level, "cell_id")
        out = out.union(placed.select("layer", "poly_id", "ref_id", g.translate(F.col("pts"), F.col("rx"), F.col("ry")).alias("pts")))
        if most == 1:
            return out
        level = level.join(inner, "cell_id").select("ref_id", F.col("to").alias("cell_id"), (F.col("rx") + F.col("dx")).alias("rx"), (F.col("ry") + F.col("dy")).alias("ry"))
        if level.isEmpty():
            return out
        depth += 1
        if depth > most:
            raise HierarchyError("a cell holds itself")


def flatten_named(layout: Layout, name: str) -> DataFrame:
    found = layout.cells.where(F.col("cell_name") == name).select("cell_id").first()
    if found is None:
        raise HierarchyError(f"no cell named {name}")
    return flatten(layout, found[0])


def layer_sizes(flat: DataFrame) -> DataFrame:
    return flat.groupBy("layer").agg(F.count("*").alias("n_elements"))
