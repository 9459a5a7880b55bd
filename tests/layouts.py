"""Small layouts by hand."""

from layoutcheck.sources.layout import make

TOP = 100


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]


NOTCH = [(0, 0), (0, 30), (10, 30), (10, 15), (20, 15), (20, 30), (30, 30), (30, 0), (0, 0)]


def build(spark, cells: dict[int, list[tuple[int, list]]], refs: list[tuple[int, int, int]], top=TOP, parents=None):
    """cells: id -> [(layer, points)]; refs: (cell, x, y) in the top cell."""
    from layoutcheck.functions.geometry import POINTS

    named = [(c, f"c{c}") for c in sorted({*cells, TOP})]
    polygons = [(i, c, layer, pts) for i, (c, layer, pts) in enumerate((c, layer, pts) for c, own in cells.items() for layer, pts in own)]
    parents = parents or [TOP] * len(refs)
    return make(
        spark.createDataFrame(named, "cell_id long, cell_name string"),
        spark.createDataFrame(polygons, f"poly_id long, cell_id long, layer int, pts {POINTS}"),
        spark.createDataFrame([(i, p, c, x, y) for i, (p, (c, x, y)) in enumerate(zip(parents, refs))], "ref_id long, parent_cell_id long, cell_id long, rx long, ry long"),
        top=top,
    )
