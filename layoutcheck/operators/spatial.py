"""Range queries over boxes: by a filter for one box, by a grid join for many."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutcheck.functions import geometry as g
from layoutcheck.operators import join as joins


def query(df: DataFrame, x_min: int, x_max: int, y_min: int, y_max: int) -> DataFrame:
    """Rows whose box overlaps the given one; touching is no overlap."""
    return df.where(g.mbr_overlap(g.box_columns(), [F.lit(v) for v in (x_min, x_max, y_min, y_max)]))


def join(a: DataFrame, b: DataFrame, tile: int = 4 * joins.TILE) -> DataFrame:
    """Pairs of overlapping boxes, columns as a_* and b_*."""
    return joins.box_overlap(a, b, strict=True, tile=tile)


def overlapping(boxes: DataFrame, key: str, tile: int = 4 * joins.TILE) -> DataFrame:
    """Pairs within one table, each once, the smaller key first."""
    return joins.box_overlap(boxes, boxes, strict=True, tile=tile, apart=F.col(f"a_{key}") < F.col(f"b_{key}"))
