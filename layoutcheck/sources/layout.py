"""The data model: a library, cells with polygons, and references that place cells in cells."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutcheck.errors import HierarchyError, OpenFileError
from layoutcheck.functions.geometry import POINTS

TIME = "STRUCT<year: INT, month: INT, day: INT, hour: INT, minute: INT, second: INT>"
LIBRARY = f"file STRING, version INT, name STRING, mtime {TIME}, atime {TIME}, dbu_in_user_unit DOUBLE, dbu_in_meter DOUBLE"
CELLS = f"cell_id BIGINT, cell_name STRING, mtime {TIME}, atime {TIME}"
POLYGONS = f"poly_id BIGINT, cell_id BIGINT, layer INT, datatype INT, pts {POINTS}"
REFS = "ref_id BIGINT, parent_cell_id BIGINT, cell_id BIGINT, rx BIGINT, ry BIGINT, is_reflected BOOLEAN, is_magnified BOOLEAN, is_rotated BOOLEAN, mag DOUBLE, angle DOUBLE"
SCHEMAS = {"library": LIBRARY, "cells": CELLS, "polygons": POLYGONS, "refs": REFS}

_REF_DEFAULTS = {"is_reflected": False, "is_magnified": False, "is_rotated": False, "mag": 1.0, "angle": 0.0}


@dataclass(frozen=True)
class Layout:
    """Tables of one design; ``top`` is the top cell's id, or None to take the cell with the most references."""

    cells: DataFrame
    polygons: DataFrame
    refs: DataFrame
    library: DataFrame | None = None
    top: int | None = None

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    def with_top(self, top: int | None) -> "Layout":
        return replace(self, top=top)

    def cache(self) -> "Layout":
        """Keeps the tables for a deck of rules."""
        return replace(self, cells=self.cells.persist(), polygons=self.polygons.persist(), refs=self.refs.persist())

    def release(self) -> None:
        for df in (self.cells, self.polygons, self.refs):
            df.unpersist()


def conform(df: DataFrame, kind: str) -> DataFrame:
    """The columns of the schema named, absent optional ones filled; raises for absent required ones."""
    optional = {"cells": {"mtime", "atime"}, "polygons": {"datatype"}, "refs": set(_REF_DEFAULTS), "library": set()}[kind]
    want = df.sparkSession.createDataFrame([], SCHEMAS[kind]).schema
    absent = [f.name for f in want if f.name not in df.columns and f.name not in optional]
    if absent:
        raise HierarchyError(f"{kind}: no column {', '.join(absent)}")
    fill = lambda f: F.col(f.name) if f.name in df.columns else F.lit(_REF_DEFAULTS.get(f.name))
    return df.select(*(fill(f).cast(f.dataType).alias(f.name) for f in want))


def make(cells: DataFrame, polygons: DataFrame, refs: DataFrame, library: DataFrame | None = None, top: int | None = None) -> Layout:
    return Layout(conform(cells, "cells"), conform(polygons, "polygons"), conform(refs, "refs"), library and conform(library, "library"), top)


def read_parquet(spark: SparkSession, path: str, top: int | None = None) -> Layout:
    """A layout from ``path``/cells, /polygons (maybe partitioned by layer), /refs and /library."""
    try:
        tables = {k: spark.read.parquet(f"{path}/{k}") for k in ("cells", "polygons", "refs")}
    except Exception as e:
        raise OpenFileError(path, str(e).splitlines()[0]) from e
    try:
        tables["library"] = spark.read.parquet(f"{path}/library")
    except Exception:  # noqa: BLE001  a layout needs none
        tables["library"] = None
    return make(tables["cells"], tables["polygons"], tables["refs"], tables["library"], top)


def write_parquet(layout: Layout, path: str, mode: str = "errorifexists") -> None:
    """Polygons are partitioned by layer, so a rule reads its own layers only."""
    layout.cells.write.mode(mode).parquet(f"{path}/cells")
    layout.polygons.repartition("layer", "cell_id").sortWithinPartitions("cell_id").write.mode(mode).partitionBy("layer").parquet(f"{path}/polygons")
    layout.refs.write.mode(mode).parquet(f"{path}/refs")
    if layout.library is not None:
        layout.library.write.mode(mode).parquet(f"{path}/library")
