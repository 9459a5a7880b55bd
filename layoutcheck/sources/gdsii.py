"""Stream files (GDSII) as layouts.

A file is a sequence of records that only reads from the front, so a task frames
a file at a time and many files read in parallel. What comes out of Python are
finished rows: a library row a file, cells, polygons and references by name.
Names become ids by a join, so a cell may be placed before it is defined.
"""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutcheck.errors import InvalidFileError, OpenFileError
from layoutcheck.functions import decode as d
from layoutcheck.sources.layout import Layout, make

# Fixed values of the stream format: the data type of each record, and the element a record may stand in.
_DATA = {
    "no_data": "ENDLIB ENDSTR BOUNDARY PATH SREF AREF TEXT ENDEL NODE BOX",
    "int16": "HEADER BGNLIB BGNSTR LAYER DATATYPE COLROW PATHTYPE NODETYPE BOXTYPE",
    "int32": "WIDTH XY BGNEXTN ENDEXTN",
    "real64": "UNITS MAG ANGLE",
    "ascii_string": "LIBNAME STRNAME SNAME",
    "bit_array": "STRANS",
}
EXPECTED = {name: d.DATA_NUMBERS[kind] for kind, names in _DATA.items() for name in names.split()}
ONLY_IN = {"WIDTH": "PATH", "PATHTYPE": "PATH", "BGNEXTN": "PATH", "ENDEXTN": "PATH", "COLROW": "AREF", "NODETYPE": "NODE", "BOXTYPE": "BOX"}
ELEMENTS = ("BOUNDARY", "PATH", "SREF", "AREF", "NODE", "BOX", "TEXT")

_TIME = pa.struct([(n, pa.int32()) for n in ("year", "month", "day", "hour", "minute", "second")])
_ROW = pa.schema(
    [
        ("kind", pa.string()), ("file", pa.string()), ("seq", pa.int64()), ("cell", pa.int64()), ("name", pa.string()),
        ("version", pa.int32()), ("mtime", _TIME), ("atime", _TIME), ("unit", pa.float64()), ("meter", pa.float64()),
        ("layer", pa.int32()), ("datatype", pa.int32()), ("pts", pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))),
        ("rx", pa.int64()), ("ry", pa.int64()), ("is_reflected", pa.bool_()), ("is_magnified", pa.bool_()), ("is_rotated", pa.bool_()), ("mag", pa.float64()), ("angle", pa.float64()),
    ]
)
_T = "STRUCT<year: INT, month: INT, day: INT, hour: INT, minute: INT, second: INT>"
ROWS = (
    f"kind STRING, file STRING, seq BIGINT, cell BIGINT, name STRING, version INT, mtime {_T}, atime {_T}, unit DOUBLE, meter DOUBLE, layer INT, datatype INT, "
    "pts ARRAY<STRUCT<x: BIGINT, y: BIGINT>>, rx BIGINT, ry BIGINT, is_reflected BOOLEAN, is_magnified BOOLEAN, is_rotated BOOLEAN, mag DOUBLE, angle DOUBLE"
)


def records(content: bytes, file: str = "") -> Iterator[tuple[int, int, bytes]]:
    """(record type, data type, payload) up to and with ENDLIB; lengths are unsigned."""
    at = 0
    while True:
        if at + 4 > len(content):
            raise InvalidFileError(f"{file}: no ENDLIB before the end of the file")
        n, kind, data = int.from_bytes(content[at : at + 2], "big"), content[at + 2], content[at + 3]
        if n < 4 or at + n > len(content):
            raise InvalidFileError(f"{file}: a record of {n} bytes at {at}")
        yield kind, data, content[at + 4 : at + n]
        if kind == d.RECORD_NUMBERS["ENDLIB"]:
            return
        at += n


def rows(content: bytes, file: str = "") -> Iterator[dict]:
    """Library, cells, polygons and references of one file. Elements that carry no polygon here (paths, arrays, nodes, boxes, texts) are dropped."""
    library: dict = {"kind": "library", "file": file}
    cell, n_cells, n_polygons, n_refs, element, own = None, 0, 0, 0, None, {}
    for kind, data, payload in records(content, file):
        name = d.RECORD_TYPES.get(kind)
        if name is None:
            continue
        if data != EXPECTED[name]:
            raise InvalidFileError(f"{file}: {name} holds {d.DATA_TYPES.get(data, data)}, not {d.DATA_TYPES[EXPECTED[name]]}")
        if name in ONLY_IN and element != ONLY_IN[name]:
            raise InvalidFileError(f"{file}: {name} outside {ONLY_IN[name]}")
        if name == "HEADER":
            library["version"] = d.int16(payload)
        elif name == "BGNLIB":
            library |= {"mtime": d.datetime(payload), "atime": d.datetime(payload, 12)}
        elif name == "LIBNAME":
            library["name"] = d.string(payload)
        elif name == "UNITS":
            library |= {"unit": d.real64(payload[:8]), "meter": d.real64(payload[8:])}
        elif name == "BGNSTR":
            cell = {"kind": "cell", "file": file, "seq": n_cells, "cell": n_cells, "mtime": d.datetime(payload), "atime": d.datetime(payload, 12)}
            n_cells += 1
        elif name == "STRNAME":
            cell["name"] = d.string(payload)
        elif name == "ENDSTR":
            yield cell
            cell = None
        elif name in ELEMENTS:
            element, own = name, {"is_reflected": False, "is_magnified": False, "is_rotated": False, "mag": 1.0, "angle": 0.0}
        elif name == "LAYER":
            own["layer"] = d.int16(payload)
        elif name == "DATATYPE":
            own["datatype"] = d.int16(payload)
        elif name == "SNAME":
            own["name"] = d.string(payload)
        elif name == "STRANS":
            own["is_reflected"] = bool(d.bit_array(payload) >> 15 & 1)
        elif name == "MAG":
            own |= {"mag": d.real64(payload), "is_magnified": True}
        elif name == "ANGLE":
            own |= {"angle": d.real64(payload), "is_rotated": True}
        elif name == "XY":
            own["xy"] = [d.point(payload, 8 * i) for i in range(d.point_count(payload))]
        elif name == "ENDEL":
            if element == "BOUNDARY":
                yield own_row(own, "polygon", file, n_polygons, cell) | {"pts": [{"x": x, "y": y} for x, y in own.get("xy", [])]}
                n_polygons += 1
            elif element == "SREF":
                if len(own.get("xy", [])) != 1:
                    raise InvalidFileError(f"{file}: a reference at {len(own.get('xy', []))} points")
                yield own_row(own, "ref", file, n_refs, cell) | {"rx": own["xy"][0][0], "ry": own["xy"][0][1]}
                n_refs += 1
            element, own = None, {}
    yield library


def own_row(own: dict, kind: str, file: str, seq: int, cell: dict | None) -> dict:
    if cell is None:
        raise InvalidFileError(f"{file}: an element outside a cell")
    return {k: v for k, v in own.items() if k != "xy"} | {"kind": kind, "file": file, "seq": seq, "cell": cell["cell"]}


def _frame(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            held = []
            for row in rows(content.as_py() or b"", path):
                held.append(row)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_pylist(held, _ROW)
                    held = []
            yield pa.RecordBatch.from_pylist(held, _ROW)


def decode(files: DataFrame) -> DataFrame:
    """Rows of all kinds from a DataFrame of (path, content)."""
    return files.select("path", "content").mapInArrow(_frame, ROWS)


def layout(decoded: DataFrame) -> Layout:
    """Tables of decoded rows. Cell ids count on from file to file; a reference without its cell raises when it is used."""
    spread = 1 << 32
    file_id = decoded.where("kind = 'library'").select("file", F.dense_rank().over(_by("file")).alias("f"))
    decoded = decoded.join(F.broadcast(file_id), "file").withColumn("base", (F.col("f") - 1).cast("long") * spread)
    cells = decoded.where("kind = 'cell'").select((F.col("base") + F.col("cell")).alias("cell_id"), F.col("name").alias("cell_name"), "mtime", "atime", "file")
    polygons = decoded.where("kind = 'polygon'").select((F.col("base") + F.col("seq")).alias("poly_id"), (F.col("base") + F.col("cell")).alias("cell_id"), "layer", "datatype", "pts")
    placed = decoded.where("kind = 'ref'").select((F.col("base") + F.col("seq")).alias("ref_id"), (F.col("base") + F.col("cell")).alias("parent_cell_id"), "file", "name", "rx", "ry", "is_reflected", "is_magnified", "is_rotated", "mag", "angle")
    named = cells.select("file", F.col("cell_name").alias("name"), "cell_id")
    met = placed.join(named, ["file", "name"], "left")
    checked = F.when(F.col("cell_id").isNotNull(), F.col("cell_id")).otherwise(F.raise_error(F.concat(F.lit("reference to an unknown cell: "), F.col("name"))).cast("long"))
    library = decoded.where("kind = 'library'").select("file", "version", "name", "mtime", "atime", F.col("unit").alias("dbu_in_user_unit"), F.col("meter").alias("dbu_in_meter"))
    return make(cells.drop("file"), polygons, met.withColumn("cell_id", checked), library)


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # a row a file


def read(spark: SparkSession, path: str) -> Layout:
    """The layout in a file, or in all files of a directory or glob."""
    try:
        files = spark.read.format("binaryFile").load(path)
    except Exception as e:
        raise OpenFileError(path, str(e).splitlines()[0]) from e
    return layout(decode(files))


# -- writing ---------------------------------------------------------------


def record(name: str, payload: bytes = b"") -> bytes:
    if len(payload) % 2:
        payload += b"\0"
    return (len(payload) + 4).to_bytes(2, "big") + bytes((d.RECORD_NUMBERS[name], EXPECTED[name])) + payload


def _times(mtime: tuple[int, ...], atime: tuple[int, ...]) -> bytes:
    return b"".join(v.to_bytes(2, "big", signed=True) for v in (*mtime, *atime))


def _xy(pts: Iterable[tuple[int, int]]) -> bytes:
    return b"".join(v.to_bytes(4, "big", signed=True) for p in pts for v in p)


def boundary(layer: int, pts: Iterable[tuple[int, int]], datatype: int = 0) -> bytes:
    two = lambda v: v.to_bytes(2, "big", signed=True)
    return record("BOUNDARY") + record("LAYER", two(layer)) + record("DATATYPE", two(datatype)) + record("XY", _xy(pts)) + record("ENDEL")


def sref(name: str, at: tuple[int, int], reflected: bool = False, mag: float | None = None, angle: float | None = None) -> bytes:
    out = record("SREF") + record("SNAME", name.encode("latin-1"))
    if reflected or mag is not None or angle is not None:
        out += record("STRANS", (0x8000 * reflected).to_bytes(2, "big"))
    if mag is not None:
        out += record("MAG", d.encode_real64(mag))
    if angle is not None:
        out += record("ANGLE", d.encode_real64(angle))
    return out + record("XY", _xy([at])) + record("ENDEL")


def structure(name: str, elements: Iterable[bytes], mtime=(2, 2, 8, 18, 18, 28), atime=(2, 2, 8, 18, 18, 28)) -> bytes:
    return record("BGNSTR", _times(mtime, atime)) + record("STRNAME", name.encode("latin-1")) + b"".join(elements) + record("ENDSTR")


def library(structures: Iterable[bytes], name: str = "LIB.DB", version: int = 600, unit: float = 1e-3, meter: float = 1e-9, mtime=(2, 2, 8, 18, 18, 28), atime=(2, 2, 8, 18, 18, 28)) -> bytes:
    units = d.encode_real64(unit) + d.encode_real64(meter)
    head = record("HEADER", version.to_bytes(2, "big")) + record("BGNLIB", _times(mtime, atime)) + record("LIBNAME", name.encode("latin-1")) + record("UNITS", units)
    return head + b"".join(structures) + record("ENDLIB")


def encode(layout: Layout, name: str = "LIB.DB") -> DataFrame:
    """(path, content): the layout as one stream file. Each cell's bytes are made by Spark; a file is one row, so a design must fit in one."""
    cells = layout.cells.select("cell_id", "cell_name")
    shapes = layout.polygons.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("poly_id", "layer", "datatype", "pts"))).alias("shapes"))
    placed = layout.refs.join(cells.withColumnRenamed("cell_name", "target"), "cell_id").groupBy(F.col("parent_cell_id").alias("cell_id")).agg(F.array_sort(F.collect_list(F.struct("ref_id", "target", "rx", "ry", "is_reflected", "is_magnified", "is_rotated", "mag", "angle"))).alias("placed"))

    def build(batches):
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                own = [boundary(s["layer"], [(p["x"], p["y"]) for p in s["pts"]], s["datatype"] or 0) for s in c["shapes"] or []]
                own += [sref(r["target"], (r["rx"], r["ry"]), r["is_reflected"], r["mag"] if r["is_magnified"] else None, r["angle"] if r["is_rotated"] else None) for r in c["placed"] or []]
                out.append(structure(c["cell_name"], own))
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), pa.array(out, pa.binary())], ["cell_id", "bytes"])

    def join(table: pa.Table) -> pa.Table:
        parts = [b for _, b in sorted(zip(table.column("cell_id").to_pylist(), table.column("bytes").to_pylist()))]
        return pa.table({"path": [f"{name}.gds"], "content": pa.array([library(parts, name)], pa.binary())})

    bodies = cells.join(shapes, "cell_id", "left").join(placed, "cell_id", "left").mapInArrow(build, "cell_id BIGINT, bytes BINARY")
    return bodies.groupBy().applyInArrow(join, "path STRING, content BINARY")
