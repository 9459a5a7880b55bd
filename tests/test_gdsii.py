import pytest
from layouts import NOTCH, build, rect
from pyspark.sql import functions as F

from layoutcheck.errors import InvalidFileError, OpenFileError
from layoutcheck.functions import decode as d
from layoutcheck.sources import gdsii

REALS = {
    "4110": 1, "4120": 2, "4130": 3, "c110": -1, "c120": -2, "c130": -3, "4080": 0.5, "40999999": 0.6, "40b33333": 0.7, "4118": 1.5, "41199999": 1.6, "411b3333": 1.7,
    "00": 0, "41a0": 10, "4264": 100, "433e80": 1000, "442710": 10000, "45186a": 100000, "3d68db8bac710cb4": 1e-4, "386df37f675ef6ec": 1e-10,
}


def test_integers_bits_strings_and_times():
    assert [d.int16(bytes.fromhex(h)) for h in ("0001", "0002", "0089", "ffff", "ff77")] == [1, 2, 137, -1, -137]
    assert [d.int32(bytes.fromhex(h)) for h in ("00000001", "00000002", "00000089", "ffffffff", "fffffffe", "ffffff77")] == [1, 2, 137, -1, -2, -137]
    assert [[i for i in range(16) if d.bit_array(bytes.fromhex(h)) >> i & 1] for h in ("0001", "0005", "8000")] == [[0], [0, 2], [15]]
    assert [d.string(b) for b in (b"hello world", b"hello world\0", b"", b"\0", b"a\0\0")] == ["hello world", "hello world", "", "", "a\0"]
    assert d.datetime(bytes([0, 2, 0, 2, 0, 8, 0, 18, 0, 18, 0, 28])) == {"year": 2, "month": 2, "day": 8, "hour": 18, "minute": 18, "second": 28}


@pytest.mark.parametrize(("raw", "value"), REALS.items())
def test_reals(raw, value):
    assert d.real64(bytes.fromhex(raw)) == pytest.approx(value, rel=1e-6)
    assert d.real64(d.encode_real64(value)) == pytest.approx(value, rel=1e-12)


def test_times_as_columns(spark):
    both = bytes([0, 2, 0, 2, 0, 8, 0, 18, 0, 18, 0, 28]) + bytes([7, 200, 0, 12, 0, 31, 0, 23, 0, 59, 255, 255])
    df = spark.createDataFrame([(bytearray(both),), (None,)], "b binary")
    found = df.select(d.datetime_col(F.col("b")).alias("m"), d.datetime_col(F.col("b"), 12).alias("a")).collect()
    assert (found[0]["m"].asDict(), found[0]["a"].asDict()) == (d.datetime(both), d.datetime(both, 12))
    assert set(found[1]["m"]) == {None}


def test_the_same_as_columns(spark):
    raw = [bytes.fromhex(h) for h in REALS]
    df = spark.createDataFrame([(bytearray(b.ljust(8, b"\0")), v) for b, v in zip(raw, map(float, REALS.values()))], "b binary, v double")
    for r in df.select(d.real64_col(F.col("b")).alias("a"), "v", d.int16_col(F.col("b")).alias("s"), d.int32_col(F.col("b")).alias("i"), "b", d.bit_col(F.col("b"), 14).alias("bit")).collect():
        assert r["a"] == pytest.approx(r["v"], rel=1e-6)
        assert (r["s"], r["i"], r["bit"]) == (d.int16(r["b"]), d.int32(r["b"]), bool(d.bit_array(r["b"]) >> 14 & 1))
    names = spark.createDataFrame([(0,), (0x10,), (0x99,)], "c int").select(d.record_name(F.col("c")).alias("n"), d.data_type_name(F.col("c")).alias("t")).collect()
    assert [tuple(r) for r in names] == [("HEADER", "no_data"), ("XY", None), (None, None)]
    text = spark.createDataFrame([(bytearray(b"abc\0"),), (bytearray(b""),)], "b binary").select(d.string_col(F.col("b")), d.point_count_col(F.col("b"))).collect()
    assert [tuple(r) for r in text] == [("abc", 0), ("", 0)]


def _lib(*structures, **kw):
    return gdsii.library(structures, **kw)


def test_read_a_file(spark, tmp_path):
    other = gdsii.record("PATH") + gdsii.record("LAYER", b"\0\1") + gdsii.record("WIDTH", bytes(4)) + gdsii.record("XY", bytes(16)) + gdsii.record("ENDEL")
    box = gdsii.record("BOX") + gdsii.record("LAYER", b"\0\1") + gdsii.record("BOXTYPE", b"\0\1") + gdsii.record("XY", bytes(40)) + gdsii.record("ENDEL")
    node = gdsii.record("NODE") + gdsii.record("LAYER", b"\0\1") + gdsii.record("NODETYPE", b"\0\1") + gdsii.record("XY", bytes(8)) + gdsii.record("ENDEL")
    array = gdsii.record("AREF") + gdsii.record("SNAME", b"INV2") + gdsii.record("COLROW", b"\0\2\0\2") + gdsii.record("XY", bytes(24)) + gdsii.record("ENDEL")
    unknown = b"\0\x06\x77\x02\0\1"
    content = _lib(
        gdsii.structure("TRANS", [gdsii.sref("INV2", (5, -7), reflected=True, mag=2.0, angle=90.0), gdsii.boundary(19, NOTCH, 3), other, box, node, array, unknown]),
        gdsii.structure("INV2", [gdsii.boundary(-1, rect(-5, -5, 5, 5))]),
        gdsii.structure("RINGO", []),
    )
    (tmp_path / "test.gds").write_bytes(content)
    layout = gdsii.read(spark, str(tmp_path / "test.gds"))
    lib = layout.library.first()
    assert (lib["name"], lib["version"], lib["dbu_in_user_unit"]) == ("LIB.DB", 600, pytest.approx(1e-3))
    assert lib["dbu_in_meter"] / lib["dbu_in_user_unit"] == pytest.approx(1e-6)
    assert tuple(lib["mtime"]) == tuple(lib["atime"]) == (2, 2, 8, 18, 18, 28)
    assert [r["cell_name"] for r in layout.cells.orderBy("cell_id").collect()] == ["TRANS", "INV2", "RINGO"]
    shapes = layout.polygons.orderBy("poly_id").collect()
    assert [(r["layer"], r["datatype"], [tuple(p) for p in r["pts"]]) for r in shapes] == [(19, 3, NOTCH), (-1, 0, rect(-5, -5, 5, 5))]
    ref = layout.refs.first()
    assert (ref["parent_cell_id"], ref["cell_id"], ref["rx"], ref["ry"], ref["is_reflected"], ref["mag"], ref["angle"]) == (0, 1, 5, -7, True, 2.0, 90.0)


def test_long_records_are_read(spark, tmp_path):
    pts = [(i, i % 2) for i in range(5000)]
    (tmp_path / "long.gds").write_bytes(_lib(gdsii.structure("A", [gdsii.boundary(1, pts)])))
    assert gdsii.read(spark, str(tmp_path / "long.gds")).polygons.first()["pts"][-1] == (4999, 1)


@pytest.mark.parametrize(
    "content",
    [
        _lib()[:-4],
        _lib()[:-6],
        b"\0\6\0\3\0\0" + _lib(),
        _lib(gdsii.structure("A", [gdsii.record("SREF") + gdsii.record("SNAME", b"A") + gdsii.record("XY", bytes(16)) + gdsii.record("ENDEL")])),
        _lib(gdsii.structure("A", [gdsii.record("BOUNDARY") + gdsii.record("WIDTH", bytes(4)) + gdsii.record("ENDEL")])),
        _lib(gdsii.boundary(1, NOTCH)),
        b"\0\0\0\0",
    ],
)
def test_broken_files(content):
    with pytest.raises(InvalidFileError):
        list(gdsii.rows(content, "x"))


def test_missing_file_and_unknown_cell(spark, tmp_path):
    with pytest.raises(OpenFileError):
        gdsii.read(spark, str(tmp_path / "not_exist.gds"))
    (tmp_path / "lost.gds").write_bytes(_lib(gdsii.structure("A", [gdsii.sref("B", (0, 0))])))
    with pytest.raises(Exception, match="unknown cell: B"):
        gdsii.read(spark, str(tmp_path / "lost.gds")).refs.collect()


def test_round_trip(spark):
    layout = build(spark, {1: [(19, NOTCH), (200, rect(0, 0, 5, 5))]}, [(1, -3, 4), (1, 7, 8)])
    back = gdsii.layout(gdsii.decode(gdsii.encode(layout)))
    assert sorted((r["layer"], tuple(map(tuple, r["pts"]))) for r in back.polygons.collect()) == [(19, tuple(NOTCH)), (200, tuple(rect(0, 0, 5, 5)))]
    assert sorted((r["rx"], r["ry"]) for r in back.refs.collect()) == [(-3, 4), (7, 8)]
