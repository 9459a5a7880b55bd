import logging

import pytest
from layouts import TOP, build, rect

from layoutcheck.errors import LayoutError, OpenFileError
from layoutcheck.operators import checks, compare
from layoutcheck.sources import layout as layouts
from layoutcheck.sources import violations as v
from layoutcheck.utility import Timer, logger

SCHEMA = ", ".join(f"{c} long" for c in v.EDGES)
A = (15, 0, 15, 10, 10, 0, 10, 10)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def outcome(df):
    return {(r["side"], r["status"]): r["n"] for r in df.groupBy("side", "status").sum("n").withColumnRenamed("sum(n)", "n").collect()}


def test_exact_comparison_counts_bags(spark):
    got = compare.exact(frame(spark, A, A, A), frame(spark, A, A[:7] + (11,))).collect()
    assert sorted((r["side"], r["n"]) for r in got) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize(
    ("other", "hit"),
    [
        (A, True),
        ((10, 0, 10, 10, 15, 0, 15, 10), True),
        ((16, 0, 16, 10, 11, 0, 11, 10), True),
        ((17, 0, 17, 10, 10, 0, 10, 10), False),
        ((15, 10, 15, 20, 10, 10, 10, 20), True),
        ((15, 11, 15, 20, 10, 11, 10, 20), False),
        ((15, 10, 15, 0, 10, 10, 10, 0), True),
    ],
)
def test_tolerant_match(spark, other, hit):
    got = outcome(compare.match(frame(spark, A), frame(spark, other)))
    assert got == ({("a", "matched"): 1, ("b", "matched"): 1} if hit else {("a", "missing"): 1, ("b", "missing"): 1})


def test_matches_are_one_to_one(spark):
    near = tuple(x + 1 for x in A)
    assert outcome(compare.match(frame(spark, A, A, near), frame(spark, A, near))) == {("a", "matched"): 2, ("a", "missing"): 1, ("b", "matched"): 2}


def test_text_files(spark, tmp_path):
    layout = build(spark, {1: [(19, rect(0, 0, 10, 10))]}, [(1, 0, 0), (1, 15, 0)])
    found = checks.space_check(layout, [19], 18).unionByName(checks.area_check(layout, 19, 101))
    v.write_text(found, str(tmp_path / "out"))
    back = v.read_text(spark, str(tmp_path / "out"))
    assert [tuple(r[c] for c in v.EDGES) for r in back.collect()] == [A]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for name in ("a/x.txt", "a/y.txt", "b/x.txt"):
        (tmp_path / name).write_text("1 2 3 4 5 6 7 8\n")
    pairs = v.result_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    assert sorted((r["file"], r["in_first"], r["in_second"]) for r in pairs) == [("x", True, True), ("y", True, False)]
    assert v.read_text(spark, str(tmp_path / "a")).where("file = 'y'").count() == 1
    with pytest.raises(OpenFileError):
        v.read_text(spark, str(tmp_path / "none")).count()


def test_layouts_as_parquet(spark, tmp_path):
    layout = build(spark, {1: [(19, rect(0, 0, 10, 10)), (20, rect(0, 0, 3, 3))]}, [(1, 0, 0)])
    layouts.write_parquet(layout, str(tmp_path / "l"))
    back = layouts.read_parquet(spark, str(tmp_path / "l"), top=TOP)
    assert checks.area_check(back, 20, 10).count() == 1
    with pytest.raises(OpenFileError):
        layouts.read_parquet(spark, str(tmp_path / "none"))
    with pytest.raises(LayoutError):
        layouts.make(layout.cells.drop("cell_id"), layout.polygons, layout.refs)


def test_logger_and_timer(tmp_path):
    log = logger("t", tmp_path / "log", console=True, level="info", colour=True)
    with Timer("work", log) as t:
        pass
    log.debug("unseen")
    log.warning("seen %d", 3)
    logging.shutdown([])
    text = (tmp_path / "log").read_text()
    assert "work" in text and "seen 3" in text and "unseen" not in text
    before = t.elapsed()
    t.start()
    t.pause()
    assert t.elapsed() >= before
    t.reset()
    assert t.elapsed() == 0
