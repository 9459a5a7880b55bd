"""Micro layouts, threshold 18."""

import random

import pytest
from layouts import NOTCH, TOP, build, rect

from layoutcheck.errors import HierarchyError, NotImplementedRule, RuleError
from layoutcheck.operators import checks, hierarchy
from layoutcheck.plans import rules

T, METAL, VIA = 18, 19, 21
EDGES = checks.COLUMNS[1:9]


def edges(df):
    return sorted(tuple(r[c] for c in EDGES) for r in df.collect())


def two(spark, dx, dy):
    return build(spark, {1: [(METAL, rect(0, 0, 10, 10))]}, [(1, 0, 0), (1, dx, dy)])


@pytest.mark.parametrize(("dx", "dy", "n"), [(10, 0, 0), (15, 0, 1), (27, 0, 1), (28, 0, 0), (12, 12, 0), (10, 15, 0), (0, 15, 1), (0, 28, 0), (-15, 0, 1), (260, 0, 0), (0, -27, 1)])
def test_spacing_between_references(spark, dx, dy, n):
    assert checks.space_inter(two(spark, dx, dy), [METAL], T).count() == n


def test_spacing_output_and_orientation(spark):
    found = checks.space_check(two(spark, 15, 0), [METAL], T)
    assert edges(found) == [(15, 0, 15, 10, 10, 0, 10, 10)]
    assert checks.space_check(two(spark, 15, 0), [METAL], T, "h").count() == 0
    assert checks.space_check(two(spark, 15, 0), [METAL], T, "v").count() == 1
    assert checks.space_check(two(spark, 15, 0), [METAL, 77], T).count() == 1
    assert checks.space_check(two(spark, 15, 0), [77, METAL], T).count() == 0


def test_width(spark):
    layout = build(spark, {1: [(METAL, rect(0, 0, 10, 30))]}, [(1, 5, -5)])
    assert edges(checks.width_check(layout, METAL, T)) == [(15, -5, 15, 25, 5, -5, 5, 25)]
    assert checks.width_check(layout, METAL, T, "h").count() == 0


def test_notch(spark):
    layout = build(spark, {1: [(METAL, NOTCH)]}, [(1, 0, 0), (1, 1000, 0)])
    assert edges(checks.space_intra(layout, [METAL], T)) == [(20, 15, 20, 30, 10, 15, 10, 30), (1020, 15, 1020, 30, 1010, 15, 1010, 30)]
    one = build(spark, {1: [(METAL, NOTCH)]}, [(1, 0, 0)])
    assert checks.width_check(one, METAL, T, "h").count() == 1
    assert checks.width_check(one, METAL, T, "v").count() == 2


def test_area_counts_definitions(spark):
    layout = build(spark, {1: [(METAL, rect(0, 0, 10, 30))], TOP: [(METAL, NOTCH)]}, [(1, 0, 0), (1, 50, 0)])
    assert [r["poly_id"] for r in checks.area_check(layout, METAL, 301).collect()] == [0]
    assert checks.area_check(layout, METAL, 300).count() == 0
    assert checks.area_check(layout, None, 751).count() == 2


@pytest.mark.parametrize(
    ("metal", "via", "sides"),
    [
        (rect(0, 0, 40, 40), rect(10, 10, 20, 20), "DL"),
        (rect(0, 0, 40, 40), rect(0, 10, 10, 20), "D"),
        (rect(0, 0, 40, 40), rect(-5, 10, 10, 20), "D"),
        (rect(0, 15, 10, 17), rect(0, 0, 10, 10), "U"),
        (rect(0, 2, 10, 8), rect(0, 10, 10, 20), ""),
        (rect(0, 0, 40, 40), rect(25, 25, 35, 35), "RU"),
    ],
)
def test_enclosure(spark, metal, via, sides):
    layout = build(spark, {1: [(METAL, metal)], 2: [(VIA, via)]}, [(1, 300, -300), (2, 300, -300)])
    side = lambda r: ("L" if r["e1x1"] - 300 == via[0][0] else "R") if r["e1x1"] == r["e1x2"] else ("D" if r["e1y1"] + 300 == via[0][1] else "U")
    assert "".join(sorted(side(r) for r in checks.enclosure_check(layout, METAL, VIA, T).collect())) == sides


def test_a_cell_with_metal_and_via_counts_as_metal(spark):
    layout = build(spark, {1: [(METAL, rect(0, 0, 40, 40)), (VIA, rect(10, 10, 20, 20))]}, [(1, 0, 0)])
    assert checks.enclosure_check(layout, METAL, VIA, T).count() == 0


def test_reuse_counts(spark):
    box = rect(0, 0, 1, 1)
    layout = build(spark, {1: [(1, box), (1, box), (2, box)], 2: [(1, box)], 3: [(3, box)]}, [(1, 0, 0), (1, 5, 5), (2, 9, 9), (1, 2, 2)], parents=[TOP, TOP, TOP, 2])
    assert sorted(tuple(r) for r in checks.reuse_counts(layout).collect()) == [(1, 3, 7), (2, 1, 3), (3, 1, 0)]
    assert checks.reuse_counts(build(spark, {1: []}, [(1, 0, 0)])).collect() == []


def test_rectilinear(spark):
    layout = build(spark, {1: [(METAL, NOTCH), (METAL, [(0, 0), (5, 5), (5, 0), (0, 0)])]}, [(1, 0, 0)])
    assert [r["poly_id"] for r in checks.rectilinear_check(layout, METAL).collect()] == [1]


def test_no_references_no_violations_but_areas(spark):
    layout = build(spark, {1: [(METAL, rect(0, 0, 10, 10))]}, [(1, 0, 0)])
    alone = layout.refs.where("false")
    from dataclasses import replace

    assert checks.space_check(replace(layout, refs=alone), [METAL], T).count() == 0
    assert checks.area_check(replace(layout, refs=alone), METAL, 101).count() == 1
    with pytest.raises(HierarchyError):
        hierarchy.top_id(replace(layout, refs=alone, top=None))


def _random(spark, seed, dx=0, dy=0, layer=METAL):
    r = random.Random(seed)
    cells = {c: [(layer, rect(x, y, x + r.randint(3, 400), y + r.randint(3, 60))) for x, y in [(r.randint(-500, 500), r.randint(-90, 90)) for _ in range(4)]] for c in range(1, 6)}
    refs = [(r.randint(1, 5), r.randint(-900, 900) + dx, r.randint(-900, 900) + dy) for _ in range(25)]
    return build(spark, cells, refs), cells, refs


def _brute(cells, refs, t):
    """Spacing by comparing all edges with all."""
    placed = []
    for k, (c, x, y) in enumerate(refs):
        for _, pts in cells[c]:
            (x0, y0), (x1, y1) = pts[0], pts[2]
            placed += [(k, "L", y0 + y, y1 + y, x0 + x), (k, "R", y0 + y, y1 + y, x1 + x), (k, "D", x0 + x, x1 + x, y0 + y), (k, "U", x0 + x, x1 + x, y1 + y)]
    n = 0
    for a in placed:
        for b in placed:
            if a[1] + b[1] in ("DU", "LR") and 0 < a[4] - b[4] < t and a[2] < b[3] and b[2] < a[3]:
                n += 1
    return n


@pytest.mark.parametrize("seed", [1, 2])
def test_spacing_is_the_brute_force_and_does_not_depend_on_tiles_or_place(spark, seed):
    layout, cells, refs = _random(spark, seed)
    want = _brute(cells, refs, T)
    assert want > 0
    for tile in (18, 64, 1024):
        assert checks.space_check(layout, [METAL], T, tile=tile).count() == want
    moved = _random(spark, seed, -12345, 54321)[0]
    assert checks.space_check(moved, [METAL], T).count() == want
    assert checks.space_check(_random(spark, seed, layer=70)[0], [70], T).count() == want


def test_edges_cross_tile_borders_once(spark):
    layout = build(spark, {1: [(METAL, rect(-1000, 0, 1000, 10))]}, [(1, 0, 0), (1, 0, 15)])
    assert edges(checks.space_inter(layout, [METAL], T)) == [(-1000, 15, 1000, 15, -1000, 10, 1000, 10)]


def test_rules_are_checked_before_they_run(spark):
    layout = two(spark, 15, 0)
    for bad in (rules.layer(19).greater_than(5), rules.layer(19).width(), rules.layer(19).inter_layer(2).width().greater_than(5), rules.layer(19).not_inter_layer(2).width().greater_than(5), rules.layer(19).enclosure().greater_than(5), rules.polygons().width().greater_than(5)):
        with pytest.raises(RuleError):
            rules.run(layout, bad)
    with pytest.raises(NotImplementedRule):
        rules.run(layout, rules.layer(19).of_kind("overlap").greater_than(5))
    assert len(rules.KINDS) == 20


def test_deck(spark, capsys):
    layout = two(spark, 15, 0)
    deck = rules.rules([rules.layer(METAL).spacing().greater_than(T), rules.layer(METAL).width().greater_than(T), rules.polygons().area().greater_than(101), rules.layer(METAL).is_rectilinear(), rules.layer(METAL).spacing("h").greater_than(T)])
    found = rules.run_deck(layout, deck)
    assert {(r["rule_id"], r["kind"]): r["n"] for r in rules.counts_by_rule(found).collect()} == {(0, "spacing"): 1, (1, "width"): 4, (2, "area"): 1}
    rules.report(found, deck)
    assert "rule 0: spacing_both: 1 violations" in capsys.readouterr().out
