from dataclasses import replace

import pytest
from layouts import TOP, build, rect

from layoutcheck.errors import HierarchyError
from layoutcheck.operators import hierarchy


def test_layer_sizes_of_a_flat_cell(spark):
    layout = build(spark, {TOP: [(n, rect(0, 0, 1, 1)) for n in (1, 2, 2, 3)]}, [])
    flat = hierarchy.layer_sizes(hierarchy.flatten(layout)).collect()
    assert sorted(tuple(r) for r in flat) == [(1, 1), (2, 2), (3, 1)]


def test_counts(spark):
    layout = build(spark, {1: [(1, rect(0, 0, 1, 1)), (1, rect(0, 0, 1, 1)), (2, rect(0, 0, 1, 1))]}, [(1, 0, 0), (1, 5, 5)])
    assert sorted(tuple(r) for r in hierarchy.count_objects(layout).collect()) == [(1, 2, 3, 0, 3), (TOP, 0, 0, 2, 2)]


def test_top_cell_is_the_first_with_the_most_references(spark):
    layout = build(spark, {1: [], 2: []}, [(1, 0, 0), (2, 0, 0)], top=None, parents=[7, 5])
    assert hierarchy.top_id(layout) == 5


def test_nested_references_are_followed(spark):
    layout = build(spark, {1: [(1, rect(0, 0, 1, 1))], 2: [], 3: []}, [(2, 100, 0), (3, 10, 1), (1, 1, 2)], parents=[TOP, 2, 3])
    got = hierarchy.flatten(layout).collect()
    assert [(r["ref_id"], tuple(r["pts"][0])) for r in got] == [(0, (111, 3))]
    circle = build(spark, {1: []}, [(1, 0, 0), (1, 1, 1)], parents=[TOP, 1])
    with pytest.raises(HierarchyError):
        hierarchy.flatten(circle)


def test_promotion(spark):
    layout = hierarchy.promote_top_polygons(build(spark, {1: [(1, rect(0, 0, 1, 1))], TOP: [(2, rect(3, 3, 4, 4))]}, [(1, 0, 0)]))
    new = layout.cells.where("cell_name LIKE 'polygon%'").collect()
    assert [(r["cell_id"], r["cell_name"]) for r in new] == [(1_000_001, "polygon1")]
    assert sorted((r["ref_id"], r["x_min"], r["x_max"]) for r in hierarchy.ref_mbrs(layout).collect()) == [(0, 0, 1), (1_000_001, 3, 4)]


def test_dangling_references(spark):
    layout = build(spark, {1: []}, [(1, 0, 0), (44, 0, 0)])
    assert [r["cell_id"] for r in hierarchy.dangling_refs(layout).collect()] == [44]
    with pytest.raises(Exception, match="no cell 44"):
        hierarchy.check_refs(layout).refs.collect()


def test_empty_polygons_have_no_edges_and_no_box(spark):
    layout = build(spark, {1: [(1, [])]}, [(1, 0, 0)])
    assert hierarchy.ref_edges(layout).count() == 0
    assert hierarchy.ref_mbrs(layout).count() == 0


def test_layers_over_64(spark):
    layout = build(spark, {1: [(200, rect(0, 0, 1, 1))], 2: [(31, rect(0, 0, 1, 1))]}, [(1, 0, 0), (2, 0, 0)])
    assert [r["cell_id"] for r in hierarchy.refs_on(layout, 200).collect()] == [1]
    assert [r["cell_id"] for r in hierarchy.refs_on_but_not(layout, 31, 200).collect()] == [2]
    assert replace(layout, top=None).top is None
