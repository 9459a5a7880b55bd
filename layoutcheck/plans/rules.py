"""Rules as values, and decks of rules as one plan.

    deck = [layer(19).spacing().greater_than(18), layer(19).width().greater_than(18),
            layer(19).with_layer(21).enclosure().greater_than(18), polygons().area().greater_than(900)]
    violations = run_deck(layout, deck)
"""

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutcheck.errors import NotImplementedRule, RuleError
from layoutcheck.operators import checks, hierarchy
from layoutcheck.sources.layout import Layout

# The kinds of rules by number.
KINDS = (
    "enclosure", "spacing_both", "spacing_h_edge", "spacing_v_edge", "spacing_corner", "spacing_center", "spacing_tip", "spacing_lup",
    "extension", "geometry", "length", "lup", "overlap", "recommend", "area", "sram", "width", "aux_not_bend", "aux_is_rectilinear", "aux_ensure",
)
OBJECTS = ("polygon", "cell", "both")
_ORIENTATIONS = {"spacing_both": "both", "spacing_h_edge": "h", "spacing_v_edge": "v"}
CODED = (*_ORIENTATIONS, "width", "enclosure", "area", "aux_is_rectilinear")


@dataclass(frozen=True)
class Rule:
    """Every method gives a new rule. ``more_layers`` are further operand layers: the via of an enclosure."""

    layers: tuple[int, ...] = ()
    kind: str | None = None
    minimum: int | None = None
    object: str = "both"
    inside: tuple[int, ...] = ()
    outside: tuple[int, ...] = ()
    name: str = field(default="", compare=False)

    def with_layer(self, n: int) -> "Rule":
        return replace(self, layers=(*self.layers, n))

    def inter_layer(self, n: int) -> "Rule":
        return replace(self, inside=(*self.inside, n))

    def not_inter_layer(self, n: int) -> "Rule":
        return replace(self, outside=(*self.outside, n))

    def of_kind(self, kind: str) -> "Rule":
        if kind not in KINDS:
            raise RuleError(f"no rule kind {kind}")
        return replace(self, kind=kind)

    def width(self) -> "Rule":
        return self.of_kind("width")

    def spacing(self, orientation: str = "both") -> "Rule":
        return self.of_kind({v: k for k, v in _ORIENTATIONS.items()}[orientation])

    def enclosure(self) -> "Rule":
        return self.of_kind("enclosure")

    def area(self) -> "Rule":
        return self.of_kind("area")

    def is_rectilinear(self) -> "Rule":
        return self.of_kind("aux_is_rectilinear")

    def greater_than(self, minimum: int) -> "Rule":
        """Ends a rule: values below the minimum are violations."""
        return replace(self, minimum=minimum)

    def named(self, name: str) -> "Rule":
        return replace(self, name=name)


def layer(n: int) -> Rule:
    return Rule(layers=(n,))


def polygons() -> Rule:
    """A rule over polygons of all layers."""
    return Rule(object="polygon")


def rules(items: Sequence[Rule]) -> list[Rule]:
    """A checked deck."""
    for rule in items:
        verify(rule)
    return list(items)


def verify(rule: Rule) -> Rule:
    """Raises for a rule that would be ignored in part or that has no check."""
    if rule.kind is None:
        raise RuleError("a rule needs a kind: width, spacing, enclosure, area or is_rectilinear")
    if rule.inside or rule.outside:
        raise RuleError("inter_layer and not_inter_layer have no effect on any check")
    if rule.kind not in CODED:
        raise NotImplementedRule(f"{rule.kind}: no check")
    if rule.kind != "aux_is_rectilinear" and rule.minimum is None:
        raise RuleError(f"{rule.kind}: no greater_than")
    if not rule.layers and rule.kind not in ("area", "aux_is_rectilinear"):
        raise RuleError(f"{rule.kind}: no layer")
    if rule.kind == "enclosure" and len(rule.layers) != 2:
        raise RuleError("enclosure: a metal layer and, by with_layer, a via layer")
    return rule


def run(layout: Layout, rule: Rule, edges: DataFrame | None = None) -> DataFrame:
    """The rule's violations. edges: those of the layout's polygons, if they are there already."""
    verify(rule)
    first = rule.layers[0] if rule.layers else None
    if rule.kind in _ORIENTATIONS:
        return checks.space_check(layout, rule.layers, rule.minimum, _ORIENTATIONS[rule.kind], edges=edges)
    if rule.kind == "width":
        return checks.width_check(layout, first, rule.minimum, edges=edges)
    if rule.kind == "enclosure":
        return checks.enclosure_check(layout, rule.layers[0], rule.layers[1], rule.minimum, edges=edges)
    if rule.kind == "area":
        return checks.area_check(layout, first, rule.minimum)
    return checks.rectilinear_check(layout, first)


def run_deck(layout: Layout, deck: Sequence[Rule]) -> DataFrame:
    """rule_id (from 0) and the violations of all rules, one plan.

    Edges of the layers that rules compare are derived once and kept for all of them.
    """
    layers = sorted({n for rule in rules(deck) if rule.kind in _ORIENTATIONS or rule.kind in ("width", "enclosure") for n in rule.layers})
    edges = hierarchy.edges(layout.polygons.where(F.col("layer").isin(*layers))).persist() if layers else None
    found = [run(layout, rule, edges).select(F.lit(i).alias("rule_id"), *checks.COLUMNS) for i, rule in enumerate(rules(deck))]
    if not found:
        raise RuleError("an empty deck")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def counts_by_rule(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule_id", "kind").agg(F.count("*").alias("n"))


def report(violations: DataFrame, deck: Sequence[Rule]) -> list[str]:
    """Lines with each rule's count and the count of its kind so far; prints them."""
    found = {r["rule_id"]: r["n"] for r in counts_by_rule(violations).collect()}
    total: dict[str, int] = {}
    lines = []
    for i, rule in enumerate(deck):
        total[rule.kind] = total.get(rule.kind, 0) + found.get(i, 0)
        lines.append(f"{rule.name or f'rule {i}'}: {rule.kind}: {found.get(i, 0)} violations, {total[rule.kind]} of this kind so far")
    print(*lines, sep="\n")
    return lines
