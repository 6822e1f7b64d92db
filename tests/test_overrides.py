from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.operators import items, overrides

NOW = datetime(2026, 5, 1)


def over(table, *rows):
    return table(S.BOM_OVERRIDE, [
        {"parent_id": p, "component_id": c, "active": a, "bom_coef": k, "modified_at": NOW}
        for p, c, a, k in rows])


def excl(table, *ids):
    return table(S.EXCLUSION, [{"item_id": i, "modified_at": NOW} for i in ids])


def test_without_overrides_stored_values_are_untouched(spark, ctx):
    for fact in (ctx.raw_fact, ctx.model["fact_variance_order"]):
        seen = overrides.effective(
            fact, overrides.empty_overrides(spark), overrides.empty_exclusions(spark))
        assert seen.columns == fact.columns
        assert seen.exceptAll(fact).count() == 0 and fact.exceptAll(seen).count() == 0


def test_override_recomputes_only_its_row(fact_rows, table):
    fact = fact_rows([
        {"component_id": "a", "produced_qty": 10, "bom_coef": 2, "expected_qty": 20,
         "actual_qty": 15, "unit_cost": 3},
        {"component_id": "b", "produced_qty": 10, "bom_coef": 2, "expected_qty": 20,
         "actual_qty": 15, "is_uniform": False},
        {"component_id": "c", "bom_coef": None, "actual_qty": 4, "line_status": "off_bom"},
        {"component_id": "d", "expected_qty": 1}, {"component_id": "e", "expected_qty": 2}])
    rows = over(table, ("P", "a", True, 3), ("P", "b", True, 1), ("P", "c", True, 5),
                ("P", "d", False, None), ("other", "e", False, None))
    got = {r.component_id: r for r in
           overrides.effective(fact, rows, excl(table, "nobody")).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    a = got["a"]
    assert (a.bom_coef, a.expected_qty, a.variance_qty, a.variance_value) == (3, 30, 15, 45)
    assert (a.variance_pct, a.product_equivalent) == (50, 5)
    assert got["b"].variance_qty == -5 and got["b"].product_equivalent is None
    c = got["c"]
    assert (c.bom_coef, c.expected_qty, c.variance_qty, c.variance_pct) == (5, 0, -4, None)
    assert c.product_equivalent == Decimal("-0.8") and c.line_status == "off_bom"
    assert got["e"].expected_qty == 2


def test_recompute_equals_a_rebuild_with_the_other_coefficient(ctx):
    """Overriding every coefficient with itself gives the stored figures again."""
    fact = ctx.raw_fact.filter(F.col("bom_coef").isNotNull())
    same = ctx.model["dim_bom"].select(
        "parent_id", "component_id", F.lit(True).alias("active"), "bom_coef")
    again = overrides.override_coef(fact, same)
    keys = ["week_start", "parent_id", "component_id", "expected_qty", "variance_qty",
            "variance_value", "product_equivalent", "variance_pct"]
    shown = lambda df: df.select(*[
        F.col(k).cast(S.TABLES["fact_variance"].schema[k].dataType).alias(k) for k in keys])
    assert shown(again).exceptAll(shown(fact)).count() == 0


def test_exclusion_hits_both_sides(fact_rows, table):
    fact = fact_rows([{"component_id": "a"}, {"component_id": "b"}, {"parent_id": "Q"}])
    left = overrides.drop_excluded(fact, excl(table, "a", "Q")).collect()
    assert [(r.parent_id, r.component_id) for r in left] == [("P", "b")]


def test_edit_cycle(spark, table):
    excluded = overrides.exclude_items(
        overrides.empty_exclusions(spark), ["a", "b", "a"], "why", "me", NOW)
    assert excluded.count() == 2
    renewed = overrides.exclude_items(excluded, ["b"], "again", "you", NOW)
    assert {r.item_id: r.reason for r in renewed.collect()} == {"a": "why", "b": "again"}
    assert overrides.include_items(renewed, ["a", "zz"]).count() == 1
    rows = overrides.override_bom(
        overrides.empty_overrides(spark), [("P", "a")], False, None, None, None, NOW)
    rows = overrides.override_bom(rows, [("P", "a"), ("P", "b")], True, 1.5, None, None, NOW)
    assert {r.component_id: (r.active, r.bom_coef) for r in rows.collect()} == {
        "a": (True, Decimal("1.5")), "b": (True, Decimal("1.5"))}
    assert overrides.reset_bom(rows, [("P", "b")]).count() == 1
    summary = overrides.override_summary(renewed, rows).first()
    assert tuple(summary) == (2, 0, 2)
    for bad in (lambda: overrides.exclude_items(excluded, [], None, None, NOW),
                lambda: overrides.override_bom(rows, [("P", "a")], True, 0, None, None, NOW)):
        with pytest.raises(ValueError):
            bad()


def test_catalogue_states_partition_the_items(ctx):
    count = lambda **o: overrides.item_catalogue(
        ctx.model["dim_item"], ctx.model["agg_component"], ctx.excluded, **o).count()
    assert count(state="excluded") + count(state="included") == count()
    assert count(state="excluded") == ctx.excluded.count() > 0
    assert count(search="%") == 0
    with pytest.raises(ValueError):
        count(state="other")


def test_bom_lists_and_costs(table):
    bom = table(S.TABLES["dim_bom"].schema, [
        {"parent_id": p, "component_id": c, "bom_coef": k} for p, c, k in
        (("P", "a", 1), ("P", "b", 2), ("P", "x", 3), ("Q", "a", 4), ("X", "a", 9))])
    dim = table(S.TABLES["dim_item"].schema, [
        {"item_id": "a", "item_name": "A", "unit_cost": 10}, {"item_id": "b"},
        {"item_id": "P", "program": "G2"}, {"item_id": "Q", "program": "G1"}])
    rows, gone = over(table, ("P", "b", False, None), ("Q", "a", True, 6)), excl(table, "x", "X")
    assert [r.component_id for r in items.bom_of_parent(bom, dim, rows, gone, "P").collect()] == ["a"]
    used = items.parents_of_component(bom, dim, rows, gone, "a").collect()
    assert [(r.parent_id, float(r.bom_coef), r.coef_overridden) for r in used] == [
        ("Q", 6, True), ("P", 1, False)]
    cost = {r.parent_id: r.material_cost for r in items.material_cost(bom, dim, rows, gone).collect()}
    assert cost == {"P": 10, "Q": 60, "X": 90}
    span = {r.component_id: (r.coef_min, r.coef_max)
            for r in items.coef_range(bom, rows, gone).collect()}
    assert span["a"] == (1, 6)
    assert items.item_card(dim, "a").first().item_name == "A"


