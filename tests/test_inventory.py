from __future__ import annotations

from datetime import date

import pytest

from bomdrift import schemas as S
from bomdrift.operators import inventory

W = [date(2026, 3, 30), date(2026, 4, 6), date(2026, 4, 13)]


def test_window_floors_to_monday_and_leaves_the_upper_week_out(fact_rows):
    fact = fact_rows([{"week_start": w, "expected_qty": n, "parent_line": l} for w, n, l in
                      ((W[0], 1, "L"), (W[1], 10, "M"), (W[2], 100, "L"))])
    row = inventory.component_window(fact, date(2026, 4, 1), date(2026, 4, 18)).first()
    assert (row.net_variance, row.period_from, row.period_to) == (11, W[0], W[2])
    only = inventory.component_window(fact, W[0], date(2026, 5, 1), items=["X"], lines=["L"])
    assert only.first().net_variance == 101
    assert inventory.component_window(fact, W[0], W[2], items=[]).count() == 0


def test_hand_made_counts(fact_rows, table):
    gaps = {"explained": 42, "over": 26, "worse": -30}
    fact = fact_rows([{"component_id": i, "expected_qty": max(g, 0), "actual_qty": max(-g, 0)}
                      for i, g in gaps.items()])
    frozen = inventory.as_frozen(inventory.component_window(fact, W[0], W[1]), 7)
    counts = table(S.COUNTS, [
        {"campaign_id": 7, "item_id": i, "qty_erp": e, "qty_counted": c} for i, e, c in
        (("explained", 1200, 1150), ("over", 800, 790), ("worse", 1200, 1150), ("none", 640, 618))])
    rows = inventory.reconcile_counts(counts, frozen)
    got = {r.item_id: (r.net_count_variance, r.explained_qty, r.residual_qty,
                       None if r.explanation_rate is None else round(r.explanation_rate, 4))
           for r in rows.collect()}
    assert got == {"explained": (-50, -42, -8, 0.84), "over": (-10, -26, 16, -0.6),
                   "worse": (-50, 30, -80, -0.6), "none": (-22, None, None, None)}
    items = table(S.TABLES["dim_item"].schema, [
        {"item_id": "explained", "unit_cost": 1}, {"item_id": "over", "unit_cost": 5}])
    total = inventory.campaign_summary(rows, items).first()
    assert (total.item_count, total.unmeasured_count, total.uncosted_count) == (4, 1, 2)
    assert total.explained_share == pytest.approx(1 - (8 + 80) / (50 + 50))


def test_zero_net_has_no_rate(spark):
    df = spark.createDataFrame([(0.0, 5.0)], "n double, r double")
    assert df.select(inventory.explanation_rate(df.n, df.r)).first()[0] is None


def test_freeze_is_idempotent_and_refused_once_closed(fact_rows):
    fact = fact_rows([{"component_id": c, "week_start": w, "expected_qty": 1}
                      for c, w in (("a", W[0]), ("b", W[0]), ("a", W[1]))])
    both = inventory.component_window(fact, W[0], W[1])
    one = inventory.component_window(fact, W[1], W[2])
    table = inventory.freeze(inventory.as_frozen(both, 1), both, 2)
    again = inventory.freeze(inventory.freeze(table, one, 1), one, 1)
    assert sorted((r.campaign_id, r.item_id) for r in again.collect()) == [
        (1, "a"), (2, "a"), (2, "b")]
    with pytest.raises(ValueError):
        inventory.freeze(table, one, 1, closed=True)


def test_incomplete_period(fact_rows):
    fact = fact_rows([{"week_start": W[0]}])
    assert inventory.incomplete_period(fact, date(2026, 3, 29)).first().incomplete
    assert not inventory.incomplete_period(fact, date(2026, 4, 1)).first().incomplete
