from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.functions import rates
from bomdrift.operators import analytics, synthesis
from bomdrift.operators.selection import Selection
from bomdrift.plans.publish import log_row

W14, W15, W16 = date(2026, 3, 30), date(2026, 4, 6), date(2026, 4, 13)


def bundle(spark, prefix="cur_", **values):
    row = dict.fromkeys(analytics.MEASURES, 0.0) | values
    return spark.createDataFrame([tuple(float(v) for v in row.values())],
                                 [prefix + k for k in row])


def kpi(df, name):
    return next(r for r in df.collect() if r.indicator == name)


def test_indicator_formulas(spark):
    rows = analytics.kpi_rows(bundle(
        spark, row_count=200, variance_row_count=50, expected_qty=1000, variance_qty=-25,
        expected_value=1000, abs_value=300, under_qty=100, over_qty=125))
    assert kpi(rows, "conformity_rate").value == 75
    assert kpi(rows, "global_pct").value == -2.5
    assert kpi(rows, "reliability").value == pytest.approx(70)
    assert kpi(rows, "net_variance").change is None
    by_qty = analytics.kpi_rows(bundle(spark, expected_qty=1000, under_qty=100, over_qty=125),
                                analytics.QUANTITY)
    assert kpi(by_qty, "reliability").value == pytest.approx(77.5)
    worst = analytics.kpi_rows(bundle(spark, expected_value=10, abs_value=50))
    assert kpi(worst, "reliability").value == 0
    empty = analytics.kpi_rows(bundle(spark))
    assert all(r.value == 0 for r in empty.collect()) and empty.count() == 8


def test_variation_bases(spark):
    rows = spark.createDataFrame([(5.0, 0.0), (5.0, -10.0), (0.0, 10.0)], "c double, p double")
    got = rows.select(*rates.variation(F.col("c"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(None, 5.0), (150.0, 15.0), (-100.0, -10.0)]


def test_kpis_compare_with_an_empty_previous_period(fact_rows):
    fact = fact_rows([{"week_start": W15, "expected_qty": 10, "actual_qty": 4}])
    rows = analytics.kpis(fact, Selection(W15, W15))
    net = kpi(rows, "net_variance")
    assert (net.value, net.change, net.change_pct) == (6, 6, None)
    assert kpi(analytics.kpis(fact, Selection(date_from=W15)), "net_variance").change is None
    none = analytics.kpis(fact, Selection(W15, W15, parents=("no",)))
    assert all(r.value == 0 for r in none.collect()) and none.count() == 8


def test_enumerated_weeks_do_not_bind_the_previous_period(fact_rows):
    fact = fact_rows([{"week_start": w, "expected_qty": 10} for w in (W14, W15)])
    rows = analytics.kpis(fact, Selection(W15, W15, weeks=(W15,)))
    assert kpi(rows, "net_variance").change == 0


def test_calendar_has_no_gap_and_is_clipped(fact_rows):
    fact = fact_rows([{"week_start": w, "parent_id": p, "expected_qty": 3}
                      for w, p in ((W14, "P"), (W16, "P"), (W16, "Q"))])
    series = analytics.weekly_series(fact, Selection(date(2026, 1, 1), date(2030, 1, 1)), fact)
    rows = series.orderBy("week_start").collect()
    assert [r.week_start for r in rows] == [W14, W15, W16]
    assert [r.row_count for r in rows] == [1, 0, 2]
    assert [r.week_label for r in rows] == ["2026-S14", "2026-S15", "2026-S16"]
    assert analytics.weekly_series(fact, Selection(parents=("no",)), fact).count() == 0
    # A selection that misses part of the history still spans the raw extent.
    assert analytics.weekly_series(fact, Selection(parents=("Q",)), fact).count() == 3
    wednesday = Selection(date_from=W14 + timedelta(days=2))
    assert analytics.week_calendar(fact, wednesday.apply(fact), wednesday).count() == 3


def test_last_week_change(fact_rows):
    fact = fact_rows([{"week_start": W14, "expected_qty": 3}, {"week_start": W16, "actual_qty": 9}])
    change = analytics.last_week_change(analytics.weekly_series(fact, Selection(), fact)).first()
    assert (change.week_start, change.last_impact, change.previous_impact) == (W16, 9, 0)
    one = analytics.weekly_series(fact.limit(1), Selection(), fact.limit(1))
    assert analytics.last_week_change(one).count() == 0


def test_rankings_and_concentration(fact_rows):
    fact = fact_rows([{"component_id": c, "expected_qty": q, "unit_cost": k, "component_category": c}
                      for c, q, k in (("a", 10, 1), ("b", 1, 100), ("c", 5, 1), ("d", 0, 1))])
    top = lambda m: [r.component_id for r in
                     analytics.top_components(fact, Selection(), 2, m).collect()]
    assert top("value") == ["b", "a"] and top("quantity") == ["a", "c"]
    share = analytics.concentration(fact, Selection(), 1).first()
    assert (share.component_count, float(share.total_impact), float(share.head_impact)) == (4, 115, 100)
    none = analytics.concentration(fact, Selection(parents=("no",)), 1).first()
    assert (none.component_count, none.head_share_pct) == (0, 0)
    labels = [r.label for r in analytics.distribution(fact, Selection(), "category", limit=500).collect()]
    assert labels == ["b", "a", "c", "d"]
    with pytest.raises(ValueError):
        analytics.distribution(fact, Selection(), "colour")
    with pytest.raises(ValueError):
        analytics.top_components(fact, Selection(), measure="weight")


def test_totals_count_production_once(fact_rows):
    fact = fact_rows([{"component_id": c, "week_start": w, "produced_qty": 7, "expected_qty": 7}
                      for c in "abc" for w in (W14, W15)])
    row = analytics.totals(fact, Selection()).first()
    assert (row.row_count, row.produced_qty, row.conformity_rate, row.variance_pct) == (6, 14, 0, 100)
    empty = analytics.totals(fact, Selection(parents=("no",))).first()
    assert (empty.row_count, empty.produced_qty, empty.conformity_rate, empty.variance_pct) == (
        0, 0, None, None)


def test_crosstab_hand_made_case(spark, fact_rows):
    made = spark.createDataFrame(
        [("PAR-001", "one", W14, 100, 5100, "B1"), ("PAR-001", "one", W15, 50, 2550, "B1"),
         ("PAR-002", None, W15, 300, 17850, None)],
        "parent_id string, parent_name string, week_start date, q long, v long, bom_id string",
    ).selectExpr("*", "CAST(q AS DECIMAL(38,6)) produced_qty",
                 "CAST(v AS DECIMAL(38,6)) produced_value")
    gaps = spark.createDataFrame(
        [("VIS", "screw", W14, 4.0, -2.5, -10.0), ("VIS", "screw", W15, 4.0, 0.0, 0.0),
         ("AIM", "magnet", W15, None, 12.0, 900.0)],
        "component_id string, component_name string, week_start date, c double, e double, v double",
    ).selectExpr("*", "CAST(c AS DECIMAL(38,6)) bom_coef",
                 "CAST(e AS DECIMAL(38,6)) product_equivalent",
                 "CAST(v AS DECIMAL(38,6)) variance_value")
    weeks = fact_rows([{"week_start": w} for w in (W14, W15, W16)])
    rows = synthesis.crosstab(made, gaps, weeks).collect()
    block = lambda name: [r for r in rows if r.block == name]
    assert [r.reference for r in block("production")] == ["PAR-002", "PAR-001"]
    assert [r.reference for r in block("variance")] == ["AIM", "VIS"]
    assert [r.complement for r in block("production")] == ["—", "B1"]
    assert [r.complement for r in block("variance")] == ["—", "4"]
    total = block("total")[0]
    assert (total.w2026_14, total.w2026_15, total.w2026_16, total.total) == (100, 350, 0, 450)
    assert total.share_pct == pytest.approx(14.5 / 450 * 100)
    value = synthesis.crosstab(made, gaps, weeks, "value").collect()
    assert next(r.total for r in value if r.block == "total") == 25500
    assert next(r.total for r in value if r.reference == "AIM") == 900


def test_synthesis_needs_one_line(fact_rows):
    for lines in ((), ("L", "M")):
        with pytest.raises(ValueError):
            synthesis.synthesis_variance(fact_rows([{}]), Selection(lines=lines))


def test_cell_blocks(ctx):
    cell = ("LINE-3", "CMP-64", 1997, 12)
    orders = synthesis.cell_orders(ctx.fact_order, *cell)
    figure = synthesis.cell_lines(ctx.fact_order, orders, *cell)
    others = synthesis.cell_lines(ctx.fact_order, orders, *cell, block="others")
    clicked = synthesis.cell_figure(ctx.fact, *cell).first()
    assert orders.count() > 0
    for name in ("variance_qty", "variance_value", "product_equivalent"):
        assert figure.agg(F.sum(name)).first()[0] == clicked[name]
    assert figure.intersect(others).count() == 0
    weeks = {r.week_start for r in synthesis.cell_weeks(ctx.fact_order, orders, cell[1]).collect()}
    assert weeks >= {r.week_start for r in others.collect()}


def test_freshness(spark):
    at = datetime(2026, 4, 1)
    log = spark.createDataFrame([log_row("a", 1, at, at, "r"),
                                 log_row("b", -1, at, at, "r", "boom")], S.LOAD_LOG)
    dq = spark.createDataFrame([("ERREUR", False), ("ALERTE", True), ("ALERTE", None)],
                               "severity string, in_anomaly boolean")
    row = analytics.freshness(log, dq, at + timedelta(hours=30)).first()
    assert (row.failed_tables, row.errors, row.alerts, row.stale, row.critical) == (
        "b", 0, 1, False, True)
    assert analytics.freshness(log, dq, at + timedelta(hours=31)).first().stale
    assert analytics.freshness(log.limit(0), dq, at).first().stale


def test_a_cell_of_many_orders_is_whole(spark, fact_rows):
    """Blocks sum to the cell however many orders stand behind it."""
    one = fact_rows([{"actual_qty": 10, "expected_qty": 0}])
    rows = one.crossJoin(spark.range(450).selectExpr("concat('O', id) AS order_id"))
    cell = ("L", "X", *date(2026, 3, 30).isocalendar()[:2])
    orders = synthesis.cell_orders(rows, *cell)
    assert orders.count() == 450
    assert synthesis.cell_lines(rows, orders, *cell).agg(F.sum("actual_qty")).first()[0] == 4500


def test_crosstab_of_no_rows_has_a_total(spark, fact_rows):
    fact = fact_rows([{"parent_line": "L", "produced_qty": 1}])
    none = synthesis.synthesis_variance(fact.limit(0), Selection(lines=("L",)))
    made = spark.createDataFrame([], "parent_id string, parent_name string, week_start date, produced_qty decimal(20,6), produced_value decimal(20,6), bom_id string")
    weeks = fact.select("week_start")
    rows = synthesis.crosstab(made, none, weeks).collect()
    assert [(r.block, r.reference, r.w2026_14, r.total, r.share_pct) for r in rows] == [("total", "—", 0, 0, 0.0)]
