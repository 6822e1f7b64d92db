from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.functions.calendar import iso_week, week_label, week_start
from bomdrift.functions.measures import order_status_label
from bomdrift.operators import dims, facts
from bomdrift.sources import views

# Lines by status and net, under and over totals of the mapped test tables.
MEASURED = {
    "fact_variance": (1261, 3232, 5084, 443269, 498842, 55573),
    "fact_variance_order": (1367, 3259, 5555, 443269, 501694, 58425),
}


@pytest.mark.parametrize("name", MEASURED)
def test_measured_totals(ctx, name):
    status = lambda s: F.count_if(F.col("line_status") == s)
    q = F.col("variance_qty")
    row = ctx.model[name].agg(
        status(S.OFF_BOM), status(S.NOMINAL), status(S.NO_CONSUMPTION), F.sum(q),
        F.sum(F.when(q > 0, q)), -F.sum(F.when(q < 0, q)),
    ).first()
    assert tuple(int(v) for v in row) == MEASURED[name]


@pytest.mark.parametrize("name", S.TABLES)
def test_primary_keys_are_unique(ctx, name):
    key = list(S.TABLES[name].key)
    assert ctx.model[name].groupBy(*key).count().filter("count > 1").count() == 0


@pytest.mark.parametrize("name", S.TABLES)
def test_written_schema_is_the_declared_one(ctx, name):
    got = [(f.name, f.dataType) for f in ctx.model[name].schema]
    assert got == [(f.name, f.dataType) for f in S.TABLES[name].schema]


def test_line_belongs_to_one_program(ctx):
    lines = ctx.raw_fact.filter(F.col("parent_line") != S.UNKNOWN)
    assert lines.groupBy("parent_line").agg(
        F.countDistinct("parent_program").alias("n")).filter("n > 1").count() == 0


def test_net_is_under_minus_over(ctx):
    for name in ("agg_week_program_line", "agg_component"):
        assert ctx.model[name].filter("variance_qty != under_qty - over_qty").count() == 0


def test_both_grains_carry_the_same_matter(ctx):
    def totals(df, keys):
        q = F.col("variance_qty")
        made = df.groupBy(*keys).agg(F.max("produced_qty").alias("p")).agg(F.sum("p")).first()[0]
        row = df.agg(F.sum(q), F.sum("variance_value"), F.sum("expected_qty"),
                     F.sum("actual_qty"), F.sum(F.greatest(q, F.lit(0))),
                     F.sum(F.greatest(-q, F.lit(0)))).first()
        return (*row, made)

    week = totals(ctx.fact, ["parent_id", "week_start"])
    order = totals(ctx.fact_order, ["order_id", "parent_id", "week_start"])
    assert week[:4] == order[:4] and week[6] == order[6]
    assert order[4] - week[4] == order[5] - week[5] >= 0


def test_iso_year_is_the_thursdays(spark):
    days = [date(2027, 1, 1), date(2026, 1, 1), date(2024, 12, 30), date(2026, 4, 5)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select(
        *iso_week(week_start("d"))).select("*", week_label("iso_year", "iso_week").alias("w"))
    assert [tuple(r) for r in rows.collect()] == [
        (date(2026, 12, 28), 2026, 53, "2026-S53"), (date(2025, 12, 29), 2026, 1, "2026-S01"),
        (date(2024, 12, 30), 2025, 1, "2025-S01"), (date(2026, 3, 30), 2026, 14, "2026-S14"),
    ]


def test_order_status_labels(spark):
    rows = spark.createDataFrame([(n,) for n in (*range(10), None)], "s long").select(
        order_status_label(F.col("s"))).collect()
    assert [r[0] for r in rows] == [*S.ORDER_STATUSES.values(), "Inconnu (9)", None]


def test_bom_version_and_repeated_lines(table):
    def line(bom, version, component, qty):
        return {"bomid": bom, "parent_itemid": "P", "bom_version_name": version,
                "statut": "Actif", "child_itemid": component, "child_qty": qty}

    raw = table(S.SOURCES["silver_bom"], [
        line("B1", None, "X", 9), line("B2", "V1", "X", 9), line("B3", "V2", "X", 1),
        line("B3", "V2", "X", 2), line("B3", "V1", "Y", 4), line("B2", "V2", "Z", 7),
    ])
    bom = views.bom_lines(raw)
    assert [tuple(r) for r in dims.bom_version(bom).collect()] == [("P", "B3", "V2")]
    got = {r.component_id: (float(r.bom_coef), r.bom_line_count) for r in dims.dim_bom(bom).collect()}
    assert got == {"X": (3.0, 2), "Y": (4.0, 1)}


def test_dim_item_defaults(table):
    items = views.items(table(S.SOURCES["silver_base_article"], [
        {"item_id": "A", "categorie": "  ", "std_cost_price": -1, "std_unit": ""},
        {"item_id": "B", "categorie": "K", "programme": "G", "std_cost_price": 0, "std_unit": "KG"},
    ]))
    made = views.made_products(table(S.SOURCES["produits_fabriques"], [
        {"ref_parent": "B", "ligne_de_prod": "L", "type": "T"}]))
    got = {r.item_id: (r.category, r.program, r.line, r.unit_cost, r.unit)
           for r in dims.dim_item(items, made).collect()}
    assert got == {"A": ("UNKNOWN", "UNKNOWN", None, None, "PCE"), "B": ("K", "G", "L", 0, "KG")}


@pytest.fixture(scope="module")
def tiny(table):
    """Two companies share an order id; one receipt has no order; one issue is returned."""
    m = lambda o, i, q, d, c="C1": {
        "inventtransorigin": o, "itemid": i, "qty": q, "datephysical": date(2026, 4, d),
        "dataareaid": c}
    mov = views.movements(table(S.SOURCES["invent_trans"], [
        m(1, "P", 10, 1), m(1, "P", -1, 1), m(2, "X", -4, 1), m(2, "X", 1, 2), m(3, "X", -5, 1),
        m(4, "P", 3, 8), m(5, "X", -2, 1, "C2"), m(6, "X", -8, 1), m(2, "X", -7, 13)]))
    g = lambda r, k, f, c="C1": {
        "recid": r, "referencecategory": k, "referenceid": f, "dataareaid": c}
    org = views.origins(table(S.SOURCES["invent_trans_origin"], [
        g(1, 2, "O1"), g(2, 8, "O1"), g(3, 8, "O2"), g(4, 2, None), g(5, 8, "O1", "C2"),
        g(6, 5, "O1")]))
    orders = views.orders(table(S.SOURCES["prod_table"], [
        {"prodid": "O1", "itemid": "P", "dataareaid": "C1", "prodstatus": 4, "bomid": "b1"},
        {"prodid": "O1", "itemid": "Q", "dataareaid": "C2", "prodstatus": 7, "bomid": "b2"}]))
    flows = facts.stock_flows(mov, org, "2026-03-30")
    return flows, orders


def test_production_keeps_receipts_without_order(tiny):
    rows = {(r.order_id, str(r.week_start)): (int(r.produced_qty), r.receipt_count)
            for r in facts.order_production(tiny[0]).collect()}
    assert rows == {("O1", "2026-03-30"): (10, 1), (None, "2026-04-06"): (3, 1)}


def test_consumption_is_net_and_needs_the_order_of_its_company(tiny):
    rows = {(r.order_id, r.parent_id, str(r.week_start)):
            (int(r.actual_qty), r.issue_count, r.return_count)
            for r in facts.order_consumption(*tiny).collect()}
    assert rows == {("O1", "P", "2026-03-30"): (3, 2, 1), ("O1", "P", "2026-04-13"): (7, 1, 0),
                    ("O1", "Q", "2026-03-30"): (2, 1, 0)}


def test_order_fact_with_null_order_and_one_header(spark, tiny, table):
    bom = table(S.TABLES["dim_bom"].schema, [
        {"parent_id": "P", "component_id": "X", "bom_coef": 2}])
    items = table(S.TABLES["dim_item"].schema, [])
    coefs = table(S.TABLES["dim_line_coef"].schema, [])
    flows, orders = tiny
    fact = facts.fact_variance_order(
        facts.order_production(flows), facts.order_consumption(flows, orders), orders, bom,
        items, coefs)
    rows = {(r.order_id, r.parent_id, str(r.week_start)):
            (r.line_status, int(r.variance_qty), r.order_bom_id) for r in fact.collect()}
    assert rows == {
        ("O1", "P", "2026-03-30"): ("nominal", 17, "b1"),
        ("O1", "P", "2026-04-13"): ("off_bom", -7, "b1"),
        ("O1", "Q", "2026-03-30"): ("off_bom", -2, "b1"),
        (None, "P", "2026-04-06"): ("no_consumption", 6, None),
    }
    assert fact.first().parent_line == "UNKNOWN" and fact.first().component_unit == "PCE"
