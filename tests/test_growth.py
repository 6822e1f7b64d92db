"""What must not grow faster than the tables: shuffles, files, and tables that a query does not need."""

from __future__ import annotations

import re
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.operators import dims, facts
from bomdrift.plans import build
from bomdrift.plans.versions import Store, by_week, digest_of
from checks.context import Context
from tests.conftest import SMALL
from tests.test_plans import executed, tight  # noqa: F401

MONDAY = date(2026, 3, 30)


def test_a_table_is_written_when_asked_for(spark, ctx, folder):
    model = build.on_demand(spark, ctx.sources, ctx.params, folder)
    assert model.entries == {}
    assert model.quality_check("q9").count() == 1
    assert {"stock_flows", "order_production", "fact_production"} <= set(model.entries)
    assert not {"order_consumption", "fact_variance", "fact_variance_order"} & set(model.entries)
    assert model["fact_pairs"].count() > 0
    assert "fact_variance" in model.entries and "fact_variance_order" not in model.entries


def test_queries_of_a_small_table_leave_the_order_fact_alone(spark, monkeypatch, folder):
    import checks.context
    from checks.registry import QUERIES

    own = Context(spark, SMALL)
    own.folder = folder
    monkeypatch.setattr("checks.registry.context", lambda *_: own)
    for name in ("s9_read_table", "q9_parent_without_line", "n10_week_calendar_empty", "a2_agg_component", "o4_effective"):
        assert QUERIES[name](spark, SMALL).count() >= 0
    assert checks.context is not None and "fact_variance_order" not in own.model.entries


def test_buckets_follow_the_rows_of_a_week(spark, ctx, folder, monkeypatch):
    monkeypatch.setattr(build, "ROWS_PER_BUCKET", 1000)
    model = build.on_demand(spark, ctx.sources, ctx.params, folder)
    assert model["fact_variance"].count() > 0
    assert model.entries["stock_flows"].rows > 4000  # over all weeks
    assert model.entries["fact_variance"].buckets == 0


def sides(spark):
    """Production and consumption by order, with keys that match, that do not, and that are NULL."""
    qty = lambda n: None if n is None else Decimal(n)
    made = [("O-1", "P-1", MONDAY, qty(2)), ("O-2", "P-1", MONDAY, qty(3)), (None, "P-1", MONDAY, qty(5)), ("O-3", "P-9", MONDAY, qty(7))]
    used = [("O-1", "P-1", "C-1", MONDAY, qty(4), 2, 0), ("O-1", "P-1", "C-8", MONDAY, qty(1), 1, 1),
            (None, "P-1", "C-1", MONDAY, qty(6), 1, 0), ("O-2", "P-1", None, MONDAY, qty(8), 1, 0)]
    bom = [("P-1", "C-1", qty(2)), ("P-1", "C-2", qty(3))]
    orders = [("O-1", "P-1", "B-1", 7, None, "C1"), ("O-2", "P-1", "B-2", None, None, "C1")]
    return (
        spark.createDataFrame(made, "order_id string, parent_id string, week_start date, produced_qty decimal(38,6)"),
        spark.createDataFrame(used, "order_id string, parent_id string, component_id string, week_start date, "
                                    "actual_qty decimal(38,6), issue_count long, return_count long"),
        spark.createDataFrame(bom, "parent_id string, component_id string, bom_coef decimal(38,6)"),
        spark.createDataFrame(orders, "order_id string, parent_id string, bom_id string, status long, close_date timestamp, company string"),
    )


@pytest.mark.parametrize("tasks", [None, 3])
def test_orders_reconcile_as_the_join_does(spark, tasks):
    made, used, bom, orders = sides(spark)
    joined = facts.reconcile(facts.explode_bom(made, bom), used, facts.ORDER_KEYS)
    keyed = facts.reconcile_orders(made, used, bom, orders, tasks)
    got = facts._matched(facts._expected(keyed), facts.ORDER_KEYS).select(*joined.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, joined.collect()))
    assert joined.where("order_id IS NULL").count() == 3 and got.count() == 9
    assert {(r.order_id, r.order_bom_id, r.status) for r in keyed.collect()} == {("O-1", "B-1", 7), ("O-2", "B-2", None), (None, None, None)}


def test_orders_reconcile_in_one_shuffle_of_unexploded_rows(tight):  # noqa: F811
    made, used, bom, orders = sides(tight)
    tight.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = executed(facts.reconcile_orders(made, used, F.broadcast(bom), orders))
    finally:
        tight.conf.set("spark.sql.adaptive.enabled", "true")
    assert "FullOuter" not in plan
    # The rows of both sides, and the orders; the bills are broadcast.
    assert len(re.findall(r"Exchange hashpartitioning\(order_id", plan)) == 2


def test_consumption_is_dealt_by_order_once(tight):  # noqa: F811
    flows = tight.range(1000).selectExpr(
        "8 AS category", "concat('O-', id % 90) AS order_id", "concat('C', id % 2) AS company", "concat('I-', id % 4) AS item_id",
        "date'2026-03-30' AS week_start", "CAST(-1 AS decimal(38,6)) AS qty", "1L AS movement_count", "0L AS positive_count",
        "date'2026-03-30' AS first_date", "date'2026-03-31' AS last_date")
    orders = tight.range(80).selectExpr("concat('O-', id) AS order_id", "'C1' AS company", "concat('P-', id % 3) AS parent_id")
    df = facts.order_consumption(flows, orders)
    assert -sum(r.actual_qty for r in df.collect()) == -flows.where("company = 'C1'").join(orders.select("order_id"), "order_id").count()
    assert not re.search(r"Exchange hashpartitioning\(order_id#\d+, parent_id", executed(df))


def test_the_order_fact_is_dealt_while_narrow(ctx):
    seen = []
    m = ctx.model
    shown = lambda rows: seen.append(rows.columns) or rows
    facts.fact_variance_order(
        m["order_production"], m["order_consumption"], m["orders"], m["dim_bom"], m["used_items"], m["dim_line_coef"], arranged=shown)
    assert len(seen) == 1 and not {"component_name", "parent_name", "variance_qty", "order_status"} & set(seen[0])


def test_facts_join_the_items_that_occur_alone(ctx):
    used, known = ctx.model["used_items"], ctx.model["dim_item"]
    ids = {r.item_id for r in used.collect()}
    fact = ctx.model["fact_variance"]
    wanted = {r[0] for r in fact.select("parent_id").union(fact.select("component_id")).distinct().collect()}
    assert ids == wanted & {r.item_id for r in known.select("item_id").collect()}
    assert len(ids) < known.count()
    assert dims.used_items(known, ctx.model["dim_bom"].limit(0)).count() == 0


@pytest.mark.parametrize("buckets", [0, 4])
def test_a_stored_table_is_written_again_without_a_shuffle(spark, ctx, folder, buckets):
    store = Store(spark, folder)
    fact = ctx.model["fact_variance"].where("week_start < date'1995-06-01'")
    first = store.stage("fact", fact, True, buckets)
    second = store.stage("copy", store.read("fact", first), True, buckets, arranged=True)
    assert {w: (p.rows, p.digest) for w, p in first.parts.items()} == {w: (p.rows, p.digest) for w, p in second.parts.items()}
    assert first.digest == fact.agg(digest_of(fact)).first()[0]


def test_weeks_of_many_rows_are_dealt_to_more_tasks(spark, ctx, monkeypatch):
    monkeypatch.setattr("bomdrift.plans.versions.ROWS_PER_TASK", 10)
    rows = ctx.model["fact_variance"].where("week_start < date'1995-03-01'")
    n, weeks = rows.count(), rows.select("week_start").distinct().count()
    dealt = by_week(rows, 0, n, weeks).withColumn("task", F.spark_partition_id())
    assert dealt.select("task").distinct().count() > weeks
    assert dealt.groupBy("week_start").agg(F.countDistinct("task").alias("n")).agg(F.max("n")).first()[0] > 1
    assert dealt.drop("task").exceptAll(rows).count() == 0 and dealt.count() == n


def test_long_sources_are_dealt_to_more_tasks(spark, monkeypatch):
    from bomdrift.sources import testdata

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f"({tasks + 1}" not in executed(testdata.invent_trans(spark, SMALL))
    monkeypatch.setattr(testdata, "BYTES_PER_PARTITION", 5000)
    before = testdata.invent_trans(spark, SMALL)
    wide = re.findall(r"hashpartitioning\(k#\d+L, (\d+)\)", executed(before))
    assert wide and all(int(n) > tasks for n in wide)
    monkeypatch.undo()
    assert before.exceptAll(testdata.invent_trans(spark, SMALL)).count() == 0


def test_origins_are_dealt_by_order_once(ctx, tight):  # noqa: F811
    from bomdrift.sources import testdata

    plan = executed(testdata.invent_trans_origin(tight, SMALL).where(F.col("referencecategory") == S.ISSUE))
    assert plan.count("Exchange hashpartitioning") == 2  # the lines, and the orders
