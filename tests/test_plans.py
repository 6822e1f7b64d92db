"""Plan shape: what must hold at any data size."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from bomdrift.operators import facts
from bomdrift.operators.selection import Selection
from checks.registry import _D1, _D2, QUERIES
from tests.conftest import SMALL


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_python_or_single_task_window(spark, name):
    plan = executed(QUERIES[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "InPandas"):
        assert operator not in plan, operator
    # A window needs a partition key: the third argument list of the operator is not empty.
    for window in re.findall(r"\+- Window .*", plan):
        assert re.search(r"\], \[[^\]]+\], \[", window), window


def test_selection_reaches_the_scan_through_the_overrides(ctx):
    sel = Selection(_D1, _D2, programs=("PRG-1",), lines=("LINE-1",))
    df = sel.apply(ctx.fact).select("variance_qty")
    plan = executed(df)
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "fact_variance_" in line)
    weeks = scan[scan.index("PartitionFilters") : scan.index("PushedFilters")]
    assert ">= 1997-07-07" in weeks and "<= 1997-12-29" in weeks
    for pushed in ("EqualTo(parent_program,PRG-1)", "EqualTo(parent_line,LINE-1)"):
        assert pushed in scan
    assert "component_name" not in scan and "parent_name" not in scan


def test_kpis_read_the_fact_once(ctx):
    from bomdrift.operators.analytics import kpis

    plan = executed(kpis(ctx.fact, Selection(_D1, _D2)))
    assert sum("FileScan" in line and "fact_variance_" in line for line in plan.splitlines()) == 1


def test_crosstab_reads_each_input_once(ctx):
    from checks.registry import _crosstab

    plan = executed(_crosstab(ctx, "value"))
    # One scan for production, one for the variances.
    assert sum("FileScan" in line and "fact_variance_" in line for line in plan.splitlines()) == 2
    assert plan.count("FileScan") == 6  # with the item master, the bills and the changes of each


def test_a_million_parents_prune_by_a_bloom_filter(spark, ctx, folder):
    spark.range(1_000_000).where("id % 3 = 0").selectExpr("concat('PAR-', id) AS parent_id").write.parquet(f"{folder}/keys")
    wanted = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
              "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        keys = spark.read.parquet(f"{folder}/keys").where("parent_id > 'PAR-1'")
        df = Selection(tables=(keys,)).apply(ctx.raw_fact)
        assert "might_contain" in df._jdf.queryExecution().optimizedPlan().toString()
        got = df.count()
    finally:
        for k in wanted:
            spark.conf.unset(k)
    assert got == ctx.raw_fact.where("parent_id > 'PAR-1' AND try_cast(substr(parent_id, 5) AS int) % 3 = 0").count() > 0


def test_dq_table_reads_each_input_once_per_purpose(ctx):
    from bomdrift.operators.quality import dq_checks

    plan = executed(dq_checks(ctx.model.quality_inputs()))
    # One pass for the fact checks, one for the grain totals.
    assert sum("/fact_variance]" in line for line in plan.splitlines()) == 2


def test_versions_are_ranked_before_the_shuffle(ctx):
    plan = executed(ctx.lazy["items"])
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[exchange:]


def test_flows_are_combined_before_the_shuffle(ctx):
    plan = executed(ctx.lazy["stock_flows"])
    top = plan.index("Exchange hashpartitioning(category")
    assert "partial_sum" in plan[top:]


@pytest.fixture
def tight(spark):
    """Thresholds small enough for the skew handling to act on test data."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed_movements(spark, rows):
    """A third of the movements on one origin."""
    n = F.col("id")
    return spark.range(0, rows, 1, 8).select(
        F.when(n % 3 == 0, 0).otherwise(n % 997 + 1).alias("origin_id"),
        F.concat(F.lit("C-"), (n % 5).cast("string")).alias("item_id"),
        F.lit(-1).cast("decimal(38,6)").alias("qty"),
        F.date_add(F.lit("2026-03-30").cast("date"), (n % 70).cast("int")).alias("physical_date"),
    )


def test_hot_origin_is_split_and_combined(tight):
    rows = 200_000
    origins = tight.range(998).select(
        F.col("id").alias("origin_id"), F.lit(8).alias("category"),
        F.concat(F.lit("O-"), (F.col("id") % 3).cast("string")).alias("order_id"),
        F.lit("C1").alias("company"))
    flows = facts.stock_flows(skewed_movements(tight, rows), origins, "2026-03-30")
    total = flows.agg(F.sum("qty"), F.sum("movement_count"))
    got = total.collect()[0]
    assert (int(got[0]), got[1]) == (-rows, rows)
    assert "isSkew=true" in executed(total) or "skew=true" in executed(total)


def test_hot_parent_explodes_whole_without_broadcast(tight):
    production = tight.range(0, 60_000, 1, 8).select(
        F.concat(F.lit("O-"), F.col("id").cast("string")).alias("order_id"),
        F.when(F.col("id") % 3 == 0, "P-0")
        .otherwise(F.concat(F.lit("P-"), (F.col("id") % 500).cast("string"))).alias("parent_id"),
        F.lit("2026-03-30").cast("date").alias("week_start"),
        F.lit(2).cast("decimal(38,6)").alias("produced_qty"))
    bom = tight.range(1500).select(
        F.concat(F.lit("P-"), (F.col("id") % 500).cast("string")).alias("parent_id"),
        F.concat(F.lit("C-"), F.col("id").cast("string")).alias("component_id"),
        F.lit(3).cast("decimal(38,6)").alias("bom_coef"))
    total = facts.explode_bom(production, bom).agg(F.count("*"), F.sum("expected_qty"))
    got = total.collect()[0]
    assert (got[0], int(got[1])) == (180_000, 180_000 * 6)
    assert "skew=true" in executed(total)
