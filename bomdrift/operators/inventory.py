"""Inventory-count reconciliation with the consumption variance."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift.functions.calendar import monday_of
from bomdrift.functions.measures import positive, zero

FROZEN = [
    "item_id", "period_from", "period_to", "unit", "net_variance", "under_qty", "over_qty",
    "expected_qty", "actual_qty", "parent_count", "week_count",
]


def component_window(
    fact: DataFrame, previous: date, current: date,
    items: Sequence[str] | None = None, lines: Sequence[str] | None = None,
) -> DataFrame:
    """Variance of each component between two count dates.

    Dates are floored to their Monday: the lower week is included, the upper week, still
    open at the count, is not. All rows are summed, conforming and off-BOM ones too.
    """
    low, high = monday_of(previous), monday_of(current)
    week = F.col("week_start")
    rows = fact.filter((week >= F.lit(low)) & (week < F.lit(high)))
    if items is not None:
        rows = rows.filter(F.col("component_id").isin(*items))
    if lines is not None:
        rows = rows.filter(F.col("parent_line").isin(*lines))
    qty = F.col("variance_qty")
    return rows.groupBy(F.col("component_id").alias("item_id")).agg(
        F.max("component_name").alias("item_name"),
        F.max("component_unit").alias("unit"),
        F.sum(qty).alias("net_variance"),
        F.sum(positive(qty)).alias("under_qty"),
        F.sum(positive(-qty)).alias("over_qty"),
        F.sum("expected_qty").alias("expected_qty"),
        F.sum("actual_qty").alias("actual_qty"),
        F.countDistinct("parent_id").alias("parent_count"),
        F.countDistinct("week_start").alias("week_count"),
        F.min("week_start").alias("first_week"),
        F.max("week_start").alias("last_week"),
    ).withColumns({"period_from": F.lit(low), "period_to": F.lit(high)})


def freeze(
    campaign_table: DataFrame, result: DataFrame, campaign_id: int, closed: bool = False
) -> DataFrame:
    """The campaign table with this campaign's rows replaced by the result.

    Running it twice changes nothing, and items no longer in the result disappear.
    """
    if closed:
        raise ValueError(f"campaign {campaign_id} is closed")
    others = campaign_table.filter(~F.col("campaign_id").eqNullSafe(F.lit(campaign_id)))
    return others.unionByName(as_frozen(result, campaign_id))


def as_frozen(result: DataFrame, campaign_id: int) -> DataFrame:
    return result.select(F.lit(campaign_id).cast("long").alias("campaign_id"), *FROZEN)


def explanation_rate(net: Column, residual: Column) -> Column:
    """1 − |residual| / |net|; NULL on a zero net, negative when the gap grows."""
    ratio = F.abs(residual).cast("double") / F.abs(net).cast("double")
    return F.when(net != 0, 1 - ratio)


def reconcile_counts(counts: DataFrame, frozen: DataFrame) -> DataFrame:
    """Net inventory variance, explained part, residual and explanation rate.

    An item without a frozen figure has no measure: its parts stay NULL, never zero.
    """
    measured = frozen.select("campaign_id", "item_id", "net_variance")
    net = F.col("net_count_variance")
    return (
        counts.join(measured, ["campaign_id", "item_id"], "left")
        .withColumn("net_count_variance", F.col("qty_counted") - F.col("qty_erp"))
        .withColumn("explained_qty", -F.col("net_variance"))
        .withColumn("residual_qty", net + F.col("net_variance"))
        .select(
            "campaign_id", "item_id", "qty_erp", "qty_counted", "net_count_variance",
            "explained_qty", "residual_qty",
            explanation_rate(net, F.col("residual_qty")).alias("explanation_rate"),
        )
    )


def campaign_summary(reconciled: DataFrame, dim_item: DataFrame) -> DataFrame:
    """Valued share explained by campaign, with the number of unmeasured items."""
    costs = dim_item.select("item_id", "unit_cost")
    cost = F.coalesce("unit_cost", zero())
    measured = F.col("residual_qty").isNotNull()
    total = lambda name: F.coalesce(
        F.sum(F.when(measured, F.abs(name) * cost)), zero()
    )
    return (
        reconciled.join(costs, "item_id", "left")
        .groupBy("campaign_id")
        .agg(
            F.count(F.lit(1)).alias("item_count"),
            F.count_if(~measured).alias("unmeasured_count"),
            F.count_if(F.col("unit_cost").isNull()).alias("uncosted_count"),
            total("net_count_variance").alias("net_value"),
            total("residual_qty").alias("residual_value"),
        )
        .withColumn(
            "explained_share", explanation_rate(F.col("net_value"), F.col("residual_value"))
        )
    )


def incomplete_period(fact: DataFrame, previous: date) -> DataFrame:
    """Whether a window starts before the fact's history."""
    history = F.col("history_from")
    return fact.agg(F.min("week_start").alias("history_from")).select(
        F.lit(monday_of(previous)).alias("period_from"),
        history,
        (F.lit(monday_of(previous)) < history).alias("incomplete"),
    )
