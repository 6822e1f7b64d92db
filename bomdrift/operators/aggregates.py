"""Aggregates of the weekly fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.functions.measures import positive

_WEEK = ["week_start", "iso_year", "iso_week"]


def agg_week_program_line(fact: DataFrame) -> DataFrame:
    """Totals by week, program and line. Under and over are absolute: net = under − over."""
    qty, value = F.col("variance_qty"), F.col("variance_value")
    return fact.groupBy(
        *_WEEK, F.col("parent_program").alias("program"), F.col("parent_line").alias("line")
    ).agg(
        F.countDistinct("parent_id").alias("parent_count"),
        F.countDistinct("component_id").alias("component_count"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("variance_type") != S.CONFORMING).alias("variance_row_count"),
        F.count_if(F.col("line_status") == S.OFF_BOM).alias("off_bom_count"),
        F.count_if(F.col("line_status") == S.NO_CONSUMPTION).alias("no_consumption_count"),
        F.sum("expected_qty").alias("expected_qty"),
        F.sum("actual_qty").alias("actual_qty"),
        F.sum(qty).alias("variance_qty"),
        F.sum(positive(qty)).alias("under_qty"),
        F.sum(positive(-qty)).alias("over_qty"),
        F.sum(value).alias("variance_value"),
        F.sum(positive(value)).alias("under_value"),
        F.sum(positive(-value)).alias("over_value"),
        F.sum(F.abs(value)).alias("abs_value"),
    )


def agg_component(fact: DataFrame) -> DataFrame:
    """Totals by component, program and line; the dominant type compares both volumes."""
    qty, value = F.col("variance_qty"), F.col("variance_value")
    totals = fact.groupBy("component_id", "parent_program", "parent_line").agg(
        F.max("component_name").alias("component_name"),
        F.max("component_category").alias("component_category"),
        F.min("bom_coef").alias("bom_coef"),
        F.max("bom_coef").alias("bom_coef_max"),
        F.bool_and("is_uniform").alias("is_uniform"),
        F.countDistinct("parent_id").alias("parent_count"),
        F.countDistinct("week_start").alias("active_week_count"),
        F.count_if(F.col("variance_type") != S.CONFORMING).alias("variance_week_count"),
        F.min("week_start").alias("first_week"),
        F.max("week_start").alias("last_week"),
        F.sum("expected_qty").alias("expected_qty"),
        F.sum("actual_qty").alias("actual_qty"),
        F.sum(qty).alias("variance_qty"),
        F.sum(positive(qty)).alias("under_qty"),
        F.sum(positive(-qty)).alias("over_qty"),
        F.sum("product_equivalent").alias("product_equivalent"),
        F.max("unit_cost").alias("unit_cost"),
        F.sum(value).alias("variance_value"),
        F.sum(F.abs(value)).alias("abs_value"),
    )
    expected = F.col("expected_qty")
    return totals.withColumns(
        {
            "variance_pct": F.when(expected > 0, qty / expected * 100).cast(S.QTY),
            "dominant_type": F.when(F.col("under_qty") >= F.col("over_qty"), S.UNDER).otherwise(
                S.OVER
            ),
        }
    )
