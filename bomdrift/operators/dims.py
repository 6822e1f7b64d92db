"""Dimensions: items, flattened BOM, and coefficient uniformity per production line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bomdrift import schemas as S
from bomdrift.functions.measures import filled, number


def dim_item(items: DataFrame, made: DataFrame) -> DataFrame:
    """Item dimension; bought items keep a NULL line."""
    lines = made.select(F.col("parent_id").alias("item_id"), "line", "product_type")
    return items.join(lines, "item_id", "left").select(
        "item_id",
        "item_name",
        "item_description",
        filled("category").alias("category"),
        "item_group_id",
        "item_group_label",
        filled("program").alias("program"),
        "line",
        "product_type",
        F.when(F.col("unit_cost") >= 0, F.col("unit_cost")).alias("unit_cost"),
        filled("unit", S.DEFAULT_UNIT).alias("unit"),
        "refreshed_at",
    )


def used_items(dim_item: DataFrame, dim_bom: DataFrame, *facts: DataFrame) -> DataFrame:
    """The items that occur as parent or component: what a fact is joined with, however long the item master is."""
    ids = None
    for df in (dim_bom, *facts):
        for column in (c for c in ("parent_id", "component_id") if c in df.columns):
            own = df.select(F.col(column).alias("item_id")).distinct()
            ids = own if ids is None else ids.union(own)
    return dim_item.join(ids.distinct(), "item_id", "left_semi")


def bom_version(bom: DataFrame) -> DataFrame:
    """The BOM version kept for each parent: last version name, then last BOM id."""
    newest = W.partitionBy("parent_id").orderBy(
        F.col("version_name").desc_nulls_last(), F.col("bom_id").desc()
    )
    return (
        bom.select("parent_id", "bom_id", "version_name")
        .distinct()
        .withColumn("version_rank", F.row_number().over(newest))
        .filter(F.col("version_rank") == 1)
        .drop("version_rank")
    )


def dim_bom(bom: DataFrame) -> DataFrame:
    """One row per (parent, component) of the kept BOM; repeated lines are summed."""
    lines = bom.groupBy("parent_id", "bom_id", "component_id").agg(
        F.sum("line_qty").cast(S.QTY).alias("bom_coef"),
        F.max("unit").alias("unit"),
        F.max("parent_stock").alias("parent_stock"),
        F.max("component_stock").alias("component_stock"),
        F.count(F.lit(1)).alias("bom_line_count"),
    )
    return lines.join(bom_version(bom), ["parent_id", "bom_id"]).select(
        "parent_id",
        "component_id",
        "bom_id",
        "version_name",
        F.lit(S.ACTIVE_BOM).alias("status"),
        "bom_coef",
        "unit",
        "parent_stock",
        "component_stock",
        "bom_line_count",
    )


def dim_line_coef(dim_bom: DataFrame, dim_item: DataFrame) -> DataFrame:
    """Coefficient range of each (line, component), uniform within 1e-6."""
    parents = dim_item.select(
        F.col("item_id").alias("parent_id"),
        F.coalesce("line", F.lit(S.UNKNOWN)).alias("line"),
        "program",
    )
    low, high = F.min("bom_coef"), F.max("bom_coef")
    return (
        dim_bom.select("parent_id", "component_id", "bom_coef")
        .join(parents, "parent_id")
        .groupBy("line", "component_id")
        .agg(
            F.max("program").alias("program"),
            F.countDistinct("parent_id").alias("parent_count"),
            low.alias("coef_min"),
            high.alias("coef_max"),
            low.alias("bom_coef"),
            (high - low <= number("0.000001")).alias("is_uniform"),
        )
    )
