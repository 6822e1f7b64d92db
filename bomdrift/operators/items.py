"""Item cards, BOMs and where-used lists, with the user overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomdrift.functions.measures import zero
from bomdrift.operators.analytics import kpis, weekly_series
from bomdrift.operators.selection import Selection


def item_card(dim_item: DataFrame, item_id: str) -> DataFrame:
    return dim_item.filter(F.col("item_id") == item_id).select(
        "item_id", "item_name", "item_description", "category", "item_group_id",
        "item_group_label", "program", "unit_cost", "unit",
    )


def effective_bom(dim_bom: DataFrame, bom_over: DataFrame) -> DataFrame:
    """Active BOM lines with the coefficient that serves the calculation."""
    marks = bom_over.select(
        "parent_id", "component_id", "active", F.col("bom_coef").alias("override_coef")
    )
    return (
        dim_bom.join(marks, ["parent_id", "component_id"], "left")
        .filter(F.coalesce("active", F.lit(True)))
        .select(
            "parent_id", "component_id", "unit",
            F.coalesce("override_coef", "bom_coef").alias("bom_coef"),
            F.col("bom_coef").alias("source_coef"),
            F.col("override_coef").isNotNull().alias("coef_overridden"),
        )
    )


def _without(df: DataFrame, excluded: DataFrame, column: str) -> DataFrame:
    ids = excluded.select(F.col("item_id").alias(column))
    return df.join(ids, column, "left_anti")


def bom_lines_costed(
    dim_bom: DataFrame, dim_item: DataFrame, bom_over: DataFrame, excluded: DataFrame
) -> DataFrame:
    """Effective BOM lines of every parent without excluded components, with costs."""
    components = dim_item.select(
        F.col("item_id").alias("component_id"), F.col("item_name").alias("component_name"),
        "category", "unit_cost",
    )
    lines = _without(effective_bom(dim_bom, bom_over), excluded, "component_id")
    return lines.join(components, "component_id", "left")


def bom_of_parent(
    dim_bom: DataFrame, dim_item: DataFrame, bom_over: DataFrame, excluded: DataFrame, parent: str
) -> DataFrame:
    """BOM of a parent, largest coefficient first."""
    lines = bom_lines_costed(
        dim_bom.filter(F.col("parent_id") == parent), dim_item, bom_over, excluded
    )
    return lines.select(
        "component_id", "component_name", "category", "bom_coef", "source_coef",
        "coef_overridden", "unit", "unit_cost",
    ).orderBy(F.col("bom_coef").desc(), "component_id")


def parents_of_component(
    dim_bom: DataFrame, dim_item: DataFrame, bom_over: DataFrame, excluded: DataFrame,
    component: str,
) -> DataFrame:
    """Where-used: parents that consume a component."""
    lines = effective_bom(dim_bom.filter(F.col("component_id") == component), bom_over)
    parents = dim_item.select(
        F.col("item_id").alias("parent_id"), F.col("item_name").alias("parent_name"),
        "program", "line",
    )
    return (
        _without(lines, excluded, "parent_id")
        .join(parents, "parent_id", "left")
        .select("parent_id", "parent_name", "program", "line", "bom_coef", "coef_overridden")
        .orderBy(F.col("program").asc_nulls_last(), "parent_id")
    )


def material_cost(
    dim_bom: DataFrame, dim_item: DataFrame, bom_over: DataFrame, excluded: DataFrame
) -> DataFrame:
    """Material cost of every parent: Σ coefficient × component cost."""
    cost = F.col("bom_coef") * F.coalesce("unit_cost", zero())
    return (
        bom_lines_costed(dim_bom, dim_item, bom_over, excluded)
        .groupBy("parent_id")
        .agg(F.sum(cost).alias("material_cost"), F.count(F.lit(1)).alias("component_count"))
    )


def coef_range(dim_bom: DataFrame, bom_over: DataFrame, excluded: DataFrame) -> DataFrame:
    """Smallest and largest coefficient of every component over its parents."""
    lines = _without(effective_bom(dim_bom, bom_over), excluded, "parent_id")
    return lines.groupBy("component_id").agg(
        F.min("bom_coef").alias("coef_min"), F.max("bom_coef").alias("coef_max")
    )


def component_sheet(
    fact: DataFrame, fact_raw: DataFrame, sel: Selection, component: str
) -> dict[str, DataFrame]:
    """Indicators and weekly series restricted to one component."""
    target = sel.with_(components=(component,))
    return {
        "kpis": kpis(fact, target, compare=False),
        "weeks": weekly_series(fact, target, fact_raw),
    }


def parent_sheet(
    fact: DataFrame, fact_raw: DataFrame, sel: Selection, parent: str
) -> dict[str, DataFrame]:
    """Indicators and weekly series restricted to one parent."""
    target = sel.with_(parents=(parent,))
    return {
        "kpis": kpis(fact, target, compare=False),
        "weeks": weekly_series(fact, target, fact_raw),
    }
