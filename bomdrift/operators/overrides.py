"""User overrides, applied when the facts are read."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.functions.measures import zero
from bomdrift.operators import pages
from bomdrift.operators.combine import delete_keys, upsert
from bomdrift.operators.selection import contains_text


def drop_excluded(fact: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop rows whose component or parent is excluded: two anti joins on equality."""
    ids = excluded.select("item_id")
    for column in ("component_id", "parent_id"):
        fact = fact.join(ids.withColumnRenamed("item_id", column), column, "left_anti")
    return fact


def _overridden(fact: DataFrame, bom_over: DataFrame) -> DataFrame:
    rows = bom_over.select(
        "parent_id",
        "component_id",
        F.col("active").alias("override_active"),
        F.col("bom_coef").alias("override_coef"),
    )
    return fact.join(rows, ["parent_id", "component_id"], "left")


def _active(joined: DataFrame) -> DataFrame:
    return joined.filter(F.coalesce("override_active", F.lit(True)))


def _recomputed(joined: DataFrame) -> DataFrame:
    coef = F.col("override_coef")
    expected = (F.col("produced_qty") * coef).cast(S.QTY)
    variance = (expected - F.col("actual_qty")).cast(S.QTY)
    new = {
        "bom_coef": coef,
        "expected_qty": expected,
        "variance_qty": variance,
        "variance_pct": F.when(expected > 0, variance / expected * 100).cast(S.QTY),
        "variance_value": (variance * F.coalesce("unit_cost", zero())).cast(S.QTY),
        "product_equivalent": F.when(F.col("is_uniform") & (coef > 0), variance / coef).cast(S.QTY),
    }
    return joined.withColumns(
        {
            name: F.when(coef.isNotNull(), value).otherwise(F.col(name))
            for name, value in new.items()
        }
    )


def drop_inactive(fact: DataFrame, bom_over: DataFrame) -> DataFrame:
    """Drop rows of deactivated BOM lines."""
    return _active(_overridden(fact, bom_over)).select(*fact.columns)


def override_coef(fact: DataFrame, bom_over: DataFrame) -> DataFrame:
    """Recompute the measures of rows whose coefficient is overridden; keep the others.

    The uniformity flag keeps its stored value, and the stored type is not recomputed:
    analytic views derive the type from the selection's tolerances.
    """
    return _recomputed(_overridden(fact, bom_over)).select(*fact.columns)


def effective(fact: DataFrame, bom_over: DataFrame, excluded: DataFrame) -> DataFrame:
    """Weekly or order facts as the user sees them. One override join, two anti joins."""
    joined = _overridden(drop_excluded(fact, excluded), bom_over)
    return _recomputed(_active(joined)).select(*fact.columns)


def adjustments(pairs: DataFrame, bom_over: DataFrame, excluded: DataFrame) -> DataFrame:
    """What the users' edits change, by (parent, component): dropped pairs and replaced coefficients.

    `pairs` are those that occur in the facts. Exclusions of either item are resolved here, on pairs, so that a fact
    takes all edits by one join on the pair, which its buckets serve without a shuffle.
    """
    ids = excluded.select("item_id").distinct()
    by_parent = pairs.join(ids.withColumnRenamed("item_id", "parent_id"), "parent_id", "left_semi")
    by_component = pairs.join(ids.withColumnRenamed("item_id", "component_id"), "component_id", "left_semi")
    none = F.lit(None).cast(S.QTY).alias("override_coef")
    dropped = by_parent.select(*BOM_KEY).union(by_component.select(*BOM_KEY)).select(*BOM_KEY, F.lit(True).alias("dropped"), none)
    lines = bom_over.select(*BOM_KEY, ~F.coalesce("active", F.lit(True)).alias("dropped"), F.col("bom_coef").alias("override_coef"))
    return dropped.union(lines).groupBy(*BOM_KEY).agg(
        F.bool_or("dropped").alias("dropped"), F.max("override_coef").alias("override_coef"))


def adjusted(fact: DataFrame, changes: DataFrame) -> DataFrame:
    """Weekly or order facts as the user sees them, by one join with the adjustments of their pairs."""
    joined = fact.join(changes, BOM_KEY, "left").filter(~F.coalesce("dropped", F.lit(False)))
    return _recomputed(joined).select(*fact.columns)


# -- editing -------------------------------------------------------------------


BOM_KEY = ["parent_id", "component_id"]


def keys_of(spark: SparkSession, keys: DataFrame | Sequence, names: list[str]) -> DataFrame:
    """Keys of one action, each once: a table of any size, or a list."""
    if not isinstance(keys, DataFrame):
        if not keys:
            raise ValueError("no row selected")
        rows = [k if isinstance(k, tuple) else (k,) for k in keys]
        keys = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return keys.select(*names).distinct()


def _marked(keys: DataFrame, schema, **values: object) -> DataFrame:
    """Keys with the same further columns on every row, in the schema's order and types."""
    return keys.select(*[
        (F.lit(values[f.name]) if f.name in values else F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def exclusion_rows(
    spark: SparkSession, item_ids: DataFrame | Sequence[str], reason: str | None, author: str | None, at: datetime
) -> DataFrame:
    """The rows that exclude items."""
    keys = keys_of(spark, item_ids, ["item_id"])
    return _marked(keys, S.EXCLUSION, reason=reason, modified_by=author, modified_at=at)


def override_rows(
    spark: SparkSession, pairs: DataFrame | Sequence[tuple[str, str]], active: bool,
    coef: float | Decimal | None, reason: str | None, author: str | None, at: datetime,
) -> DataFrame:
    """The rows that deactivate BOM lines or replace their coefficient."""
    if coef is not None and coef <= 0:
        raise ValueError("a BOM coefficient must be positive; deactivate the line instead")
    return _marked(
        keys_of(spark, pairs, BOM_KEY), S.BOM_OVERRIDE, active=active,
        bom_coef=None if coef is None else Decimal(str(coef)), reason=reason, modified_by=author,
        modified_at=at,
    )


def exclude_items(
    excluded: DataFrame, item_ids: DataFrame | Sequence[str], reason: str | None,
    author: str | None, at: datetime,
) -> DataFrame:
    """Exclude items, or renew the reason of those already excluded."""
    return upsert(excluded, exclusion_rows(excluded.sparkSession, item_ids, reason, author, at), ["item_id"])


def include_items(excluded: DataFrame, item_ids: DataFrame | Sequence[str]) -> DataFrame:
    """Take items back into the analysis."""
    return delete_keys(excluded, keys_of(excluded.sparkSession, item_ids, ["item_id"]), ["item_id"])


def override_bom(
    bom_over: DataFrame, pairs: DataFrame | Sequence[tuple[str, str]], active: bool,
    coef: float | Decimal | None, reason: str | None, author: str | None, at: datetime,
) -> DataFrame:
    """Deactivate BOM lines or replace their coefficient (None keeps the original)."""
    new = override_rows(bom_over.sparkSession, pairs, active, coef, reason, author, at)
    return upsert(bom_over, new, BOM_KEY)


def reset_bom(bom_over: DataFrame, pairs: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """Remove overrides: the lines are again those of the source."""
    return delete_keys(bom_over, keys_of(bom_over.sparkSession, pairs, BOM_KEY), BOM_KEY)


def override_summary(excluded: DataFrame, bom_over: DataFrame) -> DataFrame:
    """Number of excluded items, deactivated lines and corrected coefficients."""
    none = F.lit(None)
    rows = excluded.select(F.lit(True).alias("excluded"), none.cast("boolean").alias("active"),
                           none.cast(S.QTY).alias("bom_coef"))
    lines = bom_over.select(none.cast("boolean").alias("excluded"), "active", "bom_coef")
    return rows.unionByName(lines).agg(
        F.count_if(F.col("excluded")).alias("excluded_items"),
        F.count_if(~F.col("active")).alias("deactivated_lines"),
        F.count_if(F.col("bom_coef").isNotNull()).alias("corrected_lines"),
    )


# -- catalogues ----------------------------------------------------------------


def _searched(df: DataFrame, columns: list[str], term: str | None) -> DataFrame:
    """Rows where any of the columns holds the term; pattern characters are literal."""
    term = (term or "").strip()
    if not term:
        return df
    any_column = F.lit(False)
    for column in columns:
        any_column = any_column | contains_text([column], term)
    return df.filter(any_column)


# Columns that the catalogues sort on, and their tie-breakers.
ITEM_SORTS = (
    "item_id", "item_name", "category", "program", "line", "product_type", "unit_cost", "abs_impact",
    "variance_week_count", "excluded",
)
ITEM_TIES = (("item_id", False),)
BOM_SORTS = (
    "parent_id", "component_id", "parent_name", "component_name", "line", "original_coef", "effective_coef", "active",
    "modified_at",
)
BOM_TIES = (("parent_id", False), ("component_id", False))


def item_order(sort: str = "abs_impact", desc: bool = True) -> list[tuple[str, bool]]:
    """The order of the item catalogue by one of its sort columns; others are refused."""
    return pages.allowed(ITEM_SORTS, ITEM_TIES, sort, desc)


def bom_order(sort: str = "parent_id", desc: bool = False) -> list[tuple[str, bool]]:
    """The order of the BOM catalogue by one of its sort columns; others are refused."""
    return pages.allowed(BOM_SORTS, BOM_TIES, sort, desc)


def item_catalogue(
    dim_item: DataFrame, agg_component: DataFrame, excluded: DataFrame,
    state: str = "all", search: str | None = None,
) -> DataFrame:
    """Items with the impact they carry and their exclusion. States: all, excluded, included."""
    impact = agg_component.groupBy(F.col("component_id").alias("item_id")).agg(
        F.sum(F.abs("variance_value")).alias("abs_impact"),
        F.sum("variance_week_count").alias("variance_week_count"),
    )
    marks = excluded.select(
        "item_id", F.lit(True).alias("excluded"), "reason", "modified_by", "modified_at"
    )
    items = _searched(dim_item, ["item_id", "item_name", "category"], search)
    rows = items.join(marks, "item_id", "left")
    if state == "excluded":
        rows = rows.filter(F.col("excluded").isNotNull())
    elif state == "included":
        rows = rows.filter(F.col("excluded").isNull())
    elif state != "all":
        raise ValueError(f"unknown state {state}")
    return rows.join(impact, "item_id", "left").select(
        "item_id", "item_name", "category", "program", "line", "product_type", "unit_cost", "unit",
        F.coalesce("abs_impact", zero()).alias("abs_impact"),
        F.coalesce("variance_week_count", F.lit(0)).alias("variance_week_count"),
        F.coalesce("excluded", F.lit(False)).alias("excluded"),
        "reason", "modified_by", "modified_at",
    )


def bom_catalogue(
    dim_bom: DataFrame, dim_item: DataFrame, bom_over: DataFrame,
    state: str = "all", search: str | None = None,
) -> DataFrame:
    """BOM lines with original and effective coefficient. States: all, overridden, deactivated."""
    marks = bom_over.select(
        "parent_id", "component_id", F.lit(True).alias("overridden"), "active",
        F.col("bom_coef").alias("override_coef"), "reason", "modified_by", "modified_at",
    )
    parents = dim_item.select(
        F.col("item_id").alias("parent_id"), F.col("item_name").alias("parent_name"), "line"
    )
    components = dim_item.select(
        F.col("item_id").alias("component_id"), F.col("item_name").alias("component_name"),
        F.col("unit").alias("component_unit"),
    )
    rows = dim_bom.select("parent_id", "component_id", "bom_id", "bom_coef").join(
        marks, ["parent_id", "component_id"], "left"
    )
    if state == "overridden":
        rows = rows.filter(F.col("overridden").isNotNull())
    elif state == "deactivated":
        rows = rows.filter(F.col("active") == F.lit(False))
    elif state != "all":
        raise ValueError(f"unknown state {state}")
    rows = rows.join(parents, "parent_id", "left").join(components, "component_id", "left")
    rows = _searched(rows, ["parent_id", "component_id", "parent_name", "component_name"], search)
    return rows.select(
        "parent_id", "component_id", "bom_id", "parent_name", "component_name", "line",
        F.col("component_unit").alias("unit"),
        F.col("bom_coef").alias("original_coef"),
        F.coalesce("override_coef", "bom_coef").alias("effective_coef"),
        F.coalesce("active", F.lit(True)).alias("active"),
        F.col("override_coef").isNotNull().alias("coef_overridden"),
        "reason", "modified_by", "modified_at",
    )


def empty_exclusions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.EXCLUSION)


def empty_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.BOM_OVERRIDE)
