"""Production, consumption and variance facts.

The movement–origin join is the one pass over raw data. It is aggregated right away to
(category, order, company, item, week); the order grain rolls that up, and the weekly grain
rolls up the order grain. Sums of exact decimals, counts and minima make each roll-up equal
to a direct aggregation of the movements, and a hot order or item is reduced to one row per
task before any shuffle on its key.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bomdrift import schemas as S
from bomdrift.functions.calendar import iso_week, week_start
from bomdrift.functions.measures import order_status_label, variance_measures, zero

WEEK_KEYS = ["week_start", "parent_id", "component_id"]
ORDER_KEYS = ["order_id", "parent_id", "component_id", "week_start"]


def stock_flows(movements: DataFrame, origins: DataFrame, date_from: date | str) -> DataFrame:
    """Receipts (positive only) and BOM issues by order, company, item and week."""
    since = F.lit(str(date_from)).cast("date")
    links = origins.filter(F.col("category").isin(S.RECEIPT, S.ISSUE)).select(
        "origin_id", "category", "order_id", "company"
    )
    return (
        movements.filter(F.col("physical_date") >= since)
        .select("origin_id", "item_id", "qty", "physical_date")
        .join(links, "origin_id")
        .filter((F.col("category") == S.ISSUE) | (F.col("qty") > 0))
        .groupBy(
            "category", "order_id", "company", "item_id",
            week_start("physical_date").alias("week_start"),
        )
        .agg(
            F.sum("qty").alias("qty"),
            F.count(F.lit(1)).alias("movement_count"),
            F.count_if(F.col("qty") > 0).alias("positive_count"),
            F.min("physical_date").alias("first_date"),
            F.max("physical_date").alias("last_date"),
        )
    )


def order_production(flows: DataFrame) -> DataFrame:
    """Produced quantity by (order, parent, week); a NULL order stays a group."""
    return (
        flows.filter(F.col("category") == S.RECEIPT)
        .groupBy("order_id", F.col("item_id").alias("parent_id"), "week_start")
        .agg(
            F.sum("qty").cast(S.QTY).alias("produced_qty"),
            F.sum("movement_count").alias("receipt_count"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
        )
    )


def order_consumption(flows: DataFrame, orders: DataFrame) -> DataFrame:
    """Net consumption by (order, parent, component, week).

    Issues leave stock as negative quantities; returns come back as positive ones and are
    deducted. The order must exist in the company of the movement's origin. The company is a
    condition and no key of the join, so that rows are dealt by order once, for the join and the sums.
    """
    owners = orders.select(F.col("order_id").alias("owned"), F.col("company").alias("owner"), "parent_id")
    same_company = F.array_contains(F.array("owner"), F.col("company"))
    return (
        flows.filter(F.col("category") == S.ISSUE)
        .join(owners, (F.col("order_id") == F.col("owned")) & same_company)
        .groupBy("order_id", "parent_id", F.col("item_id").alias("component_id"), "week_start")
        .agg(
            (-F.sum("qty")).cast(S.QTY).alias("actual_qty"),
            F.sum("movement_count").alias("issue_count"),
            F.sum("positive_count").alias("return_count"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
        )
    )


def _parent_axis(dim_item: DataFrame) -> DataFrame:
    return dim_item.select(
        F.col("item_id").alias("parent_id"),
        F.col("program").alias("parent_program"),
        F.col("line").alias("parent_line"),
        F.col("item_name").alias("parent_name"),
        F.col("category").alias("parent_category"),
    )


def _with_parent(df: DataFrame, dim_item: DataFrame) -> DataFrame:
    return df.join(_parent_axis(dim_item), "parent_id", "left").fillna(
        S.UNKNOWN, ["parent_program", "parent_line", "parent_category"]
    )


def fact_production(order_production: DataFrame, dim_item: DataFrame) -> DataFrame:
    """Weekly production by parent."""
    weekly = order_production.groupBy("week_start", "parent_id").agg(
        F.sum("produced_qty").cast(S.QTY).alias("produced_qty"),
        F.sum("receipt_count").alias("receipt_count"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    return _with_parent(weekly, dim_item).select(
        *iso_week("week_start"),
        "parent_id", "parent_program", "parent_line", "parent_name", "parent_category",
        "produced_qty", "receipt_count", "first_date", "last_date",
    )


def fact_consumption(order_consumption: DataFrame, dim_item: DataFrame) -> DataFrame:
    """Weekly net consumption by parent and component."""
    weekly = order_consumption.groupBy(*WEEK_KEYS).agg(
        F.sum("actual_qty").cast(S.QTY).alias("actual_qty"),
        F.sum("issue_count").alias("issue_count"),
        F.sum("return_count").alias("return_count"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    return _with_parent(weekly, dim_item).select(
        *iso_week("week_start"),
        "parent_id", "component_id", "parent_program",
        "actual_qty", "issue_count", "return_count", "first_date", "last_date",
    )


def explode_bom(production: DataFrame, dim_bom: DataFrame) -> DataFrame:
    """Production × BOM: expected quantity of each component.

    An equi-join on the parent. Spark broadcasts the BOM when its measured size allows, and
    splits a hot parent at run time otherwise.
    """
    lines = dim_bom.select("parent_id", "component_id", "bom_coef")
    keys = [c for c in ("order_id", "week_start") if c in production.columns]
    return production.select(*keys, "parent_id", "produced_qty").join(lines, "parent_id").select(
        *keys,
        "parent_id",
        "component_id",
        "bom_coef",
        "produced_qty",
        (F.col("produced_qty") * F.col("bom_coef")).cast(S.QTY).alias("expected_qty"),
    )


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match of expected and actual rows, with the line status.

    Both sides hold at most one row per key, so no key can be hot. Rows with a NULL key do
    not match and stay one-sided.
    """
    left = expected.select(*keys, "bom_coef", "produced_qty", "expected_qty")
    right = actual.select(*keys, "actual_qty", "issue_count", "return_count")
    return _matched(left.join(right, keys, "full_outer"), keys)


def _matched(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides of a key as one row: zero for what a side lacks, and the line status."""
    return rows.select(
        *keys,
        "bom_coef",
        F.coalesce("produced_qty", zero()).alias("produced_qty"),
        F.coalesce("expected_qty", zero()).alias("expected_qty"),
        F.coalesce("actual_qty", zero()).alias("actual_qty"),
        F.coalesce("issue_count", F.lit(0)).alias("issue_count"),
        F.coalesce("return_count", F.lit(0)).alias("return_count"),
        F.when(F.col("expected_qty").isNull(), S.OFF_BOM)
        .when(F.col("issue_count").isNull(), S.NO_CONSUMPTION)
        .otherwise(S.NOMINAL)
        .alias("line_status"),
    )


def reconcile_orders(
    production: DataFrame, consumption: DataFrame, dim_bom: DataFrame, orders: DataFrame,
    tasks: int | None = None,
) -> DataFrame:
    """`reconcile` of production exploded by the BOM and consumption by order, with the order's header.

    All steps deal rows by order, so both sides and the headers are shuffled once, and production
    before it is exploded. A row with a NULL key stays one-sided, as in the join. `tasks` is the
    least number of partitions; without it, it is that of the session.
    """
    tasks = max(tasks or 0, int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if tasks else None

    def by_order(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "order_id") if tasks else df.repartition("order_id")

    headers = order_header(by_order(orders)).withColumnsRenamed(
        {"bom_id": "order_bom_id", "close_date": "order_close_date"}
    )
    bills = dim_bom.groupBy("parent_id").agg(
        F.collect_list(F.struct("component_id", "bom_coef")).alias("lines")
    )
    sides = production.select(
        "order_id", "parent_id", "week_start", F.lit(True).alias("made"), "produced_qty"
    ).unionByName(
        consumption.select(
            "order_id", "parent_id", "week_start", F.lit(False).alias("made"), "component_id",
            "actual_qty", "issue_count", "return_count",
        ),
        allowMissingColumns=True,
    )
    own = F.array(F.struct("component_id", F.lit(None).cast(S.QTY).alias("bom_coef")))
    lines = F.when(F.col("made"), F.col("lines")).otherwise(own)
    exploded = by_order(sides).join(bills, "parent_id", "left").select(
        "order_id", "parent_id", "week_start", "made", "produced_qty", "actual_qty", "issue_count",
        "return_count", F.inline(lines),
    )
    null_key = reduce(or_, [F.col(k).isNull() for k in ORDER_KEYS])
    values = ["bom_coef", "produced_qty", "actual_qty", "issue_count", "return_count"]
    rows = exploded.groupBy(*ORDER_KEYS, F.when(null_key, F.col("made")).alias("side")).agg(
        *[F.max(v).alias(v) for v in values]
    )
    return rows.join(headers, "order_id", "left").select(
        *ORDER_KEYS, *values, "order_bom_id", "order_close_date", "status"
    )


def _expected(rows: DataFrame) -> DataFrame:
    """The expected quantity of rows that have a produced one."""
    return rows.withColumn("expected_qty", (F.col("produced_qty") * F.col("bom_coef")).cast(S.QTY))


def _enrich(df: DataFrame, dim_item: DataFrame, line_coef: DataFrame, tolerance: float) -> DataFrame:
    components = dim_item.select(
        F.col("item_id").alias("component_id"),
        F.col("item_name").alias("component_name"),
        F.col("category").alias("component_category"),
        F.col("program").alias("component_program"),
        F.col("unit").alias("component_unit"),
        "unit_cost",
    )
    uniform = line_coef.select(F.col("line").alias("parent_line"), "component_id", "is_uniform")
    enriched = (
        _with_parent(df, dim_item)
        .join(components, "component_id", "left")
        .join(uniform, ["parent_line", "component_id"], "left")
        .fillna(S.UNKNOWN, ["component_category", "component_program"])
        .fillna(S.DEFAULT_UNIT, ["component_unit"])
        .fillna(False, ["is_uniform"])
    )
    return variance_measures(enriched, tolerance)


_MEASURES = [
    "bom_coef", "produced_qty", "actual_qty", "expected_qty", "variance_qty", "variance_pct",
    "variance_type", "line_status", "unit_cost", "variance_value", "is_uniform",
    "product_equivalent", "issue_count", "return_count",
]


def fact_variance(
    production: DataFrame,
    consumption: DataFrame,
    dim_bom: DataFrame,
    dim_item: DataFrame,
    line_coef: DataFrame,
    tolerance: float = 0.5,
) -> DataFrame:
    """Main fact: variance by week, parent and component."""
    base = reconcile(explode_bom(production, dim_bom), consumption, WEEK_KEYS)
    return _enrich(base, dim_item, line_coef, tolerance).select(
        *iso_week("week_start"),
        "parent_id", "parent_program", "parent_line", "parent_name", "parent_category",
        "component_id", "component_name", "component_category", "component_program",
        "component_unit", *_MEASURES,
    )


def order_header(orders: DataFrame) -> DataFrame:
    """One header per order id: last close date, then first company."""
    best = W.partitionBy("order_id").orderBy(
        F.col("close_date").desc_nulls_last(), F.col("company").asc()
    )
    return (
        orders.withColumn("header_rank", F.row_number().over(best))
        .filter(F.col("header_rank") == 1)
        .select("order_id", "bom_id", "status", "close_date")
    )


def fact_variance_order(
    order_production: DataFrame,
    order_consumption: DataFrame,
    orders: DataFrame,
    dim_bom: DataFrame,
    dim_item: DataFrame,
    line_coef: DataFrame,
    tolerance: float = 0.5,
    arranged: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    tasks: int | None = None,
) -> DataFrame:
    """The same variance one level finer, by production order.

    `arranged` deals the rows to tasks as they are to be written, while they are narrow: items,
    labels and measures are added after it.
    """
    base = arranged(reconcile_orders(order_production, order_consumption, dim_bom, orders, tasks))
    headed = _matched(_expected(base), [*ORDER_KEYS, "order_bom_id", "order_close_date", "status"]).withColumn(
        "order_status", order_status_label(F.col("status"))
    )
    return _enrich(headed, dim_item, line_coef, tolerance).select(
        *iso_week("week_start"),
        "order_id", "order_bom_id", "order_close_date", "order_status",
        "parent_id", "parent_program", "parent_line", "parent_name", "parent_category",
        "component_id", "component_name", "component_category", "component_unit", *_MEASURES,
    )
