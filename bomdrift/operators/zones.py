"""What a fact holds, week by week: a small table kept when the fact is written, read in place of the fact.

Bounds, week lists and filter lists come from it; it has one row a week, whatever the fact's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift.functions.measures import order_status_rank

# Filter lists and the columns whose values they offer.
LISTS = {"program": "parent_program", "line": "parent_line", "category": "component_category", "order_status": "order_status"}


def zone_map(fact: DataFrame) -> DataFrame:
    """One row a week: rows, and the distinct values of each filter list's column (short lists by their nature)."""
    lists = [F.sort_array(F.collect_set(c)).alias(name) for name, c in LISTS.items() if c in fact.columns]
    return fact.groupBy("week_start").agg(F.count(F.lit(1)).alias("row_count"), *lists)


def pairs(*facts: DataFrame) -> DataFrame:
    """Every (parent, component) that occurs in one of the facts."""
    found = None
    for fact in facts:
        own = fact.select("parent_id", "component_id").distinct()
        found = own if found is None else found.union(own)
    return found.distinct()


def filter_options(zones: DataFrame, zones_order: DataFrame) -> DataFrame:
    """Values of the filter lists with a rank for display order, and the week bounds, from the zone maps alone."""
    def offered(name: str) -> Column:
        return F.transform(name, lambda v: F.struct(F.lit(name).alias("option"), v.alias("value")))

    lists = zones.select(F.inline(F.concat(*map(offered, ("program", "line", "category")))))
    statuses = zones_order.select(F.lit("order_status").alias("option"), F.explode("order_status").alias("value"))
    bounds = zones.agg(F.min("week_start").alias("first"), F.max("week_start").alias("last")).select(F.inline(F.array(
        F.struct(F.lit("first_week").alias("option"), F.col("first").cast("string").alias("value")),
        F.struct(F.lit("last_week").alias("option"), F.col("last").cast("string").alias("value")),
    )))
    rank = F.when(F.col("option") == "order_status", order_status_rank(F.col("value"))).otherwise(0)
    return lists.unionByName(statuses).distinct().unionByName(bounds).select("option", "value", rank.alias("rank"))
