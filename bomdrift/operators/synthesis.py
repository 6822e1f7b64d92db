"""One production line seen as a cross-tab, and the orders behind one of its cells."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift.functions.measures import zero
from bomdrift.operators.analytics import VALUE, _check_measure
from bomdrift.operators.selection import Selection

_WEEK = ["week_start", "iso_year", "iso_week"]
_DASH = "—"


def _one_line(sel: Selection) -> None:
    if len(sel.lines) != 1:
        raise ValueError(f"the synthesis bears on one production line, {len(sel.lines)} given")


def synthesis_production(
    fact: DataFrame, dim_item: DataFrame, dim_bom: DataFrame, sel: Selection
) -> DataFrame:
    """Production of each parent and week of one line, valued at the parent's cost."""
    _one_line(sel)
    weekly = (
        sel.apply(fact)
        .groupBy("parent_id", *_WEEK)
        .agg(
            F.max("parent_name").alias("parent_name"),
            F.max("produced_qty").alias("produced_qty"),
        )
    )
    costs = dim_item.select(F.col("item_id").alias("parent_id"), "unit_cost")
    boms = dim_bom.groupBy("parent_id").agg(F.min("bom_id").alias("bom_id"))
    value = (F.col("produced_qty") * F.coalesce("unit_cost", zero())).alias("produced_value")
    return weekly.join(costs, "parent_id", "left").join(boms, "parent_id", "left").select(
        "parent_id", "parent_name", *_WEEK, "produced_qty", value, "bom_id"
    )


def synthesis_variance(fact: DataFrame, sel: Selection) -> DataFrame:
    """Variance of each uniform component and week of one line."""
    _one_line(sel)
    total = lambda name: F.coalesce(F.sum(name), zero()).alias(name)
    return (
        sel.apply(fact)
        .filter("is_uniform")
        .groupBy("component_id", *_WEEK)
        .agg(
            F.max("component_name").alias("component_name"),
            F.min("bom_coef").alias("bom_coef"),
            total("product_equivalent"),
            total("variance_value"),
            total("variance_qty"),
        )
    )


def week_column(monday: date) -> str:
    year, week, _ = monday.isocalendar()
    return f"w{year}_{week:02d}"


def _coef_text(coef: Column) -> Column:
    """Coefficient with up to four decimals, a comma and no trailing zeros."""
    text = coef.cast("decimal(20,4)").cast("string")
    short = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")
    return F.coalesce(F.when(coef.isNotNull(), F.translate(short, ".", ",")), F.lit(_DASH))


def crosstab(
    production: DataFrame, variance: DataFrame, calendar: DataFrame, measure: str = "quantity"
) -> DataFrame:
    """Reference × week table: production and variance rows, then the production total.

    Quantity mode compares produced units with product equivalents, value mode amounts.
    Production rows come by total, variance rows by absolute total. The share of the total
    row is Σ|component total| / production. Each input is read once: grouping sets give the rows and
    the total together. Only the calendar (one row per week) is read on the driver, to name the columns.
    """
    _check_measure(measure)
    made = "produced_value" if measure == VALUE else "produced_qty"
    gap = "variance_value" if measure == VALUE else "product_equivalent"
    weeks = [row.week_start for row in calendar.select("week_start").orderBy("week_start").collect()]
    kind = variance.schema[gap].dataType
    cell = lambda block, reference, name, bom, coef, week, amount: [
        F.lit(block).alias("block"), reference.alias("reference"), name.alias("name"), bom.alias("bom"),
        coef.alias("coef"), week.alias("week_start"), amount.alias("amount"),
    ]
    none = F.lit(None).cast("string")
    # A row of no block, so that the total is there even where no row is.
    anchor = production.sparkSession.range(1).select(
        *cell("none", none, none, none, zero(), F.lit(None).cast("date"), F.lit(0).cast(kind))
    )
    cells = production.select(
        *cell("production", F.col("parent_id"), F.col("parent_name"), F.col("bom_id"), zero(), F.col("week_start"), F.col(made))
    ).unionByName(
        variance.select(
            *cell("variance", F.col("component_id"), F.col("component_name"), none, F.col("bom_coef"), F.col("week_start"), F.col(gap))
        )
    ).unionByName(anchor)
    columns = [week_column(week) for week in weeks]
    rows = cells.groupBy("block", "reference").agg(
        F.max("name").alias("name"), F.max("bom").alias("bom"), F.min("coef").alias("coef"),
        *[
            F.expr(f"coalesce(sum(amount) FILTER (WHERE week_start = DATE '{week}'), 0) AS {name}")
            for week, name in zip(weeks, columns)
        ],
        F.sum("amount").alias("total"),
    )
    # Body and total in one aggregation: the rows are grouped by themselves and all together.
    is_made = F.col("block") == "production"
    whole = F.grouping_id() != 0
    counted = lambda name: F.when(
        whole, F.coalesce(F.sum(F.when(is_made, F.col(name))), zero())
    ).otherwise(F.sum(name)).alias(name)
    both = rows.groupingSets([["block", "reference"], []], "block", "reference").agg(
        whole.alias("whole"),
        F.max("name").alias("name"), F.max("bom").alias("bom"), F.min("coef").alias("coef"),
        *[counted(name) for name in [*columns, "total"]],
        F.coalesce(F.sum(F.when(F.col("block") == "variance", F.abs("total"))), zero()).alias("gaps"),
    ).filter(F.col("whole") | (F.col("block") != "none"))
    or_dash = lambda c: F.coalesce(c, F.lit(_DASH))
    pct = F.col("gaps").cast("double") / F.col("total").cast("double") * 100
    return both.select(
        F.when(F.col("whole"), "total").otherwise(F.col("block")).alias("block"),
        F.when(F.col("whole"), _DASH).otherwise(F.col("reference")).alias("reference"),
        F.when(F.col("whole"), _DASH).otherwise(or_dash(F.col("name"))).alias("name"),
        F.when(F.col("whole"), _DASH).when(is_made, or_dash(F.col("bom")))
        .otherwise(_coef_text(F.col("coef"))).alias("complement"),
        *columns, "total",
        F.when(F.col("whole"), F.when(F.col("total") != 0, pct).otherwise(F.lit(0.0))).alias("share_pct"),
    ).orderBy(F.col("block"), F.abs("total").desc(), F.col("reference"))


# -- orders behind a cell ----------------------------------------------------------


def _cell(fact: DataFrame, line: str, component: str, year: int, week: int) -> DataFrame:
    return fact.filter(
        (F.col("parent_line") == line)
        & (F.col("component_id") == component)
        & (F.col("iso_year") == year)
        & (F.col("iso_week") == week)
    )


def cell_orders(
    fact_order: DataFrame, line: str, component: str, year: int, week: int
) -> DataFrame:
    """All orders that moved the component that week; a list for display is the caller's to cut."""
    moved = _cell(fact_order, line, component, year, week)
    return moved.filter(F.col("order_id").isNotNull()).select("order_id").distinct()


def cell_figure(fact: DataFrame, line: str, component: str, year: int, week: int) -> DataFrame:
    """The cell's own figures at week grain."""
    total = lambda name: F.coalesce(F.sum(name), zero()).alias(name)
    return _cell(fact, line, component, year, week).agg(
        F.max("component_name").alias("component_name"),
        F.max("component_unit").alias("component_unit"),
        F.min("week_start").alias("week_start"),
        total("variance_qty"),
        total("product_equivalent"),
        total("variance_value"),
    )


def _rows_of(fact_order: DataFrame, orders: DataFrame, component: str) -> DataFrame:
    return fact_order.filter(F.col("component_id") == component).join(
        orders.select("order_id"), "order_id", "left_semi"
    )


def cell_weeks(fact_order: DataFrame, orders: DataFrame, component: str) -> DataFrame:
    """All weeks in which these orders moved the component."""
    return _rows_of(fact_order, orders, component).select(*_WEEK).distinct()


def cell_lines(
    fact_order: DataFrame, orders: DataFrame, line: str, component: str, year: int, week: int,
    block: str = "figure",
) -> DataFrame:
    """Rows of the cell's orders on its line and component, in two disjoint blocks.

    `figure` holds the clicked week and sums to the cell; `others` holds the other weeks.
    """
    same = (F.col("iso_year") == year) & (F.col("iso_week") == week)
    if block not in ("figure", "others"):
        raise ValueError(f"unknown block {block}")
    rows = _rows_of(fact_order, orders, component).filter(F.col("parent_line") == line)
    return rows.filter(same if block == "figure" else ~same).select(*fact_order.columns)
