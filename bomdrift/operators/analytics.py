"""Aggregate views of a selection: indicators, series, rankings, totals.

`fact` is the effective fact (see overrides.effective) unless a parameter says otherwise.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.functions import rates
from bomdrift.functions.calendar import iso_week, week_label, week_start
from bomdrift.functions.measures import order_status_rank, ratio_pct, zero
from bomdrift.operators.combine import one_row
from bomdrift.operators.selection import Selection

VALUE, QUANTITY = "value", "quantity"
# Bounds of the rankings.
STALE_HOURS = 30
DIMENSIONS = {
    "program": "parent_program",
    "line": "parent_line",
    "category": "component_category",
    "line_status": "line_status",
    "type": None,
}
_COUNTS = (
    "row_count", "variance_row_count", "parent_count", "component_count", "program_count",
    "line_count", "week_count",
)


def _check_measure(measure: str) -> None:
    if measure not in (VALUE, QUANTITY):
        raise ValueError(f"unknown measure {measure}")


_SUMMED = {
    "expected_qty": "expected_qty",
    "actual_qty": "actual_qty",
    "expected_value": "expected_qty * coalesce(unit_cost, 0)",
    "variance_qty": "variance_qty",
    "under_qty": "greatest(variance_qty, 0)",
    "over_qty": "greatest(-variance_qty, 0)",
    "variance_value": "variance_value",
    "under_value": "greatest(variance_value, 0)",
    "over_value": "greatest(-variance_value, 0)",
    "abs_value": "abs(variance_value)",
    "abs_qty": "abs(variance_qty)",
    "product_equivalent": "product_equivalent",
}
MEASURES = (*_COUNTS, *_SUMMED)
_DISTINCT = {
    "parent_count": "parent_id",
    "component_count": "component_id",
    "program_count": "parent_program",
    "line_count": "parent_line",
    "week_count": "week_start",
}


def measures(sel: Selection) -> list[Column]:
    """The 19 measures; an empty selection gives zeros."""
    off = f"({sel.variance_type_sql()}) != '{S.CONFORMING}'"
    texts = [
        "count(1) AS row_count",
        f"count_if({off}) AS variance_row_count",
        *[f"count(DISTINCT {column}) AS {name}" for name, column in _DISTINCT.items()],
        *[f"coalesce(sum({x}), 0) AS {name}" for name, x in _SUMMED.items()],
    ]
    return [F.expr(text) for text in texts]


def impact(measure: str) -> str:
    """Measure a ranking is ordered by."""
    _check_measure(measure)
    return "abs_value" if measure == VALUE else "abs_qty"


def aggregate(fact: DataFrame, sel: Selection) -> DataFrame:
    """One row of measures for the selection."""
    return sel.apply(fact).agg(*measures(sel))


# -- indicators ------------------------------------------------------------------

# key, unit, format and favourable direction by measure mode.
_KPIS = (
    ("net_variance", "euro", "unit", "neutral"),
    ("under_consumption", "euro", "unit", "down"),
    ("over_consumption", "euro", "unit", "down"),
    ("reliability", "percent", "percent", "up"),
    ("conformity_rate", "percent", "percent", "up"),
    ("global_pct", "percent", "percent", "neutral"),
    ("component_count", "count", "count", "neutral"),
    ("variance_row_count", "count", "count", "down"),
)


def _kpi_values(measure: str, prefix: str) -> list[str]:
    value = measure == VALUE
    d = lambda name: f"CAST({prefix}{name} AS DOUBLE)"
    reliability = rates.reliability_value_sql if value else rates.reliability_qty_sql
    return [
        d("variance_value" if value else "variance_qty"),
        d("under_value" if value else "under_qty"),
        d("over_value" if value else "over_qty"),
        reliability(prefix),
        rates.conformity_rate_sql(prefix),
        rates.global_pct_sql(prefix),
        d("component_count"),
        d("variance_row_count"),
    ]


def kpi_rows(bundle: DataFrame, measure: str = VALUE, compared: bool = False) -> DataFrame:
    """Indicators, one row each, from a row of cur_* (and prev_*) measures."""
    _check_measure(measure)
    current, previous = _kpi_values(measure, "cur_"), _kpi_values(measure, "prev_")
    rows = []
    for position, (spec, cur, prev) in enumerate(zip(_KPIS, current, previous, strict=True), 1):
        key, unit_value, unit_qty, good = spec
        unit = unit_value if measure == VALUE else unit_qty
        none = "CAST(NULL AS DOUBLE)"
        pct, change = rates.variation_sql(cur, prev) if compared else (none, none)
        rows.append(
            f"named_struct('position', {position}, 'indicator', '{key}', 'unit', '{unit}',"
            f" 'favourable', '{good}', 'value', {cur}, 'change_pct', {pct}, 'change', {change})"
        )
    return bundle.selectExpr(f"inline(array({', '.join(rows)}))")


def kpis(fact: DataFrame, sel: Selection, measure: str = VALUE, compare: bool = True) -> DataFrame:
    """Eight indicators with their change against the previous period.

    Both periods are read in one pass and told apart by a flag. Without both dates there is
    no previous period and the changes are NULL.
    """
    compared = compare and bool(sel.date_from and sel.date_to)
    if not compared:
        bundle = aggregate(fact, sel)
        return kpi_rows(bundle.selectExpr(*[f"{m} AS cur_{m}" for m in MEASURES]), measure)
    now, before = sel.predicate(fact), sel.previous().predicate(fact)
    by_period = (
        sel.restricted(fact).withColumn("period", F.when(now, "cur").when(before, "prev"))
        .filter(now | before)
        .groupBy("period")
        .agg(*measures(sel))
    )
    sides = [
        F.expr(f"coalesce(max(CASE WHEN period = '{side}' THEN {m} END), 0) AS {side}_{m}")
        for side in ("cur", "prev")
        for m in MEASURES
    ]
    return kpi_rows(by_period.agg(*sides), measure, compared=True)


# -- series ----------------------------------------------------------------------


def week_calendar(fact_raw: DataFrame, selected: DataFrame, sel: Selection) -> DataFrame:
    """Every Monday of the selection, clipped to the raw fact's extent.

    No week at all when the selection holds no row. `selected` is the filtered effective fact.
    """
    extent = fact_raw.agg(F.min("week_start").alias("first"), F.max("week_start").alias("last"))
    present = selected.select("week_start").limit(1).agg(F.count(F.lit(1)).alias("rows"))
    start, stop = F.col("first"), F.col("last")
    if sel.date_from:
        start = F.greatest(week_start(F.lit(sel.date_from)), start)
    if sel.date_to:
        stop = F.least(week_start(F.lit(sel.date_to)), stop)
    weeks = F.sequence(start, stop, F.expr("interval 7 days"))
    return (
        one_row(extent, present)
        .filter((F.col("rows") > 0) & (start <= stop))
        .select(F.explode(weeks).alias("week_start"))
        .select(*iso_week("week_start"))
    )


def weekly_series(fact: DataFrame, sel: Selection, fact_raw: DataFrame) -> DataFrame:
    """Measures by week on a calendar without gaps; quiet weeks carry zeros."""
    selected = sel.apply(fact)
    by_week = selected.groupBy("week_start").agg(*measures(sel))
    calendar = week_calendar(fact_raw, selected, sel)
    labelled = calendar.withColumn("week_label", week_label("iso_year", "iso_week"))
    return labelled.join(by_week, "week_start", "left").selectExpr(
        "week_start", "iso_year", "iso_week", "week_label",
        *[f"coalesce({m}, 0) AS {m}" for m in MEASURES],
    )


def full_chronology(fact: DataFrame, sel: Selection, fact_raw: DataFrame) -> DataFrame:
    """The series of the selection without any date bound."""
    return weekly_series(fact, sel.without_dates(), fact_raw)


def last_week_change(series: DataFrame, measure: str = VALUE) -> DataFrame:
    """Absolute impact of the last week against the one before; empty below two weeks."""
    two = (
        series.select("week_start", F.col(impact(measure)).alias("impact"))
        .orderBy(F.col("week_start").desc())
        .limit(2)
    )
    return (
        two.agg(
            F.count(F.lit(1)).alias("weeks"),
            F.max("week_start").alias("week_start"),
            F.max_by("impact", "week_start").alias("last_impact"),
            F.min_by("impact", "week_start").alias("previous_impact"),
        )
        .filter(F.col("weeks") == 2)
        .select(
            "week_start", "last_impact", "previous_impact",
            (F.col("last_impact") - F.col("previous_impact")).alias("change"),
        )
    )


# -- rankings --------------------------------------------------------------------


def distribution(
    fact: DataFrame, sel: Selection, dimension: str, measure: str = VALUE, limit: int | None = None
) -> DataFrame:
    """Measures by program, line, category, line status or dynamic type, largest impact first."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension}")
    column = DIMENSIONS[dimension]
    label = F.col(column) if column else sel.variance_type()
    groups = (
        sel.apply(fact)
        .groupBy(label.alias("label"))
        .agg(*measures(sel))
        .orderBy(F.col(impact(measure)).desc(), "label")
    )
    return groups if limit is None else groups.limit(limit)


def top_components(
    fact: DataFrame, sel: Selection, limit: int = 10, measure: str = VALUE
) -> DataFrame:
    """Components (by program) of largest absolute impact."""
    return (
        sel.apply(fact)
        .groupBy("component_id", "parent_program")
        .agg(
            F.max("component_name").alias("component_name"),
            F.max("component_category").alias("component_category"),
            *measures(sel),
        )
        .orderBy(F.col(impact(measure)).desc(), "component_id", "parent_program")
        .limit(limit)
    )


def concentration(
    fact: DataFrame, sel: Selection, head: int = 10, measure: str = VALUE
) -> DataFrame:
    """Share of the first components in the total absolute impact.

    The head is a top-k, which Spark keeps distributed; no window over all components.
    """
    _check_measure(measure)
    amount = F.abs("variance_value" if measure == VALUE else "variance_qty")
    by_component = (
        sel.apply(fact)
        .groupBy("component_id")
        .agg(F.coalesce(F.sum(amount), zero()).alias("impact"))
    )
    first = by_component.orderBy(F.col("impact").desc(), "component_id").limit(head)
    return one_row(
        by_component.agg(
            F.count(F.lit(1)).alias("component_count"),
            F.coalesce(F.sum("impact"), zero()).alias("total_impact"),
        ),
        first.agg(F.coalesce(F.sum("impact"), zero()).alias("head_impact")),
    ).select(
        "component_count",
        F.lit(head).alias("head"),
        "total_impact",
        "head_impact",
        F.coalesce(ratio_pct(F.col("head_impact"), F.col("total_impact")), F.lit(0.0))
        .alias("head_share_pct"),
    )


def deduplicated_production(selected: DataFrame, keys: list[str]) -> DataFrame:
    """Produced quantity once per key: it is repeated on each component row."""
    return selected.groupBy(*keys).agg(F.max("produced_qty").alias("produced_qty"))


def conformity_pct() -> Column:
    """Conformity of a group; NULL on an empty group."""
    rows, off = F.col("row_count").cast("double"), F.col("variance_row_count").cast("double")
    return F.when(rows > 0, (rows - off) / rows * 100)


def totals(fact: DataFrame, sel: Selection) -> DataFrame:
    """Totals of a whole selection; on the order fact, production is also split by order."""
    selected = sel.apply(fact)
    keys = [c for c in ("order_id", "parent_id", "week_start") if c in fact.columns]
    production = deduplicated_production(selected, keys).agg(
        F.coalesce(F.sum("produced_qty"), zero()).alias("produced_qty")
    )
    return one_row(selected.agg(*measures(sel)), production).select(
        *MEASURES,
        "produced_qty",
        conformity_pct().alias("conformity_rate"),
        ratio_pct(F.col("variance_qty"), F.col("expected_qty")).alias("variance_pct"),
    )


# -- metadata --------------------------------------------------------------------


def filter_options(fact: DataFrame, fact_order: DataFrame) -> DataFrame:
    """Values of the filter lists, one row each, with a rank for display order.

    Order statuses follow the life cycle, unknown ones last; the week bounds come as dates.
    """
    pair = lambda name, column: F.struct(
        F.lit(name).alias("option"), F.col(column).alias("value")
    )
    lists = fact.select(
        F.inline(
            F.array(
                pair("program", "parent_program"),
                pair("line", "parent_line"),
                pair("category", "component_category"),
            )
        )
    )
    statuses = fact_order.select(F.lit("order_status").alias("option"),
                                 F.col("order_status").alias("value"))
    bounds = fact.agg(F.min("week_start").alias("first"), F.max("week_start").alias("last")).select(
        F.inline(
            F.array(
                F.struct(F.lit("first_week").alias("option"),
                         F.col("first").cast("string").alias("value")),
                F.struct(F.lit("last_week").alias("option"),
                         F.col("last").cast("string").alias("value")),
            )
        )
    )
    distinct = lists.unionByName(statuses).filter(F.col("value").isNotNull()).distinct()
    return distinct.unionByName(bounds).select(
        "option", "value",
        F.when(F.col("option") == "order_status", order_status_rank(F.col("value")))
        .otherwise(0).alias("rank"),
    )


def available_weeks(fact: DataFrame) -> DataFrame:
    return fact.select("week_start").distinct()


def freshness(log: DataFrame, dq: DataFrame, now: datetime) -> DataFrame:
    """Last load, failed tables, anomalies by severity, and whether the data are stale.

    The log holds one row per table and the checks one row per check.
    """
    loads = log.agg(
        F.max("ended_at").alias("last_load"),
        F.array_join(
            F.sort_array(
                F.collect_list(F.when(F.col("status") != S.LOAD_OK, F.col("table_name")))
            ),
            ",",
        ).alias("failed_tables"),
    )
    flagged = lambda severity: F.count_if(
        F.col("in_anomaly") & (F.col("severity") == severity)
    )
    checks = dq.agg(
        flagged(S.ERROR).alias("errors"),
        flagged(S.ALERT).alias("alerts"),
        flagged(S.INFO).alias("infos"),
    )
    age = F.lit(now).cast("timestamp").cast("double") - F.col("last_load").cast("double")
    return one_row(loads, checks).select(
        "last_load", "failed_tables", "errors", "alerts", "infos",
        F.coalesce(age > STALE_HOURS * 3600, F.lit(True)).alias("stale"),
        ((F.col("errors") > 0) | (F.col("failed_tables") != "")).alias("critical"),
    )
