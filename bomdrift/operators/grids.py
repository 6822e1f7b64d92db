"""The six grids: grain, columns, default order, pages and text export."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift.functions.calendar import week_label
from bomdrift.functions.measures import ratio_pct
from bomdrift.operators import pages
from bomdrift.operators.analytics import conformity_pct, deduplicated_production, measures
from bomdrift.operators.selection import Selection

TEXT, COUNT, DECIMAL, EURO, PERCENT, DATE, FLAG, BADGE = (
    "text", "count", "decimal", "euro", "percent", "date", "flag", "badge",
)


@dataclass(frozen=True)
class GridColumn:
    """A grid column: key, label, display type, decimals, and whether it sorts and shows."""

    key: str
    label: str
    kind: str = TEXT
    decimals: int = 0
    sortable: bool = True
    visible: bool = True


@dataclass(frozen=True)
class Grid:
    """A grid: row key, tie-breaking order, default sort and columns.

    `ties` lists (column, descending); it makes every page deterministic.
    """

    key: str
    row_key: tuple[str, ...]
    ties: tuple[tuple[str, bool], ...]
    columns: tuple[GridColumn, ...]
    default_sort: str = "abs_value"
    extra_sorts: tuple[str, ...] = ()

    @property
    def sortable(self) -> set[str]:
        return {c.key for c in self.columns if c.sortable} | set(self.extra_sorts)

    def chosen(self, keys: Sequence[str] | None) -> list[GridColumn]:
        """The asked columns that exist, in the asked order; else the visible ones."""
        by_key = {c.key: c for c in self.columns}
        found = [by_key[k] for k in keys or () if k in by_key]
        return found or [c for c in self.columns if c.visible]


def _col(key, label, kind=TEXT, decimals=0, sortable=True, visible=True) -> GridColumn:
    return GridColumn(key, label, kind, decimals, sortable, visible)


_WEEK = (_col("week_label", "Week", sortable=False), _col("week_start", "Monday", DATE))
_PROGRAM = _col("parent_program", "Program")
_LINE = _col("parent_line", "Line")
_DETAIL = (
    _PROGRAM,
    _LINE,
    _col("parent_id", "Parent"),
    _col("parent_name", "Parent name", visible=False),
    _col("component_id", "Component"),
    _col("component_name", "Component name"),
    _col("component_category", "Category"),
    _col("bom_coef", "BOM coefficient", DECIMAL, 4),
    _col("produced_qty", "Produced", DECIMAL),
    _col("expected_qty", "Expected", DECIMAL, 2),
    _col("actual_qty", "Actual", DECIMAL, 2),
    _col("variance_qty", "Variance", DECIMAL, 2),
    _col("variance_pct", "Variance %", PERCENT, 1),
    _col("variance_type", "Type", BADGE),
    _col("line_status", "Status", BADGE, visible=False),
    _col("component_unit", "Unit", visible=False),
    _col("product_equivalent", "Product equivalent", DECIMAL, 1),
    _col("unit_cost", "Unit cost", EURO, 4, visible=False),
    _col("variance_value", "Value", EURO, 2),
)
_ORDER = (
    _col("order_id", "Order"),
    _col("order_status", "Order status", BADGE),
    _col("order_bom_id", "Order BOM", sortable=False, visible=False),
    _col("order_close_date", "Closed", DATE, visible=False),
)


def _counted(*keys: str) -> tuple[GridColumn, ...]:
    labels = {
        "row_count": "Rows", "variance_row_count": "Rows in variance",
        "parent_count": "Parents", "component_count": "Components", "week_count": "Weeks",
    }
    return tuple(_col(k, labels[k], COUNT) for k in keys)


def _quantities(decimals: int) -> tuple[GridColumn, ...]:
    return (
        _col("expected_qty", "Expected", DECIMAL, decimals),
        _col("actual_qty", "Actual", DECIMAL, decimals),
        _col("variance_qty", "Net variance", DECIMAL, 1),
    )


def _values(decimals: int) -> tuple[GridColumn, ...]:
    return (
        _col("variance_value", "Net value", EURO, decimals),
        _col("abs_value", "Absolute value", EURO, decimals),
    )


_SPLIT_VALUES = (_col("under_value", "Under value", EURO), _col("over_value", "Over value", EURO))
_CONFORMITY = _col("conformity_rate", "Conformity", PERCENT, 1)
_EQUIVALENT = _col("product_equivalent", "Product equivalent", DECIMAL, 1)
_PRODUCED = _col("produced_qty", "Produced", DECIMAL)
_LATEST = ("week_start", True)

# Columns, keys and orders of the six grids.
GRIDS: dict[str, Grid] = {
    g.key: g
    for g in (
        Grid(
            "details", ("week_start", "parent_id", "component_id"),
            (_LATEST, ("parent_id", False), ("component_id", False)),
            (*_WEEK, *_DETAIL), extra_sorts=("abs_value",),
        ),
        Grid(
            "details_of", ("week_start", "order_id", "parent_id", "component_id"),
            (_LATEST, ("order_id", False), ("component_id", False), ("parent_id", False)),
            (*_WEEK, *_ORDER, *_DETAIL), extra_sorts=("abs_value",),
        ),
        Grid(
            "components", ("component_id", "parent_program", "parent_line"),
            (("component_id", False), ("parent_program", False), ("parent_line", False)),
            (
                _col("component_id", "Component"), _col("component_name", "Name"),
                _col("component_category", "Category"), _PROGRAM, _LINE,
                _col("bom_coef", "BOM coefficient", DECIMAL, 4),
                _col("is_uniform", "Uniform", FLAG),
                *_counted("parent_count", "week_count", "variance_row_count"),
                *_quantities(1),
                _col("variance_pct", "Variance %", PERCENT, 1),
                _col("under_qty", "Under", DECIMAL, 1, visible=False),
                _col("over_qty", "Over", DECIMAL, 1, visible=False),
                _EQUIVALENT, *_values(2),
            ),
        ),
        Grid(
            "programs", ("week_start", "parent_program"),
            (_LATEST, ("parent_program", False)),
            (
                *_WEEK, _PROGRAM,
                *_counted("parent_count", "component_count", "row_count", "variance_row_count"),
                _CONFORMITY, *_quantities(0), *_SPLIT_VALUES, *_values(0),
            ),
        ),
        Grid(
            "lines", ("week_start", "parent_line"),
            (_LATEST, ("parent_line", False)),
            (
                *_WEEK, _LINE, _PROGRAM,
                *_counted("parent_count", "component_count", "row_count", "variance_row_count"),
                _CONFORMITY, _PRODUCED, *_quantities(0), _EQUIVALENT, *_SPLIT_VALUES, *_values(0),
            ),
        ),
        Grid(
            "parents", ("parent_id",),
            (("parent_id", False), ("parent_program", False), ("parent_line", False)),
            (
                _col("parent_id", "Parent"), _col("parent_name", "Name"), _PROGRAM, _LINE,
                *_counted("component_count", "week_count"), _PRODUCED,
                *_counted("variance_row_count"), *_quantities(0), *_values(0),
            ),
        ),
    )
}


# -- grids -----------------------------------------------------------------------

_BY_WEEK = ["week_start", "iso_year", "iso_week"]


def _label() -> Column:
    return week_label("iso_year", "iso_week").alias("week_label")


def _detail_columns() -> list[str]:
    return [c.key for c in _DETAIL if c.key != "variance_type"]


def _details(fact: DataFrame, sel: Selection, extra: Sequence[str]) -> DataFrame:
    return sel.apply(fact).select(
        *_BY_WEEK, _label(), *extra, *_detail_columns(),
        sel.variance_type().alias("variance_type"),
        F.abs("variance_value").alias("abs_value"),
    )


def grid_details(fact: DataFrame, sel: Selection) -> DataFrame:
    """One row per week, parent and component, with the dynamic type."""
    return _details(fact, sel, [])


def grid_details_of(fact_order: DataFrame, sel: Selection) -> DataFrame:
    """One row per week, order, parent and component."""
    return _details(fact_order, sel, [c.key for c in _ORDER])


def grid_components(fact: DataFrame, sel: Selection) -> DataFrame:
    """Components by program and line."""
    grouped = sel.apply(fact).groupBy("component_id", "parent_program", "parent_line").agg(
        F.max("component_name").alias("component_name"),
        F.max("component_category").alias("component_category"),
        F.min("bom_coef").alias("bom_coef"),
        F.bool_and("is_uniform").alias("is_uniform"),
        *measures(sel),
    )
    pct = ratio_pct(F.col("variance_qty"), F.col("expected_qty"))
    return grouped.withColumn("variance_pct", pct)


def grid_programs(fact: DataFrame, sel: Selection) -> DataFrame:
    """Programs by week."""
    grouped = sel.apply(fact).groupBy(*_BY_WEEK, "parent_program").agg(*measures(sel))
    return grouped.withColumns({"week_label": _label(), "conformity_rate": conformity_pct()})


def grid_lines(fact: DataFrame, sel: Selection) -> DataFrame:
    """Production lines by week, with their production counted once per parent."""
    selected = sel.apply(fact)
    produced = (
        deduplicated_production(selected, ["parent_line", "week_start", "parent_id"])
        .groupBy("parent_line", "week_start")
        .agg(F.sum("produced_qty").alias("produced_qty"))
    )
    grouped = selected.groupBy(*_BY_WEEK, "parent_line").agg(
        F.max("parent_program").alias("parent_program"), *measures(sel)
    )
    return grouped.join(produced, ["parent_line", "week_start"], "left").withColumns(
        {"week_label": _label(), "conformity_rate": conformity_pct()}
    )


def grid_parents(fact: DataFrame, sel: Selection) -> DataFrame:
    """Parents, with their production counted once per week."""
    selected = sel.apply(fact)
    produced = (
        deduplicated_production(selected, ["parent_id", "week_start"])
        .groupBy("parent_id")
        .agg(F.sum("produced_qty").alias("produced_qty"))
    )
    grouped = selected.groupBy("parent_id", "parent_program", "parent_line").agg(
        F.max("parent_name").alias("parent_name"), *measures(sel)
    )
    return grouped.join(produced, "parent_id", "left")


def grid(key: str, fact: DataFrame, sel: Selection) -> DataFrame:
    """A grid by its key; details_of reads the order fact, the others the weekly fact."""
    makers = {
        "details": grid_details,
        "details_of": grid_details_of,
        "components": grid_components,
        "programs": grid_programs,
        "lines": grid_lines,
        "parents": grid_parents,
    }
    if key not in makers:
        raise ValueError(f"unknown grid {key}")
    return makers[key](fact, sel)


# -- pages and export --------------------------------------------------------------


def order_of(grid_key: str, sort: str | None = None, desc: bool = True) -> list[tuple[str, bool]]:
    """A grid's order by one of its sort columns, then its tie-breakers; other columns are refused."""
    spec = GRIDS[grid_key]
    return pages.allowed(sorted(spec.sortable), spec.ties, sort or spec.default_sort, desc)


def page(
    df: DataFrame, grid_key: str, sort: str | None = None, desc: bool = True,
    number: int = 1, size: int = 50,
) -> DataFrame:
    """One page of a grid."""
    return slice_page(df, pages.columns(order_of(grid_key, sort, desc)), number, size)


def next_page(
    df: DataFrame, grid_key: str, mark: Sequence | None, sort: str | None = None, desc: bool = True, size: int = 50
) -> DataFrame:
    """The page of a grid after a bookmark; it costs what the first page costs."""
    return pages.following(df, order_of(grid_key, sort, desc), mark, size)


def slice_page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Sorted page as a top-k with an offset, for pages near the start; see pages.PageIndex for jumps."""
    if size < 1 or number < 1:
        raise ValueError("pages and their size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_total(df: DataFrame) -> DataFrame:
    """Number of rows over all pages, as a separate distributed count."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def export_rows(
    df: DataFrame, grid_key: str, columns: Sequence[str] | None = None,
    limit: int | None = None, sort: str | None = None, desc: bool = True,
) -> DataFrame:
    """Chosen or visible columns of all rows of a grid in sort order, or of the first `limit`.

    Without a limit the order is a range partitioning: no task holds more than its range.
    """
    keys = [c.key for c in GRIDS[grid_key].chosen(columns)]
    rows = df.orderBy(*pages.columns(order_of(grid_key, sort, desc)))
    return (rows if limit is None else rows.limit(limit)).select(*keys)


def export_truncated(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Whether an export of this limit leaves rows out; one without a limit never does."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), (F.lit(False) if limit is None else total > limit).alias("truncated"))


def _plain(value: Column) -> Column:
    """All digits of a double without an exponent, from 1e-20 to 1e20; others keep theirs."""
    text, size = value.cast("string"), F.abs(value)
    digits = lambda kind: value.try_cast(kind).cast("string")
    return (
        F.when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1e7) & (size < 1e20), digits("decimal(38,17)"))
        .when((size >= 1e-20) & (size < 1e-3), digits("decimal(38,37)"))
        .otherwise(text)
    )


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    value = F.col(name)
    if kind == "boolean":
        text = F.when(value, "Oui").otherwise("Non")
    elif kind.startswith("decimal") or kind in ("double", "float"):
        whole = value.cast("string") if kind.startswith("decimal") else _plain(value)
        short = F.regexp_replace(F.regexp_replace(whole, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
        text = F.translate(short, ".", ",")
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        text = value.cast("string")
    else:
        text = F.translate(value.cast("string"), "\t\n\r", "  ")
    return F.when(value.isNull(), F.lit("")).otherwise(text).alias(name)


def tsv_format(df: DataFrame) -> DataFrame:
    """All columns as text ready to paste in a spreadsheet.

    Decimal comma, no thousands mark, Oui/Non; tabs and line feeds become spaces, carriage
    returns go. Text that looks like a number keeps its leading zeros.
    """
    return df.select(*[_as_text(df, name) for name in df.columns])
