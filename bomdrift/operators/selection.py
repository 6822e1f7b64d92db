"""The selection applied to every analytic view: validated values, one predicate."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.functions.calendar import monday_of
from bomdrift.functions.measures import decimal_text, number

# Largest tolerance, weeks of the default view, weeks of the presets.
TOLERANCE_MAX = 1_000_000
DEFAULT_WEEKS = 13
PRESET_WEEKS = (4, 8, 13, 26, 52)
# Lists of a selection and the columns they bear on; columns that a search term is looked for in.
MEMBERS = {
    "weeks": "week_start", "programs": "parent_program", "lines": "parent_line",
    "categories": "component_category", "parents": "parent_id", "components": "component_id",
    "line_statuses": "line_status", "orders": "order_id", "order_statuses": "order_status",
}
SEARCHED = ["component_id", "component_name", "parent_id", "parent_name"]


def matching(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of df whose columns of `keys` are among its rows: lists of any length."""
    return df.join(keys, keys.columns, "left_semi")


def contains_text(columns: list[str], term: str) -> Column:
    """Case-insensitive substring over the columns joined by spaces; no pattern characters."""
    joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    return F.contains(F.lower(joined), F.lit(term.lower()))


def _clean(values: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(v.strip() for v in values if v.strip()))


@dataclass(frozen=True)
class Selection:
    """Filters of a view. Bounds are inclusive and bear on the Monday of the week.

    Short lists are literals. `tables` holds lists of any length as tables of keys, whose columns are named as the
    fact's (one or several: parent_id; parent_id and component_id). A row must be in each of them; NULL keys match
    nothing, repeated ones count once, and a table with a column that a fact lacks does not bear on it. Spark joins
    them to the fact and, where it pays, prunes the fact's scan by their weeks or by a Bloom filter of their keys.
    """

    date_from: date | None = None
    date_to: date | None = None
    weeks: tuple[date, ...] = ()
    programs: tuple[str, ...] = ()
    lines: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    parents: tuple[str, ...] = ()
    components: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    line_statuses: tuple[str, ...] = ()
    orders: tuple[str, ...] = ()
    order_statuses: tuple[str, ...] = ()
    search: str | None = None
    tolerance: float = 0.5
    tolerance_pct: float | None = None
    min_impact: float | None = None
    uniform_only: bool = False
    hide_conforming: bool = False
    tables: tuple[DataFrame, ...] = ()

    def __post_init__(self) -> None:
        def put(name: str, value: object) -> None:
            object.__setattr__(self, name, value)

        for name in ("programs", "lines", "categories", "parents", "components", "orders",
                     "order_statuses"):
            put(name, _clean(tuple(getattr(self, name))))
        for name, allowed in (("types", S.VARIANCE_TYPES), ("line_statuses", S.LINE_STATUSES)):
            values = tuple(getattr(self, name))
            unknown = set(values) - set(allowed)
            if unknown:
                raise ValueError(f"{name}: unknown {sorted(unknown)}")
            put(name, values)
        put("weeks", tuple(self.weeks))
        put("tables", tuple(self.tables))
        if self.search is not None:
            put("search", self.search.strip() or None)
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from must not be after date_to")
        if not 0 <= self.tolerance <= TOLERANCE_MAX:
            raise ValueError("tolerance out of range")
        if self.tolerance_pct is not None and not 0 <= self.tolerance_pct <= 100:
            raise ValueError("tolerance_pct out of range")
        if self.min_impact is not None and self.min_impact < 0:
            raise ValueError("min_impact must not be negative")

    # -- derived selections -------------------------------------------------
    def with_(self, **changes: object) -> Selection:
        return replace(self, **changes)

    def previous(self) -> Selection:
        """The period of the same length directly before; unbounded without both dates."""
        if not (self.date_from and self.date_to):
            return self.without_dates()
        week = timedelta(days=7)
        end = self.date_from - week
        return self.with_(date_from=end - (self.date_to - self.date_from), date_to=end, weeks=())

    def without_dates(self) -> Selection:
        return self.with_(date_from=None, date_to=None, weeks=())

    # -- columns ------------------------------------------------------------
    def variance_type_sql(self) -> str:
        """Type recomputed from the tolerances: absolute, or relative when given."""
        conforming = f"abs(variance_qty) <= {decimal_text(self.tolerance)}"
        if self.tolerance_pct is not None:
            limit = decimal_text(self.tolerance_pct)
            conforming += f" OR coalesce(abs(variance_pct) <= {limit}, false)"
        return (
            f"CASE WHEN {conforming} THEN '{S.CONFORMING}'"
            f" WHEN variance_qty > 0 THEN '{S.UNDER}' ELSE '{S.OVER}' END"
        )

    def variance_type(self) -> Column:
        return F.expr(self.variance_type_sql())

    def conditions(self, columns: list[str]) -> list[Column]:
        """The filters to be ANDed; those on a column that a table lacks do not bear on it."""
        member = {c: getattr(self, name) for name, c in MEMBERS.items() if c in columns}
        found = [F.col(c).isin(*values) for c, values in member.items() if values]
        kind = self.variance_type()
        optional = {
            "date_from": lambda day: F.col("week_start") >= F.lit(day),
            "date_to": lambda day: F.col("week_start") <= F.lit(day),
            "types": lambda kinds: kind.isin(*kinds),
            "hide_conforming": lambda _: kind != S.CONFORMING,
            "min_impact": lambda least: F.abs("variance_value") >= number(least),
            "uniform_only": lambda _: F.col("is_uniform"),
            "search": lambda term: contains_text(SEARCHED, term),
        }
        for name, condition in optional.items():
            value = getattr(self, name)
            if value is not None and value is not False and value != ():
                found.append(condition(value))
        return found

    def predicate(self, df: DataFrame) -> Column:
        """The filters as one condition; tables of keys are joins and no part of it: see `restricted`."""
        return reduce(lambda a, b: a & b, self.conditions(df.columns), F.lit(True))

    def restricted(self, df: DataFrame) -> DataFrame:
        """The rows whose keys are in all tables of keys that bear on df."""
        bearing = [keys for keys in self.tables if set(keys.columns) <= set(df.columns)]
        return reduce(matching, bearing, df)

    def apply(self, df: DataFrame) -> DataFrame:
        conditions = self.conditions(df.columns)
        return self.restricted(df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df)


# Checks whose anomaly is a set of fact rows, and the selection that shows them.
CHECK_SELECTIONS = {
    "lignes_hors_nomenclature": Selection(line_statuses=(S.OFF_BOM,)),
    "parent_produit_sans_bom": Selection(line_statuses=(S.OFF_BOM,)),
    "ecart_aberrant": Selection(hide_conforming=True, tolerance_pct=100),
    "composant_sans_cout_standard": Selection(hide_conforming=True),
    "parent_sans_perimetre": Selection(lines=(S.UNKNOWN,)),
}


def selection_for_check(name: str) -> Selection | None:
    """The rows behind a check, or None when it is not about fact rows."""
    return CHECK_SELECTIONS.get(name)


def week_extent(fact: DataFrame) -> tuple[date | None, date | None]:
    row = fact.agg(F.min("week_start"), F.max("week_start")).first()
    return row[0], row[1]


def preset(fact: DataFrame, name: str = str(DEFAULT_WEEKS)) -> Selection:
    """Selection of the last n weeks, the year to date, or everything, clipped to history.

    Reads the two bounds of the fact on the driver.
    """
    first, last = week_extent(fact)
    if last is None:
        return Selection()
    if name == "all":
        return Selection(first, last)
    if name == "ytd":
        start = date(last.year, 1, 1)
        monday = monday_of(start)
        start = monday if monday == start else monday + timedelta(days=7)
    elif name.isdigit() and int(name) in PRESET_WEEKS:
        start = last - timedelta(weeks=int(name) - 1)
    else:
        raise ValueError(f"unknown preset {name}")
    return Selection(max(start, first), last)
