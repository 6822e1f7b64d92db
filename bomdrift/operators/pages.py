"""Pages of sorted rows whose cost does not grow with the page's number.

A reader who turns pages goes on from a bookmark: the order's values in the last row seen. The next page is a filter
and a top-k. A reader who jumps uses an index: the rows laid out once in sorted ranges with their counts, so that any
page reads the one or two ranges that hold it. NULLs come last in both directions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sort columns and whether they descend; the last ones make every row's place unique.
Order = Sequence[tuple[str, bool]]
#: Rows of a range of an index, about.
RANGE_ROWS = 100_000


def allowed(sortable: Sequence[str], ties: Order, sort: str, desc: bool) -> list[tuple[str, bool]]:
    """The order of a sort key from a whitelist, then its tie-breakers."""
    if sort not in sortable:
        raise ValueError(f"sorting on {sort} is not allowed")
    return [(sort, desc), *[(name, down) for name, down in ties if name != sort]]


def columns(order: Order) -> list[Column]:
    return [F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last() for name, down in order]


def _checked(number: int, size: int) -> None:
    if size < 1 or number < 1:
        raise ValueError("pages and their size start at 1")


def bookmark(row: Row, order: Order) -> tuple:
    """Where a row stands in an order."""
    return tuple(row[name] for name, _ in order)


def beyond(order: Order, mark: Sequence) -> Column:
    """The rows that come after a bookmark."""
    found, same = F.lit(False), F.lit(True)
    for (name, down), value in zip(order, mark, strict=True):
        c = F.col(name)
        if value is not None:  # nothing comes after NULL but what a later column tells apart
            v = F.lit(value)
            found = found | (same & (((c < v) if down else (c > v)) | c.isNull()))
        same = same & c.eqNullSafe(F.lit(value))
    return found


def following(df: DataFrame, order: Order, mark: Sequence | None = None, size: int = 50) -> DataFrame:
    """The page after a bookmark, or the first one."""
    _checked(1, size)
    rows = df if mark is None else df.where(beyond(order, mark))
    return rows.orderBy(*columns(order)).limit(size)


@dataclass(frozen=True)
class PageIndex:
    """Rows stored in sorted ranges, and how many each range has."""

    stored: DataFrame
    order: tuple[tuple[str, bool], ...]
    counts: tuple[tuple[int, int], ...]

    @staticmethod
    def build(df: DataFrame, order: Order, path: str, range_rows: int = RANGE_ROWS) -> PageIndex:
        """Sort the rows into ranges at a path; the driver reads a count for each range."""
        spark, by = df.sparkSession, columns(order)
        ranges = max(1, -(-df.count() // range_rows))
        rows = df.repartitionByRange(ranges, *by).withColumn("range_", F.spark_partition_id()).sortWithinPartitions("range_", *by)
        rows.write.partitionBy("range_").parquet(path)
        stored = spark.read.schema(T.StructType([*df.schema, T.StructField("range_", T.IntegerType())])).parquet(path)
        counts = stored.groupBy("range_").count().collect()
        return PageIndex(stored, tuple(order), tuple(sorted((r["range_"], r["count"]) for r in counts)))

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def page(self, number: int, size: int = 50) -> DataFrame:
        """One page, from the ranges that hold it."""
        _checked(number, size)
        start, end = (number - 1) * size, number * size
        before = list(accumulate((n for _, n in self.counts), initial=0))
        held = [(r, b) for (r, n), b in zip(self.counts, before) if b < end and b + n > start]
        rows = self.stored.where(F.col("range_").isin(*[r for r, _ in held])) if held else self.stored.limit(0)
        return rows.orderBy(*columns(self.order)).offset(start - held[0][1] if held else 0).limit(size).drop("range_")
