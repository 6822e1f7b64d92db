"""Small helpers to combine frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(*frames: DataFrame) -> DataFrame:
    """Put the columns of several one-row frames side by side.

    The rows are stacked and folded by one small aggregation instead of a cross join.
    Column names must differ between the frames.
    """
    if len(frames) == 1:
        return frames[0]
    names = [name for frame in frames for name in frame.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(name).alias(name) for name in names])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the rows of the table that share a key with the new rows, and add the rest."""
    kept = table.join(rows.select(*keys), keys, "left_anti")
    return kept.unionByName(rows.select(*table.columns))


def delete_keys(table: DataFrame, keys_frame: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the given keys."""
    return table.join(keys_frame.select(*keys), keys, "left_anti")
