"""Publication of model tables, the load log, and grid exports."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import replace
from datetime import UTC, date, datetime
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomdrift import schemas as S
from bomdrift.operators import grids
from bomdrift.plans import export, storage
from bomdrift.plans.build import Model
from bomdrift.plans.versions import WEEK, Entry, Store

LOGGER = logging.getLogger("bomdrift.publish")
LOG_NAME = "load_log"


def select_tables(names: Sequence[str] | None) -> list[str]:
    """Published tables to load, in order; unknown names are refused."""
    if not names:
        return list(S.PUBLISHED)
    unknown = set(names) - set(S.PUBLISHED)
    if unknown:
        raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
    return [name for name in S.PUBLISHED if name in names]


def read_log(spark: SparkSession, out_dir: str) -> DataFrame:
    """The last load of each table; every load is a row that was appended."""
    path = f"{out_dir}/{LOG_NAME}"
    if not storage.exists(spark, path):
        return spark.createDataFrame([], S.LOAD_LOG)
    loads = spark.read.schema(S.LOAD_LOG).parquet(path)
    last = F.max_by(F.struct(*S.LOAD_LOG.names), F.struct("ended_at", "started_at", "run_id"))
    return loads.groupBy("table_name").agg(last.alias("last")).select("last.*")


def log_row(
    table: str, rows: int, started: datetime, ended: datetime, run_id: str, error: str | None = None
) -> tuple:
    duration = int((ended - started).total_seconds() * 1000)
    status = S.LOAD_OK if error is None else S.LOAD_FAILED
    return (table, table, rows, started, ended, duration, status, error, run_id)


def record_load(log: DataFrame, row: tuple) -> DataFrame:
    """The log with the table's row added or replaced."""
    new = log.sparkSession.createDataFrame([row], S.LOAD_LOG)
    return log.filter(~F.col("table_name").eqNullSafe(row[0])).unionByName(new)


def _store(spark: SparkSession, out_dir: str, row: tuple) -> None:
    """Append, so that no concurrent run's row is lost."""
    spark.createDataFrame([row], S.LOAD_LOG).write.mode("append").parquet(f"{out_dir}/{LOG_NAME}")


def check_key(df: DataFrame, key: Sequence[str], name: str) -> None:
    """Raise if a key column holds NULL or a key occurs twice."""
    if not key:
        return
    null = reduce(or_, [F.col(c).isNull() for c in key])
    keys = df.groupBy(*key).agg(F.count(F.lit(1)).alias("times"))
    bad = keys.where((F.col("times") > 1) | null).head(1)
    if bad:
        raise ValueError(f"{name}: key {bad[0].asDict()} is repeated or NULL")


def _renewed(store: Store, name: str, model: Model, old: Entry | None) -> Entry:
    """The table's next version: weeks (or a whole table) whose rows are those published already are not written."""
    df, source = S.TABLES[name].project(model[name]), model.entries.get(name)
    if source is None or old is None or (source.schema, source.weekly, source.buckets) != (old.schema, old.weekly, old.buckets):
        check_key(df, S.TABLES[name].key, name)
        weekly = bool(source and source.weekly)
        return store.stage(name, df, weekly, source.buckets if source else 0, arranged=weekly)
    if source.same(old):
        return old
    if not source.weekly:
        check_key(df, S.TABLES[name].key, name)
        return store.stage(name, df, False, source.buckets)
    unchanged = {w: p for w, p in old.parts.items() if w in source.parts and (p.rows, p.digest) == (source.parts[w].rows, source.parts[w].digest)}
    new = [date.fromisoformat(w) for w in source.parts if w not in unchanged]
    rows = df.where(F.col(WEEK).isin(*new)) if new else df.limit(0)
    check_key(rows, S.TABLES[name].key, name)
    return store.stage(name, rows, True, source.buckets, reuse=replace(old, parts=unchanged), arranged=True)


def publish(
    spark: SparkSession, model: Model, out_dir: str, tables: Sequence[str] | None = None,
    run_id: str = "local",
) -> dict[str, int]:
    """Publish tables one by one, each as a new version of the store in `out_dir`, and log each load.

    A table with a NULL or repeated key is refused, as a keyed target would refuse it; a fact's key lies within its
    buckets, so that the check needs no shuffle. Of a table kept by week only the weeks that changed are checked and
    written; the row counts are taken while writing.

    A failure leaves the last version in place, is logged, and stops the run.
    """
    store = Store(spark, out_dir)
    counts: dict[str, int] = {}
    for name in select_tables(tables):
        started = datetime.now(UTC)
        try:
            old = store.version().tables.get(name)
            entry = _renewed(store, name, model, old)
            if entry is not old:
                store.commit({name: entry})
            counts[name] = entry.rows
        except Exception as error:
            try:
                row = log_row(name, -1, started, datetime.now(UTC), run_id, str(error))
                _store(spark, out_dir, row)
            except Exception:
                LOGGER.exception("load log of %s not written", name)
            raise
        row = log_row(name, counts[name], started, datetime.now(UTC), run_id)
        _store(spark, out_dir, row)
    return counts


def export_grid(
    df: DataFrame, grid_key: str, path: str, columns: Sequence[str] | None = None,
    limit: int | None = None, fmt: str = "parquet", sort: str | None = None,
    desc: bool = True,
) -> bool:
    """Write a grid as an ordered set of files (see export); returns whether rows were left out by the limit."""
    rows, labels = grids.export_rows(df, grid_key, columns, limit, sort, desc), None
    if fmt == "tsv":
        known = {c.key: c.label for c in grids.GRIDS[grid_key].columns}
        labels, rows = [known[c] for c in rows.columns], grids.tsv_format(rows)
    export.write(rows, path, fmt, labels)
    return grids.export_truncated(df, limit).first().truncated
