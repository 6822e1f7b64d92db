"""The users' edits: an append-only log of changes by key, in which the last one counts.

    <root>/<edit>/part-*.parquet    changed rows, with edited_at, edit_id and whether the row was removed
    <root>/<edit>/_SUCCESS          the edit is whole; others are passed over

Every edit is a folder of its own, so editors that save at once do not meet, and none has to read the table to change
a row. Of the changes of a key the last counts, by time and then by edit; that does not depend on the order in which
folders are read, so a folder that holds the last change of every key can stand beside those it sums up.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomdrift import schemas as S
from bomdrift.operators import overrides
from bomdrift.plans import storage

SUMMED = "_sums_up.json"


class EditLog:
    """The edits of one table of user rows."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: Sequence[str]) -> None:
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, list(key)
        self.stored = T.StructType([
            *schema, T.StructField("removed", T.BooleanType()), T.StructField("edited_at", T.TimestampType()), T.StructField("edit_id", T.StringType()),
        ])

    def edits(self) -> list[str]:
        """Whole edits, by folder."""
        return sorted(name for name, _ in storage.listed(self.spark, self.root) if storage.exists(self.spark, f"{self.root}/{name}/_SUCCESS"))

    def save(self, rows: DataFrame, at: datetime, removed: bool = False) -> str:
        """Append changed rows, or the keys of removed ones; returns the edit's name."""
        edit = uuid.uuid4().hex
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns, F.lit(removed).alias("removed"), F.lit(at).cast("timestamp").alias("edited_at"), F.lit(edit).alias("edit_id")).write.parquet(f"{self.root}/{edit}")
        return edit

    def _last(self, edits: list[str]) -> DataFrame:
        if not edits:
            return self.spark.createDataFrame([], self.stored)
        rows = self.spark.read.schema(self.stored).parquet(*[f"{self.root}/{e}" for e in edits])
        others = [c for c in self.stored.names if c not in self.key]
        last = F.max_by(F.struct(*others), F.struct("edited_at", "edit_id")).alias("last")
        return rows.groupBy(*self.key).agg(last).select(*[c if c in self.key else F.col(f"last.{c}") for c in self.stored.names])

    def current(self) -> DataFrame:
        """The table as the last edits left it."""
        return self._last(self.edits()).where(~F.col("removed")).select(*self.schema.names)

    def compact(self, grace_hours: float = 24) -> str | None:
        """Sum the edits up in one folder; edits that an earlier sum of at least this age covers are removed.

        Removals stay in the sum, so that an edit read beside it cannot bring a row back. Edits saved meanwhile are
        not covered and stay.
        """
        edits = self.edits()
        before = (time.time() - grace_hours * 3600) * 1000
        for name, changed in storage.listed(self.spark, self.root):
            marker = f"{self.root}/{name}/{SUMMED}"
            if name in edits and changed <= before and storage.exists(self.spark, marker):
                for covered in json.loads(storage.read_text(self.spark, marker)):
                    storage.remove(self.spark, f"{self.root}/{covered}")
                    edits = [e for e in edits if e != covered]
        if len(edits) < 2:
            return None
        edit = uuid.uuid4().hex
        self._last(edits).write.parquet(f"{self.root}/{edit}")
        storage.create_text(self.spark, f"{self.root}/{edit}/{SUMMED}", json.dumps(edits))
        return edit


class UserEdits:
    """Excluded items and overridden BOM lines, as users change them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.excluded = EditLog(spark, f"{root}/item_exclusion", S.EXCLUSION, ["item_id"])
        self.overridden = EditLog(spark, f"{root}/bom_override", S.BOM_OVERRIDE, overrides.BOM_KEY)
        self.spark = spark

    def exclude(self, item_ids: DataFrame | Sequence[str], reason: str | None, author: str | None, at: datetime) -> str:
        """Exclude items, or renew the reason of those already excluded."""
        return self.excluded.save(overrides.exclusion_rows(self.spark, item_ids, reason, author, at), at)

    def include(self, item_ids: DataFrame | Sequence[str], at: datetime) -> str:
        """Take items back into the analysis."""
        return self.excluded.save(overrides.keys_of(self.spark, item_ids, ["item_id"]), at, removed=True)

    def override(
        self, pairs: DataFrame | Sequence[tuple[str, str]], active: bool, coef: float | Decimal | None,
        reason: str | None, author: str | None, at: datetime,
    ) -> str:
        """Deactivate BOM lines or replace their coefficient (None keeps the original)."""
        return self.overridden.save(overrides.override_rows(self.spark, pairs, active, coef, reason, author, at), at)

    def reset(self, pairs: DataFrame | Sequence[tuple[str, str]], at: datetime) -> str:
        """Remove overrides: the lines are again those of the source."""
        return self.overridden.save(overrides.keys_of(self.spark, pairs, overrides.BOM_KEY), at, removed=True)
