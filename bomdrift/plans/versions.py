"""Versioned tables: immutable data folders, and numbered manifests that say which of them make a version.

    <root>/<table>/<run>/...                        data of one write, never changed
    <root>/<table>/<run>/week_start=1997-07-07/...  the same of a table kept by week
    <root>/_manifests/000000000007.json             the tables of version 7, their folders, rows and digests

A version is there when its manifest is: one small file, created once and never replaced. A run that dies before that
leaves the last version as it was, and data folders that no manifest names; one that dies while it writes the manifest
leaves a file that is not JSON, which readers pass over. Readers of a version keep reading its folders while later
ones are published. A version names every table, so several tables change at once. Weeks whose rows did not change
are named again, not written again. Nothing else in the root is touched.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomdrift.plans import storage

MANIFESTS = "_manifests"
WEEK = "week_start"
#: Columns that a fact kept by week is bucketed by, so that joins on them need no shuffle.
PAIR = ("parent_id", "component_id")
#: Versions that a clean-up keeps, and hours that it leaves folders alone which no version names (a run may be writing).
KEPT, GRACE_HOURS = 3, 24
#: Rows that a task of a weekly write is given, where their number is known.
ROWS_PER_TASK = 500_000


@dataclass(frozen=True)
class Part:
    """A folder under the root, its rows and a digest of them that their order does not change."""

    path: str
    rows: int
    digest: str


@dataclass(frozen=True)
class Entry:
    """A table of a version: parts by week, or one part under the empty name; buckets is 0 without buckets."""

    schema: str
    parts: dict[str, Part]
    weekly: bool = False
    buckets: int = 0

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts.values())

    @property
    def digest(self) -> str:
        """The digest of all rows: that of a part is a sum, and so is that of all."""
        return str(sum(int(p.digest) for p in self.parts.values()))

    def same(self, other: Entry | None) -> bool:
        content = lambda e: (e.schema, e.weekly, {k: (p.rows, p.digest) for k, p in e.parts.items()})
        return other is not None and content(self) == content(other)

    @staticmethod
    def of(stored: dict) -> Entry:
        return Entry(**{**stored, "parts": {k: Part(**p) for k, p in stored["parts"].items()}})


@dataclass
class Version:
    number: int = 0
    tables: dict[str, Entry] = field(default_factory=dict)


def digest_of(df: DataFrame) -> Column:
    """The sum of the rows' hashes: equal for equal rows in any order."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


def by_week(df: DataFrame, buckets: int = 0, rows: int | None = None, weeks: int = 1) -> DataFrame:
    """Rows dealt and sorted as a table kept by week is written: each bucket of a week in one task, and so in one file.

    Tasks are those of a shuffle, or more where the number of rows is known and asks for it: a fixed number, for many
    small files take longest. Without buckets, a week of many rows is several files too, by the hash of the pair.
    """
    slices = buckets or -(-(rows or 1) // (weeks * ROWS_PER_TASK))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // ROWS_PER_TASK))
    piece = F.pmod(F.hash(*PAIR), F.lit(slices))  # for buckets, as Spark's writer deals rows
    week = F.floor(F.datediff(WEEK, F.lit("1970-01-05")) / 7)
    place = F.pmod(week * slices + piece if slices > 1 else week, F.lit(tasks)).cast("int")
    order = [*([piece] if buckets > 1 else []), *[F.col(c) for c in (*PAIR, "order_id") if c in df.columns]]
    return df.repartitionById(tasks, F.coalesce(place, F.lit(0))).sortWithinPartitions(WEEK, *order)


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Scans give a task few files: rows read back are many times as large as their files."""
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "16MB")
    try:
        yield
    finally:
        spark.conf.set(conf, before)


class Store:
    """Versions of the tables in one folder of shared storage."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # -- manifests ---------------------------------------------------------------

    def _numbers(self) -> list[int]:
        names = [name for name, _ in storage.listed(self.spark, f"{self.root}/{MANIFESTS}")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, number: int) -> str:
        return f"{self.root}/{MANIFESTS}/{number:012d}.json"

    def version(self, number: int | None = None) -> Version:
        """A version by number, or the last whole one; version 0 is empty."""
        for n in [number] if number is not None else reversed(self._numbers()):
            try:
                stored = json.loads(storage.read_text(self.spark, self._manifest(n)))
                return Version(n, {k: Entry.of(e) for k, e in stored["tables"].items()})
            except ValueError:  # left by a run that died while it wrote this file
                if number is not None:
                    raise
        return Version()

    def commit(self, entries: dict[str, Entry]) -> int:
        """Make a version of the last one and these tables; returns its number. Runs that commit at once follow each other."""
        while True:
            tables = {**self.version().tables, **entries}
            number = max(self._numbers(), default=0) + 1
            body = json.dumps({"tables": {k: asdict(e) for k, e in tables.items()}})
            if storage.create_text(self.spark, self._manifest(number), body):
                return number

    # -- data ----------------------------------------------------------------------

    def stage(
        self, name: str, df: DataFrame, weekly: bool = False, buckets: int = 0, reuse: Entry | None = None,
        arranged: bool = False,
    ) -> Entry:
        """Write a table's rows to a new folder; no version has them until they are committed.

        With `reuse`, its weeks stay as they are and the rows written here are added to them. `arranged` says that the
        rows of a table kept by week lie in tasks as `by_week` deals them, so that they are not shuffled once more.
        """
        run = f"{name}/{uuid.uuid4().hex[:16]}"
        path = f"{self.root}/{run}"
        schema = df.schema.json()
        if not weekly:
            seen = Observation()
            counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), digest_of(df).alias("digest"))
            if buckets:
                self._bucketed(counted.repartition(buckets, *PAIR).write.format("parquet"), buckets, path)
            else:
                storage.laid_out(counted).write.parquet(path)
            return Entry(schema, {"": Part(run, seen.get["rows"], seen.get["digest"])}, False, buckets)
        rows = df if arranged else by_week(df, buckets)
        writer = rows.write.partitionBy(WEEK).format("parquet")
        with small_splits(self.spark):
            if buckets:
                self._bucketed(writer, buckets, path)
            else:
                writer.save(path)
        written = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        weeks = written.groupBy(WEEK).agg(F.count(F.lit(1)).alias("rows"), digest_of(written).alias("digest")).collect()
        if any(r[WEEK] is None for r in weeks):
            raise ValueError(f"{name}: rows without {WEEK}")
        parts = {r[WEEK].isoformat(): Part(f"{run}/{WEEK}={r[WEEK].isoformat()}", r["rows"], r["digest"]) for r in weeks}
        return Entry(schema, {**(reuse.parts if reuse else {}), **parts}, True, buckets)

    def _bucketed(self, writer: DataFrameWriter, buckets: int, path: str) -> None:
        table = f"staging_{uuid.uuid4().hex}"
        writer.bucketBy(buckets, *PAIR).sortBy(*PAIR).option("path", path).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # its files stay

    def read(self, name: str, entry: Entry | None = None) -> DataFrame:
        """A table of the last version, or as an entry describes it; its folders stay those of that version.

        Tables kept by week or in buckets become catalog tables: with a partition a week, a selection lists and opens
        the files of its weeks alone; with buckets, joins on the pair need no shuffle.
        """
        entry = entry or self.version().tables[name]
        schema = T.StructType.fromJson(json.loads(entry.schema))
        if not entry.parts:
            return self.spark.createDataFrame([], schema)
        if not entry.weekly and not entry.buckets:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{entry.parts[''].path}")
        places = {week: f"{self.root}/{p.path}" for week, p in sorted(entry.parts.items())}
        table = f"{name}_{hashlib.sha256(json.dumps([entry.schema, entry.buckets, places]).encode()).hexdigest()[:16]}"
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            by_week = f"PARTITIONED BY ({WEEK})" if entry.weekly else ""
            clustered = f"CLUSTERED BY ({', '.join(PAIR)}) INTO {entry.buckets} BUCKETS" if entry.buckets else ""
            place = f"{self.root}/{name}" if entry.weekly else places[""]
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {by_week} {clustered} LOCATION '{place}'")
            if entry.weekly:
                added = " ".join(f"PARTITION ({WEEK} = DATE '{week}') LOCATION '{place}'" for week, place in places.items())
                self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {added}")
        return self.spark.table(table).select(*schema.names)

    # -- clean-up ------------------------------------------------------------------

    def vacuum(self, keep: int = KEPT, grace_hours: float = GRACE_HOURS) -> list[str]:
        """Remove versions before the last `keep`, and data that no version names any more; returns what went.

        Folders younger than the grace are left alone: a run may be writing them. Only folders of tables that some
        version names are looked at.
        """
        numbers = self._numbers()
        last = [self.version(n) for n in numbers[-keep:] if self._whole(n)]
        named = {p.path for v in last for e in v.tables.values() for p in e.parts.values()}
        tables = {t for n in numbers if self._whole(n) for t in self.version(n).tables}
        before = (time.time() - grace_hours * 3600) * 1000
        gone = []
        for table in sorted(tables):
            for run, changed in storage.listed(self.spark, f"{self.root}/{table}"):
                path = f"{table}/{run}"
                if changed > before or path in named:
                    continue
                weeks = [f"{path}/{w}" for w, _ in storage.listed(self.spark, f"{self.root}/{path}") if w.startswith(f"{WEEK}=")]
                kept = [w for w in weeks if w in named]
                gone += [w for w in weeks if w not in named] if kept else [path]
        for n in numbers[:-keep]:
            storage.remove(self.spark, self._manifest(n))
        for path in gone:
            storage.remove(self.spark, f"{self.root}/{path}")
        return gone

    def _whole(self, number: int) -> bool:
        try:
            return bool(self.version(number))
        except ValueError:
            return False


