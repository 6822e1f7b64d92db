"""Exports as one ordered set of files.

    <path>/header.csv                  the header line, once (header.txt for TSV, none for Parquet)
    <path>/part-00000-<run>-c000.csv   rows in sort order: ranges by part number, rows within a part
    <path>/_manifest.json              format, columns and, for every part in order, its first row's number and its rows

Header and parts, joined in the manifest's order, are the sorted rows as one file. The manifest is written last: a
folder without it holds an export that is being written or was cut off, and is refused. The driver handles a name and
a count for each part, never rows.

NULL and the empty text differ in CSV (nothing, and two quotes) but where a single column is exported, whose fields
are all quoted so that no line is blank; both are empty in TSV, as in any text to paste.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomdrift.plans import storage

MANIFEST = "_manifest.json"
HEADER = {"csv": "header.csv", "tsv": "header.txt"}
FORMATS = ("csv", "tsv", "parquet")
# The CSV writer and reader strip blanks unless told otherwise; quotes are doubled, as other readers expect.
_CSV = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}


@dataclass(frozen=True)
class Part:
    name: str
    first: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    fmt: str
    columns: tuple[str, ...]
    parts: tuple[Part, ...]

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)


def _number(name: str) -> tuple[int, int]:
    """The place of a part: its task's number, then the file's number within the task."""
    part, file = re.match(r"part-(\d+)-.*?(?:-c(\d+))?\.", name).groups()
    return int(part), int(file or 0)


def _stored(spark: SparkSession, path: str, fmt: str, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The rows of the parts: texts of CSV and TSV as strings."""
    files = [f"{path}/{name}" for name in names]
    if fmt == "parquet":
        return spark.read.parquet(*files)
    if fmt == "tsv":  # no quotes and no line feeds within a field
        fields = F.split("value", "\t", -1)
        lines = spark.read.option("lineSep", "\n").text(files)
        return lines.select(*[fields[i].alias(c) for i, c in enumerate(columns)])
    schema = ", ".join(f"`{c}` string" for c in columns)
    # Nothing between two separators is read as this mark, hence as NULL, and two quotes as the empty text.
    return spark.read.schema(schema).options(multiLine=True, nullValue="\u0001\u0001", emptyValue="", **_CSV).csv(files)


def write(rows: DataFrame, path: str, fmt: str, labels: Sequence[str] | None = None) -> Manifest:
    """Write sorted rows, in place of an export at this path; TSV takes rows of texts without tabs and line feeds."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    spark, path, columns = rows.sparkSession, path.rstrip("/"), tuple(rows.columns)
    storage.remove(spark, f"{path}/{MANIFEST}")
    if fmt == "parquet":
        rows.write.mode("overwrite").parquet(path)
    elif fmt == "tsv":
        lines = rows.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns]).alias("value"))
        lines.write.mode("overwrite").option("lineSep", "\n").text(path)
    else:
        rows.write.mode("overwrite").options(quoteAll=len(columns) == 1, **_CSV).csv(path)
    if fmt != "parquet":
        storage.create_text(spark, f"{path}/{HEADER[fmt]}", ("\t" if fmt == "tsv" else ",").join(labels or columns) + "\n")
    names = sorted((n for n, _ in storage.listed(spark, path) if n.startswith("part-")), key=_number)
    counted = {}
    if names:
        lines = spark.read.option("lineSep", "\n").text([f"{path}/{n}" for n in names]) if fmt == "tsv" else _stored(spark, path, fmt, columns, names)
        found = lines.groupBy(F.col("_metadata.file_name").alias("name")).count().collect()  # a row for each part
        counted = {r["name"]: r["count"] for r in found}
    parts, first = [], 0
    for name in names:
        parts.append(Part(name, first, counted.get(name, 0)))
        first += parts[-1].rows
    manifest = Manifest(fmt, columns, tuple(parts))
    storage.create_text(spark, f"{path}/{MANIFEST}", json.dumps(asdict(manifest)))
    return manifest


def manifest_of(spark: SparkSession, path: str) -> Manifest:
    if not storage.exists(spark, f"{path}/{MANIFEST}"):
        raise ValueError(f"{path} holds no finished export")
    stored = json.loads(storage.read_text(spark, f"{path}/{MANIFEST}"))
    return Manifest(stored["fmt"], tuple(stored["columns"]), tuple(Part(**p) for p in stored["parts"]))


def read(spark: SparkSession, path: str, first: int = 0, rows: int | None = None) -> DataFrame:
    """A finished export; with bounds, the parts that hold the rows numbered from `first` on, and no others."""
    path = path.rstrip("/")
    manifest = manifest_of(spark, path)
    last = manifest.rows if rows is None else first + rows
    names = [p.name for p in manifest.parts if p.first < last and p.first + p.rows > first]
    if not names:
        names = [p.name for p in manifest.parts[:1]]
        return _stored(spark, path, manifest.fmt, manifest.columns, names).limit(0)
    return _stored(spark, path, manifest.fmt, manifest.columns, names)
