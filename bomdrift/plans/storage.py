"""Files and folders of any storage that Hadoop reads, and the layout of written tables."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    """Hadoop file system of a path, so that any shared storage works."""
    jvm = spark._jvm  # noqa: SLF001
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), jvm  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    fs, jvm = _fs(spark, path)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path))


def remove(spark: SparkSession, path: str) -> None:
    fs, jvm = _fs(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of what a folder holds; nothing if there is no such folder."""
    fs, jvm = _fs(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = fs.listStatus(folder) if fs.exists(folder) else []
    return [(f.getPath().getName(), f.getModificationTime()) for f in found]


def files_size(spark: SparkSession, *frames: DataFrame) -> int:
    """Bytes of all files that the frames read, each once."""
    total = 0
    for path in {path for df in frames for path in df.inputFiles()}:
        fs, jvm = _fs(spark, path)
        total += fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))).getLen()
    return total


def read_text(spark: SparkSession, path: str) -> str:
    """A small file; one that was not written to its end raises ValueError."""
    fs, jvm = _fs(spark, path)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "ChecksumException":
            raise
        raise ValueError(f"{path} is broken") from error
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; returns whether this call did, and not another run before it."""
    fs, jvm = _fs(spark, path)
    try:
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(path), False)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    stream.write(text.encode())
    stream.close()
    return True


def laid_out(df: DataFrame) -> DataFrame:
    """Arrange a table with weeks for pruning: balanced files by year and line, week order.

    REBALANCE lets AQE split a hot year or line over several files and merge small ones; the
    local sort gives the page statistics that skip other weeks.
    """
    if "iso_year" not in df.columns:
        return df
    spread = [c for c in ("iso_year", "parent_line", "line") if c in df.columns]
    order = [c for c in ("week_start", "parent_line", "component_id") if c in df.columns]
    return df.hint("rebalance", *[F.col(c) for c in spread]).sortWithinPartitions(*order)


def write(df: DataFrame, path: str) -> None:
    laid_out(df).write.mode("overwrite").parquet(path)
