"""Tables and files in the shared folder that the session names; what they hold survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir; a local session without the setting gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = spark.sparkContext.applicationId
        root = _LOCAL[own] = _LOCAL.get(own) or tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The same rows, computed once and read back from the shared folder; cuts the lineage."""
    path = folder(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    read = frame.sparkSession.read.schema(frame.schema).parquet(path)
    _PATHS[read] = path
    return read


def discard(frame: DataFrame) -> None:
    """Remove what `written` wrote for this frame, once nothing reads it any more."""
    spark, path = frame.sparkSession, _PATHS.pop(frame)
    folder_ = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    folder_.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder_, True)  # noqa: SLF001


def filesystem(uri: str):
    """The Arrow file system of a folder's URI and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, whatever their names."""
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(1).alias("_"), *others).alias("doc_row"))


def unbundled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the documents that were bundled."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("doc_row").getField(c).alias(c) for c in columns))
