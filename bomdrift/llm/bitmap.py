"""A bitmap of ids, of one size whatever their number: rows whose id has no bit need no join with a table of the ids.

Other ids may share a bit with one of them, so rows that have theirs are still to be joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomdrift.llm.words import mix

#: 4 MB are broadcast.
LOG_BITS = 25


def _cells(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - LOG_BITS)).astype(np.int64)


def bitmap(ids: DataFrame) -> Broadcast:
    """The bits of the ids, the only column, long and not null; the driver gets a row for each 64 bits that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _cells(batch[0].to_numpy())
            yield pa.record_batch([pa.array(cells >> 6, pa.int32()), pa.array(np.left_shift(np.int64(1), cells & 63))], ["word", "bits"])

    found = ids.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((1 << LOG_BITS) // 64, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(words.tobytes())


def among(ids: pa.Array, bits: Broadcast) -> pa.Array:
    """Of every id whether it has its bit."""
    cells = _cells(ids.to_numpy(zero_copy_only=False))
    return pa.array((np.frombuffer(bits.value, np.int64)[cells >> 6] >> (cells & 63)) & 1 == 1)
