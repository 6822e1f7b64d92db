"""Best-fit packing with certificates: partitions pack by best-fit decreasing, dual-feasible functions bound them.

Items are dealt to partitions of bounded size by a hash. Each partition packs its items by best-fit
decreasing and computes a lower bound of its number of sequences with two families of dual-feasible
functions. Where both are equal the partition is certified and final. The rest keep their full sequences,
exchange the documents of all others, and pack again in new partitions, until nothing is gained.

Items that are longer than a sequence are cut before; an item's length is at least 1. Null and empty texts
have their end id. Rows that repeat are packed as often as they come. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomdrift.llm.store import written
from bomdrift.llm.tokens import Encoder, encoded

CAPACITY = 2048
#: Items that a partition packs; about 100 bytes each.
ITEMS = 200_000
ROUNDS = 8


def pieces(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids: every text's ids and `end`, cut if longer than `capacity`."""
    tokens = encoded(docs, path, end, "doc_id")
    cut = F.expr(f"transform(sequence(0, (size(ids) - 1) div {capacity}), i -> slice(ids, CAST(i AS int) * {capacity} + 1, {capacity}))")
    return tokens.select("doc_id", F.posexplode(cut).alias("piece", "ids")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.size("ids").cast("long").alias("length"), "ids"
    )


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first into the fullest bin that has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    some, made = 0, 0  # bit r: some bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fits = some >> need
        if fits:
            have = need + (fits & -fits).bit_length() - 1
            own = room[have].pop()
            if not room[have]:
                some ^= 1 << have
        else:
            own, have, made = made, capacity, made + 1
        bins[item], offsets[item] = own, capacity - have
        if have > need:
            room[have - need].append(own)
            some |= 1 << (have - need)
    return bins, offsets


def lower_bound(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """Least number of bins for count[x] items of length x, by dual-feasible functions."""
    x = np.arange(len(count))
    best = -(-int((count * x).sum()) // capacity)
    for least in range(1, capacity // 2 + 1):  # long items fill a bin, short ones count nothing
        f = np.where(x > capacity - least, capacity, np.where(x < least, 0, x))
        best = max(best, -(-int((count * f).sum()) // capacity))
    for k in range(1, 64):  # rounded down to multiples of capacity / k, but for exact multiples of capacity / (k + 1)
        f = np.where(x * (k + 1) % capacity == 0, x * k, (x * (k + 1) // capacity) * capacity)
        best = max(best, -(-int((count * f).sum()) // (k * capacity)))
    return best


def _packed(items: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("item", ignore_index=True)
        length = own["length"].to_numpy()
        bins, offset = best_fit(length, capacity)
        bound = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        made = int(bins.max()) + 1
        full = np.bincount(bins, length)[bins] == capacity
        part = int(own["part"].iloc[0])
        return pd.DataFrame({
            "item": own["item"], "length": length, "sequence_id": (turn << 56) + (part << 32) + bins, "offset": offset,
            "settled": full | (made == bound), "first": bins * 0 + (offset == 0),
        })

    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, "item long, length long, sequence_id long, offset long, settled boolean, first long")


def pack(items: DataFrame, capacity: int = CAPACITY, size: int = ITEMS) -> DataFrame:
    """item, sequence_id, offset for every row (item: unique long, length: 1 to capacity)."""
    n = items.count()
    result = written(_packed(items, max(1, -(-n // size)), 0, capacity), "packed")
    for turn in range(1, ROUNDS):
        rest = result.where("NOT settled")
        before = rest.agg(F.count("*"), F.sum("first")).first()
        parts = -(-before[0] // size)
        if not before[0]:
            break
        again = written(_packed(rest.select("item", "length"), parts, turn, capacity), "packed")
        if again.agg(F.sum("first")).first()[0] >= before[1]:
            break
        result = result.where("settled").unionByName(again)
    return result.select("item", "sequence_id", "offset")


def certificate(items: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences that were made, and the least that any packing of all items needs."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # capacity rows at most
        count[length] = n
    return packed.where("offset = 0").count(), lower_bound(count, capacity)


def checksums(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and ids_crc32 of `ids` as little-endian unsigned 32-bit integers."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()
        for batch in batches:
            ids = batch["ids"]
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), ids.offsets.to_pylist()
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
            yield pa.record_batch([*(batch[n] for n in keep), pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    return rows.select(*keep, "ids").mapInArrow(run, rows.select(*keep).withColumn("ids_crc32", F.lit(0).cast("long")).schema)


def sequences(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The written pieces (item, doc_id, piece, start, length, ids) and the place of each item."""
    cut = written(pieces(docs, path, end, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return cut, pack(cut.select("item", "length"), capacity)
