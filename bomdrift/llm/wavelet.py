"""Token ids as wavelet matrices: one compressed file per shard with access, counting and occurrence lookup.

Documents are dealt to ranges of ascending doc_id. Each task sorts its ranges, and writes a file whenever
`shard` ids have come together, so that a shard is a run of neighbouring documents. Files have names of
their own attempt; the manifest, a table, names those that count.

A file holds, after a JSON header: doc_ids and document ends, and for every bit of an id, highest first, the
plane of that bit over all positions, each plane stably sorted by the bits before. Planes are cut into
blocks of BLOCK bits that are compressed one by one, with the number of ones before each block, so that
access, rank and select read single blocks.

Null and empty texts have the end id only. Null doc_ids come first. Rows that repeat are written as often
as they come. An empty table gives no shards.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bomdrift.llm.store import filesystem, folder, written
from bomdrift.llm.tokens import SLICE, Encoder
from bomdrift.llm.words import slices

MAGIC = b"WVM1"
SHARD = 1 << 22
BLOCK = 1 << 18
#: Rows that one range of doc_ids has, about, and how many ranges there are at most; a range is sorted in a task.
RANGE, RANGES = 5_000, 10_000


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's file: documents, the positions after them, and all ids."""
    x = ids.astype(np.uint32 if len(ids) and ids.max() > 0xFFFF else np.uint16)
    bits = max(1, int(x.max()).bit_length() if len(x) else 1)
    parts, planes = [], []
    for bit in range(bits - 1, -1, -1):
        plane = (x >> bit & 1).astype(bool)
        blocks = [plane[i : i + BLOCK] for i in range(0, len(plane), BLOCK)]
        ones = [int(np.count_nonzero(b)) for b in blocks]
        parts += [_squeeze(np.packbits(b).tobytes()) for b in blocks]
        planes.append({"zeros": len(x) - sum(ones), "ones": np.cumsum([0, *ones]).tolist(), "bytes": [len(p) for p in parts[len(parts) - len(blocks) :]]})
        x = np.concatenate((x.compress(~plane), x.compress(plane)))  # several times as fast as indexing
    docs = [_squeeze(json.dumps(doc_ids).encode()), _squeeze(ends.astype("<i8").tobytes())]
    head = json.dumps({"n": len(ids), "bits": bits, "block": BLOCK, "docs": [len(d) for d in docs], "planes": planes}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *docs, *parts])


class Shard:
    """A shard's file, opened: reads the header and documents, and blocks of planes as they are needed."""

    def __init__(self, file):
        self.file = file
        magic, size = struct.unpack("<4sI", file.read(8))
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.head = json.loads(file.read(size))
        self.n, self.bits, self.block = (self.head[k] for k in ("n", "bits", "block"))
        a, b = self.head["docs"]
        self.doc_ids = json.loads(zstandard.decompress(file.read(a)))
        self.ends = np.frombuffer(zstandard.decompress(file.read(b)), "<i8")
        at, self.place = 8 + size + a + b, []
        for plane in self.head["planes"]:
            self.place.append([at, *(at + np.cumsum(plane["bytes"])).tolist()])
            at = self.place[-1][-1]
        self.bits_of = lru_cache(maxsize=64)(self._bits_of)

    def _bits_of(self, level: int, block: int) -> np.ndarray:
        at = self.place[level]
        self.file.seek(at[block])
        raw = zstandard.decompress(self.file.read(at[block + 1] - at[block]))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=min(self.block, self.n - block * self.block))

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        block, rest = divmod(i, self.block)
        ones = self.head["planes"][level]["ones"][block]
        return ones + (int(np.count_nonzero(self.bits_of(level, block)[:rest])) if rest else 0)

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level, plane in enumerate(self.head["planes"]):
            block, rest = divmod(i, self.block)
            bit, ones = int(self.bits_of(level, block)[rest]), self._ones(level, i)
            value, i = 2 * value + bit, plane["zeros"] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        """Where positions i to j that hold the token stand after the last plane."""
        for level, plane in enumerate(self.head["planes"]):
            a, b = self._ones(level, i), self._ones(level, j)
            i, j = (plane["zeros"] + a, plane["zeros"] + b) if token >> (self.bits - 1 - level) & 1 else (i - a, j - b)
        return i, j

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often a token occurs from start to stop (rank)."""
        if token >> self.bits or not self.n:
            return 0
        i, j = self._range(token, start, self.n if stop is None else stop)
        return j - i

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value in a plane."""
        plane = self.head["planes"][level]
        before = [x if bit else b * self.block - x for b, x in enumerate(plane["ones"])]
        before[-1] = plane["ones"][-1] if bit else plane["zeros"]
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * self.block + int(np.flatnonzero(self.bits_of(level, block) == bit)[k - before[block]])

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token (select)."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.head["planes"][level]["zeros"] if bit else i)
        return i

    @cached_property
    def ids(self) -> np.ndarray:
        """All ids, the sorting undone plane by plane."""
        x = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            plane = np.concatenate([self._bits_of(level, b) for b in range(len(self.head["planes"][level]["bytes"]))] or [np.zeros(0, np.uint8)]).astype(bool)
            zeros, before = self.head["planes"][level]["zeros"], np.empty_like(x)
            np.place(before, ~plane, x[:zeros])
            np.place(before, plane, x[zeros:] | x.dtype.type(1 << (self.bits - 1 - level)))
            x = before
        return x


def write(docs: DataFrame, path: str, end: int, shard: int = SHARD, ranges: int | None = None) -> DataFrame:
    """Write all documents; the manifest: part, turn (shards in order), file, docs, tokens."""
    to = folder(docs.sparkSession, "wavelet")
    n = ranges or min(max(1, -(-docs.count() // RANGE)), RANGES)
    cuts = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})
    bounds = np.array(cuts, np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in slices(batches, limit=SLICE):
            ids, at = encoder.encode(b["text"])
            raw, last = ids.astype("<u4").tobytes() if encoder.wide else ids.astype("<u2").tobytes(), struct.pack("<I" if encoder.wide else "<H", end)
            width = len(last)
            own = np.searchsorted(bounds, b["doc_id"].cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False), "left")
            rows = [raw[width * i : width * j] + last for i, j in zip(at.tolist(), at[1:].tolist())]
            yield pa.record_batch([pa.array(own, pa.int32()), b["doc_id"].cast(pa.int64()), pa.array(np.full(b.num_rows, width), pa.int32()), pa.array(rows, pa.binary())], ["part", "doc_id", "width", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()
        fs, root = filesystem(to)
        fs.create_dir(root, recursive=True)
        attempt, now, turn, held, ids, ends, size = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}", None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{root}/{now:06d}-{turn:06d}-{attempt}.wvm"
            with fs.open_output_stream(name) as out:
                out.write(pack(held, np.array(ends, np.int64), np.concatenate(ids)))
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([turn], pa.int32()), [f"{to}/{name.rpartition('/')[2]}"], pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], ["part", "turn", "file", "docs", "tokens"])

        for b in batches:
            for p, doc, width, raw in zip(b["part"].to_pylist(), b["doc_id"].to_pylist(), b["width"].to_pylist(), b["ids"]):
                if held and (p != now or size >= shard):
                    yield flush()
                    turn = turn + 1 if p == now else 0
                    held, ids, ends, size = [], [], [], 0
                elif p != now:
                    turn = 0
                now = p
                ids.append(np.frombuffer(raw.as_buffer(), f"<u{width}"))
                size += len(ids[-1])
                held.append(doc)
                ends.append(size)
        if held:
            yield flush()

    rows = docs.select("doc_id", "text").mapInArrow(dealt, "part int, doc_id long, width int, ids binary")
    rows = rows.repartition(n, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
    return written(rows.mapInArrow(save, "part int, turn int, file string, docs long, tokens long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in all shards), ids of every document, from the files."""
    within = Window.partitionBy("part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    totals = dict(map(tuple, manifest.groupBy("part").agg(F.sum("tokens")).collect()))  # RANGES rows at most
    before = F.split(F.lit(",".join(str(x) for x in accumulate((totals.get(p, 0) for p in range(max(totals, default=0))), initial=0))), ",").cast("array<bigint>")
    files = manifest.select("file", (F.get(before, F.col("part")) + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("base"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()
        for b in batches:
            for uri, base in zip(b["file"].to_pylist(), b["base"].to_pylist()):
                fs, name = filesystem(uri)
                with fs.open_input_file(name) as file:
                    s = Shard(file)
                    at = np.concatenate(([0], s.ends))
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s.ids.astype(np.int32)))
                    yield pa.record_batch([pa.array(s.doc_ids, pa.int64()), pa.array(base + at[:-1], pa.int64()), lists], ["doc_id", "start", "ids"])

    n = max(1, manifest.count())
    return files.repartition(n, "file").mapInArrow(load, "doc_id long, start long, ids array<int>")
