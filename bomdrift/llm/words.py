"""Words of whole Arrow string columns as numpy arrays: byte ranges and 64-bit hashes, no per-word Python."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the memory of a Python worker (a longer single text is handled alone).
SLICE_BYTES = 2 << 20

_RANDOM = np.random.default_rng(20240611)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _STEP = (int(x) | 1 for x in _RANDOM.integers(2**60, 2**63, 2))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Words are runs of anything but ASCII blanks: [^\x20\x09-\x0D]+
BLANKS = np.ones(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words are runs of ASCII letters and digits and of every code point above ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.ones(256, bool)
ALNUM[:128] = False
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
#: Words are runs of ASCII letters and of every code point above ASCII: [^\x00-\x40\x5B-\x60\x7B-\x7F]+ once folded
ALPHA = ALNUM.copy()
ALPHA[0x30:0x3A] = False
#: Words are runs of [A-Za-z\u00C0-\u00FF] once folded: 0xC3 is the first byte of just these code points beyond ASCII.
LATIN = ALPHA.copy()
LATIN[128:] = False
LATIN[0xC3] = True
#: Lower case of A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python process: reused workers keep it from task to task."""
    return sys.__dict__.setdefault("_bomdrift_llm", {}).setdefault(name, {})


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    powers = process_cache("powers")
    have = powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * SLICE_BYTES:
            powers[base] = have
    return have


def _rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for every pair, from one prefix sum."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values))[: len(values)], out=sums[1:])
    back = _powers(pow(base, -1, 2**64), len(values) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of rows: word i has the bytes data[start[i]:end[i]]; row r has words offset[r]:offset[r + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offset: np.ndarray
    at: np.ndarray  # bytes of row r: data[at[r]:at[r + 1]]

    def count(self, bytes_: np.ndarray) -> np.ndarray:
        """Of each row, how many bytes are marked."""
        sums = np.concatenate(([0], np.cumsum(bytes_)))
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def keyed(self, row: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Hashes that differ between rows as well as between values."""
        return mix(value + mix(row.astype(np.uint64) + np.uint64(1)))

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offset) - 1), np.diff(self.offset))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of `size` words within a row, in order."""
        if len(self.hash) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.arange(len(self.hash) - size + 1)
        row = self.row()
        first = first[row[first] == row[first + size - 1]]
        return first, _rolling(self.hash, first, first + size, _STEP)

    def whole(self) -> np.ndarray:
        """A hash of each row's whole word sequence."""
        return _rolling(self.hash, self.offset[:-1], self.offset[1:], _STEP)


def words(texts: pa.Array, kind: np.ndarray = BLANKS, fold: bool = False) -> Words:
    """Split every text; null has no words."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if fold:
        data = FOLD[data]
    inside = kind[data]
    if kind is LATIN:
        inside[1:] |= data[:-1] == 0xC3
    edge = np.zeros(len(data) + 1, bool)  # a word can't run on from one row into the next
    edge[at] = True
    start = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1 if len(data) else start
    return Words(data, start, end, _rolling(_BYTE[data], start, end, _BASE), np.searchsorted(start, at), at)


def strings(w: Words, chosen: np.ndarray) -> pa.Array:
    """The chosen words as an Arrow string column."""
    length = w.end[chosen] - w.start[chosen]
    to = np.concatenate(([0], np.cumsum(length)))
    data = w.data[np.repeat(w.start[chosen] - to[:-1], length) + np.arange(to[-1])]
    return pa.Array.from_buffers(pa.string(), len(chosen), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data)])


class Tally:
    """Sums of counts by key columns, gathered over many slices in bounded memory; Spark adds what tasks emit."""

    def __init__(self, keys: list[str], counts: list[str], limit: int = 400_000) -> None:
        self.keys, self.counts, self.limit = keys, counts, limit
        self.parts: list[pa.Table] = []
        self.rows = 0

    def _merged(self) -> pa.Table:
        whole = pa.concat_tables(self.parts).combine_chunks()
        summed = whole.group_by(self.keys, use_threads=False).aggregate([(c, "sum") for c in self.counts])
        return summed.select([*self.keys, *(f"{c}_sum" for c in self.counts)]).rename_columns([*self.keys, *self.counts])

    def add(self, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        """Takes in more counts; what no longer fits is put out."""
        self.parts.append(pa.table(columns))
        self.rows += self.parts[-1].num_rows
        if self.rows > self.limit:
            self.parts = [self._merged()]
            self.rows = self.parts[0].num_rows
            if self.rows > self.limit // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """Puts out all that is left."""
        if self.parts:
            yield from self._merged().to_batches(max_chunksize=50_000)
        self.parts, self.rows = [], 0


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text size (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            done = length[first - 1] if first else 0
            after = max(first + 1, int(np.searchsorted(length, done + limit, "right")))
            yield batch.slice(first, after - first)
            first = after

