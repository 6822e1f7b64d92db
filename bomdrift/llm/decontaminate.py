"""Benchmark decontamination: a broadcast set of normalised test n-grams against the word windows of every text.

A benchmark item is cut into windows of `size` words (an item of fewer words, but not none, is one window).
The hashes of all windows are a sorted array that is broadcast; its size is counted first, and beyond
`block` entries the windows are split into blocks that scan the documents one after the other. Each task
hashes all windows of its texts at once, looks them up, and compares the words of every hit.

Null and empty texts have no words: documents hit nothing, items are skipped. A null item_id is the
item ''. Rows that repeat an item_id are one item. Repeated documents are scanned alike.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomdrift.llm.store import written
from bomdrift.llm.words import ALNUM, Words, slices, words

WINDOW = 10
#: (window, item) pairs that are broadcast at once; about 150 bytes each.
BLOCK = 500_000


def _text(w: Words, first: int, size: int) -> bytes:
    return b" ".join(w.data[w.start[i] : w.end[i]].tobytes() for i in range(first, first + size))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(n, window, item): the distinct windows of every item; n words joined by one blank."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w, found = words(batch["text"], ALNUM, fold=True), set()
            for row, item in enumerate(batch["item"].to_pylist()):
                first, n = int(w.offset[row]), int(w.offset[row + 1] - w.offset[row])
                m = min(n, size)
                found.update((m, _text(w, first + i, m), item) for i in range(n - m + 1 if n else 0))
            n, text, item = zip(*found) if found else ((), (), ())
            yield pa.record_batch([pa.array(n, pa.int32()), pa.array(text, pa.binary()), pa.array(item, pa.string())], ["n", "window", "item"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(cut, "n int, window binary, item string").distinct()


class _Index:
    """Windows by length: sorted hashes, a bit table before them, and the items of each window's words."""

    def __init__(self, rows: list):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        texts = defaultdict(list)
        for n, window, item in rows:
            if window not in self.items:
                texts[n].append(bytes(window))
            self.items[bytes(window)].append(item)
        self.known = {}
        for n, own in texts.items():
            w = words(pa.array(own, pa.binary()), ALNUM)
            known = np.sort(w.windows(n)[1])
            bits = np.zeros(1 << 16, bool)
            bits[known >> np.uint64(48)] = True
            self.known[n] = known, bits

    def hits(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items by row."""
        hit, found, row = np.zeros(len(w.hash), bool), defaultdict(set), None
        for n, (known, bits) in self.known.items():
            first, value = w.windows(n)
            maybe = np.flatnonzero(bits[value >> np.uint64(48)])
            at = np.searchsorted(known, value[maybe])
            for i in first[maybe[known[np.minimum(at, len(known) - 1)] == value[maybe]]].tolist():
                if items := self.items.get(_text(w, i, n)):
                    row = w.row() if row is None else row
                    hit[i : i + n] = True
                    found[int(row[i])].update(items)
        return hit, found


def _without(w: Words, hit: np.ndarray, text: str) -> str:
    """One text without its hit words and what stands between them."""
    raw, base, parts = text.encode(), 0, []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        parts.append(raw[base : int(w.start[a])])
        base = int(w.end[b - 1])
    return b"".join([*parts, raw[base:]]).decode()


def scan(docs: DataFrame, benchmark: DataFrame, *keep: str, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, `keep`, n_words, n_hit, items (sorted), cleaned (the text without hit words) for every row of docs.

    Cleaning repeats until no window occurs: cutting a span can bring words together. Every round cuts at once what the
    windows of all blocks hit in the same text; with several blocks, only the texts that were cut are scanned again.
    """
    spark = docs.sparkSession
    grams = written(item_windows(benchmark, size), "benchmark")
    blocks = max(1, -(-grams.count() // block))

    def scanned(rows: DataFrame, *own: str) -> DataFrame:
        """own, text, n_words, at (the hit words), items, cleaned."""
        frame = rows.select(*own, "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("items"), F.col("text").alias("cleaned"))
        for k in range(blocks):
            part = grams.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k).select("n", "window", "item").collect()
            sent = spark.sparkContext.broadcast([(n, bytes(window), item) for n, window, item in part])
            frame = _scan(frame, sent, k == blocks - 1, blocks == 1)
            if blocks > 1:
                frame = written(frame, "scanned")
                sent.unpersist()
        return frame

    names = ["doc_id", *keep, "n_words", "n_hit", "items"]
    found = scanned(docs, "doc_id", *keep).select("doc_id", *keep, "n_words", F.size("at").cast("long").alias("n_hit"), F.array_sort("items").alias("items"), "cleaned")
    if blocks == 1:
        return found
    done, cut = found.where("n_hit = 0"), found.where("n_hit > 0")
    while not cut.isEmpty():
        again = scanned(cut.select(F.struct(*names).alias("found"), F.col("cleaned").alias("text")), "found")
        rest = lambda hit: again.where((F.size("at") > 0) == hit).select("found.*", "cleaned")
        done, cut = done.union(rest(False)), rest(True)
    return done


def _scan(frame: DataFrame, rows, last: bool, alone: bool) -> DataFrame:
    """Add what one block hits in `text`; the last block cuts what all have hit, and if it is alone, as long as it hits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(rows.value)
        for batch in slices(batches):
            w = words(batch["text"], ALNUM, fold=True)
            hit, found = index.hits(w)
            at, items, cleaned = batch["at"].to_pylist(), batch["items"].to_pylist(), batch["cleaned"].to_pylist()
            for row, own in found.items():
                lo, hi = int(w.offset[row]), int(w.offset[row + 1])
                at[row] = sorted({*at[row], *np.flatnonzero(hit[lo:hi]).tolist()})
                items[row] = sorted({*items[row], *own})
            for row in [r for r in range(batch.num_rows) if last and at[r]]:
                own = words(pa.array([cleaned[row]]), ALNUM, fold=True)
                cut = np.zeros(len(own.hash), bool)
                cut[at[row]] = True
                while cut.any():
                    cleaned[row] = _without(own, cut, cleaned[row])
                    if not alone:
                        break
                    own = words(pa.array([cleaned[row]]), ALNUM, fold=True)
                    cut, _ = index.hits(own)
            new = {"n_words": pa.array(np.diff(w.offset), pa.int64()), "at": pa.array(at, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string())), "cleaned": pa.array(cleaned, pa.string())}
            yield pa.record_batch([new[n] if n in new else batch[n] for n in batch.schema.names], batch.schema.names)

    return frame.mapInArrow(search, frame.schema)
