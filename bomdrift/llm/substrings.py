"""Substring deduplication on a De Bruijn graph of word k-mers with minimizers.

A word is removed if a window of `size` words that covers it also starts in a document with a smaller
doc_id. Texts of equal words are one text; all but the first of them lose everything. Windows of the rest:

1. Every window has a minimizer, the least hash of its runs of size / 2 words. Only minimizers that stand in
   two different texts can belong to a repeated window; they are found from about 1/13 of the positions.
2. The windows with such minimizers become edges between their first and last size - 1 words. Edges found in
   two documents stay, each with a source: the first place in the document with the smallest doc_id.
3. Edges that follow each other in their source are compacted into one path, up to a node where documents part or
   meet. The join of all edges with these paths turns every document's edges into spans, at one distance to the source.
4. Each span is compared with its source's words by a digest of both, taken at their coordinates.

Null doc_ids count as larger than any other. Null and empty texts have no words. Rows that repeat a doc_id are
one document: none of them is a smaller one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomdrift.llm.bitmap import among, bitmap
from bomdrift.llm.store import bundled, discard, unbundled, written
from bomdrift.llm.words import Words, slices, words

SIZE = 50
#: Bytes of text that become words at once.
SLICE = 1 << 20
NONE = 2**63 - 1


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch["doc_id"].cast(pa.int64()).fill_null(NONE)


def _whole(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every row's word sequence."""
    a = w.whole()
    return a.view(np.int64), Words(w.data, w.start, w.end, w.hash ^ np.uint64(0x9E3779B97F4A7C15), w.offset, w.at).whole().view(np.int64)


def _minimizers(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and minimizer of every window."""
    first, value = w.windows(size)
    part = size // 2
    at, short = w.windows(part)
    least = np.full(len(w.hash), 2**64 - 1, np.uint64)
    least[at] = short
    width, span = 1, size - part + 1  # least over `span` runs, by doubling
    while width < span:
        step = min(width, span - width)
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return first, value, least[first]


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, one, two (128 bits of the words), n_words, and the distinct minimizers of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            w = words(batch["text"])
            first, _, least = _minimizers(w, size)
            row = w.row()[first]
            order = np.lexsort((least, row))
            row, least = row[order], least[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
            row, least = row[new], least[new]
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            one, two = _whole(w)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(least.view(np.int64)))
            yield pa.record_batch([_ids(batch), pa.array(one), pa.array(two), pa.array(np.diff(w.offset), pa.int64()), lists], ["doc_id", "one", "two", "n_words", "least"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, one long, two long, n_words long, least array<long>")


def _edges(texts: DataFrame, size: int) -> DataFrame:
    """(edge, doc_id, at, before, after): the windows whose minimizer is among the row's, and 16 bits of the words beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            w = words(batch["text"])
            first, value, least = _minimizers(w, size)
            known = np.unique(batch["least"].flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            place = np.searchsorted(known, least)
            take = known[np.minimum(place, len(known) - 1)] == least if len(known) else np.zeros(len(least), bool)
            first, value = first[take], value[take]
            row = w.row()[first]
            beside = np.concatenate((np.zeros(1, np.uint64), w.hash, np.zeros(1, np.uint64))).astype(np.uint16).view(np.int16)
            before = np.where(first > w.offset[row], beside[first], 0)
            after = np.where(first + size < w.offset[row + 1], beside[first + size + 1], 0)
            at = first - w.offset[row] + (batch["turn"].to_numpy()[row].astype(np.int64) << 32)
            out = [value.view(np.int64), batch["doc_id"].to_numpy()[row], at, before, after]
            for k in range(0, max(len(first), 1), 100_000):
                yield pa.record_batch([pa.array(x[k : k + 100_000]) for x in out], ["edge", "doc_id", "at", "before", "after"])

    return texts.select("doc_id", "turn", "text", "least").mapInArrow(run, "edge long, doc_id long, at long, before short, after short")


def _paths(found: DataFrame) -> DataFrame:
    """(edge, source, source_at, path): repeated edges with their source, on compacted paths.

    A path goes on from an edge to the next in its source while every document goes on by the same word and comes by the same.
    """
    edges = found.groupBy("edge").agg(
        F.min(F.struct("doc_id", "at")).alias("src"), F.max("doc_id").alias("last"),
        (F.min("before") != F.max("before")).alias("joins"), (F.min("after") != F.max("after")).alias("parts"))
    edges = edges.where("src.doc_id < last").select("edge", F.col("src.doc_id").alias("source"), F.col("src.at").alias("source_at"), "joins", "parts")
    order = Window.partitionBy("source").orderBy("source_at")
    before = lambda c: F.lag(c).over(order)
    begins = F.col("joins") | F.coalesce(before("parts"), F.lit(True)) | (before("source_at") != F.col("source_at") - 1)
    return edges.withColumn("path", F.sum(begins.cast("int")).over(order)).select("edge", "source", "source_at", "path")


def _spans(found: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_id, at, n, source, source_at): runs of n windows on a path of a smaller document."""
    met = found.select("edge", "doc_id", "at").join(paths, "edge").where("source < doc_id")
    order = Window.partitionBy("doc_id").orderBy("at")
    before = lambda c: F.lag(c).over(order)
    follows = (before("at") == F.col("at") - 1) & (before("source_at") == F.col("source_at") - 1) & (before("source") == F.col("source")) & (before("path") == F.col("path"))
    runs = met.withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(order))
    return runs.groupBy("doc_id", "run").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n"), F.min("source").alias("source"), F.min("source_at").alias("source_at")).drop("run")


def _marked(docs: DataFrame, wanted: Broadcast) -> DataFrame:
    """The rows of docs whose ids may be wanted, so that a join with the wanted ones shuffles few other texts.

    That join is to shuffle: broadcast, it would hold a Python worker of this step and one of the next at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(among(_ids(batch), wanted))

    return docs.mapInArrow(run, docs.schema)


def _digest(w: Words, row: int, at: int, n: int) -> bytes:
    lo = int(w.offset[row]) + at
    return hashlib.blake2b(b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start[lo : lo + n].tolist(), w.end[lo : lo + n].tolist())), digest_size=16).digest()


def _sources(spans: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(source, source_at, n, digest): the digest of the source's words of every span."""
    turn = lambda c: F.shiftright(c, 32).cast("int")
    wanted = spans.select(F.col("source").alias("doc_id"), turn("source_at").alias("turn"), "source_at", "n").distinct()
    wanted = wanted.groupBy("doc_id", "turn").agg(F.collect_list(F.struct("source_at", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            w = words(batch["text"])
            for row, (doc, own) in enumerate(zip(batch["doc_id"].to_pylist(), batch["spans"].to_pylist())):
                at, n = [x["source_at"] for x in own], [x["n"] for x in own]
                digest = [_digest(w, row, a & 0xFFFFFFFF, k + size - 1) for a, k in zip(at, n)]
                yield pa.record_batch([pa.array([doc] * len(own), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int32()), pa.array(digest, pa.binary())], ["source", "source_at", "n", "digest"])

    return texts.select("doc_id", "turn", "text").join(wanted, ["doc_id", "turn"]).mapInArrow(run, "source long, source_at long, n int, digest binary").distinct()


@dataclass
class Repeats:
    """hits: (doc_id, one, copy, spans) of every text that loses words; texts: (doc_id, one, turn, text, least) with repeated minimizers.

    doc_id is NONE where it is null. copy: a smaller document has the very words. spans: at and n words, and the source's digest.
    """

    hits: DataFrame
    texts: DataFrame


def repeats(docs: DataFrame, size: int = SIZE) -> Repeats:
    scanned = written(_scan(docs, size).where(F.col("n_words") >= size), "scanned")
    firsts = written(scanned.groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.first("least").alias("least")), "firsts")
    least = firsts.select(F.col("rep").alias("doc_id"), "one", F.explode("least").alias("least"))
    repeated = least.groupBy("least").agg(F.count("*").alias("texts")).where("texts > 1").select("least")
    wanted = least.join(repeated, "least").groupBy("doc_id", "one").agg(F.collect_list("least").alias("least"))
    wanted = wanted.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("one")) - 1)
    wanted = written(wanted, "wanted")
    near = _marked(docs.select("doc_id", "text"), bitmap(wanted.select("doc_id")))
    whole = near.select(F.coalesce("doc_id", F.lit(NONE)).alias("doc_id"), "text")
    texts = written(_matching(whole.join(wanted.hint("merge"), "doc_id")), "texts")
    discard(wanted)
    found = _edges(texts, size)
    spans = written(_spans(found, _paths(found)), "spans")
    checked = spans.join(_sources(spans, texts, size), ["source", "source_at", "n"]).select("doc_id", F.shiftright("at", 32).cast("int").alias("turn"), F.struct(F.expr("CAST(at & 4294967295 AS int)").alias("at"), (F.col("n") + size - 1).alias("n"), "digest").alias("span"))
    own = checked.groupBy("doc_id", "turn").agg(F.collect_list("span").alias("spans"))
    own = own.join(texts.select("doc_id", "turn", "one").distinct(), ["doc_id", "turn"]).select("doc_id", "one", F.lit(False).alias("copy"), "spans")
    copies = scanned.join(firsts.select("one", "two", "rep"), ["one", "two"]).where("rep < doc_id").select("doc_id", "one").distinct()
    hits = written(own.unionByName(copies.select("doc_id", "one", F.lit(True).alias("copy"), F.lit(None).cast(own.schema["spans"].dataType).alias("spans"))), "hits")
    for frame in (scanned, firsts, spans):
        discard(frame)
    return Repeats(hits, texts)


def _matching(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, one, turn, least) whose text has the words that `one` stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            yield batch.filter(pa.array(_whole(words(batch["text"]))[0] == batch["one"].to_numpy()))

    return rows.select("doc_id", "one", "turn", "text", "least").mapInArrow(run, "doc_id long, one long, turn int, text string, least array<long>")


def deduplicated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The columns of docs with the text that is left (words joined by one blank where any went), n_words, n_removed.

    Other columns may have any names that do not start with hit_ and are not n_words or n_removed; see `cleaned`.
    """
    found = repeats(docs, size)
    discard(found.texts)
    return _without(docs, found.hits)


def _without(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs with the text that is left, n_words, n_removed; rows that surely have no hits are not shuffled."""
    wanted = bitmap(hits.select("doc_id"))
    hits = hits.groupBy(F.col("doc_id").alias("hit_doc")).agg(F.collect_list(F.struct("one", "copy", "spans")).alias("hit_texts"))
    marked = _marked(docs, wanted)
    rows = marked.join(hits.hint("merge"), F.coalesce(marked["doc_id"], F.lit(NONE)) == hits["hit_doc"], "left").drop("hit_doc")
    names = docs.columns

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices((batch.filter(pc.invert(among(_ids(batch), wanted))) for batch in batches), limit=SLICE):
            n = np.diff(words(batch["text"]).offset)
            yield pa.record_batch([*batch.columns, pa.array(n, pa.int64()), pa.array(np.zeros(len(n), np.int64))], [*names, "n_words", "n_removed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            w = words(batch["text"])
            one, texts, removed = None, batch["text"].to_pylist(), [0] * batch.num_rows
            for row, own in enumerate(batch["hit_texts"].to_pylist()):
                if not own:
                    continue
                one = _whole(w)[0] if one is None else one
                lo, hi = int(w.offset[row]), int(w.offset[row + 1])
                gone = np.zeros(hi - lo, bool)
                for hit in own:
                    if hit["one"] != int(one[row]):
                        continue
                    gone |= hit["copy"]
                    for span in hit["spans"] or ():
                        if _digest(w, row, span["at"], span["n"]) == span["digest"]:
                            gone[span["at"] : span["at"] + span["n"]] = True
                removed[row] = int(gone.sum())
                if removed[row]:
                    texts[row] = " ".join(w.data[w.start[lo + i] : w.end[lo + i]].tobytes().decode() for i in np.flatnonzero(~gone).tolist())
            columns = [pa.array(texts, pa.string()) if n == "text" else batch[n] for n in names]
            yield pa.record_batch([*columns, pa.array(np.diff(w.offset), pa.int64()), pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"])

    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return docs.mapInArrow(counted, out).union(rows.select(*names, "hit_texts").mapInArrow(run, out))


def digest(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and kept_sha256 of the words of `text`, joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in batch["text"].to_pylist()]
            yield pa.record_batch([*(batch[c] for c in keep), pa.array(sha)], [*keep, "kept_sha256"])

    return rows.select(*keep, "text").mapInArrow(run, rows.select(*keep).withColumn("kept_sha256", F.lit("")).schema)


def _whole_digest(docs: DataFrame) -> DataFrame:
    """doc_id, one, n_words, kept_sha256 of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            w = words(batch["text"])
            sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in batch["text"].to_pylist()]
            yield pa.record_batch([_ids(batch), pa.array(_whole(w)[0]), pa.array(np.diff(w.offset), pa.int64()), pa.array(sha)], ["doc_id", "one", "n_words", "kept_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, one long, n_words long, kept_sha256 string")


def digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs; only texts that lose words are cut."""
    found = repeats(docs, size)
    left = _without(found.texts.select("doc_id", "one", "text"), found.hits.where("NOT copy"))
    cut = digest(left.where("n_removed > 0"), "doc_id", "one", "n_removed").withColumnRenamed("kept_sha256", "cut_sha256").distinct()
    copies = found.hits.where("copy").select("doc_id", "one", "copy")
    rows = _whole_digest(docs).join(copies, ["doc_id", "one"], "left").join(cut, ["doc_id", "one"], "left")
    return rows.select(
        F.nullif("doc_id", F.lit(NONE)).alias("doc_id"), "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"))


def cleaned(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with the text that is left, whatever its other columns are called."""
    return unbundled(deduplicated(bundled(docs), size), docs.columns)
