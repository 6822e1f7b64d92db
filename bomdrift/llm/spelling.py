"""Spelling variants of a corpus's words, by a bit-sliced position index.

Runs of [A-Za-z\\u00C0-\\u00FF] are lower-cased in A-Z only. Let h be the unsigned crc32 of `<doc_id>:<run>`; where
ERASE divides h, the run loses its code point h % length. Words are the results of at least MIN_LENGTH code points
and MIN_TIMES occurrences. Two words are near at one inserted, deleted or replaced code point. A word's form is its
most frequent near word (ties: the smallest), if that has at least RATIO times its occurrences; its root is where the
forms end.

Near words share their first or their last half, whose length depends on the shorter word alone, so words meet in
cells by (shorter length, side, hash of the half). A cell indexes its words by bits: for every position and letter,
the set of words that have this letter there, 64 words an integer. For all its queries at once, the recurrence over
positions keeps three sets: no error yet, one letter replaced (same position), one letter inserted (index shifted by
one). Pairs that share both halves are reported on the first side only. Cells have a bounded number of words: a half
that too many words share is dealt to several chunks, and every two of its chunks meet in a cell of their own.

Null texts have no words; a null doc_id counts as ''. Rows that repeat are counted again. Other columns are not read.
Texts are read whole, a text longer than a slice by itself; a very long run is one word. An empty table, or one
without repeated words, gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift.llm.store import written
from bomdrift.llm.words import LATIN, Tally, Words, slices, strings, words

#: One run in so many, by its hash, loses a code point.
ERASE = 199
MIN_LENGTH, MIN_TIMES = 6, 5
#: A form has so many times the occurrences of its variant.
RATIO = 5
#: Words of a cell, about; a cell of twice as many is dealt to chunks.
CELL = 2048
#: Runs of more bytes are hashed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table()


def crc32(w: Words, prefixes: list[bytes]) -> np.ndarray:
    """Unsigned crc32 of each word after its row's prefix; all words of a position are stepped at once."""
    before = np.array([zlib.crc32(p) for p in prefixes], np.uint32)[w.row()]
    length = w.end - w.start
    order = np.argsort(-length, kind="stable")
    order = order[length[order] <= LONG]
    start, state = w.start[order], before[order] ^ np.uint32(0xFFFFFFFF)
    reach = np.searchsorted(-length[order], -np.arange(LONG), "left")  # words that have a byte at this position
    for at in range(LONG):
        n = reach[at]
        if not n:
            break
        s = state[:n]
        state[:n] = CRC_TABLE[(s ^ w.data[start[:n] + at]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty(len(length), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > LONG):
        out[i] = zlib.crc32(w.data[w.start[i] : w.end[i]].tobytes(), int(before[i]))
    return out


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word, after erasures, that is long enough."""
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(["word"], ["n"])
        for batch in slices(batches):
            w = words(batch["text"], LATIN, fold=True)
            h = crc32(w, [f"{i}:".encode() for i in batch["id"].to_pylist()])
            two = np.concatenate(([0], np.cumsum(w.data == 0xC3)))  # first bytes of the code points of two
            length = w.end - w.start - (two[w.end] - two[w.start])
            erased = h % ERASE == 0
            _, first, n = np.unique(w.hash[whole := np.flatnonzero(~erased & (length >= MIN_LENGTH))], return_index=True, return_counts=True)
            yield from tally.add({"word": strings(w, whole[first]), "n": pa.array(n)})
            short = []
            for i in np.flatnonzero(erased & (length > MIN_LENGTH)):
                at, run_ = int(h[i]) % int(length[i]), w.data[w.start[i] : w.end[i]].tobytes().decode()
                short.append(run_[:at] + run_[at + 1 :])
            yield from tally.add({"word": pa.array(short, pa.string()), "n": pa.array(np.ones(len(short), np.int64))})
        yield from tally.rest()

    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near(letters: np.ndarray, length: np.ndarray, queries: np.ndarray, shorter: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (query, word) of a cell, by number.

    letters and queries: a byte by word and position, 0 beyond the end; queries have `shorter` letters, words as many
    or one more. On side 0, pairs that share the first half; on side 1, pairs that do not.
    """
    cells = -(-len(letters) // 64)
    bits = lambda marks: np.packbits(np.pad(marks, [(0, 0), (0, cells * 64 - len(letters))]), axis=1, bitorder="little").view(np.uint64)

    def index(at: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets of words by their letter at a position, and the row of each letter; row 0 is empty."""
        column = letters[:, at]
        have = np.unique(column)
        have = have[have > 0]
        out = np.zeros((len(have) + 1, cells), np.uint64)
        if len(have):
            out[1:] = bits(have[:, None] == column[None, :])
        row = np.zeros(256, np.int64)
        row[have] = np.arange(1, len(have) + 1)
        return out, row

    none = np.full((len(queries), cells), ~np.uint64(0))
    replaced, inserted = np.zeros_like(none), np.zeros_like(none)
    here = index(0)
    for at in range(shorter):
        after = index(at + 1)
        letter = queries[:, at]
        same, shifted = here[0][here[1][letter]], after[0][after[1][letter]]
        replaced = (replaced & same) | (none & ~same)
        inserted = (inserted | none) & shifted
        none = none & same
        if at + 1 == shorter // 2:
            if side:
                replaced &= ~none
                inserted &= ~none
                none = np.zeros_like(none)
            else:
                replaced, inserted = np.zeros_like(none), np.zeros_like(none)
        here = after
    equal, longer = bits(np.stack([length == shorter, length == shorter + 1]))
    hits = (replaced & equal) | ((inserted | none) & longer)
    query, cell = np.nonzero(hits)
    found, bit = np.nonzero(np.unpackbits(hits[query, cell][:, None].view(np.uint8), axis=1, bitorder="little"))
    return query[found], cell[found] * 64 + bit


def _cell(key: tuple, cell: pa.Table) -> pa.Table:
    """Per word of the cell: how many near words it has here, and the most frequent of them."""
    shorter, side = key[0].as_py(), key[1].as_py()
    cell = cell.sort_by("word")
    word = cell["word"].combine_chunks()
    narrow = np.array([x.encode("latin-1") for x in word.to_pylist()], f"S{shorter + 2}")  # a byte for a code point
    letters = narrow.view(np.uint8).reshape(len(narrow), shorter + 2)
    length, n = pc.utf8_length(word).to_numpy(), cell["n"].to_numpy()
    query = np.flatnonzero(cell["query"].to_numpy() & (length == shorter))
    indexed = np.flatnonzero(cell["indexed"].to_numpy())
    q, v = near(letters[indexed], length[indexed], letters[query], shorter, side)
    q, v = query[q], indexed[v]
    back = length[v] > shorter  # replacements are met from both words
    q, v = np.concatenate((q, v[back])), np.concatenate((v, q[back]))
    order = np.lexsort((v, -n[v], q))
    q, v = q[order], v[order]
    own, first, many = np.unique(q, return_index=True, return_counts=True)
    best = v[first]
    return pa.table({"word": word.take(pa.array(own)), "n_near": pa.array(many), "best_n": pa.array(n[best]), "best": word.take(pa.array(best))})


def meetings(vocabulary: DataFrame, cell: int = CELL) -> DataFrame:
    """Each word in all cells where it meets words that may be near, as a query or indexed or both."""
    length = F.char_length("word")
    sides = [F.struct((length - less).alias("shorter"), F.lit(side).alias("side")) for less in (0, 1) for side in (0, 1)]
    entries = vocabulary.select("word", "n", F.inline(F.array(*sides))).where(F.col("shorter") >= MIN_LENGTH)
    key = F.xxhash64(F.when(F.col("side") == 0, F.expr("left(word, shorter div 2)")).otherwise(F.expr("right(word, shorter div 2)")))
    cells = entries.groupBy("shorter", "side").agg(F.ceil(F.count("*") / cell).alias("buckets"))
    dealt = entries.join(cells, ["shorter", "side"]).select("word", "n", "shorter", "side", F.pmod(key, F.col("buckets")).alias("bucket"))
    crowded = dealt.groupBy("shorter", "side", "bucket").agg(F.count("*").alias("many")).where(F.col("many") > 2 * cell)
    crowded = crowded.select("shorter", "side", "bucket", F.ceil(F.col("many") / cell).alias("chunks"))
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.col("chunks"))
    every = dealt.join(crowded, ["shorter", "side", "bucket"], "left").na.fill(1, ["chunks"]).withColumn("own", own)
    chunks = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)

    def place(row: Column, column: Column, query: Column, indexed: Column) -> Column:
        return F.struct(row.alias("row"), column.alias("column"), query.alias("query"), indexed.alias("indexed"))

    yes, mine = F.lit(True), F.col("own")
    queries = F.transform(chunks, lambda c: place(mine, c, yes, c == mine))
    indexed = F.transform(F.filter(chunks, lambda c: c != mine), lambda c: place(c, mine, ~yes, yes))
    return every.select("word", "n", "shorter", "side", "bucket", F.inline(F.concat(queries, indexed)))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where the forms end, by pointer jumping; forms never lead in a circle."""
    to = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        to = jumped.drop("moved")
        if not jumped.where("moved").head(1):
            return to


def variants(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    vocabulary = written(counts(docs).where(F.col("n") >= MIN_TIMES), "words")
    met = meetings(vocabulary, cell).groupBy("shorter", "side", "bucket", "row", "column").applyInArrow(
        _cell, "word string, n_near long, best_n long, best string")
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    formed = F.coalesce(-F.col("top.less") >= RATIO * F.col("n"), F.lit(False))
    named = written(vocabulary.join(best, "word", "left").select(
        "word", F.when(formed, F.col("top.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, -F.col("top.less")).alias("form_n")), "forms")
    roots = followed(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
