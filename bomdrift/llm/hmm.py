"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by scaled forward recursion.

Tokens are words in lower case (A-Z), then one end. Every training word has emissions of its own in each of STATES
states. Those of the most frequent SYMBOLS words are broadcast. Any other word is emitted as one of 64 shapes (length,
bytes above ASCII, other than letters), and within its shape in state s with the probability
(g / p + 0.5) / (N + 0.5 (V + 1)): g its expected count in s, p the part of the shape's expected counts that s has,
N and V the shape's tokens and words beyond the SYMBOLS. A word of no training document has g = 0; before the first
round g / p is the word's count. These expected counts are summed by Spark into a table of a row per word, whatever
their number; a task streams it and keeps the words of the texts that it holds, HELD tokens at once.
Words of known count are looked up in the LISTED most frequent ones, which are broadcast; the rest of every
document joins the table of all counts.

Texts are cut into chunks whose products of transition and emission matrices are computed side by side; running
through a document's products gives the exact forward and backward vectors at every chunk's edge, hence exact
Baum-Welch counts and the exact likelihood, at any length of text. All training documents take part in each round.

Null and empty texts have the end only. Null doc_ids are training documents. Rows that repeat count as often as
they come. Without training documents all counts are 0 and the model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift.llm.store import filesystem, folder, written
from bomdrift.llm.words import BLANKS, Words, mix, slices, words

STATES = 4
SYMBOLS = 1 << 15
LISTED = 1 << 18
SHAPES = 64
CHUNK = 64
#: Steps after which vectors are scaled; emissions are far above the 1e-70 that this many would need to vanish.
SCALED = 4
#: Tokens of the texts that a task holds while it looks up their words' emissions, about.
HELD = 1 << 24
ROUNDS = 5
#: The end's key among the words' hashes.
END = np.uint64(0x656E64)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def shapes(w: Words) -> np.ndarray:
    """The shape of every word."""
    def some(mark: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mark)))
        return (sums[w.end] > sums[w.start]).astype(np.int64)

    letter = ((w.data >= 97) & (w.data <= 122)) | (w.data >= 128)
    return (np.minimum(w.end - w.start, 16) - 1) * 4 + some(w.data >= 128) * 2 + some(~letter)


def _sum(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, the first of each further array but the last, and the sums of the last."""
    distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
    return distinct, *(v[first] for v in values[:-1]), np.bincount(back, values[-1], len(distinct)).astype(np.int64)


def counts(texts: DataFrame) -> DataFrame:
    """(word, shape, times) of all texts; a word is its hash, the end has shape -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def out() -> pa.RecordBatch:
            key, shape, times = _sum(*(np.concatenate(x) for x in zip(*held)))
            return pa.record_batch([pa.array(key.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(times)], ["word", "shape", "times"])

        for batch in slices(batches):
            w = words(batch["text"], BLANKS, fold=True)
            ends += batch.num_rows
            if len(w.hash):
                held.append(_sum(w.hash, shapes(w), np.ones(len(w.hash))))
                size += len(held[-1][0])
            if size > 2_000_000:
                held, size = [_sum(*(np.concatenate(x) for x in zip(*held)))], 0
                if len(held[0][0]) > 1_000_000:
                    yield out()
                    held = []
        if ends:
            held.append((np.array([END]), np.array([-1]), np.array([ends])))
            yield out()

    return texts.select("text").mapInArrow(run, "word long, shape int, times long").groupBy("word").agg(F.first("shape").alias("shape"), F.sum("times").alias("times"))


@dataclass
class Lexicon:
    """The LISTED most frequent words, sorted by hash, and what the rest is counted as."""

    word: np.ndarray
    times: np.ndarray
    symbol: np.ndarray  # -1: emitted within its shape
    shape: np.ndarray
    total: int
    types: int
    shape_total: np.ndarray
    shape_types: np.ndarray
    symbols: int  # words with emissions of their own, the end among them

    def sizes(self) -> int:
        return self.symbols + SHAPES

    def base(self, times: np.ndarray) -> np.ndarray:
        return np.log10((times + 0.5) / (self.total + 0.5 * (self.types + 1)))

    def inner(self, times: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return np.log10((times + 0.5) / (self.shape_total[shape] + 0.5 * (self.shape_types[shape] + 1)))


def lexicon(table: DataFrame) -> Lexicon:
    # the words of the highest counts, by a threshold on a histogram of counts: no task sorts and nothing is cut at random
    grade = F.floor(F.log2("times") * 8)
    least, many = 10**6, 0
    for r in sorted(table.groupBy(grade.alias("grade")).count().collect(), reverse=True):  # some hundred rows
        many += r["count"]
        if many > LISTED:
            break
        least = r["grade"]
    top = table.where((grade >= least) | (F.col("word") == int(END))).toArrow()  # LISTED rows at most, and the end
    word = top["word"].to_numpy().view(np.uint64)
    times, shape = top["times"].to_numpy(), top["shape"].to_numpy().astype(np.int64)
    order = np.lexsort((word, -times, word != END))  # the end is a symbol
    word, times, shape = word[order], times[order], shape[order]
    symbols = min(SYMBOLS, len(word))
    symbol = np.where(np.arange(len(word)) < symbols, np.arange(len(word)), -1)
    total, types = np.zeros(SHAPES + 1, np.int64), np.zeros(SHAPES + 1, np.int64)
    for r in table.groupBy("shape").agg(F.sum("times").alias("n"), F.count("*").alias("v")).collect():  # SHAPES + 1 rows at most
        total[r["shape"]], types[r["shape"]] = r["n"], r["v"]
    n, v = int(total.sum()), int(types.sum())
    np.subtract.at(total, shape[:symbols], times[:symbols])
    np.subtract.at(types, shape[:symbols], 1)
    order = np.argsort(word)
    return Lexicon(word[order], times[order], symbol[order], shape[order], n, v, total[:SHAPES], types[:SHAPES], symbols)


def sequences(docs: DataFrame, lexicon_, *keep: str) -> DataFrame:
    """Per row: symbols (array<int>), sums over its listed words, and the words that are not listed.

    A symbol is that of the word, or sizes() + i of the i-th listed word, or -1 - i of the row's i-th other word.
    """
    kept = docs.select(*keep, "text")
    names = [*kept.columns[:-1], "symbols", "base", "inner", "n_known", "others", "other_shapes", "other_times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(**lexicon_.value)
        end = np.flatnonzero(lex.word == END)
        for batch in slices(batches):
            w = words(batch["text"], BLANKS, fold=True)
            rows, row, shape = batch.num_rows, w.row(), shapes(w)
            at = np.minimum(np.searchsorted(lex.word, w.hash), max(len(lex.word) - 1, 0))
            listed = lex.word[at] == w.hash if len(lex.word) else np.zeros(len(row), bool)
            symbol = np.where(listed, lex.symbol[at], -1) if len(lex.word) else np.full(len(row), -1)
            by_shape = symbol < 0
            symbol = np.where(by_shape, lex.sizes() + at, symbol)
            times = np.where(listed, lex.times[at], 0) if len(lex.word) else np.zeros(len(row))
            end_times = int(lex.times[end[0]]) if len(end) else 0
            base = np.bincount(row[listed], lex.base(times[listed]), rows) + lex.base(np.array([end_times]))
            within = listed & by_shape
            inner = np.bincount(row[within], lex.inner(times[within], shape[within]), rows)
            known = np.bincount(row[listed], minlength=rows) + (end_times > 0)
            to = w.offset + np.arange(rows + 1)
            rest = ~listed
            key = w.keyed(row[rest], w.hash[rest])
            _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(row[rest][first], kind="stable")
            first, n = first[order], n[order]
            ends = np.searchsorted(row[rest][first], np.arange(rows + 1))
            symbol[rest] = ends[row[rest]] - np.argsort(order)[back] - 1
            out = np.full(len(symbol) + rows, lex.symbol[end[0]] if len(end) else lex.symbols, np.int32)
            out[np.arange(len(symbol)) + row] = symbol
            lists = lambda x, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x))
            yield pa.record_batch([
                *(batch[n_] for n_ in names[:-7]), lists(out, to), pa.array(base.astype(float)), pa.array(inner.astype(float)), pa.array(known.astype(np.int64)),
                lists(w.hash[rest][first].view(np.int64), ends), lists(shape[rest][first].astype(np.int32), ends), lists(n.astype(np.int32), ends),
            ], names)

    fields = {"symbols": "array<int>", "base": "double", "inner": "double", "n_known": "long", "others": "array<long>", "other_shapes": "array<int>", "other_times": "array<int>"}
    return kept.mapInArrow(run, kept.drop("text").withColumns({k: F.lit(None).cast(v) for k, v in fields.items()}).schema)


@dataclass
class Model:
    """start: of the state before the first token; move: between states; emit: (symbol, state), with a row per shape last."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(lex: Lexicon, states: int = STATES) -> Model:
    """Emissions near the words' frequencies, told apart by their hashes; states that last."""
    mass = np.zeros(lex.sizes())
    own = lex.symbol >= 0
    mass[lex.symbol[own]] = lex.times[own]
    mass[lex.symbols :] = lex.shape_total
    noise = np.stack([mix(np.concatenate((lex.word[own][np.argsort(lex.symbol[own])], np.arange(SHAPES, dtype=np.uint64))) ^ np.uint64(977 * (k + 1))) for k in range(states)], 1) / 2.0**64
    emit = (mass + 0.5)[:, None] * (0.5 + noise)
    move = np.full((states, states), 0.02 / max(states - 1, 1))
    np.fill_diagonal(move, 0.98 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


@dataclass
class Chunks:
    """Chunks of at most CHUNK tokens, longest first; place[d] of chunk c of document d by document and number."""

    ids: np.ndarray
    active: np.ndarray  # chunks that have a token t
    order: np.ndarray  # of chunk i in document order, its row in ids
    offset: np.ndarray  # chunks of document d: offset[d]:offset[d + 1] in document order


def chunked(values: np.ndarray, at: np.ndarray) -> Chunks:
    n = np.diff(at)
    many = -(-n // CHUNK)
    offset = np.concatenate(([0], np.cumsum(many)))
    doc = np.repeat(np.arange(len(n)), many)
    begin = at[:-1][doc] + (np.arange(offset[-1]) - offset[:-1][doc]) * CHUNK
    length = np.minimum(CHUNK, at[1:][doc] - begin)
    longest = np.argsort(-length, kind="stable")
    order = np.empty_like(longest)
    order[longest] = np.arange(len(longest))
    step = np.arange(CHUNK)
    ids = values[np.minimum(begin[longest][:, None] + step, len(values) - 1)]
    return Chunks(ids, np.searchsorted(-length[longest], -step, "left"), order, offset)


def emitted(c: Chunks, m: Model) -> np.ndarray:
    """(token of the chunk, state, chunk): emissions, states before chunks so that sums over states run along chunks."""
    return np.ascontiguousarray(m.emit[c.ids.T].transpose(0, 2, 1))


def products(c: Chunks, m: Model, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per chunk in document order, the scaled product of its steps' matrices, and the log of the scale."""
    k, n = len(m.start), len(c.ids)
    out, log, turn = np.repeat(np.eye(k)[:, :, None], n, 2), np.zeros(n), np.ascontiguousarray(m.move.T)
    for t, a in enumerate(c.active):
        if not a:
            break
        x = np.matmul(turn, out[:, :, :a])
        x *= e[t, :, :a]
        if t % SCALED == SCALED - 1 or t == CHUNK - 1 or c.active[t + 1] < a:
            scale = x.max((0, 1))
            x *= 1 / scale
            log[:a] += np.log(scale)
        out[:, :, :a] = x
    return out.transpose(2, 0, 1)[c.order], log[c.order]


def _along(c: Chunks, forward: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents that have a chunk of each number, and that chunk, from the first or from the last."""
    many = np.diff(c.offset)
    numbers = range(int(many.max()) if len(many) else 0)
    for i in numbers if forward else reversed(numbers):
        docs = np.flatnonzero(many > i)
        yield docs, c.offset[docs] + i


def likelihood(c: Chunks, m: Model) -> np.ndarray:
    """Natural log of every document's probability."""
    step, log = products(c, m, emitted(c, m))
    state, total = np.tile(m.start, (len(c.offset) - 1, 1)), np.zeros(len(c.offset) - 1)
    for docs, chunk in _along(c, True):
        state[docs] = np.einsum("dk,dkj->dj", state[docs], step[chunk])
        scale = state[docs].sum(1)
        state[docs] /= scale[:, None]
        total[docs] += np.log(scale) + log[chunk]
    return total


def expected(c: Chunks, m: Model, into: Model) -> None:
    """Add the expected starts, moves and emissions of all documents to `into`."""
    k, n = len(m.start), len(c.ids)
    e = emitted(c, m)
    step, _ = products(c, m, e)
    left, right = np.empty((n, k)), np.empty((n, k))  # forward before, backward after each chunk, in document order
    state = np.tile(m.start, (len(c.offset) - 1, 1))
    for docs, chunk in _along(c, True):
        left[chunk] = state[docs]
        state[docs] = np.einsum("dk,dkj->dj", state[docs], step[chunk])
        state[docs] /= state[docs].sum(1, keepdims=True)
    back = np.ones((len(c.offset) - 1, k))
    for docs, chunk in _along(c, False):
        right[chunk] = back[docs]
        back[docs] = np.einsum("dkj,dj->dk", step[chunk], back[docs])
        back[docs] /= back[docs].sum(1, keepdims=True)
    first = m.start * back
    into.start += (first / first.sum(1, keepdims=True)).sum(0)
    of = np.empty(n, np.int64)  # the document order of each row of ids
    of[c.order] = np.arange(n)
    alpha, turn = np.empty((CHUNK + 1, k, n)), np.ascontiguousarray(m.move.T)
    alpha[0] = left[of].T
    for t, a in enumerate(c.active):
        x = turn @ alpha[t, :, :a]
        x *= e[t, :, :a]
        if t % SCALED == SCALED - 1:
            x *= 1 / x.sum(0)
        alpha[t + 1, :, :a] = x
    beta, done = np.ascontiguousarray(right[of].T), 0
    for t in range(CHUNK - 1, -1, -1):
        a = c.active[t]
        if not a:
            continue
        if a > done:  # chunks that end here
            last = alpha[t + 1, :, done:a] * beta[:, done:a]
            alpha[t + 1, :, done:a] = last / last.sum(0)
            done = a
        ahead = e[t, :, :a] * beta[:, :a]
        before = m.move @ ahead
        both = alpha[t, :, :a] * before
        scale = 1 / both.sum(0)
        ahead *= scale
        into.move += m.move * (alpha[t, :, :a] @ ahead.T)
        both *= scale
        alpha[t, :, :a] = both  # from here on the probabilities of the states
        if t % SCALED == 0:
            before *= 1 / before.sum(0)
        beta[:, :a] = before
    ids = np.concatenate([c.ids[:a, t] for t, a in enumerate(c.active)])
    for s in range(k):
        gamma = np.concatenate([alpha[t + 1, s, :a] for t, a in enumerate(c.active)])
        into.emit[:, s] += np.bincount(ids, gamma, len(into.emit))


@dataclass
class Own:
    """The emissions of the words beyond the symbols. path: the table of the last round's sums, if any; share: (shape, state)."""

    path: str | None
    share: np.ndarray

    def ratio(self, word: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """(word, state): by what the emission of each of the sorted words differs from its count's share of its shape."""
        out = np.ones((len(word), self.share.shape[1]))
        if not self.path or not len(word):
            return out
        store, root = filesystem(self.path)
        for info in store.get_file_info(fs.FileSelector(root)):
            if not info.base_name.endswith(".parquet"):
                continue
            with store.open_input_file(info.path) as raw:
                for batch in pq.ParquetFile(raw).iter_batches(1 << 17):
                    key = batch["id"].to_numpy().view(np.uint64)
                    at = np.minimum(np.searchsorted(word, key), len(word) - 1)
                    met = np.flatnonzero((word[at] == key) & batch["own"].to_numpy(zero_copy_only=False))
                    at, g = at[met], np.stack([batch[f"s{s}"].to_numpy()[met] for s in range(out.shape[1])], 1).astype(float)
                    share = self.share[shape[at]]
                    out[at] = np.where(share > 0, (g / np.where(share > 0, share, 1) + 0.5) / (g.sum(1, keepdims=True) + 0.5), 1)
        return out


def _held(batches: Iterator[pa.RecordBatch], lex: Lexicon, m: Model, own: Own) -> Iterator[tuple]:
    """(model, words, shapes, batches): batches of about HELD tokens, each with its symbols in that model, whose last rows are the words'."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += len(batch["symbols"].flatten())
        if size >= HELD:
            yield _with_words(group, lex, m, own)
            group, size = [], 0
    if group:
        yield _with_words(group, lex, m, own)


def _with_words(group: list[pa.RecordBatch], lex: Lexicon, m: Model, own: Own) -> tuple:
    first = lex.sizes()
    flat = lambda batch, name: batch[name].flatten().to_numpy(zero_copy_only=False)
    used = np.zeros(len(lex.word), bool)
    for batch in group:
        x = flat(batch, "symbols")
        used[x[x >= first] - first] = True
    other = [flat(batch, "others").view(np.uint64) for batch in group]
    word, at = np.unique(np.concatenate((lex.word[used], *other)), return_index=True)
    shape = np.concatenate((lex.shape[used], *(flat(batch, "other_shapes") for batch in group)))[at].astype(np.int64)
    listed = np.zeros(len(lex.word), np.int64)
    listed[used] = np.searchsorted(word, lex.word[used])
    out = []
    for batch, hashes in zip(group, other):
        x = flat(batch, "symbols").astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(batch["symbols"].offsets.to_numpy()))
        known, rest = np.flatnonzero(x >= first), np.flatnonzero(x < 0)
        x[known] = first + listed[x[known] - first]
        start = batch["others"].offsets.to_numpy().astype(np.int64)
        x[rest] = first + np.searchsorted(word, hashes)[start[row[rest]] - start[0] - x[rest] - 1]
        at = batch["symbols"].offsets.to_numpy()
        out.append((batch, x, at - at[0]))
    emit = np.concatenate((m.emit, m.emit[lex.symbols + shape] * own.ratio(word, shape)))
    return Model(m.start, m.move, emit), word, shape, out


def train(rows: DataFrame, lex: Lexicon, lexicon_, rounds: int = ROUNDS, states: int = STATES) -> tuple[Model, Own]:
    """Baum-Welch over all rows' symbols; every round's counts are summed over partitions, of words in a table."""
    spark, model = rows.sparkSession, first_model(lex, states)
    own = Own(None, np.full((SHAPES, states), 1 / states))
    sums = [F.sum(f"s{i}").cast("float").alias(f"s{i}") for i in range(states)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((vars(model), vars(own)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lex, m, own = Lexicon(**lexicon_.value), Model(**sent.value[0]), Own(**sent.value[1])
            first = lex.sizes()
            for full, word, shape, held in _held(batches, lex, m, own):
                into = Model(np.zeros(states), np.zeros((states, states)), np.zeros_like(full.emit))
                for _, values, at in held:
                    for part, offsets, _ in _parts(values, at, 1 << 18):
                        expected(chunked(part, offsets), full, into)
                for s in range(states):  # a shape has the sums of its words
                    into.emit[lex.symbols : first, s] += np.bincount(shape, into.emit[first:, s], SHAPES)
                kept = np.flatnonzero(into.emit[:first].any(1))
                table = np.concatenate((into.start[None], into.move, into.emit[kept], into.emit[first:]))
                ids = np.concatenate((np.arange(-1 - states, 0), kept, word.view(np.int64)))
                is_word = np.arange(len(ids)) >= len(ids) - len(word)
                for a in range(0, len(ids), 100_000):
                    part = slice(a, a + 100_000)
                    yield pa.record_batch([pa.array(is_word[part]), pa.array(ids[part]), *(pa.array(table[part, s].astype(np.float32)) for s in range(states))], ["own", "id", *(f"s{s}" for s in range(states))])

        schema = ", ".join(["own boolean, id long", *(f"s{s} float" for s in range(states))])
        path = folder(spark, "emissions")
        rows.select("symbols", "others", "other_shapes").mapInArrow(run, schema).groupBy("own", "id").agg(*sums).write.option("compression", "zstd").parquet(path)
        found = spark.read.schema(schema).parquet(path).where("NOT own").toArrow()  # SYMBOLS + SHAPES rows, and some for the moves
        start, move, emit = np.full(states, 0.1), np.full((states, states), 0.1), np.zeros_like(model.emit)
        ids, table = found["id"].to_numpy(), np.stack([found[f"s{s}"].to_numpy() for s in range(states)], 1).astype(float)
        emit[ids[ids >= 0]] = table[ids >= 0]
        start += table[ids == -1 - states].sum(0)
        moved = (ids < 0) & (ids > -1 - states)
        move[ids[moved] + states] += table[moved]
        whole = emit[lex.symbols :].sum(1, keepdims=True)
        own = Own(path, emit[lex.symbols :] / np.where(whole > 0, whole, 1))
        emit += 0.5 * emit.sum(1, keepdims=True) / max(emit.sum(), 1) * states + 1e-3  # a little of the words' frequencies
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        sent.unpersist()
    return model, own


def _parts(values: np.ndarray, at: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Flat values and offsets of rows of at most about `limit` tokens, and which rows."""
    first = 0
    while first < len(at) - 1:
        after = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield values[at[first] : at[after]], at[first : after + 1] - at[first], slice(first, after)
        first = after


def scored(docs: DataFrame, held: Column, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs; trained where not held."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    table = written(counts(rows.where("NOT held_out")), "counts")
    lex = lexicon(table)
    sent = spark.sparkContext.broadcast(vars(lex))
    cut = written(sequences(rows, sent, "doc_id", "held_out").withColumn("row", F.monotonically_increasing_id()), "symbols")
    trained = train(cut.where("NOT held_out"), lex, sent, rounds)
    model = spark.sparkContext.broadcast(tuple(map(vars, trained)))
    keep = ["row", "doc_id", "held_out", "base", "inner", "n_known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full, _, _, held_ in _held(batches, Lexicon(**sent.value), Model(**model.value[0]), Own(**model.value[1])):
            for batch, symbols, offsets in held_:
                for values, at, part in _parts(symbols, offsets, 1 << 18):
                    own = batch.slice(part.start, part.stop - part.start)
                    log = likelihood(chunked(values, at), full) / np.log(10)
                    yield pa.record_batch([*(own[n] for n in keep), pa.array(np.diff(at), pa.int64()), pa.array(log)], [*keep, "n_tokens", "log"])

    likely = cut.select(*keep, "symbols", "others", "other_shapes").mapInArrow(run, cut.select(*keep).withColumns({"n_tokens": F.lit(0).cast("long"), "log": F.lit(0.0)}).schema)
    others = cut.select("row", F.explode(F.arrays_zip("others", "other_shapes", "other_times")).alias("o")).select("row", F.col("o.others").alias("word"), F.col("o.other_shapes").alias("in"), F.col("o.other_times").alias("n"))
    shaped = F.array(*(F.lit(float(t + 0.5 * (v + 1))) for t, v in zip(lex.shape_total.tolist(), lex.shape_types.tolist())))
    c = F.coalesce("times", F.lit(0))
    rare = others.join(table.select("word", "times"), "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(lex.total + 0.5 * (lex.types + 1)))).alias("more_base"),
        F.sum(F.col("n") * F.log10((c + 0.5) / F.element_at(shaped, F.col("in") + 1))).alias("more_inner"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"))
    none = lambda x: F.coalesce(x, F.lit(0))
    return likely.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + none("more_known")).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + none("more_base")).alias("base_score"), (F.col("log") + F.col("inner") + none("more_inner")).alias("score"))
