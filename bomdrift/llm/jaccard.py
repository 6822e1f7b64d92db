"""Near-duplicate join of word-shingle sets by exact Jaccard similarity, size-aware.

A document's set is its distinct shingles of `words_` words in lower case; with fewer words, the whole
sequence. Equal sets are one node. All shingles have one order, rare before frequent (a bounded sketch of
their frequency over all documents, then the hash), and two similar sets share shingles among their first ones: sets of n
shingles have n - ceil(0.8 n) + 1 first shingles of which one must be shared, or one more of which two must.

Light sets (few shingles) enumerate every 2-subset of their first shingles as a key; heavy sets are looked up
in the inverted lists of single first shingles, as are the light sets that can be similar to a heavy one.
The boundary is the set size of least cost: rows of subsets against rows of lists and comparisons there.

Links are wanted as classes, so not every pair of a list is verified. First each set of a list is compared
with the list's least node and with the one before it. Further passes do so in other orders, for sets that are in
different classes yet, while pairs of classes become fewer. Then every pair of a list that is still not in one class is
compared: no link between classes is lost, and large groups of copies stay linear. Of the keys that two classes share,
as many as all similar pairs of them share in excess of one are left out there, those of the most pairs first: what stays
of a long list are pairs of classes that have few other keys in common. Pairs that share too few keys for
their sizes are not verified, nor pairs that differ in too many parities: every set has 512 bits, each the parity of its
shingles of one hash, and sets differ by at least as many shingles as bits. Of a class in a list, the bits that all and
that any of its sets have bound what it differs from another class by, before their sets meet.

Null doc_ids count as larger than any other. Null and empty texts have an empty set and are linked with
nothing. Rows that repeat are alike. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bomdrift.llm.bitmap import among, bitmap
from bomdrift.llm.components import components
from bomdrift.llm.store import discard, written
from bomdrift.llm.words import BLANKS, mix, slices, words

SHINGLE = 5
#: Bytes of text that become words at once.
SLICE = 1 << 20
PERCENT = 80
#: Cells of the frequency sketch, counted over all documents; one byte each is broadcast.
CELLS = 1 << 22
#: Parts of the sketch that are summed apart.
CHUNKS = 64
NONE = 2**63 - 1
#: Comparisons of a set in an inverted list: with its least node and the one before it.
VISITS = 2
#: Words of 64 bits with the parities of a set; FOLDED of them, each the XOR of two, go with the rows of lists.
PARITIES = [f"p{i}" for i in range(8)]
FOLDED = [f"f{i}" for i in range(4)]
#: Passes go on while they leave at most this share of the pairs of classes.
GAIN = 0.9


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, by row and value, and the offset of each row."""
    w = words(texts, BLANKS, fold=True)
    row = w.row()
    first, value = w.windows(size)
    n = np.diff(w.offset)
    few = np.flatnonzero((n > 0) & (n < size))
    rows = np.concatenate((row[first], few))
    value = np.concatenate((value, w.whole()[few]))
    order = np.lexsort((value, rows))
    rows, value = rows[order], value[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
    rows, value = rows[new], value[new]
    return value, np.searchsorted(rows, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return sums[at[1:]] - sums[at[:-1]]


def _parities(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of every set a row of words whose bits are the parities of its shingles by nine bits of their hash."""
    bits = np.zeros((len(at) - 1) * len(PARITIES), np.uint64)
    place = values >> np.uint64(55)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    np.bitwise_xor.at(bits, rows * len(PARITIES) + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return bits.view(np.int64).reshape(-1, len(PARITIES))


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch["doc_id"].cast(pa.int64()).fill_null(NONE)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per document (doc_id, n, node, check, parities): node and check are 128 bits of its set. Per task its sketch, by (chunk, counts)."""
    names = ["doc_id", "n", "node", "check", "chunk", "counts", *PARITIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for batch in slices(batches, limit=SLICE):
            value, at = _sets(batch["text"], size)
            seen += np.bincount((value & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            node, check = (mix(_sums(mix(value ^ np.uint64(salt)), at)).view(np.int64) for salt in (0, 0x5DEECE66D))
            none = lambda kind: pa.nulls(batch.num_rows, kind)  # noqa: B023, E731
            yield pa.record_batch([_ids(batch), pa.array(np.diff(at), pa.int64()), pa.array(node), pa.array(check), none(pa.int32()), none(pa.binary()), *map(pa.array, _parities(value, at).T.copy())], names)
        if seen.any():
            counts = [zlib.compress(part.tobytes(), 1) for part in np.minimum(seen, 2**32 - 1).astype(np.uint32).reshape(CHUNKS, -1)]
            none = pa.nulls(CHUNKS, pa.int64())
            yield pa.record_batch([none, none, none, none, pa.array(range(CHUNKS), pa.int32()), pa.array(counts, pa.binary()), *[none] * len(PARITIES)], names)

    schema = "doc_id long, n long, node long, `check` long, chunk int, counts binary, " + ", ".join(f"{p} long" for p in PARITIES)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _levels(seen: DataFrame) -> np.ndarray:
    """Of every cell an eighth of a power of two, by its count over all documents; 0 where chance alone may give it.

    Sketches are summed as they stream by; the driver gets a byte for each cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"]):
                own = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint32).astype(np.int64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        for chunk, own in sums.items():
            grade = np.minimum(np.ceil(8 * np.log2(1 + own)), 255).astype(np.uint8)
            yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([int(own.sum())]), pa.array([grade.tobytes()], pa.binary())], ["chunk", "total", "grades"])

    whole = seen.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(run, "chunk int, total long, grades binary").toArrow()
    grades, total = np.zeros((CHUNKS, CELLS // CHUNKS), np.uint8), 0
    for chunk, own, grade in zip(*(whole[c].to_pylist() for c in ("chunk", "total", "grades"))):
        grades[chunk], total = np.frombuffer(grade, np.uint8), total + own
    mean = total / CELLS
    grades[grades <= 8 * np.log2(2 + mean + 6 * np.sqrt(mean))] = 0
    return grades.reshape(-1)


def _first(n: np.ndarray) -> np.ndarray:
    """How many first shingles of a set of n hold one that is shared with every similar set."""
    return n - -(-n * PERCENT // 100) + 1


def boundary(sizes: dict[int, int]) -> int:
    """The largest size of light sets, by least cost; sizes: sets by their size.

    A light set costs the rows of its subsets; a heavy one a row for each first shingle and VISITS comparisons there.
    """
    n = np.array(sorted(sizes), np.int64)
    if not len(n):
        return 0
    count = np.array([sizes[k] for k in n.tolist()], float)
    first = _first(n)
    light = np.concatenate(([0], np.cumsum(count * (first + 1) * first / 2)))
    heavy = np.concatenate(([0], np.cumsum(count * first * (1 + VISITS))))
    cuts = np.concatenate(([0], n))
    low = np.searchsorted(n, cuts * PERCENT / 100, "right")
    cost = light + heavy[-1] - heavy[np.minimum(low, len(n))]
    return int(cuts[np.argmin(cost)])


def _postings(docs: DataFrame, size: int, level, light: int) -> DataFrame:
    """(key, node, n) of every document's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = np.frombuffer(level.value, np.uint8), set()
        for batch in slices(batches, limit=SLICE):
            value, at = _sets(batch["text"], size)
            n = np.diff(at)
            node = mix(_sums(mix(value), at)).view(np.int64)
            rows = np.repeat(np.arange(len(n)), n)
            new = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)  # equal sets of a task once
            order = np.lexsort((value, levels[(value & np.uint64(CELLS - 1)).astype(np.int64)], rows))
            value = value[order]
            place = np.arange(len(value)) - at[:-1][rows]
            keys, of = [], []
            heavy = n * 100 > light * PERCENT
            single = (new & heavy)[rows] & (place < _first(n)[rows])
            keys.append(value[single])
            of.append(rows[single])
            few = new & (n <= light) & (n > 1)
            most = int((_first(n)[few] + 1).max()) if few.any() else 0
            for j in range(1, most):  # the pairs (i, j), i < j, of all light rows at once
                own = np.flatnonzero(few & (np.minimum(_first(n) + 1, n) > j))
                last = value[at[own] + j]
                for i in range(j):
                    keys.append(mix(mix(value[at[own] + i]) + last))
                    of.append(own)
            key, row = np.concatenate(keys), np.concatenate(of)
            for a in range(0, max(len(key), 1), 100_000):
                k, r = key[a : a + 100_000], row[a : a + 100_000]
                yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(node[r]), pa.array(n[r], pa.int32())], ["key", "node", "n"])

    return docs.select("text").mapInArrow(run, "key long, node long, n int")


def _lists(postings: DataFrame) -> DataFrame:
    """(key, node, n, low, last) of every key of two nodes or more: each node once, with the least and the one before it.

    Postings are sorted by key and node and read as a stream, so that a long list needs no memory.
    """
    names = ["key", "node", "n", "low", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),)  # the last row, and its list's least node
        low = 0
        for batch in batches:
            key, node, n = (np.concatenate((h, batch[c].to_numpy())) for h, c in zip(held, names))
            had = len(held[0])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, n = key[new], node[new], n[new]
            begin = np.ones(len(key), bool)
            begin[1:] = key[1:] != key[:-1]
            start = np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))
            least = node[start]
            if had:
                least[start == 0] = low
            later = np.flatnonzero(~begin)
            # a list's least node itself is reported when its second node comes
            second = later[(node[later - 1] == least[later])]
            at = np.concatenate((second - 1, later))
            last = np.concatenate((least[second], node[later - 1]))
            yield pa.record_batch([pa.array(key[at]), pa.array(node[at]), pa.array(n[at]), pa.array(least[at]), pa.array(last)], names)
            if len(key):
                held, low = (key[-1:], node[-1:], n[-1:]), int(least[-1])

    dealt = postings.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "key long, node long, n int, low long, last long")


def _verified(pairs: DataFrame, docs: DataFrame, listed: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, written; only the texts of their nodes become sets, where they are read."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(_sets_of(docs, bitmap(listed.join(nodes, "node").select("doc_id")), size).join(nodes, "node", "left_semi"), "sets")
    own = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}"))
    met = pairs.join(own("a"), "a").join(own("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                like.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            keep = pa.array(like, pa.bool_())
            yield pa.record_batch([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])

    near = written(met.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "near")
    discard(sets)
    return near


def _sets_of(docs: DataFrame, wanted: Broadcast, size: int) -> DataFrame:
    """(node, set) of the documents whose ids may be wanted: each node once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices((batch.filter(among(_ids(batch), wanted)) for batch in batches), limit=SLICE):
            value, at = _sets(batch["text"], size)
            node = mix(_sums(mix(value), at)).view(np.int64)
            new = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
            raw = value.tobytes()
            own = [raw[8 * a : 8 * b] for a, b in zip(at[:-1][new].tolist(), at[1:][new].tolist())]
            yield pa.record_batch([pa.array(node[new]), pa.array(own, pa.binary())], ["node", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, `set` binary")


def _alike(light: int, part: float = 1) -> str:
    """Whether pairs of n_a and n_b shingles share as many keys, or this part of them, as similar sets of their sizes must.

    Of `need` shared shingles in sets of at most n, all but the last ceil(0.8 n) - 1 are among the first of both.
    """
    need = f"CEIL({PERCENT}D * (n_a + n_b) / {100 + PERCENT}) - CEIL({PERCENT}D * greatest(n_a, n_b) / 100) + 1"
    return f"{_size_fits('n_a', 'n_b')} AND keys >= IF(greatest(n_a, n_b) <= {light}, 1, {part} * ({need}))"


def _size_fits(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})"


def _parity_fits(differ: str, shingles: str) -> str:
    """Whether sets of so many shingles together may be similar if they differ in at least so many."""
    return f"{100 + PERCENT} * ({differ}) <= {100 - PERCENT} * ({shingles})"


def _unlike(names: list[str], ones: str, zeros: str) -> str:
    """The bits that are set in `ones` and not in `zeros`, counted."""
    return " + ".join(f"bit_count({ones.format(p)} & ~{zeros.format(p)})" for p in names)


def _by_parity(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be similar by the parities of their sets."""
    met = pairs
    for x in "ab":
        met = met.join(nodes.select(*(F.col(c).alias(c + ("" if c == "node" else f"_{x}")) for c in ("node", "n", *PARITIES))).withColumnRenamed("node", x), x)
    differ = " + ".join(f"bit_count({p}_a ^ {p}_b)" for p in PARITIES)
    return met.where(_parity_fits(differ, "n_a + n_b")).select("a", "b")


def _mixed(lists: DataFrame, label: DataFrame) -> DataFrame:
    """(key, node, n, class) of the lists whose nodes are in several classes."""
    own = lists.select("key", "node", "n").join(label, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    mixed = own.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    return written(own.join(mixed, "key"), "lists")


def _neighbours(own: DataFrame, salt: int, light: int) -> DataFrame:
    """Pairs (a, b) of different classes that stand side by side in the lists, or one of them first, in an order of this pass."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(salt)), "node")
    one = F.struct("node", "class", "n")
    placed = own.withColumns({"before": F.lag(one).over(order), "first": F.first(one).over(order)})
    met = placed.withColumn("hub", F.explode(F.array_distinct(F.array("before", "first")))).where("hub IS NOT NULL AND hub.class != class").where(_size_fits("n", "hub.n"))
    below = F.col("node") < F.col("hub.node")
    pick = lambda x, y: F.when(below, F.col(x)).otherwise(F.col(y))
    many = met.groupBy(pick("node", "hub.node").alias("a"), pick("hub.node", "node").alias("b")).agg(
        F.count("*").alias("keys"), F.max(pick("n", "hub.n")).alias("n_a"), F.max(pick("hub.n", "n")).alias("n_b"))
    # in an order of its own, a pair stands side by side in some of its lists only
    return many.where(_alike(light, 1 / 8)).select("a", "b")


def _spare(light: int) -> str:
    """How many of the keys that two classes share each pair of similar sets in them shares at least, less one, by the classes' sizes in a list.

    Sets of n >= m shingles share more than 0.8 (n + m) / 1.8 - 0.8 n first ones, see `_alike`.
    """
    surplus = lambda n, m: f"{PERCENT}L * (100L * {m} - {PERCENT}L * {n})"
    both = f"least({surplus('most_a', 'least_b')}, {surplus('most_b', 'least_a')})"
    return f"IF(greatest(least_a, least_b) <= {light}, 0L, greatest(0L, {both} DIV {100 * (100 + PERCENT)}L))"


def _met(own: DataFrame, light: int) -> DataFrame:
    """(key, class_a, class_b, spare) of classes that share a key and may have similar sets by their sizes and parities.

    Of the keys that two classes share, the `spare` ones of the most pairs are left out; each similar pair still has one.
    """
    groups = own.groupBy("key", "class").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("members"),
        *(F.bit_and(f).alias(f"all_{f}") for f in FOLDED), *(F.bit_or(f).alias(f"any_{f}") for f in FOLDED))
    left, right = (groups.select("key", *(F.col(c).alias(f"{c}_{x}") for c in groups.columns if c != "key")) for x in "ab")
    apart = f"{_unlike(FOLDED, 'all_{}_a', 'any_{}_b')} + {_unlike(FOLDED, 'all_{}_b', 'any_{}_a')}"
    across = left.join(right, "key").where(f"class_a < class_b AND 100 * most_a >= {PERCENT} * least_b AND 100 * most_b >= {PERCENT} * least_a")
    across = across.where(_parity_fits(apart, "most_a + most_b"))
    across = across.select("key", "class_a", "class_b", F.expr("members_a * members_b").alias("many"), F.expr(_spare(light)).alias("spare"))
    two = Window.partitionBy("class_a", "class_b")
    across = across.withColumns({"spare": F.min("spare").over(two), "place": F.row_number().over(two.orderBy(F.desc("many"), "key"))})
    return across.where("place > spare").select("key", "class_a", "class_b", "spare")


def _across(own: DataFrame, nodes: DataFrame, light: int) -> DataFrame:
    """All pairs (a, b) of the lists' nodes of different classes that may be similar by their sizes, parities and keys."""
    folded = (F.col(p).bitwiseXOR(F.col(q)).alias(f) for f, p, q in zip(FOLDED, PARITIES, PARITIES[len(FOLDED) :]))
    own = own.join(nodes.select("node", *folded), "node")
    members = lambda x: own.select("key", *(F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in ("class", "node", "n", *FOLDED)))
    met = _met(own, light).join(members("a"), ["key", "class_a"]).join(members("b"), ["key", "class_b"]).where(_size_fits("n_a", "n_b"))
    differ = " + ".join(f"bit_count({f}_a ^ {f}_b)" for f in FOLDED)
    met = met.where(_parity_fits(differ, "n_a + n_b"))
    least, most = (F.col("a") < F.col("b")), (F.col("a") > F.col("b"))
    size_of = lambda first, x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    many = met.groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(
        (F.count("*") + F.max("spare")).alias("keys"), F.max(size_of(least, "n_a", "n_b")).alias("n_p"), F.max(size_of(most, "n_a", "n_b")).alias("n_q"))
    many = many.select(F.col("p").alias("a"), F.col("q").alias("b"), "keys", F.col("n_p").alias("n_a"), F.col("n_q").alias("n_b"))
    return _by_parity(many.where(_alike(light)).select("a", "b"), nodes)


def classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of its class) for every row of docs."""
    spark = docs.sparkSession
    seen = written(_signatures(docs, size), "signatures")
    rows = seen.where("chunk IS NULL").select("doc_id", "n", "node", F.col("check"), *PARITIES)
    level = _levels(seen)
    sizes = {r["n"]: r["count"] for r in rows.where("n > 0").groupBy("n").count().collect()}  # a row per set size
    light = boundary(sizes)
    reps = rows.where("n > 0").groupBy("node", "check").agg(F.min("doc_id").alias("rep"))

    postings = _postings(docs, size, spark.sparkContext.broadcast(level.tobytes()), light)
    shared = written(_lists(postings), "lists")
    hubs = shared.select("node", F.explode(F.array_distinct(F.array("low", "last"))).alias("hub")).where("node != hub")
    many = hubs.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.count("*").alias("keys"))
    nodes = written(rows.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), *(F.max(p).alias(p) for p in PARITIES)), "nodes")
    for x in "ab":
        many = many.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}")), x)
    pairs = written(_by_parity(many.where(_alike(light)).select("a", "b"), nodes), "pairs")
    met = [pairs]
    listed = written(shared.select("node").distinct().join(reps, "node").select(F.col("rep").alias("doc_id"), "node"), "listed")
    links = _verified(pairs, docs, listed, size)
    label = components(links)

    # lists of sets that are in different classes yet: further passes in other orders join most of them, then all pairs
    own, least = _mixed(shared, label), None
    discard(shared)
    for salt in count():
        by_key = own.select("key", "class").distinct().groupBy("key").agg(F.count("*").alias("many"))
        left = by_key.agg(F.sum(F.col("many") * (F.col("many") - 1))).head()[0] or 0  # pairs of classes that are to be met
        if not left or least is not None and left > GAIN * least:
            break
        least = left
        met.append(written(_by_parity(_neighbours(own, salt, light).join(pairs, ["a", "b"], "left_anti"), nodes), "pairs"))
        pairs, links = pairs.union(met[-1]), links.union(_verified(met[-1], docs, listed, size))
        label = components(links)
        own, before = _mixed(own, label), own
        discard(before)
    met.append(written(_across(own, nodes, light).join(pairs, ["a", "b"], "left_anti"), "pairs"))
    label = components(links.union(_verified(met[-1], docs, listed, size)))
    for frame in (own, listed, nodes, *met):
        discard(frame)

    reps = reps.join(label, "node", "left").withColumn("class", F.coalesce("component", "node"))
    named = reps.join(reps.groupBy("class").agg(F.min("rep").alias("component_id")), "class").select("node", "check", "component_id")
    full = rows.where("n > 0").join(named, ["node", "check"])
    result = full.select("doc_id", "n", "component_id").union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    known = lambda c: F.nullif(F.col(c), F.lit(NONE)).alias(c)
    return result.select(known("doc_id"), F.col("n").alias("n_shingles"), known("component_id"))


def representatives(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of docs whose doc_id is the least of their class; of rows that repeat a doc_id, one stays.

    A row without doc_id can't be named: it stays, and no other row goes because of it.
    """
    named = docs.where("doc_id IS NOT NULL")
    kept = written(classes(named, size).where("doc_id = component_id").select("doc_id"), "kept")
    rows = named.join(kept, "doc_id", "left_semi").select(*docs.columns)
    if kept.groupBy("doc_id").count().where("count > 1").head(1):
        rows = rows.dropDuplicates(["doc_id"])
    return rows.unionByName(docs.where("doc_id IS NULL"))
