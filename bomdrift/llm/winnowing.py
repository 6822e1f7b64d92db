"""Document fingerprints by winnowing, in DataFrame functions only.

A text's tokens are its words (runs of anything but ASCII blanks); Han, kana and Hangul characters are tokens of
their own. Every GRAM tokens in a row give a Karp-Rabin hash; of every WINDOW hashes in a row the least is chosen, the
rightmost of equal ones. A fingerprint lists the chosen hashes with their positions (token numbers), so two texts
that share GRAM + WINDOW - 1 tokens in a row share a chosen hash, and the positions say where. A text of fewer tokens
than a gram gives the hash of all it has, one of fewer grams than a window the least of all; a text of blanks has an
empty fingerprint. Equal texts have equal fingerprints, whatever else is in their rows.

The likeness of two fingerprints is the Jaccard similarity of their hash sets; two empty ones are alike.

A document is also held against an edit of itself: its last quarter is replaced by the beginning of the next
document. Next is by ascending doc_id, nulls last, equal ids by a hash of the text, and the first after the last.
Documents are dealt to parts by ranges of ids; an id with many rows is dealt to several parts by the text's hash. One
shuffle brings a part together, where the next row is at hand; of each part's first row only the text is carried to
the part before.

Null texts count as empty. Repeated rows are documents of their own (equal in id and text, they are interchangeable).
Other columns are not read, so their names may clash. Texts are hashed whole, in time proportional to their length.
An empty table gives no rows; a single document is next to itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tokens of a gram, grams of a window.
GRAM, WINDOW = 5, 16
#: Modulus (a prime below 2**31) and base of the hash.
MODULUS, BASE = 2**31 - 1, 1_000_003
#: Characters that are tokens of their own: kana, Han, Hangul.
SINGLE = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"
TOKEN = rf"[{SINGLE}]|[^\x20\x09-\x0D{SINGLE}]+"
#: Parts for each shuffle partition.
PARTS = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def _upto(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(text: Column, gram: int = GRAM) -> Column:
    """The hash of every gram of a text, in order."""
    def of(hashes: Column) -> Column:
        at = lambda i: F.get(hashes, i)
        rolled = lambda i: reduce(lambda h, j: (h * BASE + at(i + j)) % MODULUS, range(1, gram), at(i))
        whole = F.aggregate(hashes, F.lit(0).cast("long"), lambda h, x: (h * BASE + x) % MODULUS)
        few = F.when(F.size(hashes) > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(hashes) < gram, few).otherwise(F.transform(_upto(F.size(hashes) - gram + 1), rolled))

    token = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % MODULUS
    return let(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), token), of)


def chosen(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The chosen grams in order, each as hash * 2**31 + (2**31 - 1 - position): the least is the rightmost of equals."""
    def of(keys: Column) -> Column:
        least = lambda i: F.array_min(F.slice(keys, i + 1, window))
        few = F.when(F.size(keys) > 0, F.array(F.array_min(keys))).otherwise(keys)
        return F.when(F.size(keys) < window, few).otherwise(F.array_distinct(F.transform(_upto(F.size(keys) - window + 1), least)))

    return let(F.transform(grams(text, gram), lambda h, i: h * 2**31 + (2**31 - 1 - i)), of)


def written_out(keys: Column) -> Column:
    """A fingerprint as text: `position:hash` in order, hashes in eight hexadecimal digits."""
    digits = lambda k: F.lower(F.lpad(F.hex(F.shiftright(k, 31)), 8, "0"))
    position = lambda k: 2**31 - 1 - k.bitwiseAND(F.lit(2**31 - 1))
    return F.array_join(F.transform(keys, lambda k: F.concat(position(k).cast("string"), F.lit(":"), digits(k))), " ")


def hashes(keys: Column) -> Column:
    """The set of chosen hashes."""
    return F.array_distinct(F.transform(keys, lambda k: F.shiftright(k, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _constant(values: list[int], kind: str) -> Column:
    """A literal array of numbers, however many."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _below(edges: list[int], value: Column) -> Column:
    """How many of the sorted edges are below a value, by blocks of edges."""
    block = max(1, math.isqrt(len(edges)))
    count = lambda array: F.size(F.filter(array, lambda e: e < value))
    whole = count(_constant(edges[block - 1 :: block], "bigint"))
    return let(whole * block, lambda before: before + count(F.slice(_constant(edges, "bigint"), before + 1, block)))


def parted(rows: DataFrame, parts: int) -> DataFrame:
    """rows of (doc_id, tie, ...) with `part`: parts follow each other in the order of (doc_id nulls last, tie)."""
    share = F.percentile_approx("doc_id", [(i + 1) / (parts + 1) for i in range(parts)], 10 * parts)
    found = rows.agg(share.alias("ids"), F.count("*").alias("rows"), F.count("doc_id").alias("named")).head()  # parts + 2 numbers
    times = Counter(found["ids"] or [])
    edges = sorted(times)
    # slot 2 i lies between two edges, slot 2 i + 1 is an edge itself, the last slot has the rows without id
    width = [1, *(x for e in edges for x in (times[e], 1)), 1 + parts * (found["rows"] - found["named"]) // max(found["rows"], 1)]
    start = [0, *accumulate(width)]
    slot = let(_below(edges, F.col("doc_id")), lambda i: 2 * i + (F.get(_constant(edges, "bigint"), i).eqNullSafe(F.col("doc_id"))).cast("int"))
    slot = F.when(F.col("doc_id").isNull(), len(width) - 1).otherwise(slot)
    within = (F.shiftright("tie", 11) + F.lit(2**52)) / F.lit(2.0**53)  # the hash as a fraction, in its order
    part = let(slot, lambda s: F.get(_constant(start, "int"), s) + F.floor(within * F.get(_constant(width, "int"), s)).cast("int"))
    return rows.withColumn("part", part)


def fingerprinted(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = parted(rows.withColumn("tie", F.xxhash64("text")), parts)
    # the first row of each part, whose text goes to the part before; the first part follows the last
    present = sorted(r["part"] for r in rows.select("part").distinct().collect())  # numbers of parts
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")).alias("key"))
    place = F.array_position(_constant(present, "int"), F.col("part")).cast("int")
    before = F.get(_constant(present[-1:] + present, "int"), place - 1)
    leads = first.select(before.alias("before"), "part", F.col("key.doc_id").alias("doc_id"), F.col("key.tie").alias("tie"))
    same = (F.col("r.part") == F.col("l.part")) & F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.tie") == F.col("l.tie"))
    heads = rows.alias("r").join(F.broadcast(leads.alias("l")), same).select(F.col("before").alias("part"), F.col("text").alias("head_text"))
    heads = heads.groupBy("part").agg(F.first("head_text").alias("head_text"))
    own = rows.repartition("part").withColumn("keys", chosen(F.col("text"), gram, window))
    following = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_last(), "tie")
    own = own.withColumns({"next_text": F.lead("text").over(following), "next_keys": F.lead("keys").over(following)})
    last = F.col("next_text").isNull()
    whole = own.join(heads, "part").withColumns({
        "next_keys": F.when(last, chosen(F.col("head_text"), gram, window)).otherwise(F.col("next_keys")),
        "next_text": F.coalesce("next_text", "head_text")})
    return _compared(whole, gram, window)


def _compared(rows: DataFrame, gram: int, window: int) -> DataFrame:
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 4 as int))"), F.expr("left(next_text, cast(n_chars div 4 as int))"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    rows = rows.withColumn("edited_keys", chosen(F.col("edited"), gram, window))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written_out(F.col("keys")).alias("fingerprint"), written_out(F.col("edited_keys")).alias("edited_fingerprint"),
        let(hashes(F.col("keys")), lambda own: likeness(own, hashes(F.col("edited_keys")))).alias("near_edited"),
        let(hashes(F.col("keys")), lambda own: likeness(own, hashes(F.col("next_keys")))).alias("near_next"),
    )
