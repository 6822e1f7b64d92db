"""How far the sources of a language differ in their terms, by three-dimensional cube partitioning.

Terms are runs of ASCII letters and of code points above ASCII, lower case of A-Z only. A language keeps the terms
that at least MIN_DOCS of its documents have. A group (language, source), and the language itself, gives each kept
term the share p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), all in exact integers: V terms are kept, N
is the sum of the counts over them.

The pairs of groups are compared in a cube. A language's groups are dealt to blocks of `group_block`, its kept terms
to blocks of about `term_block`; a task owns a cell (group block, group block, term block), gets a copy of both
slices, takes the absolute differences of all pairs of groups over its terms, and the cells of a pair are added up
along the term axis. Only shares of terms that a group has are shipped: a term that it lacks has the group's base
share, so a cell needs the number of its terms and each group's base. A cell holds at most
2 * group_block * term_block shares, whatever the number of groups, terms and documents.

Null text, language and source count as ''. A row is a document: repeated rows count again, doc_id and other columns
are not read. A group without kept terms is compared like any other (all its shares are base shares); a language
without kept terms gives pairs of value 0 and no terms. Ties are ordered by the item's bytes. Texts are read whole, a
text longer than a slice by itself. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bomdrift.llm.store import written
from bomdrift.llm.words import ALPHA, Tally, slices, strings, words

#: Documents of a language that must have a term for it to be kept.
MIN_DOCS = 30
#: Shares are integers of this scale, with this many added to every count.
SCALE, PRIOR = 1_000_000_000, 5
#: Terms reported for each group.
TOP = 50
#: Groups and terms of a block of the cube.
GROUP_BLOCK, TERM_BLOCK = 8, 4096


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, times, docs): occurrences and documents; a row without term counts a group's documents."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(["lang", "source", "term"], ["times", "docs"])
        for batch in slices(batches):
            w = words(batch["text"], ALPHA, fold=True)
            groups = pa.table({"lang": batch["lang"], "source": batch["source"], "row": np.arange(batch.num_rows)})
            groups = groups.group_by(["lang", "source"], use_threads=False).aggregate([("row", "list")])
            rows = groups["row_list"].combine_chunks()
            group = np.empty(batch.num_rows, np.int64)
            group[rows.values.to_numpy()] = np.repeat(np.arange(len(rows)), pc.list_value_length(rows).to_numpy())
            # occurrences by document and word, then by group and word
            row = w.row()
            _, first, times = np.unique(w.keyed(row, w.hash), return_index=True, return_counts=True)
            own = group[row[first]]
            _, word, back, n = np.unique(w.keyed(own, w.hash[first]), return_index=True, return_inverse=True, return_counts=True)
            total = np.zeros(len(word), np.int64)
            np.add.at(total, back, times)
            of = pa.array(np.concatenate((own[word], np.arange(len(rows)))))
            none = np.zeros(len(rows), np.int64)
            yield from tally.add({
                "lang": groups["lang"].combine_chunks().take(of), "source": groups["source"].combine_chunks().take(of),
                "term": pa.concat_arrays([strings(w, first[word]), pa.nulls(len(rows), pa.string())]),
                "times": pa.array(np.concatenate((total, none))), "docs": pa.array(np.concatenate((n, np.bincount(group, minlength=len(rows))))),
            })
        yield from tally.rest()

    partial = named.mapInArrow(run, "lang string, source string, term string, times long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))


def share(times: Column, total: Column, kept: Column) -> Column:
    """A term's share, in exact integers."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(F.lit(SCALE)) * wide(times + PRIOR), wide(total + PRIOR * kept))


def shares(counted: DataFrame, min_docs: int = MIN_DOCS, term_block: int = TERM_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, kept, base) and their shares (lang, source, term, block, seat, seats, p, q).

    `seat` is a term's place in its block of `seats` terms; q is the language's share. A group's base is the share of
    a term that it lacks.
    """
    by_term = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("in_lang"))
    kept = written(by_term.where(F.col("docs") >= min_docs).drop("docs"), "terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    blocked = kept.join(langs, "lang").select(
        "lang", "term", share(F.col("in_lang"), F.col("lang_total"), F.col("kept")).alias("q"),
        F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / term_block)).alias("block"),
    )
    within = Window.partitionBy("lang", "block")
    seated = written(blocked.repartition("lang", "block").select(  # not by language, as the join left it
        "*", (F.row_number().over(within.orderBy("term")) - 1).alias("seat"), F.count("*").over(within).cast("int").alias("seats")), "seats")
    own = written(counted.where("term IS NOT NULL").select("lang", "source", "term", "times").join(seated, ["lang", "term"]), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    groups = (
        counted.where("term IS NULL").select("lang", "source").join(langs.select("lang", "kept"), "lang", "left")
        .join(totals, ["lang", "source"], "left").na.fill(0, ["kept", "total"])
    )
    groups = written(groups.withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0)), "groups")
    p = own.join(groups.select("lang", "source", "total", "kept"), ["lang", "source"])
    return groups, p.select("lang", "source", "term", "block", "seat", "seats", share(F.col("times"), F.col("total"), F.col("kept")).alias("p"), "q")


def _cell(key: tuple, cell: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of groups of one cell; a row without seat names a group and its base."""
    _, a, b, _ = (k.as_py() for k in key)
    seat = cell["seat"].combine_chunks()
    named = cell.filter(pc.is_null(seat)).sort_by([("side", "ascending"), ("source", "ascending")])
    held = cell.filter(pc.is_valid(seat))
    seats = int(pc.max(cell["seats"]).as_py() or 0)
    sides = []
    for side in range(1 if a == b else 2):
        mine, have = (t.filter(pc.equal(t["side"], side)) for t in (named, held))
        source = mine["source"].combine_chunks()
        dense = np.repeat(mine["p"].to_numpy()[:, None], seats, 1)
        at = pc.index_in(have["source"], source).to_numpy()
        dense[at, have["seat"].to_numpy()] = have["p"].to_numpy()
        sides.append((source, dense))
    (left, x), (right, y) = sides[0], sides[-1]
    i, j, value = [], [], []
    for k in range(len(left)):
        others = np.arange(k + 1 if a == b else 0, len(right))
        i.append(np.full(len(others), k))
        j.append(others)
        value.append(np.abs(y[others] - x[k]).sum(1))
    i, j, value = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (i, j, value))
    lang = pa.array([key[0].as_py()] * len(i), pa.string())
    return pa.table({"lang": lang, "a": left.take(pa.array(i)), "b": right.take(pa.array(j)), "value": pa.array(value)})


def pairs(groups: DataFrame, own: DataFrame, group_block: int = GROUP_BLOCK) -> DataFrame:
    """(lang, a, b, value): the divergence of every two groups of a language, once."""
    # groups by number in the order of their names, so that every block has group_block of them
    numbered = groups.select("*", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number"))
    numbered = numbered.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / group_block).cast("int"))
    placed = written(numbered.withColumn("mine", F.floor(F.col("number") / group_block).cast("int")).drop("number"), "blocks")
    blocks = own.select("lang", "block", "seats").distinct()
    # every group stands in each of its cells, also where it has no term; a language without terms has one empty block
    names = placed.join(blocks, "lang", "left").select(
        "lang", "source", "mine", "blocks", F.coalesce("block", F.lit(0)).alias("block"), F.lit(None).cast("int").alias("seat"),
        F.coalesce("seats", F.lit(0)).alias("seats"), F.col("base").alias("p"))
    held = own.join(placed.select("lang", "source", "mine", "blocks"), ["lang", "source"]).select(*names.columns)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    copies = names.union(held).select("*", other).select(
        "lang", F.least("mine", "other").alias("row_block"), F.greatest("mine", "other").alias("column_block"), "block",
        (F.col("mine") > F.col("other")).cast("int").alias("side"), "source", "seat", "seats", "p")
    cells = copies.groupBy("lang", "row_block", "column_block", "block").applyInArrow(_cell, "lang string, a string, b string, value long")
    return cells.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audited(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK
) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by divergence, and the terms a source uses more than its language."""
    counted = written(counts(docs), "counts")
    groups, own = shares(counted, min_docs, term_block)
    both = pairs(groups, own, group_block).select(
        "lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("pair"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = lambda rows, part: rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = own.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked(both.select("lang", "pair.*", "value"), "pair").union(ranked(terms, "term").where(F.col("rank") <= top))
