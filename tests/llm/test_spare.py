"""Keys that classes share in excess of what their similar sets must share, and ids that texts are fetched by."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bomdrift.llm import bitmap, jaccard, substrings
from test_parity import brute, family

ROW = "key long, node long, n int, class long, " + ", ".join(f"{f} long" for f in jaccard.FOLDED)


def need(n: int, m: int) -> int:
    """First shingles that similar sets of n and m share at least."""
    return -(-80 * (n + m) // 180) - -(-80 * max(n, m) // 100) + 1


def test_no_similar_pair_shares_only_spare_keys(spark):
    r = random.Random(5)
    rows = [(n, n + r.randrange(0, 1 + n // 20), m, m + r.randrange(0, 1 + m // 20)) for n, m in ((n, max(1, n + r.randrange(-n // 5, 1 + n // 5))) for n in range(1, 400, 3))]
    got = spark.createDataFrame(rows, "least_a int, most_a int, least_b int, most_b int").withColumn("spare", F.expr(jaccard._spare(14))).collect()
    for x in got:
        sizes = [(n, m) for n in range(x["least_a"], x["most_a"] + 1) for m in range(x["least_b"], x["most_b"] + 1) if 100 * min(n, m) >= 80 * max(n, m)]
        assert all(x["spare"] < (1 if max(n, m) <= 14 else need(n, m)) for n, m in sizes)
    assert sum(x["spare"] > 0 for x in got) > len(got) // 3


def test_keys_of_long_lists_are_left_out(spark):
    """Two classes share 50 keys, 25 of them with 40 members of the first: sets of 200 must share 19, more than 17 by the bound, so 17 long ones go."""
    rows = [(k, 1000 + i, 200, 1) for k in range(50) for i in range(40 if k < 25 else 1)] + [(k, 2000, 200, 2) for k in range(50)]
    own = spark.createDataFrame([(*x, *[0] * len(jaccard.FOLDED)) for x in rows], ROW)
    met = jaccard._met(own, 14).collect()
    assert need(200, 200) == 19 and {x["spare"] for x in met} == {17} and len(met) == 33
    assert sum(x["key"] < 25 for x in met) == 8


def test_a_class_that_shares_too_few_keys_is_not_met(spark):
    rows = [(k, node, 200, node) for k in range(17) for node in (1, 2)] + [(k, node, 200, node) for k in range(100, 118) for node in (3, 4)]
    own = spark.createDataFrame([(*x, *[0] * len(jaccard.FOLDED)) for x in rows], ROW)
    assert {(x["class_a"], x["class_b"]) for x in jaccard._met(own, 14).collect()} == {(3, 4)}


def test_texts_are_read_in_place_and_no_link_is_lost(spark, monkeypatch):
    """Without further passes all links between classes are left to the last join; no table of texts is written or joined."""
    made, own = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda frame, name: made.append(name) or own(frame, name))
    monkeypatch.setattr(jaccard, "GAIN", 0.0)
    texts = {1000 * k + i: t for k, n in enumerate((60, 150, 400)) for i, t in family(20 + k, 30, n).items()}
    sets = {i: {" ".join(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    got = jaccard.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute(sets)
    assert "texts" not in made and "sets" in made


def test_rows_without_id_keep_their_links(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    near = " ".join([*base[:50], "other", *base[51:]])
    rows = [(None, " ".join(base))] * 3 + [(None, near), (4, near + " more"), (9, "alone")]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"]) for x in got) == [(0, 4)] * 4 + [(4, 4), (9, 9)]


def test_a_bitmap_holds_all_its_ids_and_few_others(spark):
    ids = [-(2**63), -1, 0, 7, 2**63 - 1, *range(10**6, 10**6 + 500)]
    bits = bitmap.bitmap(spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(3))
    assert all(bitmap.among(pa.array(ids, pa.int64()), bits).to_pylist())
    assert sum(bitmap.among(pa.array(np.arange(10**7, 10**7 + 10**5)), bits).to_pylist()) < 50
    none = bitmap.bitmap(spark.createDataFrame([], "doc_id long"))
    assert not any(bitmap.among(pa.array(ids, pa.int64()), none).to_pylist())


def test_texts_without_repeats_are_not_shuffled(spark, documents, monkeypatch):
    """Only rows whose ids may be among the hits are joined with them; the others keep text, columns and counts."""
    joined, own = [], substrings._marked
    monkeypatch.setattr(substrings, "_marked", lambda docs, wanted: joined.append(own(docs, wanted)) or joined[-1])
    documents = documents.select("doc_id", "text", "lang")
    got = substrings.deduplicated(documents)
    before = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(joined) == 2 and all(frame.count() < documents.count() for frame in joined)
    assert got.count() == documents.count() and got.columns == ["doc_id", "text", "lang", "n_words", "n_removed"]
    kept = [r for r in got.where("n_removed = 0").collect() if r["doc_id"] is not None]
    assert {12, 13, 16, 20} <= {r["doc_id"] for r in kept} and all(r["text"] == before[r["doc_id"]] for r in kept)
