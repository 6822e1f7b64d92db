"""Operators over words against plain Python over whole texts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bomdrift.llm import decontaminate, jaccard, licenses, quality, substrings
from bomdrift.llm.components import components
from bomdrift.llm.words import ALNUM, words

BIG = 2**63 - 1


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_words_are_those_of_the_pattern(plain):
    texts = [t for _, t in plain]
    w = words(pa.array(texts, pa.string()))
    found = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.offset, w.offset[1:])]
    assert found == [split(t) for t in texts]
    w = words(pa.array(texts, pa.string()), ALNUM, fold=True)
    found = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.offset, w.offset[1:])]
    assert found == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t)) for t in texts]


def test_windows_have_equal_hashes_only_for_equal_words():
    w = words(pa.array(["a b c a b c", "x a b c", "ab c", None, ""]))
    first, value = w.windows(3)
    of = lambda i: tuple(w.data[w.start[k] : w.end[k]].tobytes() for k in range(i, i + 3))
    assert len({(of(i), v) for i, v in zip(first, value)}) == len({of(i) for i in first}) == len(set(value.tolist()))


def brute_substrings(docs, size):
    known = {}
    for i, t in docs:
        w = split(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            known[key] = min(known.get(key, BIG), BIG if i is None else i)
    out = []
    for i, t in docs:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if known[tuple(w[k : k + size])] < (BIG if i is None else i):
                gone[k : k + size] = [True] * size
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [50, 12])
def test_substrings_against_brute_force(documents, plain, size):
    found = rows(substrings.digests(documents, size))
    assert found == brute_substrings(plain, size)
    whole = substrings.deduplicated(documents.select("doc_id", "text"), size)
    assert rows(substrings.digest(whole, "doc_id", "n_words", "n_removed")) == found
    assert any(r[2] for r in found)


def test_substring_stage_keeps_columns(documents):
    out = substrings.cleaned(documents)
    assert out.columns == documents.columns and out.count() == documents.count()
    same = rows(documents.select("doc_id", "kept", "items"))
    assert rows(out.select("doc_id", "kept", "items")) == same


def brute_measures(text):
    w = split(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(repeated)


def test_quality_base_against_brute_force(documents, plain):
    found = quality.judge(documents).select("doc_id", *quality.MEASURES[:5], "base_failed", "kept").collect()
    want = [(i, *(m := brute_measures(t)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for i, t in plain]
    assert sorted((tuple(r)[:-1] for r in found), key=str) == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert quality.filtered(documents).columns == documents.columns


def test_quality_model_against_the_labels(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{n}.parquet") for n in ("documents", "labels"))
    both = quality.judge(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in both}
    assert n[1, True] > 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] > 0.9 * (n[0, False] + n.get((0, True), 0))


def test_expectation_maximisation_is_that_of_all_rows(rng=np.random.default_rng(4)):
    """Counts of patterns give what single rows give, and a rule at random gets an accuracy near one half."""
    n, rules = 4000, len(quality.RULES)
    good = rng.random(n) < 0.7
    cast = np.zeros((n, rules), np.int64)
    for j, (vote, _) in enumerate(quality.RULES.values()):
        right = good if vote > 0 else ~good
        chance = np.where(right, 0.7, 0.1) if j else np.full(n, 0.3)
        cast[:, j] = np.where(rng.random(n) < chance, vote, 0)
    one = quality.fit(cast, np.ones(n))
    patterns, times = np.unique(cast, axis=0, return_counts=True)
    many = quality.fit(patterns, times.astype(float))
    assert np.allclose(one.chance, many.chance) and np.isclose(one.share, many.share)
    assert abs(many.share - 0.7) < 0.05
    assert ((many.odds(cast) > 0) == good).mean() > 0.97
    assert many.accuracy()[0] < 0.5 < many.accuracy()[1:].min()


def brute_scan(docs, items, size=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    grams = {}
    for item, t in items:
        w = norm(t)
        m = min(len(w), size)
        for i in range(len(w) - m + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + m]), set()).add("" if item is None else str(item))
    out = []
    for i, t in docs:
        w, hit, own = norm(t), set(), set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                if names := grams.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    own |= names
        out.append((i, len(w), len(hit), sorted(own)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def benchmark_items(spark, plain):
    text = dict((i, t) for i, t in plain if i is not None)
    w = split(text[20])
    items = [(1, " ".join(w[100:125])), (2, " ".join(w[110:118])), (3, "ONE"), (4, None), (5, ""), (None, "same same"), (10, " ".join(w[105:130])), (1, "again " + " ".join(w[300:312])), (7, "nothing of this occurs anywhere at all in the documents here")]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontamination_against_brute_force(documents, plain, benchmark_items, block):
    items, frame = benchmark_items
    found = decontaminate.scan(documents, frame, "kept", block=block)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "items").collect()), key=str)
    assert got == brute_scan(plain, items)
    texts = [(r["doc_id"], r["cleaned"]) for r in found.collect()]
    assert all(not r[2] for r in brute_scan(texts, items))
    clean = {str(i): t for i, t in texts}
    assert all(clean[str(i)] == t for i, t in plain if i in (2, 5, 7))


def test_decontamination_cuts_the_same_in_any_blocks(spark, documents, benchmark_items):
    """Windows of one block that overlap those of another, and windows that only a cut brings together."""
    w = [f"v{i}" for i in range(40)]
    texts = ["x y " + " ".join(w[:30]) + " z", " ".join(w[:5] + w[10:40] + w[5:10]), " ".join(w[30:35] + w[:20] + w[35:40]), "A, " + ". ".join(w[:12]) + "! B"]
    docs = spark.createDataFrame([(100 + i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    items = spark.createDataFrame([(20, " ".join(w[:30])), (21, " ".join(w[30:40])), (22, " ".join(w[:10]))], "item_id long, text string")
    both = docs.union(documents.select("doc_id", "text", "kept")), items.union(benchmark_items[1])
    one, many = (rows(decontaminate.scan(*both, "kept", block=block)) for block in (500_000, 7))
    assert many == one
    clean = {r[0]: r[-1] for r in one}
    assert clean[100] == "x y  z" and not set(clean[102].split()) & set(w)


def brute_classes(docs, size=5):
    sets = []
    for _, t in docs:
        w = split(fold(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), BIG), BIG if i is None else i)
    name = lambda x: None if x == BIG else x
    return sorted(((i, len(sets[k]), name(least[find(k)])) for k, (i, _) in enumerate(docs)), key=str)


def test_classes_against_brute_force(documents, plain):
    assert rows(jaccard.classes(documents)) == brute_classes(plain)


def test_classes_of_chains_and_large_groups(spark):
    """Copies that drift: each links with its neighbours only; and a hundred variants of one text."""
    w = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(w[i * 4 : i * 4 + 80])) for i in range(30)]
    base = [f"b{i}" for i in range(90)]
    docs += [(100 + i, " ".join(base[:i] + [f"x{i}"] + base[i:])) for i in range(90)]
    docs += [(300 + i, " ".join([f"{'pqrst'[k]}{min(k, i)}" for k in range(5)] + ["t", "u"])) for i in range(6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(jaccard.classes(frame)) == brute_classes(docs)


@pytest.mark.parametrize("light", [0, 20, 10**6])
def test_every_boundary_gives_the_same_classes(documents, plain, monkeypatch, light):
    monkeypatch.setattr(jaccard, "boundary", lambda sizes: light)
    short = documents.where("length(text) < 1000 OR text IS NULL")
    kept = [(i, t) for i, t in plain if t is None or len(t) < 1000]
    assert rows(jaccard.classes(short)) == brute_classes(kept)


def test_one_document_of_each_class_stays(documents):
    out = jaccard.representatives(documents)
    assert out.columns == documents.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[5] == 1 and ids[20] == 1 and not ids[7] and not ids[6] and ids[12] and ids[13] and ids[None] == 2


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b")
    assert components(links).agg(F.max("component"), F.count("*")).first() == (0, 200)


def test_licences_by_ordered_sentences(spark):
    grant = next(k for k, v in licenses.SENTENCES.items() if v == "mit-grant")
    notice, asis = (next(k for k, v in licenses.SENTENCES.items() if v == x) for x in ("mit-notice", "mit-asis"))
    docs = [
        (1, f"Copyright X. All rights reserved.\n\n{grant.capitalize()}:\n\n{notice}. \n\n{asis.upper()}."), (2, f"{notice}. {grant}. {asis}."), (3, "text\nLicensed under CC BY-NC 4.0.\nmore"),
        (4, "Licensed under the Apache License,\nVersion 2.0."), (5, None), (6, ""), (7, "no licence is named here"), (8, "Released under the MIT License. Released under the MIT License."),
    ]
    found = {r["doc_id"]: r["licenses"] for r in licenses.recognised(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: ["MIT", "all-rights-reserved"], 2: [], 3: ["CC-BY-NC-4.0"], 4: ["Apache-2.0"], 5: [], 6: [], 7: [], 8: ["MIT"]}


def brute_licences(ids):
    """The rules as patterns over the identifiers, each on what is left."""
    left, found = " " + "  ".join(ids) + " ", []
    for name, own in licenses.RULES:
        rule = "((?: [^ ]+ )*?)".join(f" {i} " for i in own)
        if re.search(rule, left):
            found.append(name)
        left = re.sub(rule, "".join(f"\\{k}" for k in range(1, len(own))), left)
    return list(dict.fromkeys(found))


def test_licence_rules_are_those_of_the_patterns(spark):
    import random

    r = random.Random(6)
    names = sorted(set(licenses.SENTENCES.values()))
    some = [[r.choice(r.sample(names, r.randrange(1, 7))) for _ in range(r.choice([1, 3, 8, 40, 300]))] for _ in range(150)]
    some += [[i for i in names if i.startswith(("bsd", "gpl", "mit"))] * 3]
    frame = spark.createDataFrame([(k, ids) for k, ids in enumerate(some)], "k long, ids array<string>")
    got = {x["k"]: x["found"] for x in frame.select("k", licenses._matched(F.col("ids")).alias("found")).collect()}
    assert got == {k: brute_licences(ids) for k, ids in enumerate(some)}


def test_every_known_sentence_has_a_hint():
    assert all(re.search(licenses.HINT, s) for s in licenses.SENTENCES)


def test_licences_of_very_long_texts(spark):
    known = list(licenses.SENTENCES)
    docs = [(1, "All rights reserved.\n" * 20_000), (2, ". ".join(known * 600) + "."), (3, "no licence here. " * 100_000)]
    found = {x["doc_id"]: (len(x["sentence_ids"]), x["licenses"]) for x in licenses.recognised(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[1] == (20_000, ["all-rights-reserved"]) and found[3] == (0, [])
    assert found[2][0] == 600 * len(known) and set(found[2][1]) == {n for n, _ in licenses.RULES if n != "BSD-2-Clause"}


def test_empty_tables(documents, benchmark_items):
    none = documents.where("false")
    assert not substrings.cleaned(none).count() and not quality.filtered(none).count() and not jaccard.classes(none).count()
    assert not decontaminate.scan(none, benchmark_items[1]).count() and not licenses.recognised(none).count()
    clean = decontaminate.scan(documents, benchmark_items[1].where("false"))
    assert clean.where("n_hit = 0").count() == documents.count()
