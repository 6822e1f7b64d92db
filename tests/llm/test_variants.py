"""Divergence audit, spelling variants and fingerprints against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bomdrift.llm import divergence, spelling, winnowing
from bomdrift.llm.words import LATIN, words

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, part int"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# -- divergence ------------------------------------------------------------------


def brute_divergence(docs, min_docs, top):
    found, have = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(text))
        found[lang, source].update(terms)
        have[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in found}:
        kept = sorted(t for t, n in have[lang].items() if n >= min_docs)
        whole = Counter()
        for (g, _), c in found.items():
            if g == lang:
                whole.update({t: c[t] for t in kept})
        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        q, p = shares(whole), {s: shares(c) for (g, s), c in found.items() if g == lang}
        for s in p:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out, key=str)


def audit_docs():
    r = random.Random(5)
    words_ = ["Alpha", "beta", "gamma", "é́t", "ΔELTA", "zeta9eta", "中文"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    docs = [(" ".join(r.choices(words_, range(len(words_), 0, -1), k=r.randrange(3, 60))), r.choice(["en", "en", "fr", None]), f"s{r.randrange(7)}") for _ in range(300)]
    docs += [(None, "en", "none"), ("", "en", "s1"), ("12 ## 34", "en", "digits"), ("lonely words", "xx", "a"), ("lonely words", "xx", None), ("Alpha " * 400_000, "en", "s1")]
    return docs + docs[:20]


@pytest.mark.parametrize("group_block, term_block", [(2, 7), (8, 4096), (1, 1)])
def test_divergence_is_that_of_plain_loops(spark, group_block, term_block):
    docs = audit_docs()
    frame = spark.createDataFrame([(None, t, g, s, "clash", 1, 2) for t, g, s in docs], SCHEMA).repartition(5)
    assert rows(divergence.audited(frame, 5, 4, group_block, term_block)) == brute_divergence(docs, 5, 4)


def test_divergence_without_kept_terms_and_without_rows(spark):
    docs = [("a b", "en", "x"), (None, "en", "y"), ("c", "fr", "x")]
    frame = spark.createDataFrame([(1, t, g, s, None, 1, 2) for t, g, s in docs], SCHEMA)
    assert rows(divergence.audited(frame)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert rows(divergence.audited(frame.limit(0))) == []


def test_shares_are_exact_beyond_64_bits(spark):
    n = 10**15 + 7
    frame = spark.createDataFrame([(n, 3 * n, 11)], "times long, total long, kept long")
    assert frame.select(divergence.share(F.col("times"), F.col("total"), F.col("kept"))).head()[0] == 1 + 10**9 * (n + 5) // (3 * n + 55)


# -- spelling --------------------------------------------------------------------


def test_crc32_and_words_are_those_of_the_library():
    texts = ["Haus Ähre xÿz ×÷ aĀb ſtraße", "q" * 500 + " " + "é" * 40, None, "", "Ã\u0080Ã"]
    w = words(pa.array(texts, pa.string()), LATIN, fold=True)
    found = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.offset, w.offset[1:])]
    wanted = [re.findall("[A-Za-zÀ-ÿ]+", fold(t)) for t in texts]
    assert found == wanted
    prefixes = [f"{k}:".encode() for k in range(len(texts))]
    assert spelling.crc32(w, prefixes).tolist() == [zlib.crc32(f"{k}:{x}".encode()) for k, ws in enumerate(wanted) for x in ws]


def brute_counts(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", fold(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def brute_variants(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def spelled(seed):
    """Many short words over few letters, so that most have near words, with steep counts."""
    r = random.Random(seed)
    vocabulary = list({"".join(r.choices("abcé", k=r.randrange(5, 10))) for _ in range(700)}) + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "é" * 6, "é" * 7, "q" * 300, "q" * 301, "q" * 299 + "z"]
    text = []
    for k, w in enumerate(vocabulary):
        text += [w if r.random() < 0.5 else w.upper() if w.isascii() else w] * r.choice([1, 4, 5, 6, 30, 200])
    text += ["nnnnnn"] * 250 + ["nnnnnno"] * 40 + ["nnnnnnop"] * 7  # a form of a form
    r.shuffle(text)
    docs = [(k, " ".join(text[k::40])) for k in range(40)]
    return docs + [(None, "aaaaaa bbbbbb " * 9), (None, "aaaaaa bbbbbb " * 9), (50, None), (51, ""), (51, "12 ?"), (7, docs[7][1])]


@pytest.mark.parametrize("cell", [16, 2048])
def test_variants_are_those_of_plain_loops(spark, cell):
    docs = spelled(3)
    frame = spark.createDataFrame([(i, t, "w", "s", "clash", 1, 2) for i, t in docs], SCHEMA).repartition(4)
    want = brute_variants(brute_counts(docs))
    assert sum(1 for x in want if x[1]) > 20 and any(x[2] != x[1] for x in want if x[1])
    assert rows(spelling.variants(frame, cell)) == want
    assert rows(spelling.variants(frame.limit(0), cell)) == []


def test_near_finds_every_pair_once_over_both_sides():
    r = random.Random(8)
    vocabulary = sorted({"".join(r.choices("ab", k=r.choice([6, 7]))) for _ in range(300)})
    letters = np.array([w.encode() for w in vocabulary], "S8").view(np.uint8).reshape(len(vocabulary), 8)
    length = np.array([len(w) for w in vocabulary])
    query = np.flatnonzero(length == 6)
    found = [(int(query[q]), int(v)) for side in (0, 1) for q, v in zip(*spelling.near(letters, length, letters[query], 6, side))]
    assert len(found) == len(set(found))
    assert set(found) == {(int(q), v) for q in query for v in range(len(vocabulary)) if one_apart(vocabulary[q], vocabulary[v])}


def test_a_long_text_of_words_is_counted_whole(spark):
    text = "longish " * 300_000 + "lengish " * 7
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r[0]: r[3] for r in spelling.variants(frame).collect()}.items() >= {("lengish", brute_counts([(1, text)])["lengish"])}


# -- winnowing -------------------------------------------------------------------

M, B = 2**31 - 1, 1_000_003


def brute_keys(text, gram, window):
    single = "[぀-ヿ㐀-䶿一-鿿가-힯]"
    token = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % M for w in re.findall(single + "|[^\\x20\\x09-\\x0D" + single[1:-1] + "]+", text)]
    hashes = []
    for at in range(max(len(token) - gram + 1, min(len(token), 1))):
        h = 0
        for x in token[at : at + gram]:
            h = (h * B + x) % M
        hashes.append(h)
    chosen = []
    for at in range(max(len(hashes) - window + 1, min(len(hashes), 1))):
        own = hashes[at : at + window]
        place = at + max(k for k, h in enumerate(own) if h == min(own))  # the rightmost
        if not chosen or chosen[-1][0] != place:
            chosen.append((place, hashes[place]))
    return chosen


def brute_fingerprints(docs, gram, window):
    order = sorted(((i is None, i or 0), t or "", i) for i, t in docs)
    out = []
    for k, (_, text, i) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        keys, changed, other = (brute_keys(t, gram, window) for t in (text, edited, after))
        def alike(a, b):
            a, b = {h for _, h in a}, {h for _, h in b}
            return 1.0 if not a and not b else len(a & b) / len(a | b)
        show = lambda ks: " ".join(f"{p}:{h:08x}" for p, h in ks)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(keys), show(changed), alike(keys, changed), alike(keys, other)))
    return sorted(out, key=str)


@pytest.mark.parametrize("gram, window", [(5, 16), (2, 3)])
def test_fingerprints_are_those_of_plain_loops(spark, documents, plain, gram, window):
    docs = [(100 + k, t) for k, (_, t) in enumerate(plain)]
    docs += [(99, "東京 は日本の首都です。" * 9 + " and more 한국어"), (98, "x"), (97, "a b c d e " * 40), (96, "😀 " * 30)]
    frame = spark.createDataFrame([(i, t, "keys", "edited", "clash", 1, 2) for i, t in docs], SCHEMA).repartition(5)
    assert rows(winnowing.fingerprinted(frame, gram, window)) == brute_fingerprints(docs, gram, window)


def test_next_follows_ids_texts_and_the_end(spark):
    r = random.Random(2)
    docs = [(r.choice([None, 7, 7, k]), " ".join(str(r.randrange(9)) for _ in range(r.randrange(30)))) for k in range(200)] + [(3, "same row")] * 30
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    keyed = frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = sorted(map(tuple, keyed.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    want = []
    for k, (i, text, _) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(text) // 4
        want.append((i, hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    got = winnowing.fingerprinted(frame).select("doc_id", "edited_sha256")
    assert Counter(map(tuple, got.collect())) == Counter(want)
    # rows of one id and rows without id are dealt to several parts
    parts = winnowing.parted(keyed, 32)
    assert parts.where("doc_id = 7").select("part").distinct().count() > 3 and parts.where("doc_id IS NULL").select("part").distinct().count() > 3


def test_shared_passages_share_a_chosen_hash_at_their_positions(spark):
    r = random.Random(4)
    passage = [f"p{k}" for k in range(winnowing.GRAM + winnowing.WINDOW - 1)]
    texts = [" ".join([f"{n}x{k}" for k in range(r.randrange(50))] + passage + [f"{n}y{k}" for k in range(r.randrange(50))]) for n in range(20)]
    prints = [r_[0] for r_ in spark.createDataFrame([(t,) for t in texts], "text string").select(winnowing.written_out(winnowing.chosen(F.col("text")))).collect()]
    for text, other, a, b in zip(texts, texts[1:], prints, prints[1:]):
        a, b = ({h: int(p) for p, h in (x.split(":") for x in f.split())} for f in (a, b))
        start, start_other = text.split().index("p0"), other.split().index("p0")
        assert any(h in b and a[h] - start == b[h] - start_other >= 0 for h in a)


def test_fingerprints_of_none_one_and_long_texts(spark):
    frame = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert rows(winnowing.fingerprinted(frame.limit(0))) == []
    assert rows(winnowing.fingerprinted(frame)) == [(1, 0, hashlib.sha256(b"").hexdigest(), "", "", 1.0, 1.0)]
    long = " ".join(str(k) for k in range(250_000))
    got = winnowing.fingerprinted(spark.createDataFrame([(1, long), (2, "a")], "doc_id long, text string")).where("doc_id = 1").head()
    assert got["n_chars"] == len(long) and got["near_edited"] > 0.7 and got["near_next"] == 0


def test_fingerprints_run_no_python_on_executors(spark, documents):
    plan = winnowing.fingerprinted(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|ArrowEval|InPandas|InArrow", plan)
