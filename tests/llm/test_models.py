"""Archives, token files, packing and models: exact round trips, brute force, certificates and held-out accuracy."""

from __future__ import annotations

import hashlib
import io
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from bomdrift.llm import hmm, jaccard, language, packing, quality, queries, substrings, warc, wavelet
from bomdrift.llm.store import folder, written
from bomdrift.llm.tokens import Encoder

from test_texts import brute_classes, brute_measures, brute_scan, brute_substrings, fold, split

SMALL = "/root/testdata/sf0.001"
PATH = queries.TOKENIZER


@pytest.fixture(scope="module")
def pages(spark):
    big, tie = "<p>" + "x" * 2000, "é" * 500
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "http://b\r\nX: y", tie), (4, "u", tie), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (None, "u", big), (9, "again", big), (10, "u", "z" * 100_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_archive_round_trip(pages):
    got = warc.archived(pages)
    found = Counter((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_sha1"], None if r["payload"] is None else bytes(r["payload"])) for r in got.collect())
    want = Counter()
    for r in pages.collect():
        raw = (r["html"] or "").encode()
        same = [x["page_id"] for x in pages.collect() if (x["html"] or "").encode() == raw and x["page_id"] is not None]
        again = len(raw) >= 1000 and r["page_id"] != max(same)
        urn = lambda i: None if i is None else f"urn:x-page:{i}"
        want[urn(r["page_id"]), "revisit" if again else "response", urn(max(same)) if again else None, len(raw), hashlib.sha1(raw).hexdigest(), b"" if again else raw] += 1
    assert found == want
    assert {r["target_uri"] for r in got.collect()} == {"http://a/1", "http://a/2", None, "http://b\r\nX: y", "u", "again"}


def test_archive_filters_reach_the_reader(spark, pages):
    warc.register(spark)
    to = folder(spark, "warc")
    warc.page_records(pages).write.format("warc").mode("append").save(to)
    read = spark.read.format("warc").option("payload", "false").option("partition_bytes", "1").load(to)
    assert read.count() == pages.count() and read.where("payload IS NOT NULL").count() == 0
    assert read.rdd.getNumPartitions() >= pages.count()
    some = read.where("record_type = 'revisit' AND target_uri IN ('u', 'http://a/1')")
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().replace("PushedFilters", "") or some.count() == 2
    assert some.count() == 2
    reader = warc.WarcReader({"path": to})
    from pyspark.sql.datasource import EqualTo, IsNotNull

    kept = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), IsNotNull(("payload",))]))
    assert kept == [IsNotNull(("payload",))] and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4


def test_archives_grow_by_appends_and_are_replaced_by_overwrites(spark, pages):
    warc.register(spark)
    to = folder(spark, "warc")
    records = warc.page_records(pages)
    for kind in ("response", "revisit"):
        records.where(F.col("record_type") == kind).write.format("warc").mode("append").save(to)
    read = lambda: Counter(r[0] for r in spark.read.format("warc").load(to).select("record_type").collect())
    assert read() == Counter(r[0] for r in records.select("record_type").collect()) and sum(read().values()) == pages.count()
    records.where("record_type = 'revisit'").write.format("warc").mode("overwrite").save(to)
    assert read() == {"revisit": 4}


def _archive(path, rows, by_member, zipped):
    import gzip

    raw = [warc.record({"record_type": "response", "refers_to": None, "payload_bytes": len(p), "payload_sha1": hashlib.sha1(p).hexdigest(), "record_id": i, "target_uri": u, "payload": p}) for i, u, p in rows]
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\nContent-Length: 7\r\n\r\na: b\r\n\n\r\n\r\n"
    raw = [info, *raw]
    with open(path, "wb") as f:
        for at in range(0, len(raw), by_member):
            part = b"".join(raw[at : at + by_member])
            f.write(gzip.compress(part) if zipped else part)


@pytest.mark.parametrize("by_member, zipped", [(1, True), (2, True), (100, True), (1, False)])
def test_archives_of_others_are_streamed_whole(spark, tmp_path, by_member, zipped):
    rows = [(f"urn:{k}", f"http://h/{k} é\t%41", bytes([k]) * (k * 300_000)) for k in range(7)]
    path = str(tmp_path / ("a.warc.gz" if zipped else "a.warc"))
    _archive(path, rows, by_member, zipped)
    warc.register(spark)
    got = {r["record_id"]: (r["target_uri"], None if r["payload"] is None else bytes(r["payload"])) for r in spark.read.format("warc").load(path).collect()}
    assert got == {"urn:i": (None, b"a: b\r\n\n"), **{i: (u, p) for i, u, p in rows}}
    some = spark.read.format("warc").load(path).where("record_type = 'response' AND target_uri = 'http://h/5 é\t%41'")
    assert [(r["record_id"], r["payload_bytes"], bytes(r["payload"])) for r in some.collect()] == [("urn:5", 1_500_000, rows[5][2])]
    bare = spark.read.format("warc").option("payload", "false").load(path)
    assert bare.where("payload IS NULL").count() == 8


def test_a_record_cut_off_is_an_error(spark, tmp_path):
    path = str(tmp_path / "cut.warc")
    _archive(path, [("urn:1", "u", b"x" * 5000)], 1, False)
    whole = open(path, "rb").read()
    open(path, "wb").write(whole[:-3000])
    warc.register(spark)
    with pytest.raises(Exception, match="ends within its block"):
        spark.read.format("warc").load(path).collect()


def test_empty_archive(pages):
    assert warc.archived(pages.where("false")).count() == 0


def test_ids_are_those_of_whole_texts(plain):
    texts = [t for _, t in plain] + ["don't 'tis İ, İx ×a a×b é« «é» <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y 12ab34 ...'s ,'t éa ǅ ŉa ß, ΣΑΣ 中文，字 ½ ² ª", "A'B C,D"]
    ids, at = Encoder(PATH).encode(pa.array(texts, pa.string()))
    whole = Tokenizer.from_file(PATH)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def tokens(plain, end):
    whole = Tokenizer.from_file(PATH)
    return [(i, [*whole.encode(t or "", add_special_tokens=False).ids, end]) for i, t in plain]


def test_wavelet_files_round_trip(documents, plain):
    shards = wavelet.write(documents, PATH, end=2, shard=2000, ranges=3)
    assert shards.count() > 4
    found = [(r["doc_id"], r["start"], r["ids"]) for r in wavelet.read(shards).collect()]
    assert sorted(((i, x) for i, _, x in found), key=str) == sorted(tokens(plain, 2), key=str)
    order = sorted(found, key=lambda r: r[1])
    assert [r[1] for r in order] == np.cumsum([0, *(len(r[2]) for r in order)])[:-1].tolist()
    assert [r[0] for r in order] == sorted((i for i, _ in plain), key=lambda i: -1 if i is None else i)
    assert wavelet.read(wavelet.write(documents.where("false"), PATH, end=2)).count() == 0


def test_wavelet_access_count_and_occurrence(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    r = np.random.default_rng(5)
    ids = np.minimum(r.zipf(1.3, 700), 70_000).astype(np.int64)
    s = wavelet.Shard(io.BytesIO(wavelet.pack([7, 9], np.array([300, 700]), ids)))
    assert s.ids.tolist() == ids.tolist() == [s.access(i) for i in range(700)]
    for t in {1, 2, 5, 70_001, int(ids.max()), 1 << 20}:
        at = np.flatnonzero(ids == t).tolist()
        assert [s.occurrence(t, k) for k in range(s.count(t))] == at
        assert s.count(t, 100, 500) == sum(100 <= i < 500 for i in at)
    assert wavelet.Shard(io.BytesIO(wavelet.pack([], np.zeros(0, np.int64), np.zeros(0, np.int64)))).count(3) == 0


def test_packing_is_whole_and_certified(spark, documents, plain):
    rows = queries.packed(documents).collect()
    of = defaultdict(list)
    for i, x in tokens(plain, 0):
        for k in range(0, len(x), 2048):
            of[i, k // 2048, k, len(x[k : k + 2048]), zlib.crc32(np.array(x[k : k + 2048], "<u4").tobytes())].append(1)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter({k: len(v) for k, v in of.items()})
    check_packed([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)


def check_packed(rows, capacity):
    bins = defaultdict(list)
    for s, offset, length in rows:
        bins[s].append((offset, length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("low,high", [(1, 100), (34, 60), (20, 51), (100, 101)])
def test_packing_against_the_bound(spark, low, high):
    r = np.random.default_rng(low)
    items = written(spark.createDataFrame([(i, int(x)) for i, x in enumerate(r.integers(low, high, 900))], "item long, length long"), "items")
    placed = packing.pack(items, 100, 150)
    n = check_packed([(x["sequence_id"], x["offset"], x["length"]) for x in placed.join(items, "item").collect()], 100)
    made, least = packing.certificate(items, placed, 100)
    assert made == n and least <= n and placed.count() == 900
    alone = len(set(packing.best_fit(np.array([x["length"] for x in items.collect()]), 100)[0]))
    assert n <= 1.03 * alone + 1  # partitions of 150 items lose a little


def test_bounds_hold_for_every_small_packing():
    r = np.random.default_rng(3)
    for _ in range(200):
        x = r.integers(1, 11, r.integers(1, 12))
        assert packing.lower_bound(np.bincount(x, minlength=11), 10) <= packing.best_fit(x, 10)[0].max() + 1
    assert packing.lower_bound(np.bincount([6] * 7, minlength=11), 10) == 7  # volume alone says 5
    assert packing.lower_bound(np.bincount([4] * 5, minlength=11), 10) == 3  # two fit in a bin


def brute_likelihood(symbols, m):
    state, log = m.start, 0.0
    for s in symbols:
        state = (state @ m.move) * m.emit[s]
        log += math.log(state.sum())
        state = state / state.sum()
    return log


def brute_expected(symbols, m):
    k, n = len(m.start), len(symbols)
    a, b = [m.start], [np.ones(k)]
    for s in symbols:
        x = (a[-1] @ m.move) * m.emit[s]
        a.append(x / x.sum())
    for s in reversed(symbols):
        x = m.move @ (m.emit[s] * b[0])
        b.insert(0, x / x.sum())
    out = hmm.Model(np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit))
    g = a[0] * b[0]
    out.start += g / g.sum()
    for t, s in enumerate(symbols):
        g = a[t + 1] * b[t + 1]
        out.emit[s] += g / g.sum()
        x = a[t][:, None] * m.move * (m.emit[s] * b[t + 1])
        out.move += x / x.sum()
    assert n == round(out.emit.sum())
    return out


def test_forward_recursion_and_counts_against_plain_loops():
    r = np.random.default_rng(2)
    m = hmm.Model(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(9), 3).T)
    docs = [r.integers(0, 9, n) for n in (1, 64, 65, 3, 400, 128, 1, 63)]
    c = hmm.chunked(np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    assert np.allclose(hmm.likelihood(c, m), [brute_likelihood(d, m) for d in docs])
    into = hmm.Model(np.zeros(3), np.zeros((3, 3)), np.zeros((9, 3)))
    hmm.expected(c, m, into)
    want = [brute_expected(d, m) for d in docs]
    for name in ("start", "move", "emit"):
        assert np.allclose(getattr(into, name), sum(getattr(w, name) for w in want))


def test_scores_base_and_probabilities(documents, plain, monkeypatch):
    monkeypatch.setattr(hmm, "LISTED", 40)
    monkeypatch.setattr(hmm, "SYMBOLS", 25)
    found = hmm.scored(documents, F.coalesce(hmm.remainder() == 1, F.lit(False)), rounds=2).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    seen = Counter()
    for i, t in plain:
        if not held(i):
            seen.update([*split(fold(t)), None])
    n, v = sum(seen.values()), len(seen)
    want = [(i, held(i), len(w := [*split(fold(t)), None]), sum(seen[x] > 0 for x in w), n, round(sum(math.log10((seen[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, t in plain]
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found), key=str) == sorted(want, key=str)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_words_beyond_the_symbols_have_emissions_of_their_own(spark, monkeypatch):
    """Two topics in words of one shape: states tell them apart only if training gathers counts of each word."""
    r = np.random.default_rng(6)
    topic = lambda k, n: " ".join(f"{'ab'[k]}{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in r.integers(0, 200, n))
    docs = spark.createDataFrame([(i, topic(i % 2, 300)) for i in range(120)], "doc_id long, text string").repartition(3)
    held = F.col("doc_id") >= 100
    full = hmm.scored(docs, held, rounds=12).where("held_out").agg(F.sum("score")).first()[0]
    for name, value in {"SYMBOLS": 1, "LISTED": 50, "HELD": 2000}.items():
        monkeypatch.setattr(hmm, name, value, raising=False)
    base, score, tokens = hmm.scored(docs, held, rounds=12).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert score > base + 0.2 * tokens  # two topics of equal size: log10(2) = 0.3 a word
    assert abs(score - full) < 0.05 * tokens


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, score = hmm.scored(docs, hmm.remainder() == 1).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > 0.97 * base


def test_scores_without_training_text(documents):
    found = hmm.scored(documents, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in found)
    assert hmm.scored(documents.where("false"), F.lit(False)).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = language.identified(docs, hmm.remainder() == 0).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_language_cases(spark, documents):
    docs = documents.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "aa").when(F.col("doc_id") % 3 == 1, "bb"))
    found = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language.identified(docs, F.lit(False)).collect()}
    assert all(0 <= s <= 1 for s in found.values()) and {l for _, l in found} <= {"aa", "bb", "und"}
    assert {i for i, l in found if l == "und"} == {12, 13, 14}
    assert {r["lang_pred"] for r in language.identified(documents, F.lit(False)).collect()} == {"en", "und"}
    assert {r["lang_pred"] for r in language.identified(documents, F.lit(True)).collect()} == {"und"}
    assert language.identified(documents.where("false"), F.lit(False)).count() == 0


def test_sample_of_rows_without_id_or_of_one_id(spark):
    docs = spark.range(2000).selectExpr("CAST(IF(id % 2 = 0, NULL, 7) AS long) AS doc_id", "IF(id % 2 = 0, 'aa', 'bb') AS lang", "concat('text ', id) AS text")
    found = {r["lang"]: r["count"] for r in language._sample(docs, 100).groupBy("lang").count().collect()}
    assert set(found) == {"aa", "bb"} and all(60 < n < 140 for n in found.values())


def test_families_join_languages_that_are_alike():
    e = np.eye(6)
    centre = {"a": e[0] + 0.2 * e[1], "b": e[0] + 0.2 * e[2], "c": e[3] + 0.2 * e[4], "d": e[3] + 0.2 * e[5]}
    assert sorted(language.families(centre)) == [["a", "b"], ["c", "d"]]


@pytest.mark.parametrize("source", ["cases", "table"])
def test_pipeline_against_brute_force(spark, documents, source):
    docs = documents if source == "cases" else queries.table(spark, SMALL, "documents")
    benchmark = [tuple(r) for r in queries.table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    model = None
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        columns, docs_in = docs.columns, docs
        docs = written(stage(spark, docs, SMALL), name)
        if name != "packed_sequences":
            assert docs.columns == columns
            after = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name == "quality_rules":
            model = {(r["doc_id"], r["n_words"], r["word_chars"]): r["kept"] for r in quality.judge(docs_in).collect()}
            want = [(i, t) for i, t in before if model[(i, *brute_measures(t)[:2])]]
        elif name == "near_duplicates":
            least = brute_classes([x for x in before if x[0] is not None])
            keep = {i for i, _, c in least if i == c}
            want = list({i: (i, t) for i, t in before if i in keep}.values()) + [x for x in before if x[0] is None]
        elif name == "repeated_passages":
            sha = sorted(((i, hashlib.sha256(" ".join(split(t)).encode()).hexdigest()) for i, t in after), key=str)
            assert sha == sorted(((r[0], r[3]) for r in brute_substrings(before, 50)), key=str)
            continue
        elif name == "benchmark_passages":
            assert all(not r[2] for r in brute_scan(after, benchmark))
            hit = {r[0] for r in brute_scan(before, benchmark) if r[2]}
            assert sorted((x for x in before if x[0] not in hit), key=str) == sorted((x for x in after if x[0] not in hit), key=str)
            continue
        else:
            rows = docs.collect()
            check_packed([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
            assert sum(r["length"] for r in rows) == sum(len(x) for _, x in tokens(before, 0))
            continue
        assert sorted(after, key=str) == sorted(want, key=str)
