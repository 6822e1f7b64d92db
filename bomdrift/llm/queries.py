"""One query per operator, each over the whole of its table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomdrift.llm import decontaminate, divergence, hmm, jaccard, language, licenses, packing, quality, spelling, substrings, warc, wavelet, winnowing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, "^urn:x-page:(-?[0-9]+)$", 1).cast("long")
    read = F.col("record_type") == "response"  # of these the payload itself is measured
    return records.select(
        page("record_id").alias("page_id"),
        F.when(read, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(read, F.sha1("payload")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write(table(spark, sf_dir, "documents"), TOKENIZER, end=2)
    read = wavelet.read(shards).withColumn("n_tokens", F.size("ids").cast("long"))
    return packing.checksums(read, "doc_id", "start", "n_tokens")


def packed(docs: DataFrame) -> DataFrame:
    """The place and the digest of every piece, the pieces' ids read from the written table."""
    pieces, places = packing.sequences(docs, TOKENIZER)
    digests = packing.checksums(pieces, "item", "doc_id", "piece", "start", "length")
    return digests.join(places, "item").drop("item")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognised(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents"), F.coalesce(hmm.remainder() == 1, F.lit(False)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"), F.coalesce(hmm.remainder() == 0, F.lit(False)))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprinted(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_substring_dedup, op3_quality_rules, op4_token_output, op5_best_fit_packing, op6_decontamination, op7_license_scan, op8_ngram_jaccard_join, op9_hidden_markov, op10_language_id, op11_source_divergence, op12_spelling_variants, op13_document_fingerprints)}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP6 = f"""
WITH a AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS gram
      FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS r(i) WHERE len(ws) > 0),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM a),
l AS (SELECT doc_id, i, {", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in range(10))} FROM w),
s AS ({" UNION ALL ".join(f"SELECT doc_id, i, {n} AS n, concat_ws(' ', {', '.join(f'w{k}' for k in range(n))}) AS gram FROM l WHERE w{n - 1} IS NOT NULL AND {n} IN (SELECT n FROM g)" for n in range(1, 11))}),
h AS (SELECT doc_id, i, n, item FROM s JOIN g USING (n, gram)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) AS r(j) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT a.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM a LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP8 = f"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM a),
l AS (SELECT doc_id, i, {", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in range(5))}, count(*) OVER (PARTITION BY doc_id) AS n FROM w),
s AS (SELECT DISTINCT doc_id, hash(concat_ws(' ', w0, w1, w2, w3, w4)) AS s FROM l WHERE w4 IS NOT NULL OR (n < 5 AND i = 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z u ON u.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * k >= 80 * (u.n + v.n - k)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM a UNION SELECT d.b, r.c FROM r JOIN d ON d.a = r.doc_id WHERE r.c < d.b)
SELECT a.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM a LEFT JOIN z USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL
"""

_OP2 = f"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM a),
g AS (SELECT doc_id, i, w, CASE WHEN count(*) OVER v = 50 THEN md5_number(string_agg(w, ' ') OVER v) END AS g FROM w
      WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT g, min(doc_id) AS least FROM g WHERE g IS NOT NULL GROUP BY g),
h AS (SELECT g.doc_id, i, w, coalesce(least < g.doc_id, false) AS hit FROM g LEFT JOIN m USING (g)),
c AS (SELECT doc_id, i, w, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS k, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT a.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM a LEFT JOIN r USING (doc_id)
"""

_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
g AS (SELECT h, max(page_id) AS head FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM d LEFT JOIN g USING (h)
"""

def _op7() -> str:
    """Sentences by a join with the known ones, rules by lists of positions."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.SENTENCES.items())
    norm = lambda x: f"trim(regexp_replace({x}, '{licenses.BETWEEN}', ' ', 'g'))"
    steps, left = [], "left0"
    for k, (name, own) in enumerate(licenses.RULES):
        rule = "((?: [^ ]+ )*?)".join(f" {i} " for i in own)  # each stands between two blanks, what is between them is a group
        rest = "".join(f"\\{i}" for i in range(1, len(own)))
        steps.append(f"r{k} AS (SELECT * REPLACE (regexp_replace(rest, '{rule}', '{rest}', 'g') AS rest, CASE WHEN regexp_matches(rest, '{rule}') THEN list_append(found, '{name}') ELSE found END AS found) FROM {left})")
        left = f"r{k}"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
plain AS (SELECT doc_id, translate(coalesce(text, ''), {quoted(licenses.UPPER + licenses.MARKS)}, {quoted(licenses.LOWER + " " * len(licenses.MARKS))}) AS t FROM documents),
s AS (SELECT doc_id, i, unnest([s]) AS s FROM (SELECT doc_id, unnest(string_split_regex(t, '{licenses.ENDS}')) AS s, generate_subscripts(string_split_regex(t, '{licenses.ENDS}'), 1) AS i FROM plain)),
n AS (SELECT doc_id, i, s, k.id FROM s LEFT JOIN known k ON k.sentence = {norm("s")}),
l AS (SELECT doc_id, i, unnest(string_split(s, chr(10))) AS s, generate_subscripts(string_split(s, chr(10)), 1) AS j FROM n WHERE id IS NULL),
f AS (SELECT doc_id, i, 0 AS j, id FROM n WHERE id IS NOT NULL UNION ALL SELECT doc_id, i, j, k.id FROM l JOIN known k ON k.sentence = {norm("l.s")}),
left0 AS (SELECT doc_id, count(*) AS n_known, string_agg(id, ' ' ORDER BY i, j) AS sentence_ids, ' ' || string_agg(id, '  ' ORDER BY i, j) || ' ' AS rest, []::VARCHAR[] AS found FROM f GROUP BY doc_id),
{", ".join(steps)}
SELECT d.doc_id, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(sentence_ids, '') AS sentence_ids,
       coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licenses
FROM documents d LEFT JOIN {left} USING (doc_id)
"""


_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 30),
lv AS (SELECT lang, count(*) AS v, sum(n) AS total FROM v GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(gt.total, 0) + 5 * lv.v) AS p,
             1 + (1000000000::HUGEINT * (v.n + 5)) // (lv.total + 5 * lv.v) AS q
      FROM g JOIN v USING (lang) JOIN lv USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
      LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""


# The crc32 is stepped by the table over the bytes of `<doc_id>:<run>`; near words share a word with one code point less.
_OP12 = f"""
WITH RECURSIVE d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+') AS ws FROM documents),
r AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(ws) AS w FROM d) GROUP BY ALL),
crc AS (SELECT list_value({", ".join(map(str, spelling.CRC_TABLE.tolist()))})::BIGINT[] AS t),
b AS (SELECT r.*, flatten(list_transform(string_split(id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bytes FROM r),
s(id, w, n, bytes, pos, state) AS (
  SELECT id, w, n, bytes, 0, 4294967295 FROM b
  UNION ALL SELECT id, w, n, bytes, pos + 1, xor(t[(xor(state, bytes[pos + 1]) & 255) + 1], state >> 8) FROM s, crc WHERE pos < len(bytes)),
h AS (SELECT w, n, xor(state, 4294967295) AS h FROM s WHERE pos = len(bytes)),
e AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM x),
m AS (SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = k.less UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = k.less),
c AS (SELECT word, count(*) AS n_near, max(n) AS best FROM m GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 5 * v.n THEN best END AS form_n,
             CASE WHEN best >= 5 * v.n THEN (SELECT min(other) FROM m WHERE m.word = v.word AND m.n = best) END AS form FROM v LEFT JOIN c USING (word)),
p(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT p.word, f.word, f.form FROM p JOIN f ON f.word = p.form)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM f JOIN p ON p.word = f.word AND p.form IS NULL
"""


def _op13() -> str:
    """Hashes of grams as an unrolled polynomial, the least of each window by position, sets by lists."""
    m, b, k, w = winnowing.MODULUS, winnowing.BASE, winnowing.GRAM, winnowing.WINDOW
    hash_ = "hs[i]"
    for j in range(1, k):
        hash_ = f"(({hash_}) * {b} + hs[i + {j}]) % {m}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER o AS after, first_value(coalesce(text, '')) OVER o AS head
           FROM documents WINDOW o AS (ORDER BY doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT row_number() OVER () AS k, doc_id, text, coalesce(after, head) AS next_text, length(text) AS n,
             left(text, length(text) - length(text) // 4) || left(coalesce(after, head), length(text) // 4) AS edited FROM d),
t AS (SELECT k, 0 AS side, text FROM e UNION ALL SELECT k, 1, edited FROM e UNION ALL SELECT k, 2, next_text FROM e),
h AS (SELECT k, side, list_transform(regexp_extract_all(text, '{winnowing.TOKEN}'), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {m}) AS hs FROM t),
g AS (SELECT k, side, CASE WHEN len(hs) = 0 THEN [] WHEN len(hs) < {k} THEN [list_reduce(hs, lambda a, x: (a * {b} + x) % {m})]
      ELSE list_transform(range(1, len(hs) - {k - 2}), lambda i: {hash_}) END AS gs FROM h),
p AS (SELECT k, side, list_transform(gs, lambda x, i: x * 2147483648 + 2147483648 - i) AS ps FROM g),
f AS (SELECT k, side, list_sort(list_distinct(CASE WHEN len(ps) = 0 THEN [] WHEN len(ps) < {w} THEN [list_min(ps)]
      ELSE list_transform(range(1, len(ps) - {w - 2}), lambda i: list_min(ps[i:i + {w - 1}])) END)) AS ks FROM p),
q AS (SELECT k, side, list_distinct(list_transform(ks, lambda x: x >> 31)) AS s,
             array_to_string(list_transform(list_sort(list_transform(ks, lambda x: [2147483647 - (x & 2147483647), x >> 31])), lambda x: x[1] || ':' || printf('%08x', x[2])), ' ') AS f FROM f),
j AS (SELECT a.k, b.side, CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END AS near
      FROM q a JOIN q b USING (k) WHERE a.side = 0)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint, x.near AS near_edited, y.near AS near_next
FROM e JOIN q a ON a.k = e.k AND a.side = 0 JOIN q b ON b.k = e.k AND b.side = 1 JOIN j x ON x.k = e.k AND x.side = 1 JOIN j y ON y.k = e.k AND y.side = 2
"""


ORACLE = {"op13_document_fingerprints": _op13(), "op12_spelling_variants": _OP12, "op11_source_divergence": _OP11, "op1_warc": _OP1, "op2_substring_dedup": _OP2, "op6_decontamination": _OP6, "op7_license_scan": _op7(), "op8_ngram_jaccard_join": _OP8}
