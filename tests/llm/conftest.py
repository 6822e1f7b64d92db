from __future__ import annotations

import random

import pytest

SMALL = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "té") for b in ("n", "st", "r", "ß", "", "m")]


def prose(seed: int, n: int) -> str:
    """n invented words in sentences."""
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ",", "\n"]) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Cases: copies, near copies, shared passages, ties, repeated rows, nulls, empty and long texts, odd columns."""
    base, other = prose(1, 120), prose(2, 150)
    near = base.split()
    near[60] = "changed"
    passage = " ".join(prose(3, 70).split())
    rows = [
        (5, base), (7, base), (6, " ".join(near)), (2, other), (9, prose(4, 40) + " " + passage), (3, passage + " " + prose(5, 60)),
        (11, prose(6, 90) + "\n" + passage + "\n" + prose(7, 30)), (12, None), (13, ""), (14, " \t\n"), (15, "one"), (16, "one"), (17, "ONE two three four"),
        (18, "same " * 400), (19, "same " * 300), (20, prose(8, 4000)), (20, prose(8, 4000)), (None, base), (None, prose(9, 80)), (21, passage),
        (22, "don't stop 12 × 3 <|endoftext|> 中文 é́ " + passage), (23, "a\x1cb a\x85c a\xa0d"), (24, "word\n" * 60),
    ]
    full = [(i, t, "en", "s", len(t or ""), "kept", 1.5, [1]) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words double, items array<int>").repartition(3)


@pytest.fixture(scope="session")
def plain(documents):
    """(doc_id, text) of the documents."""
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
