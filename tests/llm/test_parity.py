"""Parities of shingle sets: no similar pair is lost, unlike pairs are not verified, and what served them is removed."""

from __future__ import annotations

import random

import numpy as np
import pytest

from bomdrift.llm import jaccard, store, substrings


def brute(sets: dict[int, set[str]]) -> dict[int, int]:
    """The least id reachable from every id by links of similar sets."""
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= jaccard.PERCENT * len(sets[a] | sets[b])]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def family(seed: int, size: int, n: int) -> dict[int, str]:
    """Texts that share most words with a common one; some pairs are just similar, some just not."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(n)]
    out = {}
    for i in range(size):
        words = list(base)
        for at in r.sample(range(n), r.randrange(0, max(2, n // 25))):
            words[at] = f"v{r.randrange(10**6)}"
        out[i] = " ".join(words)
    return out


def test_sets_differ_by_no_fewer_shingles_than_bits():
    r = np.random.default_rng(1)
    for n in (1, 20, 300, 3000):
        one = r.integers(0, 2**63, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for changed in (0, 1, n // 5, n):
            two = np.concatenate((one[changed:], r.integers(0, 2**63, changed, np.int64).astype(np.uint64)))
            bits = jaccard._parities(np.concatenate((one, two)), np.array([0, n, 2 * n]))
            apart = len(set(one.tolist()) ^ set(two.tolist()))
            assert sum((x ^ y).bit_count() for x, y in zip(*bits.view(np.uint64).tolist())) <= apart


@pytest.mark.parametrize("light", [0, 40, 10**6])
def test_families_of_near_copies_keep_their_links(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard, "boundary", lambda sizes: light)
    texts = {100 * k + i: t for k, n in enumerate((12, 60, 300)) for i, t in family(k, 25, n).items()}
    sets = {i: {" ".join(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    got = jaccard.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute(sets)


def test_unlike_pairs_that_share_keys_are_not_verified(spark, monkeypatch):
    """Half of every text is common: single shingles are shared, the sets are far from similar."""
    r = random.Random(4)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, common + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(60))) for i in range(40)]
    seen, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "boundary", lambda sizes: 10**6)
    monkeypatch.setattr(jaccard, "_levels", lambda seen: np.zeros(jaccard.CELLS, np.uint8))  # all shingles alike: by hash
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r["doc_id"] == r["component_id"] for r in got.collect()) and sum(seen) == 0


def test_tables_that_served_the_join_are_removed(spark, monkeypatch):
    made, own = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda frame, name: made.append((name, own(frame, name))) or made[-1][1])
    out = jaccard.classes(spark.createDataFrame(list(family(9, 20, 80).items()), "doc_id long, text string"))
    held = {name for name, frame in made if frame in store._PATHS}
    assert not held & {"texts", "sets", "lists", "pairs", "nodes", "listed"} and out.count() == 20


def test_tables_that_served_the_repeats_are_removed(spark, monkeypatch):
    made, own = [], substrings.written
    monkeypatch.setattr(substrings, "written", lambda frame, name: made.append((name, own(frame, name))) or made[-1][1])
    passage = " ".join(f"p{i}" for i in range(70))
    out = substrings.cleaned(spark.createDataFrame([(1, "a b " + passage), (2, passage + " c"), (3, "d"), (4, "d")], "doc_id long, text string"))
    assert not {name for name, frame in made if frame in store._PATHS} & {"scanned", "firsts", "spans", "texts"}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a b " + passage, 2: "c", 3: "d", 4: "d"}
