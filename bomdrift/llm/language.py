"""Language identification in two steps: the family, then one-versus-one linear support vector machines within it.

A text is the relative frequencies of its hashed byte n-grams (1 to 3 bytes, ASCII letters in lower case),
square-rooted, so that every text has length 1. Families are learned: languages whose mean vectors are more alike
than languages are on average are merged, the most alike first. For every two families, and for every two
languages of a family, a machine is trained in a task of its own on a bounded sample: SAMPLE labelled documents
of each language, chosen by a hash of the id and the text. All machines predict by votes, then by the sum of their margins.

Prediction reads the text only, whole. Null texts and texts without a letter are `und` with score 0, as is every
text if nothing was learned. Rows with null text or language are not learned from. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift.llm.store import written
from bomdrift.llm.words import FOLD, slices, words

SIZE = 1 << 12
#: Labelled documents of each language that the machines learn from, about.
SAMPLE = 1_000
ROUNDS = 150
#: Rows whose vectors are held at once.
ROWS = 256
NONE = "und"


def vectors(texts: pa.Array) -> np.ndarray:
    """A row of SIZE numbers for every text; all 0 for an empty one."""
    w = words(texts)
    data, n = FOLD[w.data].astype(np.int64), len(texts)
    row = np.repeat(np.arange(n), np.diff(w.at))
    out = np.zeros(n * SIZE)
    code = np.zeros(len(data), np.int64)
    for k in range(3):
        m = len(data) - k
        if m <= 0:
            break
        code = code[:m] * 257 + data[k:] + 1
        same = row[:m] == row[k:]
        slot = ((code * 0x9E3779B1 + k * 0x85EBCA6B) >> 13) & (SIZE - 1)
        out += np.bincount(row[:m][same] * SIZE + slot[same], minlength=n * SIZE)
    out = out.reshape(n, SIZE)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1)).astype(np.float32)


def has_letter(texts: pa.Array) -> np.ndarray:
    w = words(texts)
    found = w.count(((w.data | 32) >= 97) & ((w.data | 32) <= 122)) > 0
    for i in np.flatnonzero(~found & (np.diff(w.at) > 0)).tolist():
        found[i] = any(c.isalpha() for c in texts[i].as_py())
    return found


def _sample(docs: DataFrame, size: int) -> DataFrame:
    """(lang, vector): about `size` documents of each language, as bytes of float32."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    share = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"), "text") / F.lit(2.0**64) + 0.5
    many = labelled.groupBy("lang").count().collect()  # a row per language
    parts = F.create_map(*(F.lit(x) for r in many for x in (r["lang"], size / r["count"]))) if many else F.lit(None).cast("map<string,double>")
    some = labelled.where(share < F.element_at(parts, F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches):
            own = vectors(batch["text"])
            yield pa.record_batch([batch["lang"], pa.array([v.tobytes() for v in own], pa.binary())], ["lang", "vector"])

    return written(some.mapInArrow(run, "lang string, vector binary"), "sample")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def families(centre: dict[str, np.ndarray]) -> list[list[str]]:
    """Groups of languages, by average likeness of their mean vectors."""
    names = sorted(centre)
    unit = np.stack([centre[n] / max(np.linalg.norm(centre[n]), 1e-12) for n in names]) if names else np.zeros((0, 1))
    like = unit @ unit.T
    groups = [[i] for i in range(len(names))]
    usual = like[np.triu_indices(len(names), 1)].mean() if len(names) > 1 else 0.0
    while len(groups) > 2:
        near, a, b = max((like[np.ix_(x, y)].mean(), i, j) for (i, x), (j, y) in combinations(enumerate(groups), 2))
        if near <= usual:
            break
        groups[a] += groups.pop(b)
    return [[names[i] for i in sorted(g)] for g in groups]


def machine(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, cost: float = 1e-4) -> np.ndarray:
    """Weights and offset of a linear machine with squared hinge loss, both classes weighing alike; y: 1 and -1."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), 1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    pace = 1.0
    for _ in range(rounds):  # accelerated gradient; the curvature is at most 2 |x|**2 + cost
        miss = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - (cost * ahead - 2 * (x.T @ (weight * miss * y))) / (4 + cost)
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = (new + (pace - 1) / after * (new - w)).astype(x.dtype)
        w, pace = new.astype(x.dtype), after
    return w


def learn(docs: DataFrame, size: int = SAMPLE) -> dict:
    """The families, and a machine for every two families and every two languages of one."""
    spark = docs.sparkSession
    sample = _sample(docs, size)

    def mean(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [own["lang"].iloc[0]], "centre": [np.frombuffer(b"".join(own["vector"]), np.float32).reshape(-1, SIZE).mean(0).tobytes()]})

    found = sample.groupBy("lang").applyInPandas(mean, "lang string, centre binary").collect()  # a row per language
    groups = families({r["lang"]: np.frombuffer(r["centre"], np.float32) for r in found})
    duels = [(f"f{a}-{b}", groups[a], groups[b]) for a, b in combinations(range(len(groups)), 2)]
    duels += [(f"l{g}:{a}-{b}", [own[a]], [own[b]]) for g, own in enumerate(groups) for a, b in combinations(range(len(own)), 2)]
    if not duels:
        return {"groups": groups, "machines": {}}
    sides = spark.createDataFrame([(k, lang, side) for k, x, y in duels for side, own in ((1, x), (-1, y)) for lang in own], "duel string, of string, side int")

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["side", "vector"], ignore_index=True)
        x = np.frombuffer(b"".join(own["vector"]), np.float32).reshape(-1, SIZE)
        return pd.DataFrame({"duel": [own["duel"].iloc[0]], "machine": [machine(x, own["side"].to_numpy(np.float32)).tobytes()]})

    dealt = sample.join(sides, F.col("lang") == F.col("of")).select("duel", "side", "vector")
    fitted = dealt.groupBy("duel").applyInPandas(fit, "duel string, machine binary").collect()  # a row per two classes
    return {"groups": groups, "machines": {r["duel"]: bytes(r["machine"]) for r in fitted}}


def _best(x: np.ndarray, names: list[str], machines: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The class with most votes, then the largest sum of margins, for each row; and how sure its least sure duel is."""
    n, k = len(x), len(names)
    votes, margins, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
    for a, b, w in machines:
        d = x @ w[:-1] + w[-1]
        for own, margin in ((a, d), (b, -d)):
            votes[:, own] += margin > 0
            margins[:, own] += np.tanh(margin)
            least[:, own] = np.minimum(least[:, own], margin)
    best = np.argmax(votes * 1e3 + margins, 1) if k else np.zeros(n, np.int64)
    sure = 1 / (1 + np.exp(-3 * least[np.arange(n), best])) if k else np.zeros(n)
    return best, sure


def identified(docs: DataFrame, held: Column, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; learned where not held."""
    rows = docs.select("doc_id", held.alias("held_out"), "lang", "text")
    model = docs.sparkSession.sparkContext.broadcast(learn(rows.where("NOT held_out"), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = model.value["groups"]
        own = {k: np.frombuffer(v, np.float32) for k, v in model.value["machines"].items()}
        between = [(a, b, own[f"f{a}-{b}"]) for a, b in combinations(range(len(groups)), 2)]
        within = [[(a, b, own[f"l{g}:{a}-{b}"]) for a, b in combinations(range(len(x)), 2)] for g, x in enumerate(groups)]
        for batch in _rows(batches):
            x, able = vectors(batch["text"]), has_letter(batch["text"]) & bool(groups)
            family, sure = _best(x, [str(g) for g in range(len(groups))], between)
            lang, score = np.full(len(x), NONE, object), np.where(able, sure, 0.0)
            for g, names in enumerate(groups):
                at = np.flatnonzero(able & (family == g))
                if len(at):
                    best, most = _best(x[at], names, within[g])
                    lang[at] = np.array(names, object)[best]
                    score[at] = np.minimum(score[at], most)
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), batch["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
