"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Every rule says good (1), bad (-1) or nothing (0) about a text. The rules' distinct vote patterns and how
often each occurs are counted over all documents (at most 3**len(RULES) patterns, whatever the input), and
expectation-maximisation on these counts gives the share of good documents and the probability of every
vote of every rule among good and among bad documents, hence its accuracy. A document is kept if its
posterior probability of being good is at least `keep` and it passes the base rules.

Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. With an empty
table the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomdrift.llm.store import bundled, unbundled, written
from bomdrift.llm.words import slices, words

MIN_WORDS = 50
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(192, 256)])  # a code point above ASCII counts as one
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_distinct", "n_short")

#: name: (vote, when it is cast); else the rule abstains. Fixed by what web text shows, not fitted.
RULES = {
    "symbols": (-1, "n_symbols > 0.15 * n_words"),
    "capitals": (-1, "n_upper > 0.40 * n_letters"),
    "exclamations": (-1, "n_bangs > 0.20 * n_words"),
    "repeated_lines": (-1, "n_dup_lines > 0.30 * n_lines"),
    "repeated_words": (-1, "n_repeat_words > 0.30 * n_words"),
    "few_distinct": (-1, "n_distinct < 0.30 * least(n_words, 100)"),
    "no_short_words": (-1, "n_short < 0.05 * n_words"),
    "plain": (1, "n_symbols < 0.02 * n_words AND n_bangs < 0.03 * n_words AND n_upper < 0.15 * n_letters"),
    "varied": (1, "n_repeat_words < 0.10 * n_words AND n_dup_lines < 0.10 * n_lines + 1"),
    "worded": (1, "n_short BETWEEN 0.20 * n_words AND 0.80 * n_words"),
}
#: What expectation-maximisation starts from: chances that a bad or a good document gets the vote a rule casts.
START = {-1: (0.30, 0.05), 1: (0.30, 0.70)}


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and MEASURES of every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(batch["text"])
            rows, row = batch.num_rows, w.row()
            points = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))  # bytes that begin a code point
            length = points[w.end] - points[w.start]
            first, value = w.windows(3)
            _, back, times = np.unique(w.keyed(row[first], value), return_inverse=True, return_counts=True)
            twice = first[times[back] > 1]
            repeated = np.zeros(len(row), bool)
            for i in range(3):
                repeated[twice + i] = True
            _, one = np.unique(w.keyed(row, w.hash), return_index=True)
            lines = [[x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")] for t in batch["text"].to_pylist()]
            out = {
                "n_words": np.diff(w.offset),
                "word_chars": np.bincount(row, length, rows),
                "n_symbols": w.count(_SYMBOL[w.data]),
                "n_dup_lines": [len(x) - len(set(x)) for x in lines],
                "n_repeat_words": np.bincount(row[repeated], minlength=rows),
                "n_lines": [len(x) for x in lines],
                "n_upper": w.count((w.data >= 65) & (w.data <= 90)),
                "n_letters": w.count(_LETTER[w.data]),
                "n_bangs": w.count(w.data == 33),
                "n_distinct": np.bincount(row[one], minlength=rows),
                "n_short": np.bincount(row[length <= 4], minlength=rows),
            }
            yield pa.record_batch([*(batch[c] for c in keep), *(pa.array(np.asarray(out[k]).astype(np.int64)) for k in MEASURES)], [*keep, *MEASURES])

    needed = docs.select(*dict.fromkeys((*keep, "text")))
    return needed.mapInArrow(count, docs.select(*keep).withColumns({k: F.lit(0).cast("long") for k in MEASURES}).schema)


def votes(measured: DataFrame) -> DataFrame:
    """The measured rows with one vote column rule_<name> for each rule; a text without words gets no vote."""
    said = {f"rule_{k}": F.expr(f"CAST(IF(n_words > 0 AND ({when}), {vote}, 0) AS int)") for k, (vote, when) in RULES.items()}
    return measured.withColumns(said)


@dataclass
class LabelModel:
    """share: of good documents; chance[rule, class, vote + 1]: of a vote among good (1) or bad (0) documents."""

    share: float
    chance: np.ndarray

    def odds(self, patterns: np.ndarray) -> np.ndarray:
        """Log odds of good for rows of votes."""
        logs = np.log(self.chance[:, 1] / self.chance[:, 0])
        return np.log(self.share / (1 - self.share)) + logs[np.arange(patterns.shape[1]), patterns + 1].sum(1)

    def accuracy(self) -> np.ndarray:
        """Of each rule, the probability that a vote it casts is right."""
        prior = np.array([1 - self.share, self.share])
        right = prior[0] * self.chance[:, 0, 0] + prior[1] * self.chance[:, 1, 2]
        cast = (prior[:, None] * (self.chance[:, :, 0] + self.chance[:, :, 2]).T).sum(0)
        return right / cast


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, share: float = 0.8, weight: float = 10.0) -> LabelModel:
    """Expectation-maximisation over vote patterns (columns in the order of RULES) and their counts.

    `weight` pseudo-documents at the starting values keep every probability off 0 and 1 and the classes apart.
    """
    start = np.zeros((len(RULES), 2, 3))
    for rule, (vote, _) in enumerate(RULES.values()):
        start[rule, :, vote + 1] = START[vote]
        start[rule, :, -vote + 1] = 0.01
        start[rule, :, 1] = 0.99 - start[rule, :, vote + 1]
    model = LabelModel(share, start)
    cast = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        good = 1 / (1 + np.exp(-model.odds(patterns)))
        mass = np.stack([counts * (1 - good), counts * good])
        votes_of = np.einsum("cp,prv->rcv", mass, cast) + weight * start
        total = mass.sum(1)
        model = LabelModel(float((total[1] + weight * share) / (total.sum() + weight)), votes_of / votes_of.sum(2, keepdims=True))
    return model


def learned(voted: DataFrame) -> LabelModel:
    """The model of all rows' votes."""
    names = [f"rule_{k}" for k in RULES]
    seen = voted.where("n_words > 0").groupBy(*names).count().collect()  # a row per vote pattern
    table = np.array([tuple(r) for r in seen], np.int64).reshape(-1, len(names) + 1)
    return fit(table[:, :-1], table[:, -1].astype(float))


def judged(voted: DataFrame, model: LabelModel, keep: float = 0.5) -> DataFrame:
    """voted with base_failed, posterior and kept."""
    score = F.lit(float(np.log(model.share / (1 - model.share))))
    for name, own in zip(RULES, np.log(model.chance[:, 1] / model.chance[:, 0]).tolist()):
        score = score + F.element_at(F.array(*map(F.lit, own)), F.col(f"rule_{name}") + 2)
    base = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")
    return voted.withColumn("base_failed", base).withColumn("posterior", 1 / (1 + F.exp(-score))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))


def judge(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """doc_id, MEASURES, the votes, base_failed, posterior and kept for every row of docs."""
    voted = written(votes(measures(docs, "doc_id")), "quality")
    return judged(voted, learned(voted), keep)


def filtered(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """The rows of docs that are kept. Texts are measured again rather than shuffled to meet their verdicts."""
    model = learned(written(votes(measures(docs, "doc_id")), "quality"))
    rows = judged(votes(measures(bundled(docs), "doc_id", "text", "doc_row")), model, keep)
    return unbundled(rows.where("kept"), docs.columns)
