"""Token ids of whole texts by a public tokenizer file; a piece that occurs often is encoded once.

The tokenizer splits texts at blanks, between letters and other characters, and around every digit. Words
of ASCII and Latin letters, digits and marks are split at exactly these places, and each distinct piece is
encoded by the library. Other words (apostrophes, other scripts, combining marks, control characters,
special tokens) go to the library whole. Both ways give the ids of the whole text.

Null and empty texts have no ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomdrift.llm.words import _BASE, _BYTE, FOLD, _rolling, process_cache, slices, words

#: Distinct pieces that a Python worker remembers; then it starts anew.
REMEMBERED = 600_000

#: Bytes of text encoded at once.
SLICE = 1 << 20

_LETTERS, _DIGIT, _OTHER, _UNSAFE = 1, 2, 3, 4
_CLASS = np.full(256, _UNSAFE, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _LETTERS
_CLASS[48:58] = _DIGIT
_CLASS[[x for x in range(33, 127) if _CLASS[x] == _UNSAFE and x != 39]] = _OTHER
#: Two bytes that make a word unsafe: multiplication and division signs, capital I with dot, start of a special token.
_PAIRS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (ord("<"), ord("|")))


class Encoder:
    """Ids of many texts at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # a piece is never split further, so only the blanks between pieces count
        alone = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ways = {"whole": self.tokenizer.pre_tokenizer, "piece": alone}
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    @property
    def wide(self) -> bool:
        """Whether an id may need more than 16 bits."""
        return len(self.last) > 1 << 16

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The one of this Python process."""
        cache = process_cache("encoders")
        if path not in cache:
            cache[path] = cls(path)
        return cache[path]

    @staticmethod
    def release() -> None:
        """Free what a reused Python process remembers, before work that needs no tokenizer."""
        process_cache("encoders").clear()

    def _encoded(self, way: str, texts: list[str]) -> list[list[int]]:
        self.tokenizer.pre_tokenizer = self.ways[way]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # pieces by hash, sorted
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, keys: np.ndarray, pieces: list[bytes], safe: np.ndarray) -> None:
        """Encode pieces that are new."""
        texts = [p.decode() for p in pieces]
        order = np.concatenate((np.flatnonzero(safe), np.flatnonzero(~safe)))
        n = int(safe.sum())
        first = [texts[k] for k in order[:n].tolist()]
        ids = np.array([i for x in self._encoded("piece", [" ".join(first[i : i + 1000]) for i in range(0, n, 1000)]) for i in x], np.int32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != n:
            raise ValueError("the tokenizer does not end its pieces as expected")
        others = self._encoded("whole", [texts[k] for k in order[n:].tolist()])
        had, made = int(self.begin[-1]), len(self.begin) - 1
        known = np.concatenate((self.known, keys[order]))
        place = np.concatenate((self.place, np.arange(made, made + len(order))))
        sort = np.argsort(known, kind="stable")
        self.known, self.place = known[sort], place[sort]
        self.begin = np.concatenate([self.begin, had + ends, had + len(ids) + np.cumsum([len(x) for x in others], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids, np.array([i for x in others for i in x], np.int32)])

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return self.known[at] == keys, self.place[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offset of each text's ids."""
        w = words(texts)
        kind = _CLASS[w.data]
        unsafe = kind == _UNSAFE
        for a, b in _PAIRS:
            unsafe[:-1] |= (w.data[:-1] == a) & (w.data[1:] == b)
        sums = np.concatenate(([0], np.cumsum(unsafe)))
        bad = sums[w.end] > sums[w.start]
        inside = np.zeros(len(w.data) + 1, np.int8)
        inside[w.start] += 1
        inside[w.end] -= 1
        inside = np.cumsum(inside, dtype=np.int8).astype(bool)[:-1]
        cut = inside & (kind == _DIGIT)
        cut[1:] |= inside[1:] & (kind[1:] != kind[:-1])
        folded = FOLD[w.data]
        for a, b in zip(w.start[bad].tolist(), w.end[bad].tolist()):
            cut[a:b] = False
            folded[a:b] = w.data[a:b]  # special tokens are written in lower case only
        cut[w.start] = True
        start = np.flatnonzero(cut)
        stop = np.zeros(len(w.data) + 1, bool)
        stop[start], stop[w.end] = True, True
        stop = np.flatnonzero(stop)
        end = stop[np.searchsorted(stop, start, "right")]
        key = _rolling(_BYTE[folded], start, end, _BASE)
        distinct, one, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget()
        have, place = self._find(distinct)
        new = np.flatnonzero(~have)
        if len(new):
            raw, at = folded.tobytes(), one[new]
            of = np.searchsorted(w.start, start[at], "right") - 1
            self.learn(distinct[new], [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())], ~bad[of])
            place = self._find(distinct)[1]
        place = place[back]
        begin = self.begin
        length = begin[place + 1] - begin[place]
        after = np.concatenate(([0], np.cumsum(length)))
        ids = self.ids[np.arange(after[-1]) + np.repeat(begin[place] - after[:-1], length)]
        return ids, after[np.searchsorted(start, w.at)]


def encoded(docs: DataFrame, path: str, end: int, *keep: str | Column) -> DataFrame:
    """The columns `keep` and `ids`, array<int>, of every row's whole text with the id `end` after it."""
    kept = docs.select(*keep, "text")
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in slices(batches, limit=SLICE):
            ids, at = encoder.encode(batch["text"])
            # one more id after each text
            to = at + np.arange(len(at))
            out = np.full(len(ids) + len(at) - 1, end, np.int32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = ids
            lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(out))
            yield pa.record_batch([*(batch[n] for n in names), lists], [*names, "ids"])

    return kept.mapInArrow(run, kept.drop("text").withColumn("ids", F.array().cast("array<int>")).schema)
