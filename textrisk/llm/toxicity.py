"""Toxicity: character n-gram embeddings, averaged, into a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself, a text
the mean of its words; a softmax layer on top tells toxic from clean.  Vectors
and layer are trained together in numpy.  A misspelt word that was never seen
shares most n-grams with the word it stands for.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrisk.llm.labelled import Sample, adam, sample

BUCKETS = 1 << 17
DIM = 8
SIZES = (3, 4, 5)
PER_CLASS = 3000
MAX_CHARS = 20_000
EPOCHS = 6
#: Buckets that fewer training texts share are not learned from.
MIN_TEXTS = 8
#: Pull of the vectors towards zero, against learning single texts by heart.
DECAY = 1e-7
THRESHOLD = 0.5
#: Words whose score a task remembers, and characters of the longest.
REMEMBERED = 100_000
LONGEST = 64
#: Characters of a long word whose n-grams are held at a time.
BLOCK = 1 << 14
#: Characters of texts whose new words are scored together, and of words hashed together.
TOGETHER, HASHED = 1 << 18, 1 << 16

_WORD = re.compile(r"\w+")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_CRC = _crc_table()


def _blocks(word: str) -> Iterator[list[int]]:
    """Hash buckets of the n-grams that begin in each block of the word, and at last of the word itself."""
    # Bytes are cut faster than characters, and in plain words they are the same.
    plain = word.isascii()
    marked = f"<{word}>".encode() if plain else f"<{word}>"
    for start in range(0, len(marked), BLOCK):
        part = marked[start : start + BLOCK + max(SIZES) - 1]
        grams = [part[i : i + n] for n in SIZES for i in range(min(BLOCK, len(part) - n + 1))]
        if start + BLOCK >= len(marked):
            grams.append(word.encode() if plain else word)
        yield [crc32(g) % BUCKETS for g in grams] if plain else [crc32(g.encode()) % BUCKETS for g in grams]


def buckets(word: str) -> list[int]:
    """Hash buckets of the word and of all its n-grams."""
    return [b for part in _blocks(word) for b in part]


@dataclass(frozen=True)
class Model:
    """The trained layers, folded into one number for each bucket: logit = bias + mean of the words.

    ``empty`` is the logit of a text without words: the share of toxic texts.
    """

    weights: np.ndarray
    bias: float
    empty: float

    def word(self, word: str) -> float:
        if len(word) + 2 <= BLOCK:
            found = buckets(word)
            return float(np.add.reduce(self.weights.take(found))) / len(found)
        total, n = 0.0, 0
        for part in _blocks(word):
            total, n = total + float(self.weights[part].sum()), n + len(part)
        return total / n

    def words(self, words: list[str]) -> np.ndarray:
        """``word`` of many words: the checksums of all their n-grams go on together, character by character."""
        if not words:
            return np.zeros(0)
        marked = "".join([f"<{w}>" for w in words])
        raw = np.frombuffer(marked.encode(), np.uint8)
        begins = np.flatnonzero((raw & 0xC0) != 0x80)
        n_bytes = np.diff(np.append(begins, len(raw)))
        n_chars = np.fromiter(map(len, words), np.int64, len(words)) + 2
        owner = np.repeat(np.arange(len(words)), n_chars)
        left = np.repeat(np.cumsum(n_chars), n_chars) - np.arange(len(owner))
        total = self.weights.take([crc32(w.encode()) % BUCKETS for w in words])
        state = np.full(len(owner), 0xFFFFFFFF, np.uint32)
        at = np.arange(len(owner))  # where the n-grams begin that are not yet at the end of their word
        for n in range(1, max(SIZES) + 1):
            kept = left[at] >= n
            at, state = at[kept], state[kept]
            place, size = begins[at + n - 1], n_bytes[at + n - 1]
            state = _CRC[(state ^ raw[place]) & 0xFF] ^ (state >> np.uint32(8))
            for k in range(1, 4):
                more = np.flatnonzero(size > k)
                if not len(more):
                    break
                state[more] = _CRC[(state[more] ^ raw[place[more] + k]) & 0xFF] ^ (state[more] >> np.uint32(8))
            if n in SIZES:
                total += np.bincount(owner[at], self.weights.take(~state % BUCKETS), len(words))
        return total / (1 + sum(np.maximum(n_chars - n + 1, 0) for n in SIZES))


@dataclass
class _Matrix:
    """Buckets and their shares of all texts one after another, a text between two of ``cuts``.

    Two large arrays go back to the system when they are freed; arrays of each
    text would leave the driver as large as while it trained.
    """

    index: np.ndarray
    share: np.ndarray
    cuts: np.ndarray
    n_texts: np.ndarray

    def learnable(self, common: np.ndarray) -> None:
        """Keep the ``common`` buckets, by their place among them."""
        place, end = (np.cumsum(common) - 1).astype(np.int32), 0
        cuts = [0]
        for start, stop in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            index, share = self.index[start:stop], self.share[start:stop]
            kept = common[index]
            index, share = place[index[kept]], share[kept]
            self.index[end : end + len(index)], self.share[end : end + len(index)] = index, share
            end += len(index)
            cuts.append(end)
        self.cuts = np.array(cuts)


def _matrix(texts: list[str]) -> _Matrix:
    """The buckets of each text with their shares, and for each bucket the number of texts that have it."""
    known: dict[str, bytes] = {}
    index, share, cuts, n_texts = array("i"), array("f"), [0], np.zeros(BUCKETS, np.int64)
    for text in texts:
        counts = Counter(_WORD.findall((text or "").lower()))
        lists = []
        for word in counts:
            found = known.get(word)
            if found is None:
                found = np.array(buckets(word), np.int32).tobytes()
                if len(word) <= LONGEST and len(known) < REMEMBERED:
                    known[word] = found
            lists.append(found)
        if lists:
            sizes = np.array([len(x) // 4 for x in lists])
            shares = np.repeat(np.array(list(counts.values())) / sizes / sum(counts.values()), sizes)
            own, where = np.unique(np.frombuffer(b"".join(lists), np.int32), return_inverse=True)
            index.frombytes(own.tobytes())
            share.frombytes(np.bincount(where, shares).astype(np.float32).tobytes())
            n_texts[own] += 1
        cuts.append(len(index))
    return _Matrix(np.frombuffer(index, np.int32), np.frombuffer(share, np.float32), np.array(cuts), n_texts)


def train(
    found: Sample, epochs: int = EPOCHS, rate: float = 0.1, batch: int = 64, decay: float = DECAY, dropout: float = 0.5, seed: int = 7
) -> Model | None:
    """Fit on the sample; None without labelled texts."""
    if not found.texts:
        return None
    rng = np.random.default_rng(seed)
    layer, bias = rng.normal(0, 1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    rows, classes, n_rows = _matrix(found.texts), found.labels.astype(int), len(found.texts)
    common = rows.n_texts >= min(MIN_TEXTS, n_rows)
    used = np.flatnonzero(common)
    rows.learnable(common)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (len(used), DIM)).astype(np.float32)
    steps = -(-n_rows // batch) * epochs
    move = adam([vectors, layer, bias], rate, steps)
    for _ in range(epochs):
        order = rng.permutation(n_rows)
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            spans = [slice(rows.cuts[i], rows.cuts[i + 1]) for i in part]
            sizes = rows.cuts[part + 1] - rows.cuts[part]
            index = np.concatenate([rows.index[s] for s in spans])
            share = np.concatenate([rows.share[s] for s in spans])
            share = share * (rng.random(len(share)) >= dropout).astype(np.float32) / np.float32(1 - dropout)
            owner = np.repeat(np.arange(len(part)), sizes)
            weighed = vectors[index] * share[:, None]
            hidden = np.stack([np.bincount(owner, weighed[:, d], len(part)) for d in range(DIM)], 1).astype(np.float32)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), classes[part]] -= 1
            error = p * (found.weights[part, None] / len(part)).astype(np.float32)
            back = (error @ layer.T)[owner] * share[:, None]
            grad = np.stack([np.bincount(index, back[:, d], len(used)) for d in range(DIM)], 1).astype(np.float32)
            move([grad + decay * vectors, hidden.T @ error, error.sum(0)])
    weights = np.zeros(BUCKETS)
    weights[used] = vectors @ (layer[:, 1] - layer[:, 0])
    share = np.clip(np.average(found.labels, weights=found.weights), 1e-6, 1 - 1e-6)
    return Model(weights, float(bias[1] - bias[0]), float(np.log(share / (1 - share))))


class _Scores(dict):
    """Word scores, looked up once per word while it is remembered.

    When half of the words are new, the older half goes, without those that were
    asked for again; so frequent words stay, however many rare ones pass.
    """

    def __init__(self, model: Model):
        self.model, self.before = model, {}

    def keep(self, scores: dict[str, float]) -> None:
        if len(self) + len(scores) > REMEMBERED // 2:
            self.before = dict(self)
            self.clear()
        self.update(scores)

    def __missing__(self, word: str) -> float:
        value = self.before.get(word)
        if value is None:
            value = self.model.word(word)
        if len(word) <= LONGEST:
            self.keep({word: value})
        return value

    def learn(self, texts: list[list[str]]) -> None:
        """Score the words of ``texts`` that are new, some at a time."""
        part, size = [], 0
        for word in set().union(*texts):
            if word not in self and word not in self.before and len(word) <= LONGEST:
                part.append(word)
                size += len(word) + 2
                if size >= HASHED:
                    self.keep(dict(zip(part, self.model.words(part).tolist(), strict=True)))
                    part, size = [], 0
        self.keep(dict(zip(part, self.model.words(part).tolist(), strict=True)))


def _together(texts: pd.Series) -> Iterator[list[str | None]]:
    """Texts in order, some TOGETHER characters at a time, one text at least."""
    part, size = [], 0
    for value in texts:
        part.append(value)
        size += len(value or "")
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def score(text: str, model: Model | None) -> Column:
    """Probability that a text is toxic.

    A null or empty text has no words and gets the share of toxic texts; with
    nothing to learn from the score is 0.  Row-local, whole texts: a text without
    blanks is one word, of which all n-grams count.
    """
    if model is None:
        return F.lit(0.0)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Scores(model)
        for texts in batches:
            logits = []
            for part in _together(texts):
                cut = [_WORD.findall(value.lower()) if value else [] for value in part]
                known.learn(cut)
                for words in cut:
                    logits.append(model.bias + sum(map(known.__getitem__, words)) / len(words) if words else model.empty)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -50, 50))), dtype=float)

    return F.pandas_udf(scored, "double")(F.col(text))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", id_column: str = "doc_id", text: str = "text") -> Model | None:
    """Train on a bounded sample of the labelled documents that are not held out."""
    return train(sample(docs, labels, target, PER_CLASS, MAX_CHARS, id_column, text))


def without_toxic(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``; all columns stay."""
    return docs.where(score(text, model) < threshold)
