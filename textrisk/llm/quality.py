"""Text quality by multiple-instance learning with gated attention.

A text is a bag of passages of PASSAGE bytes.  Each passage is encoded from its
characters, a gate tells how much it matters, and the weighted mean of the
passages is classified.  Encoder, gate and classifier learn together from labels
of whole documents, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.llm.common import pieces
from textrisk.llm.labelled import Sample, adam, sample

PASSAGE = 512
CLASSES = 16
HASHED = 256
FEATURES = CLASSES * CLASSES + HASHED
HIDDEN, GATE = 32, 16
PER_CLASS = 1500
MAX_CHARS = 20_000
EPOCHS = 12
THRESHOLD = 0.3
#: Passages that are worked on at once.
BLOCK = 2048


def _classes() -> np.ndarray:
    """Class of each byte: kinds of letters, digits, blanks, marks and bytes above ASCII."""
    table = np.full(256, 12, np.uint8)
    groups = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r", ".", ",", "!?", "'\"", "()[]{}<>", "-_/")
    for number, group in enumerate(groups):
        table[[ord(c) for c in group]] = number
    for number, group in ((13, "|"), (14, "#$%&*+=@^~")):
        table[[ord(c) for c in group]] = number
    table[128:] = 15
    return table


_CLASS = _classes()


@dataclass(frozen=True)
class Model:
    """Encoder, gate and classifier."""

    encoder: np.ndarray
    encoder_bias: np.ndarray
    gate_tanh: np.ndarray
    gate_sigmoid: np.ndarray
    gate: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passage vectors and their attention before normalizing."""
        h = np.tanh(x @ self.encoder + self.encoder_bias)
        gated = np.tanh(h @ self.gate_tanh) / (1 + np.exp(-(h @ self.gate_sigmoid)))
        return h, np.exp(np.clip(gated @ self.gate, -30, 30))


def features(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows for consecutive passages of ``sizes`` bytes: pairs of byte classes and hashed byte triples, as root shares."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    x = np.zeros((n, FEATURES), np.float32)
    if len(data) > 1:
        kind = _CLASS[data].astype(np.int64)
        same = owner[1:] == owner[:-1]
        code = owner[:-1] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:]
        x[:, : CLASSES * CLASSES] = np.bincount(code[same], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    if len(data) > 2:
        wide = data.astype(np.uint32)
        triple = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761) >> np.uint32(24)
        same = owner[2:] == owner[:-2]
        x[:, CLASSES * CLASSES :] = np.bincount((owner[:-2] * HASHED + triple)[same], minlength=n * HASHED).reshape(n, -1)
    return np.sqrt(x / np.maximum(sizes, 1)[:, None].astype(np.float32))


def passages(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and size of the passages of texts of ``lengths`` bytes; an empty text has one empty passage."""
    counts = np.maximum(1, -(-lengths // PASSAGE))
    owner = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, np.minimum(PASSAGE, lengths[owner] - place * PASSAGE)


def train(found: Sample, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 64, seed: int = 11) -> Model | None:
    """Fit on the sample; None without labelled texts."""
    if not found.texts:
        return None
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t in found.texts]
    owner, sizes = passages(np.array([len(r) for r in raw]))
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    rows = [features(data[ends[i] : ends[min(i + BLOCK, len(sizes))]], sizes[i : i + BLOCK]) for i in range(0, len(sizes), BLOCK)]
    x = np.concatenate(rows)
    cuts = np.searchsorted(owner, np.arange(len(raw) + 1))
    draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
    model = Model(
        draw(FEATURES, HIDDEN) * 4, np.zeros(HIDDEN, np.float32), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.zeros(1, np.float32)
    )
    values = [model.encoder, model.encoder_bias, model.gate_tanh, model.gate_sigmoid, model.gate, model.output, model.bias]
    move = adam(values, rate, -(-len(raw) // batch) * epochs)
    for _ in range(epochs):
        order = rng.permutation(len(raw))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            rows_of = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in part])
            first = np.concatenate([[0], np.cumsum(cuts[part + 1] - cuts[part])[:-1]])
            doc = np.repeat(np.arange(len(part)), cuts[part + 1] - cuts[part])
            xb = x[rows_of]
            h = np.tanh(xb @ model.encoder + model.encoder_bias)
            t, s = np.tanh(h @ model.gate_tanh), 1 / (1 + np.exp(-(h @ model.gate_sigmoid)))
            e = np.exp(np.clip((t * s) @ model.gate, -30, 30))
            a = e / np.add.reduceat(e, first)[doc]
            z = np.add.reduceat(a[:, None] * h, first)
            p = 1 / (1 + np.exp(-(z @ model.output + model.bias)))
            error = ((p - found.labels[part]) * found.weights[part] / len(part)).astype(np.float32)
            to_z = error[:, None] * model.output
            along = (h * to_z[doc]).sum(1)
            to_gate = a * (along - np.add.reduceat(a * along, first)[doc])
            inside = to_gate[:, None] * model.gate
            to_t, to_s = inside * s * (1 - t * t), inside * t * s * (1 - s)
            to_h = a[:, None] * to_z[doc] + to_t @ model.gate_tanh.T + to_s @ model.gate_sigmoid.T
            to_x = to_h * (1 - h * h)
            move(
                [
                    xb.T @ to_x, to_x.sum(0), h.T @ to_t, h.T @ to_s,
                    ((t * s) * to_gate[:, None]).sum(0), z.T @ error, error.sum(keepdims=True),
                ]
            )
    return model


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """Scores of the texts of an Arrow string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, np.uint8)
    owner, sizes = passages(np.diff(places))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    total, weighed = np.zeros(len(column)), np.zeros((len(column), HIDDEN))
    for i in range(0, len(sizes), BLOCK):
        j = min(i + BLOCK, len(sizes))
        h, e = model.encode(features(raw[ends[i] : ends[j]], sizes[i:j]))
        first = np.flatnonzero(np.r_[True, owner[i + 1 : j] != owner[i : j - 1]])
        docs = owner[i:j][first]
        total[docs] += np.add.reduceat(e, first)
        weighed[docs] += np.add.reduceat(e[:, None] * h, first)
    return 1 / (1 + np.exp(-((weighed / total[:, None]) @ model.output + model.bias[0])))


def scored(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): probability that a text has quality 1.

    Whole texts, in blocks of passages, so that a text of any length fits; an
    empty or null text is one empty passage.  With nothing to learn from the
    score is 0.  Row-local; repeated rows and null ids stay.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_column), F.lit(0.0).alias("score"))
    kind = rows.schema["id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            scores = pa.array(score_texts(batch.column(1), model).astype(float), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["id", "score"])

    return rows.mapInArrow(judge, f"id {kind}, score double").withColumnRenamed("id", id_column)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", id_column: str = "doc_id", text: str = "text") -> Model | None:
    """Train on a bounded sample of the labelled documents that are not held out."""
    return train(sample(docs, labels, target, PER_CLASS, MAX_CHARS, id_column, text))
