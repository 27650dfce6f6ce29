"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sample:
    texts: list[str]
    labels: np.ndarray
    weights: np.ndarray


def held_out(id_column: str) -> Column:
    """Documents that are never learned from: a fifth, by checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    target: str,
    per_class: int,
    max_chars: int,
    id_column: str = "doc_id",
    text: str = "text",
) -> Sample:
    """At most ``per_class`` documents of each class, those with the smallest hashes of their ids.

    Documents of more than ``max_chars`` are not learned from (they are scored
    like all others), so the sample has at most 2 * per_class * max_chars
    characters however large the tables are.  Weights restore the class shares
    among all labelled rows.  Rows with a null id or a label other than 0 and 1
    do not count; of several labels or texts of one id the largest and the
    smallest is taken.
    """
    marks = (
        labels.select(F.col(id_column).alias("id"), F.col(target).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    totals = {r.label: r.n for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label in sorted(totals):
        part = marks.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return Sample([], np.zeros(0), np.zeros(0))
    found = (
        docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
        .where(F.length("text") <= max_chars)
        .join(F.broadcast(chosen), "id")  # 2 * per_class rows at most
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))
        .orderBy("id")
        .collect()
    )
    y = np.array([r.label for r in found], dtype=float)
    share = {label: n / max(1, (y == label).sum()) for label, n in totals.items()}
    weights = np.array([share[int(v)] for v in y])
    return Sample([r.text for r in found], y, weights / weights.mean() if len(y) else weights)


def adam(parameters: list[np.ndarray], rate: float, steps: int):
    """A function that moves ``parameters`` against their gradients, ever less over ``steps`` steps."""
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    step = 0

    def move(gradients: list[np.ndarray]) -> None:
        nonlocal step
        step += 1
        for p, g, m, v in zip(parameters, gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * max(0.02, 1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    return move
