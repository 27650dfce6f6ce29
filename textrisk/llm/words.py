"""Texts as arrays of word numbers, for operators on runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F



def word_numbers(text: Column) -> Column:
    """A 64-bit number for each word: lower case, cut at white space; null for a null text."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow list column and the length of each list."""
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def some_words(batch: pa.RecordBatch, column: int, n_words: int = 400_000, n_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of words in its list ``column``, one row at least."""
    lengths = np.nan_to_num(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False))
    total = np.concatenate([[0], np.cumsum(lengths)])
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(total, total[start] + n_words, side="right")) - 1
        stop = min(max(stop, start + 1), start + n_rows, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Unrelated odd numbers, one for each place in a run.
FACTORS = list(mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1))


def windows(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside its text, the text's number, the position in the text.

    A text of fewer words, but not of none, is one run.
    """
    values = values.view(np.uint64) if values.dtype == np.int64 else values.astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    factors = FACTORS[:size]
    total = np.zeros(max(len(values) - size + 1, 0), np.uint64)
    for i, factor in enumerate(factors):
        total += values[i : i + len(total)] * factor
    full = np.maximum(lengths - size + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), full)
    position = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    hashes = mixed(total[starts[owner] + position])
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        rest = np.zeros(len(short), np.uint64)
        for i, factor in enumerate(factors):
            there = lengths[short] > i
            rest[there] += values[starts[short[there]] + i] * factor
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        hashes = np.concatenate([hashes, mixed(rest + np.uint64(1))])[order]
        position = np.concatenate([position, np.zeros(len(short), np.int64)])[order]
    return hashes, owner, position
