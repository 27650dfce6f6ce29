"""I-Match fingerprints: hashes of the terms of a document that are neither rare nor common.

The lexicon holds the terms whose inverse document frequency lies in a band.  A
fingerprint has one part for each of many random subsets of the lexicon: the hash
of the sorted distinct terms of the text in that subset.  The subsets keep ever
smaller shares, so that for short and for long texts some of them hold a term or
two and survive an edit.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.llm.common import compact
from textrisk.llm.words import mixed
from textrisk.storage import store

#: Band of the inverse document frequency, log(documents / documents with the term).
IDF = (math.log(5), math.log(1000))
#: Shares of the lexicon that the subsets keep; each share is drawn several times.
SHARES = (1 / 2, 1 / 8, 1 / 32, 1 / 128, 1 / 512, 1 / 2048)
DRAWS = 16
PARTS = len(SHARES) * DRAWS
#: Parts that a comparison rests on, at least, from the smallest shares up.
TOLD = 12
# ASCII characters that are not letters, digits or the low line part terms.
_PARTED = bytes(b if b > 127 or chr(b).isalnum() or b == ord("_") else 32 for b in range(256))


def term_number(term: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(term, digest_size=8).digest(), "little", signed=True)


def terms(text: str | None) -> set[bytes]:
    """Distinct terms of a text in lower case, as UTF-8."""
    return set(text.lower().encode().translate(_PARTED).split()) if text else set()


@dataclass(frozen=True)
class Lexicon:
    """Numbers of the terms in the band, sorted."""

    numbers: np.ndarray

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """Which of ``numbers`` are in the lexicon."""
        if not len(self.numbers):
            return np.zeros(len(numbers), bool)
        at = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        return self.numbers[at] == numbers


def _local_counts(texts: DataFrame, share: float) -> DataFrame:
    """(term, n, covered): terms that at least ``share`` of a run of texts have, with their number.

    ``covered`` is the size of the run, or 0 for a run so small that all its terms
    are there.  A row without a term has the totals of the run.
    """

    def emit(found: Counter, n_texts: int) -> pa.RecordBatch:
        covered = n_texts if share * n_texts > 1 else 0
        kept = [(term_number(t), n) for t, n in found.items() if n >= share * n_texts]
        term, n = zip(*kept, strict=True) if kept else ((), ())
        columns = [pa.array([*term, None], pa.int64()), pa.array([*n, n_texts], pa.int64()), pa.array([covered] * (len(kept) + 1), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["term", "n", "covered"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_texts, found = 0, Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(terms(text.as_py()))
                n_texts += 1
                if len(found) > 1_000_000:  # memory stays bounded
                    yield emit(found, n_texts)
                    n_texts, found = 0, Counter()
        yield emit(found, n_texts)

    return texts.mapInArrow(count, "term bigint, n bigint, covered bigint")


def _exact_counts(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, n): in how many texts of a task each of the wanted terms is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(t): i for i, t in enumerate(wanted)}
        totals = np.zeros(len(wanted), np.int64)
        known: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for t in terms(text.as_py()):
                    if t not in known:
                        if len(known) > 300_000:
                            known.clear()
                        known[t] = place.get(term_number(t), -1)
                    if known[t] >= 0:
                        totals[known[t]] += 1
        there = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[there]), pa.array(totals[there])], names=["term", "n"])

    return texts.mapInArrow(count, "term bigint, n bigint")


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = IDF) -> Lexicon:
    """Terms of ``docs`` in the band, counted over all documents.

    Two passes, each with little to shuffle.  A term that at least a share
    exp(-band[1]) of all documents have has that share in some run of documents;
    the first pass finds those, with an upper bound of their counts, the second
    counts what the bound lets through.  There are at most (distinct terms per
    document) * exp(band[1]) terms in the lexicon, however many documents there are.
    """
    texts = docs.select(F.col(text).alias("text"))
    share = math.exp(-band[1])
    local = compact(
        _local_counts(texts, share).groupBy("term").agg(F.sum("n").alias("n"), F.sum("covered").alias("covered")), "terms"
    )
    totals = local.table.where("term IS NULL").first()
    if totals is None or not totals.n:
        return Lexicon(np.zeros(0, np.int64))
    low, high = totals.n * share, totals.n * math.exp(-band[0])
    bound = F.col("n") + F.lit(share) * (F.lit(totals.covered) - F.col("covered"))
    maybe = local.table.where(F.col("term").isNotNull() & (bound >= low)).select("term").toArrow()
    local.drop()
    wanted = np.sort(maybe.column(0).to_numpy())
    counted = _exact_counts(texts, wanted).groupBy("term").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n").between(low, high)).select("term").toArrow()
    return Lexicon(np.sort(kept.column(0).to_numpy()))


class Fingerprints:
    """Fingerprints by one lexicon; remembers which terms are in it."""

    def __init__(self, lexicon: Lexicon):
        inside = lexicon.numbers.view(np.uint64)
        self.row = {int(n): i for i, n in enumerate(lexicon.numbers)}
        self.kept = np.zeros((len(inside), PARTS), np.uint64)
        for k in range(PARTS):
            salt = np.uint64((k + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))
            self.kept[:, k] = mixed(inside + salt) < np.uint64(int(SHARES[k // DRAWS] * (1 << 63)) * 2)
        self.weights = mixed(inside)
        self.known: dict[bytes, int] = {}

    def _place(self, term: bytes) -> int:
        if len(self.known) > 300_000:
            self.known.clear()
        place = self.known[term] = self.row.get(term_number(term), -1)
        return place

    def of(self, text: str | None) -> np.ndarray:
        """Parts of the fingerprint, 0 where a subset holds no term of the text.

        The terms of a part are in the order of the lexicon; their mixed numbers
        are summed, which gives the same for the same terms only.
        """
        known = self.known
        rows = np.array(sorted(p for p in ((known[t] if t in known else self._place(t)) for t in terms(text)) if p >= 0), np.int64)
        kept = self.kept[rows]
        sums = mixed((kept * self.weights[rows, None]).sum(axis=0))
        parts = (sums >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        parts[~kept.any(axis=0)] = 0
        return parts

    @staticmethod
    def packed(parts: np.ndarray, text: str | None) -> bytes:
        """Two bytes for each part; if all are empty the hash of the text follows."""
        raw = parts.astype(">u2").tobytes()
        return raw if parts.any() else raw + hashlib.sha256((text or "").encode()).digest()


def likeness(a: np.ndarray, b: np.ndarray, same_text: bool = False) -> float:
    """Share of equal parts among those that hold a term in one of the two texts.

    The smallest subsets are looked at first, and larger ones only until TOLD
    parts hold a term: the fewer terms a part holds, the closer the share comes to
    the terms that the texts have in common.  Without any part that holds a term
    only equal texts are alike.
    """
    if same_text:
        return 1.0
    there = (a | b) != 0
    told = np.cumsum(there.reshape(len(SHARES), DRAWS).sum(axis=1)[::-1])
    equal = np.cumsum((there & (a == b)).reshape(len(SHARES), DRAWS).sum(axis=1)[::-1])
    level = min(int(np.searchsorted(told, TOLD)), len(SHARES) - 1)
    return float(equal[level] / told[level]) if told[level] else 0.0


def fingerprint(docs: DataFrame, found: Lexicon, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text as hexadecimal text; null counts as empty.  Row-local."""
    import pandas as pd

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        prints = Fingerprints(found)
        for values in batches:
            yield pd.Series([prints.packed(prints.of(v), v).hex() for v in values], dtype=object)

    one.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(into, F.pandas_udf(one, "string")(F.col(text)))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_COLUMNS = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edit_report(docs: DataFrame, found: Lexicon, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are; the next text stands for the edit.

    The next document is the one before in order of ids, for the last the first;
    equal ids are ordered by a hash of their texts, null ids come last.  Null
    texts count as empty; a single document is its own next.

    Texts are range-partitioned by id and moved once.  Each task reads its rows in
    order and knows the next one but for its last; the first and last rows of
    tasks, two per task, are then paired in a second step.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text").desc()]

    def judged(prints: Fingerprints, this: tuple, after: tuple) -> tuple:
        (key, value, own), (_, other, others) = this, after
        changed = edited(value, other)
        new = prints.of(changed)
        return (
            key, len(value), hashlib.sha256(changed.encode()).digest(), prints.packed(own, value), prints.packed(new, changed),
            likeness(own, new, value == changed), likeness(own, others, value == other),
        )

    def batch_of(results: list[tuple], edges: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        n, m = len(results), len(edges)
        columns = list(zip(*results, strict=True)) if results else [()] * 7
        types = [id_type, pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64()]
        arrays = [pa.array([*c, *([None] * m)], t) for c, t in zip(columns[1:], types[1:], strict=True)]
        keys = pa.array([*columns[0], *[e[0] for e in edges]], id_type)
        edge = [pa.array([*[None] * n, *[e[k] for e in edges]], t) for k, t in ((1, pa.string()), (2, pa.int32()), (3, pa.int32()))]
        return pa.RecordBatch.from_arrays(
            [keys, *arrays, *edge],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edge_text", "part", "place"],
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, before = Fingerprints(found), None
        part = TaskContext.get().partitionId()
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for start in range(0, batch.num_rows, 500):
                cut = batch.slice(start, 500)
                results, edges = [], []
                for key, value in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True):
                    this = (key, value, prints.of(value))
                    if before is None:
                        edges.append((key, value, part, 0))
                    else:
                        results.append(judged(prints, before, this))
                    before = this
                yield batch_of(results, edges, id_type)
        if before is not None:
            yield batch_of([], [(before[0], before[1], part, 1)], id_type)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(found)
        for batch in batches:
            results = []
            for key, value, other in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                results.append(judged(prints, (key, value, prints.of(value)), (None, other, prints.of(other))))
            yield batch_of(results, [], batch.column(0).type).select(list(range(7)))

    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    walked = store(sorted_rows.mapInArrow(walk, f"id {kind}, {_COLUMNS}, edge_text string, part int, place int"), "fingerprints").table
    edges = walked.where("part IS NOT NULL")
    firsts = edges.where("place = 0").select("part", F.col("edge_text").alias("next_text"))
    lasts = edges.where("place = 1").select("id", "edge_text", "part")
    numbers = sorted(r.part for r in firsts.select("part").collect())  # one per task
    following = docs.sparkSession.createDataFrame(
        [(p, numbers[(i + 1) % len(numbers)]) for i, p in enumerate(numbers)], "part int, next_part int"
    )
    paired = lasts.join(following, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part")
    rest = paired.select("id", "edge_text", "next_text").mapInArrow(pair, f"id {kind}, {_COLUMNS}")
    whole = walked.where("part IS NULL").drop("edge_text", "part", "place").unionByName(rest)
    text_of = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return whole.withColumns(text_of).withColumnRenamed("id", id_column)
