"""Long passages that several documents share, by a sparse suffix array of words.

Only suffixes that begin at minimisers are kept: of every run of WINDOW seeds (runs
of SEED words) the one with the smallest hash.  Two equal passages of
SEED + WINDOW - 1 words or more hold the same minimisers at the same places.  The
suffixes are sorted by their words, each is compared with the nearest ones of
other documents before and after it, and a match is extended to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.llm.common import text_key
from textrisk.llm.words import ragged, some_words, windows, word_numbers
from textrisk.storage import store

#: Words of a passage, at least.
MIN_WORDS = 50
SEED = 17
WINDOW = MIN_WORDS - SEED + 1


def minimisers(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Indexes of the seeds that are smallest in some run of WINDOW seeds of their text; of equal ones the first."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), hashes))] = np.arange(n)
    size = WINDOW
    # Smallest of each run by doubling: best[i] is the smallest of the 2 ** k ranks from i on.
    best, width = rank.copy(), 1
    while width * 2 <= size:
        best[: n - width] = np.minimum(best[: n - width], best[width:])
        width *= 2
    shift = size - width
    whole = np.flatnonzero(np.arange(n) + size <= n)
    whole = whole[owner[whole] == owner[whole + size - 1]]
    chosen = np.minimum(best[whole], best[whole + shift])
    by_rank = np.empty(n, np.int64)
    by_rank[rank] = np.arange(n)
    return np.unique(by_rank[chosen])


def _chosen(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, text and position of the minimisers of texts of MIN_WORDS words or more."""
    hashes, owner, position = windows(values, lengths, SEED)
    long = lengths[owner] >= MIN_WORDS
    hashes, owner, position = hashes[long], owner[long], position[long]
    at = minimisers(hashes, owner)
    return hashes[at], owner[at], position[at]


def _contexts(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The MIN_WORDS words from ``at`` on and before ``at``, the near ones first, within their texts; 0 outside.

    Words are cut to 32 bits; big-endian, so that bytes sort like words.
    """
    small = (values.view(np.uint64) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    step = np.arange(MIN_WORDS)
    right, left = at[:, None] + step, at[:, None] - 1 - step
    there = lambda index, inside: np.where(inside, small[np.clip(index, 0, max(len(small) - 1, 0))], np.uint32(0))
    return (
        there(right, right < ends[:, None]).astype(">u4"),
        there(left, left >= starts[:, None]).astype(">u4"),
    )


def suffixes(texts: DataFrame) -> DataFrame:
    """(doc, key, n_words, places, seeds) for (doc, key, words): positions and hashes of the minimisers, for texts that have any."""
    kind = texts.schema["doc"].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in some_words(batch, 2):
                values, lengths = ragged(part.column(2))
                seeds, owner, position = _chosen(values, lengths)
                rows, first = np.unique(owner, return_index=True)
                offsets = pa.array(np.append(first, len(owner)).astype(np.int32))
                own = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0),
                        own.column(1),
                        pa.array(lengths[rows].astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(position.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(seeds.view(np.int64))),
                    ],
                    names=["doc", "key", "n_words", "places", "seeds"],
                )

    schema = f"doc {kind}, key string, n_words int, places array<int>, seeds array<bigint>"
    return texts.select("doc", "key", "words").mapInArrow(pick, schema)


def _with_contexts(texts: DataFrame) -> DataFrame:
    """(doc, pos, right, left) for (doc, words, places)."""
    kind = texts.schema["doc"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = MIN_WORDS * 4
        for batch in batches:
            for part in some_words(batch, 1):
                values, lengths = ragged(part.column(1))
                places, counts = ragged(part.column(2))
                ends = np.cumsum(lengths)
                starts = ends - lengths
                owner = np.repeat(np.arange(part.num_rows), counts)
                right, left = _contexts(values, starts[owner], ends[owner], starts[owner] + places)
                raw = pa.binary(width)
                blocks = [pa.FixedSizeBinaryArray.from_buffers(raw, len(owner), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in (right, left)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(places.astype(np.int32)), *blocks],
                    names=["doc", "pos", "right", "left"],
                )

    return texts.select("doc", "words", "places").mapInArrow(cut, f"doc {kind}, pos int, right binary, left binary")


def _blocks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, MIN_WORDS)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading words that rows of ``a`` and ``b`` share."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), MIN_WORDS)


def _neighbours(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
    """Matches of sorted suffixes with the nearest ones of other documents.

    ``before`` is, for each run of one document, the last row of another one.
    With ``edges`` the first and last two runs come out as well, for the
    comparison across tasks.
    """
    held: list[pa.RecordBatch] = []

    def matches(table: pa.RecordBatch) -> pa.RecordBatch:
        doc = table.column(0)
        codes = doc.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        right, left = _blocks(table.column(2)), _blocks(table.column(3))
        n = len(codes)
        new = np.ones(n, bool)
        new[1:] = codes[1:] != codes[:-1]
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        reach_left, reach_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        found = np.zeros(n, bool)
        for other in (starts[run] - 1, ends[run]):
            valid = np.flatnonzero((other >= 0) & (other < n))
            r = _common(right[valid], right[other[valid]])
            l_ = _common(left[valid], left[other[valid]])
            good = (r >= SEED) & (r + l_ >= MIN_WORDS)
            rows = valid[good]
            found[rows] = True
            np.maximum.at(reach_left, rows, l_[good])
            np.maximum.at(reach_right, rows, r[good])
        rows = np.flatnonzero(found)
        position = table.column(1).to_numpy()[rows]
        spare = [pa.nulls(len(rows), pa.binary())] * 2
        return pa.RecordBatch.from_arrays(
            [
                doc.take(pa.array(rows)),
                pa.array((position - reach_left[rows]).astype(np.int32)),
                pa.array((position + reach_right[rows]).astype(np.int32)),
                pa.array(np.zeros(len(rows), bool)),
                *spare,
            ],
            names=["doc", "first", "last", "edge", "right", "left"],
        )

    def edge_rows(table: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        part = table.take(pa.array(rows))
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), part.column(1), pa.array(np.ones(len(rows), bool)), part.column(2), part.column(3)],
            names=["doc", "first", "last", "edge", "right", "left"],
        )

    def runs(table: pa.RecordBatch) -> np.ndarray:
        codes = table.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        return np.cumsum(new) - 1

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]

    first_block = True
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = joined(held)
        run = runs(table)
        if run[-1] < 3:
            held = [table]
            continue
        # The last two runs wait for what follows; their earlier rows are compared now and again.
        yield matches(table)
        if edges and first_block:
            yield edge_rows(table, np.flatnonzero(run <= 1))
        first_block = False
        held = [table.slice(int(np.flatnonzero(run >= run[-1] - 1)[0]))]
    if held:
        table = joined(held)
        yield matches(table)
        if edges:
            run = runs(table)
            yield edge_rows(table, np.flatnonzero((run >= run[-1] - 1) | (run <= 1) if first_block else run >= run[-1] - 1))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each document with those that touch made one."""
    for batch in batches:
        firsts, counts = ragged(batch.column(1))
        lasts, _ = ragged(batch.column(2))
        owner = np.repeat(np.arange(batch.num_rows), counts)
        order = np.lexsort((lasts, firsts, owner))
        owner, firsts, lasts = owner[order].astype(np.int64), firsts[order].astype(np.int64), lasts[order].astype(np.int64)
        # The owner is part of the number, so that the running maximum starts anew with each document.
        reach = np.maximum.accumulate(owner << 32 | lasts)
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] << 32 | firsts[1:]) > reach[:-1]
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(owner)) - 1
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(owner[at])),
                pa.array(firsts[at].astype(np.int32)),
                pa.array((reach[end] & 0xFFFFFFFF).astype(np.int32)),
            ],
            names=["doc", "first", "last"],
        )


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, first_word, end_word): passages of MIN_WORDS words or more that another document has too.

    Positions count words cut at white space, compared in lower case; the end is
    exclusive.  Passages of a document that touch or overlap are one.  Equal
    texts of enough words are repeated as a whole.  A repetition within one
    document does not count.  Null, empty and short texts have no passages; rows
    with a null id are not searched; repeated rows of an id are one document.

    The minimisers of all texts are stored in one pass.  Copies are folded into
    their smallest id by a hash of the text.  Suffixes
    whose seed only one text has are dropped before any context is attached, and
    contexts of a fixed number of words are enough, as a longer passage holds a
    minimiser in every WINDOW seeds.  The sort splits a seed that very many
    documents share, since document and position are part of its key; the few
    rows at the ends of tasks are compared again in a second step.
    """
    owned = docs.where(F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    texts = owned.select(F.col("id").alias("doc"), text_key("text").alias("key"), word_numbers(F.col("text")).alias("words"))
    signed = store(suffixes(texts), "suffixes").table
    members = signed.select("key", F.col("doc").alias("id"), "n_words").distinct()
    heads = members.groupBy("key").agg(F.min("id").alias("doc"), F.count(F.lit(1)).alias("n"))
    one = signed.join(heads.select("key", "doc"), ["key", "doc"]).dropDuplicates(["key"])
    every = one.select("doc", F.explode(F.arrays_zip("places", "seeds")).alias("s")).select("doc", "s.places", F.col("s.seeds").alias("seed"))
    seeds = every.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("seed")
    # Kept, so that both sides of the next join are plain shuffles, which a seed with very many rows can split.
    seeds = seeds.persist(StorageLevel.DISK_ONLY)
    places = every.join(seeds, "seed", "left_semi").groupBy("doc").agg(F.collect_set("places").alias("places"))
    contexts = _with_contexts(
        owned.withColumnRenamed("id", "doc").join(places, "doc").select("doc", word_numbers(F.col("text")).alias("words"), "places")
    )
    kind = contexts.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, first int, last int, edge boolean, right binary, left binary"
    spark = docs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["right", "doc", "pos"]
    array = contexts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = store(array.mapInArrow(lambda batches: _neighbours(batches, True), schema), "neighbours").table
    seeds.unpersist()
    across = (
        found.where("edge").select("doc", F.col("first").alias("pos"), "right", "left").distinct().coalesce(1).sortWithinPartitions(*order)
    )  # a few rows per task
    matched = found.where("NOT edge").unionByName(across.mapInArrow(lambda batches: _neighbours(batches, False), schema)).select("doc", "first", "last")
    spans = matched.distinct().groupBy("doc").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    id_kind = spans.schema["doc"].dataType.simpleString()
    passages = spans.mapInArrow(_united, f"doc {id_kind}, first int, last int")
    single = members.join(heads.where("n = 1").select("key", "doc"), "key").select("id", "doc")
    copies = members.join(heads.where("n > 1").select("key"), "key").select("id", F.lit(0).alias("first"), F.col("n_words").alias("last"))
    return single.join(passages, "doc").select("id", "first", "last").unionByName(copies).select(
        F.col("id").alias(id_column), F.col("first").alias("first_word"), F.col("last").alias("end_word")
    )
