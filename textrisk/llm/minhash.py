"""Near duplicates by ProbMinHash, banding and exact verification.

The likeness of two texts is the probability Jaccard similarity of their
five-word runs, weighted by how often a run occurs; for texts without repeated
runs it is the plain Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrisk.llm.common import ROWS_AT_ONCE, at_once, compact, connected_components, counted, sized, text_key
from textrisk.llm.words import mixed, ragged, some_words, windows, word_numbers
from textrisk.storage import Stored, store

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 40
ROWS = 8
#: Likeness that two signatures must suggest before whole texts are compared.  At THRESHOLD
#: the estimate stays below it with probability 0.0001.
SUGGESTED = 0.7
#: Numbers of 64 bits that hold the parities of a text's runs.
PARITIES = 32
#: Members times centres of open buckets up to which one task lets them meet.
MEETINGS_AT_ONCE = 1 << 21
#: Words of pairs that one task compares without a shuffle of all texts.
WORDS_AT_ONCE = 1 << 21
_STEP, _BITS = 0xD1342543DE82EF95, (1 << 64) - 1


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each text with their counts, ordered by text and hash."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    starts = np.flatnonzero(first)
    return h[starts], o[starts], np.diff(np.append(starts, len(h)))


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``weighted`` in no order, with one sort."""
    _, at, counts = np.unique(mixed(hashes + owner.astype(np.uint64) * np.uint64(_STEP)), return_index=True, return_counts=True)
    return hashes[at], owner[at], counts


def signatures(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """ProbMinHash signatures of ``n`` texts: an element hash for each of ``size`` registers.

    Each element arrives as a Poisson process with its weight as rate; an arrival
    goes to a random register, which keeps the element that came first.  Arrival
    times only grow, so an element stops as soon as it is later than the latest
    register of its text.  Arrivals depend on element and number only, and are
    drawn for all texts at once, round by round.
    """
    time = np.full(n * size, np.inf)
    label = np.zeros(n * size, np.uint64)
    element, base, rate = hashes, owner * size, counts.astype(float)
    now = np.zeros(len(hashes))
    step = 0
    while len(element):
        step += 1
        draw = mixed(element + np.uint64((2 * step + 1) * _STEP & _BITS))
        now = now - np.log(((draw >> np.uint64(24)).astype(float) + 0.5) * 2.0**-40) / rate
        place = base + ((draw & np.uint64(0xFFFFFF)) * np.uint64(size) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(time, place, now)
        won = time[place] == now
        label[place[won]] = element[won]
        texts, where = np.unique(base, return_inverse=True) if step == 1 or step % 8 == 0 else (texts, where)  # noqa: F821
        latest = time.reshape(n, size)[texts // size].max(axis=1)
        going = now < latest[where]
        element, base, rate, now, where = element[going], base[going], rate[going], now[going], where[going]
    return label.reshape(n, size)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    if (x == x[0]).all() and (y == y[0]).all() and x[0] == y[0]:
        return len(x) * x[0] / (x.sum() + only_x + only_y)
    # sum of max(x_j / x_i, y_j / y_i) over j, by order of x / y
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    low_y = np.cumsum(y) + only_y
    high_x = x.sum() - np.cumsum(x) + only_x
    return float((1 / (high_x / x + low_y / y)).sum())


def banded(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc, key, bands, sketch): identity of the text, a hash for each band, and two
    bits of each register; texts without words have no bands."""
    size, columns = BANDS * ROWS, ["doc", "key", "words"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in some_words(batch, 2):
                values, lengths = ragged(part.column(2))
                hashes, owner, _ = windows(values, lengths, SHINGLE)
                h, o, counts = _distinct(hashes, owner)
                signature = signatures(h, o, counts, part.num_rows, size).reshape(-1, BANDS, ROWS)
                band = np.zeros(signature.shape[:2], np.uint64)
                for r in range(ROWS):
                    band = mixed(band + signature[:, :, r])
                offsets = np.concatenate([[0], np.cumsum(np.where(lengths > 0, BANDS, 0))]).astype(np.int32)
                flat = pa.array(band[lengths > 0].ravel().view(np.int64))
                bands = pa.ListArray.from_arrays(pa.array(offsets), flat)
                pairs = (signature.reshape(-1, size // 32, 32) & np.uint64(3)) << np.arange(0, 64, 2, dtype=np.uint64)
                bits = pa.array(np.bitwise_or.reduce(pairs, axis=2).ravel().view(np.int64))
                places = pa.array(np.arange(0, (part.num_rows + 1) * (size // 32), size // 32, dtype=np.int32))
                sketch = pa.ListArray.from_arrays(places, bits)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bands, sketch], names=["doc", "key", "bands", "sketch"])

    rows = docs.where(F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id_column).alias("doc"), text_key(text).alias("key"), word_numbers(F.col(text)).alias("words")
    )
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select(columns).mapInArrow(sign, f"doc {kind}, key string, bands array<bigint>, sketch array<bigint>")


def suggested(a: str, b: str) -> Column:
    """Likeness that two sketches suggest: unlike registers agree in two bits by chance in a quarter of the cases."""
    differ = [f"({a}[{i}] ^ {b}[{i}])" for i in range(BANDS * ROWS // 32)]
    unlike = " + ".join(f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {0x5555555555555555}L)" for x in differ)
    return 1 - F.expr(unlike) / F.lit(BANDS * ROWS) / 0.75


def verified(pairs: DataFrame, texts: DataFrame, n_words: int | None = None) -> DataFrame:
    """(a, b, likeness) of the pairs, from whole texts (doc, text).

    Of pairs with few words, at most ``n_words``, only their own texts are moved, to one task.
    """
    if n_words is not None and n_words <= WORDS_AT_ONCE:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
        texts, pairs = texts.join(F.broadcast(ids), "doc", "left_semi").repartition(1), pairs.coalesce(1)
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select(
        "a", "b", "text_a", "text_b"
    )
    kind = pairs.schema["a"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for c in (2, 3):
                values, lengths = ragged(batch.column(c))
                h, o, counts = weighted(*windows(values, lengths, SHINGLE)[:2])
                cuts = np.searchsorted(o, np.arange(batch.num_rows + 1))
                sets.append((h, counts, cuts))
            (ha, ca, ka), (hb, cb, kb) = sets
            found = [
                likeness((ha[ka[i] : ka[i + 1]], ca[ka[i] : ka[i + 1]]), (hb[kb[i] : kb[i + 1]], cb[kb[i] : kb[i + 1]]))
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "likeness"]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from compare(some_words(batch, 2))

    words = both.select("a", "b", word_numbers(F.col("text_a")).alias("x"), word_numbers(F.col("text_b")).alias("y"))
    return words.mapInArrow(cut, f"a {kind}, b {kind}, likeness double")


def parities(texts: DataFrame) -> DataFrame:
    """(doc, parity, n_runs) of texts (doc, text): for each bit whether an odd number of the
    text's distinct runs fall on it, and the number of runs with repeats."""
    bits = 64 * PARITIES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in some_words(batch, 1):
                values, lengths = ragged(part.column(1))
                hashes, owner, _ = windows(values, lengths, SHINGLE)
                n_runs = np.bincount(owner, minlength=part.num_rows)
                h, o, _ = _distinct(hashes, owner)
                odd = np.bincount(o * bits + (h % np.uint64(bits)).astype(np.int64), minlength=part.num_rows * bits) & 1
                packed = np.bitwise_or.reduce(odd.astype(np.uint64).reshape(-1, 64) << np.arange(64, dtype=np.uint64), axis=1)
                places = pa.array(np.arange(0, (part.num_rows + 1) * PARITIES, PARITIES, dtype=np.int32))
                parity = pa.ListArray.from_arrays(places, pa.array(packed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), parity, pa.array(n_runs, pa.int64())], names=["doc", "parity", "n_runs"])

    words = texts.select("doc", word_numbers(F.col("text")).alias("words"))
    kind = texts.schema["doc"].dataType.simpleString()
    return words.mapInArrow(count, f"doc {kind}, parity array<bigint>, n_runs long")


def reachable(parity: tuple[str, str], n_runs: tuple[str, str], threshold: float) -> Column:
    """Whether two texts' parities leave a likeness of ``threshold`` possible; never false for a link.

    The bits that differ, h, are at most the distinct runs in one text only, p and q.  With
    X and Y runs the likeness is at most 1 / (X / (X - p) + Y / (Y - q) - 1), which is highest,
    by Cauchy and Schwarz, at (sqrt X + sqrt Y)^2 / (X + Y - h) in place of the two fractions.
    """
    differ = F.expr(" + ".join(f"bit_count({parity[0]}[{i}] ^ {parity[1]}[{i}])" for i in range(PARITIES)))
    x, y = (F.col(n).cast("double") for n in n_runs)
    return differ <= x + y - F.pow(F.sqrt(x) + F.sqrt(y), F.lit(2.0)) * F.lit(threshold / (1 + threshold)) + F.lit(0.001)


def _apart(members: DataFrame, classes: DataFrame, known: DataFrame, drawn: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of a bucket's members (doc, band, hash, sketch) in different classes that are not
    among ``known`` and by the parities ``drawn`` may reach ``threshold``."""
    bucket = ["band", "hash"]
    named = members.join(classes.withColumnRenamed("node", "doc"), "doc", "left").select(
        "doc", *bucket, "sketch", F.coalesce("component", "doc").alias("class")
    )
    largest = (
        named.groupBy(*bucket, "class").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(bucket).agg(F.max(F.struct("n", "class")).alias("most"), F.count(F.lit(1)).alias("n_classes"))
        .where("n_classes > 1")
    )
    split = named.join(largest, bucket).select("doc", *bucket, "sketch", "class", (F.col("class") != F.col("most.class")).alias("is_odd"))
    split = split.join(drawn, "doc")
    odd = split.where("is_odd").select(
        F.col("band").alias("o_band"), F.col("hash").alias("o_hash"), F.col("doc").alias("o_doc"), F.col("sketch").alias("o_sketch"),
        F.col("class").alias("o_class"), F.col("parity").alias("o_parity"), F.col("n_runs").alias("o_n_runs"),
    )
    pairs = split.join(
        odd,
        (F.col("band") == F.col("o_band"))
        & (F.col("hash") == F.col("o_hash"))
        & (F.col("class") != F.col("o_class"))
        & (~F.col("is_odd") | (F.col("doc") < F.col("o_doc")))
        & (suggested("sketch", "o_sketch") >= SUGGESTED)
        & reachable(("parity", "o_parity"), ("n_runs", "o_n_runs"), threshold),
    )
    pairs = pairs.select(F.least("doc", "o_doc").alias("a"), F.greatest("doc", "o_doc").alias("b")).distinct()
    return pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: (id, class_id, n_links).

    ``class_id`` is the smallest id among the texts that are linked, directly or
    through others; ``n_links`` the number of different texts found linked to
    this one.  Equal texts are one class.  Empty texts and texts of white space
    have no runs and are only linked to equal ones; a null text or a null id is
    a class of its own (a null id has a null class).  Repeated rows of one id are
    one document; of its several texts each links it.

    Equal texts are folded into their smallest id first, so a large group of
    copies costs one row.  In each bucket of a band the texts are compared with
    a centre, the member with most company over all bands.  Members that are not
    linked to it stay for another round with about four times as many centres, until no
    two of them remain in a bucket: alike texts take one comparison each, and only
    texts that are alike to no centre meet more of them.  At last the members of a bucket
    that the links so far leave in different classes meet, those outside its largest
    class with all others; so each pair in a bucket is compared or in one class.  Pairs
    whose signatures suggest less than SUGGESTED are left out, and after the first round
    those that by their parities cannot be linked; every link is verified on the whole texts.
    """
    signed = store(banded(docs, id_column, text), "bands")
    heads = signed.table.groupBy("key").agg(F.min("doc").alias("doc"))
    one = signed.table.join(heads, ["key", "doc"]).dropDuplicates(["key"])
    # What is kept on the executors' disks is worked out again from stored tables if one is lost.
    bands = one.select("doc", F.posexplode("bands").alias("band", "hash")).persist(StorageLevel.DISK_ONLY)
    sizes = bands.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = bands.join(sizes, ["band", "hash"]).select("doc", "band", "hash", "n")
    company = shared.groupBy("doc").agg(F.sum("n").alias("company"))
    drawn = one.select("doc", "sketch")
    met, n_met = counted(shared.join(company, "doc").join(drawn, "doc").select("doc", "band", "hash", "company", "sketch"), "open")
    bands.unpersist()
    wanted = met.table.select("doc").distinct().join(heads, "doc")
    owned = docs.select(F.col(id_column).alias("doc"), F.col(text).alias("text"), text_key(text).alias("key"))
    texts = store(owned.join(wanted, ["doc", "key"]).groupBy("doc").agg(F.min("text").alias("text")), "texts")
    parity, n_texts = counted(parities(texts.table), "parities")
    longest = (parity.table.agg(F.max("n_runs")).first()[0] or 0) + SHINGLE

    compared: list[Stored] = []
    left, n_left, n_known, n_centres = met, n_met, 0, 1
    while True:
        open_ = at_once(left.table, n_left)
        n_members = open_.groupBy("band", "hash").agg(F.count(F.lit(1)).cast("double").alias("n")).where("n > 1")
        n_meetings = n_members.agg(F.sum(F.col("n") * F.least("n", F.lit(float(n_centres))))).first()[0]
        if n_meetings is None and left is not met:
            break
        if n_left > ROWS_AT_ONCE or (n_meetings or 0) > MEETINGS_AT_ONCE:
            open_ = left.table
        # The member with most company, and from the second round on about four times as many others each time.
        draw = F.pmod(F.xxhash64("doc", "band", F.lit(n_centres)), F.lit(1 << 30)) / F.lit(1 << 30)
        buckets = open_.groupBy("band", "hash").agg(F.max(F.struct("company", "doc")).alias("c"), F.count(F.lit(1)).alias("n"))
        marked = open_.join(buckets.where("n > 1"), ["band", "hash"]).select(
            "doc", "band", "hash", "company", "sketch",
            ((F.col("doc") == F.col("c.doc")) | (draw * F.col("n") < n_centres - 1)).alias("is_centre"),
        )
        possible = suggested("sketch", "c_sketch") >= SUGGESTED
        if left is not met:  # one centre a bucket needs no parities, so only the few members left carry them
            marked = marked.join(at_once(parity.table, n_texts), "doc")
            possible &= reachable(("parity", "c_parity"), ("n_runs", "c_n_runs"), threshold)
        centres = marked.where("is_centre").drop("is_centre").withColumnRenamed("doc", "centre")
        centres = centres.withColumnsRenamed({c: f"c_{c}" for c in centres.columns if c != "centre"})
        ahead = F.struct("c_company", "centre") > F.struct("company", "doc")
        judged = (
            marked.join(
                centres,
                (F.col("band") == F.col("c_band"))
                & (F.col("hash") == F.col("c_hash"))
                & (ahead | ~F.col("is_centre"))
                & possible,
            )
            .select("doc", "band", "hash", F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b"))
        )
        if open_ is left.table:  # else one task works it out again sooner than a plan that reads it back is shuffled
            judged = judged.persist(StorageLevel.DISK_ONLY)
        pairs = judged.select("a", "b").distinct()
        if compared:
            pairs = pairs.join(at_once(known.select("a", "b"), n_known), ["a", "b"], "left_anti")  # noqa: F821
        new, n_new = counted(pairs, "pairs")
        compared.append(compact(verified(new.table, texts.table, n_new * 2 * longest), "likeness"))
        new.drop()
        n_known += n_new
        known = reduce(DataFrame.union, [c.table for c in compared])
        near = at_once(known, n_known).where(F.col("likeness") >= threshold).select("a", "b")
        linked = judged.join(near, ["a", "b"], "left_semi").select("doc", "band", "hash").distinct()
        waiting = marked.where("NOT is_centre").join(linked, ["doc", "band", "hash"], "left_anti").select(met.table.columns)
        following, n_left = counted(waiting, "open")
        judged.unpersist()
        if left is not met:
            left.drop()
        left, n_centres = following, 4 * n_centres
    known = at_once(known, n_known)
    classes = connected_components(known.where(F.col("likeness") >= threshold).select("a", "b"))
    named = F.broadcast(classes.table) if n_known <= ROWS_AT_ONCE else classes.table
    drawn = F.broadcast(parity.table) if n_texts <= ROWS_AT_ONCE // 2 else parity.table
    new, n_new = counted(_apart(met.table, named, known, drawn, threshold), "pairs")
    rest = compact(verified(new.table, texts.table, n_new * 2 * longest), "likeness")
    new.drop()
    compared.append(rest)
    both = at_once(known.unionByName(rest.table), n_known + n_new)
    links = compact(both.where(F.col("likeness") >= threshold).select("a", "b"), "links")
    if not rest.table.where(F.col("likeness") >= threshold).isEmpty():
        classes.drop()
        classes = connected_components(links.table)
    for done in (met, left, texts, parity, *compared):
        done.drop()
    degree = links.table.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n_links"))
    assigned = (
        signed.table.select("key", F.col("doc").alias("id")).distinct()
        .join(heads, "key")
        .join(classes.table.withColumnRenamed("node", "doc"), "doc", "left")
        .join(degree, "doc", "left")
        .groupBy("id")
        .agg(F.min(F.coalesce("component", "doc")).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    )
    ids = docs.select(F.col(id_column).alias("id"))
    return (
        ids.join(assigned, "id", "left")
        .select(F.col("id").alias(id_column), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose id names their class: one document of each group; all columns stay.

    Of several rows with one id one stays.  Rows with a null id stay.  The text
    moves only where the list of ids to leave out is too large to broadcast, or
    ids repeat.
    """
    found = near_duplicates(docs.select(id_column, text), id_column, text, threshold)
    others = compact(found.where(F.col(id_column) != F.col("class_id")).select(id_column).distinct(), "others").table
    n_others = others.count()
    kept = docs.join(sized(others, 64 * n_others), id_column, "left_anti")
    counts = docs.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.count(F.lit(1)).alias("n"))
    repeated = compact(counts.where("n > 1").select(id_column), "repeated").table
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, id_column, "left_semi").dropDuplicates([id_column])
    return kept.join(repeated, id_column, "left_anti").unionByName(once)
