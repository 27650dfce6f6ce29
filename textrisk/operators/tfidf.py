"""Term weights in long form: one row per record and term.

No step needs the vocabulary on one machine, so this form works for vocabularies
of any size.  ``model.py`` uses vectors instead while the vocabulary is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vocabulary limits.
MAX_DF = 0.8
MIN_DF = 5
MIN_DF_FROM = 20  # documents; below that every term counts

BROADCAST_TERMS = 1 << 17
# Terms have no longest length, so their bytes are counted too.
BROADCAST_BYTES = 16 << 20
_HOT_SHARE = 10_000


def min_df_for(n_docs: int) -> int:
    return MIN_DF if n_docs >= MIN_DF_FROM else 1


def term_counts(docs: DataFrame, *, keep: Sequence[str] = ("record_id",)) -> DataFrame:
    """Rows ``(keep..., term, tf)`` from a column ``tokens``, without a shuffle.

    The tokens of a record are sorted; a term's count is the distance between
    the place where it starts and the place where the next one does.
    """
    ordered = docs.select(*keep, F.sort_array("tokens").alias("_sorted"))
    tokens, starts = F.col("_sorted"), F.col("_starts")
    places = F.sequence(F.lit(0), F.size(tokens) - 1)
    is_start = lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1))
    placed = ordered.withColumn(
        "_starts", F.when(F.size(tokens) > 0, F.filter(places, is_start)).otherwise(F.array().cast("array<int>"))
    )
    counts = F.transform(
        starts,
        lambda at, i: F.struct(
            F.get(tokens, at).alias("term"), (F.coalesce(F.get(starts, i + 1), F.size(tokens)) - at).alias("tf")
        ),
    )
    return placed.select(*keep, F.inline(counts))


def document_frequency(docs: DataFrame) -> DataFrame:
    """Rows ``(term, df)``; counted before the shuffle, so frequent terms are cheap."""
    terms = docs.select(F.explode(F.array_distinct("tokens")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(frequencies: DataFrame, n_docs: int, *, min_df: int | None = None, max_df: float = MAX_DF) -> DataFrame:
    """Rows ``(term, df, idf)`` of the terms within the limits; smooth idf."""
    low = min_df_for(n_docs) if min_df is None else min_df
    kept = frequencies.filter((F.col("df") >= low) & (F.col("df") <= max_df * n_docs))
    return kept.withColumn("idf", F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def have_own_hashes(terms: DataFrame) -> bool:
    """Whether no two terms have the same hash (xxhash64)."""
    return terms.groupBy(F.xxhash64("term")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def frequent_terms(terms: DataFrame, limit: int) -> Column:
    """Condition for the most frequent terms: nearly ``limit`` of them, and all that
    hold more than 1/10,000 of the postings, of which there can be no more than 10,000.

    Terms of nearly equal frequency stay together; longer ones are left out, so that
    the bytes are bounded too.
    """
    length = F.octet_length("term")
    step, short = F.floor(F.log2("df") * 16), length * limit <= BROADCAST_BYTES
    sizes = terms.groupBy(step.alias("step")).agg(F.count_if(short).alias("n_terms"), F.sum("df").alias("total")).collect()
    lowest, taken = float("inf"), 0
    for row in sorted(sizes, key=lambda r: r["step"], reverse=True):
        taken += row["n_terms"]
        if taken > limit:
            break
        lowest = float(row["step"])
    total = sum(row["total"] for row in sizes)
    is_hot = (F.col("df") * _HOT_SHARE > total) & (length * _HOT_SHARE <= BROADCAST_BYTES)
    return is_hot | (short & (step >= F.lit(lowest)))


def attach_terms(postings: DataFrame, terms: DataFrame, *, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Join postings with a term table (columns ``term``, ``df``, ...).

    A table of checked small size is broadcast.  A larger one is split: its most
    frequent terms (``broadcast_terms``, or 10,000) and those that hold more than
    1/10,000 of all postings, of which there can be no more than 10,000, are
    broadcast; the rest are rare enough for an even shuffle.
    """
    size, n_bytes = terms.agg(F.count(F.lit(1)), F.sum(F.octet_length("term"))).first()
    if size <= broadcast_terms and (n_bytes or 0) <= BROADCAST_BYTES:
        return postings.join(F.broadcast(terms), "term")
    # Long terms are left to the shuffle, so the hot ones are bounded in bytes.
    is_hot = frequent_terms(terms, max(broadcast_terms, _HOT_SHARE))
    hot = F.broadcast(terms.filter(is_hot))
    rare = terms.filter(~is_hot)
    frequent = postings.join(hot, "term")
    others = postings.join(hot.select("term"), "term", "left_anti").join(rare.hint("shuffle_hash"), "term")
    return frequent.unionByName(others)


def weigh(postings: DataFrame, terms: DataFrame, *, keep: Sequence[str] = ("record_id",), broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Add ``weight``: tf * idf divided by the length of the record's vector.

    ``keep`` must identify a record.  A record's group holds one row per term it
    contains, so no group grows with the table.
    """
    raw = attach_terms(postings, terms, broadcast_terms=broadcast_terms)
    raw = raw.withColumn("weight", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*keep)))
    return raw.withColumn("weight", F.col("weight") / length)


def gather(contributions: DataFrame, *, keep: Sequence[str] = ("record_id",), limit: int = 5) -> DataFrame:
    """Per record the sum of ``contribution`` as ``total`` and, as ``top_terms``,
    the terms with the largest positive ones, best first.

    Equal contributions are ordered by term, last one first.  The list that is
    sorted holds the terms of one record; after ``weigh`` the rows of a record
    are together already, so nothing is shuffled again.
    """
    raising = F.when(F.col("contribution") > 0, F.struct("contribution", "term"))
    gathered = contributions.groupBy(*keep).agg(
        F.sum("contribution").alias("total"), F.sort_array(F.collect_list(raising), asc=False).alias("_raising")
    )
    best = F.transform(F.slice("_raising", 1, limit), lambda b: b["term"])
    return gathered.select(*keep, "total", best.alias("top_terms"))
