"""Ranked lexical search over a length-stratified index.

Terms are the maximal runs of ASCII letters and digits and of characters beyond
ASCII in the whole text, ASCII letters lower-cased (nothing else is folded).  With
N the documents that have a term, L all their terms, n a document's terms, df the
documents that hold a term and tf its count in one document, a term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))) and a document has the normaliser
m = 10 + (90 n N) div L.  A query's score for a document sums, over the query's
distinct terms, w * ((10^9 tf) div (1000 tf + 8 m)); all in 64-bit integers.

Two passes over the documents:

1. N, L and the df of every query term: each task counts its own documents and
   sends one row per query term it met and one with its N and L; Spark adds them
   up, so a very common term sends one row per task.
2. Each task indexes its own documents: it groups them by m (a stratum), lists
   the postings of query terms by tf within a stratum and computes the impact
   (10^9 tf) div (1000 tf + 8 m) once per (m, tf).  Strata are visited by falling
   bound (per query, its weights times the largest impact of each term in the
   stratum); a stratum whose bound stays under every query's k-th best score so
   far is skipped whole, the others are scored exactly as one matrix product
   (integers far below 2^53, so exact in doubles).  A task sends only its ``k``
   best documents per query; Spark ranks those.

No document that can reach the top ``k`` is skipped, so the result equals scoring
every document, and nothing grows with queries times documents.  Queries are
taken in blocks of ``QUERY_BLOCK``, one pass 2 per block.

Defined results: null and empty texts have no terms and are never returned; a null
query text finds nothing; queries and documents are rows, so repeated rows are
ranked each (equal documents get equal scores and adjacent ranks); equal scores
rank by ascending doc_id, nulls last; documents with score 0 are never returned;
other columns of the inputs are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the contract: the term pattern and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WEIGHT_SCALE = 1000
IMPACT_SCALE = 1_000_000_000
TF_SCALE = 1000
NORM_FACTOR = 8
NORM_BASE = 100
NORM_SLOPE = 90
#: Documents returned per query.
TOP_K = 10
#: Parameters: queries per pass over the documents, documents per scored block.
QUERY_BLOCK = 2000
DOC_BLOCK = 512

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER_ASCII = str.maketrans(_UPPER, _UPPER.lower())
_TERM_RE = re.compile(TERM)


def terms(text: Column) -> Column:
    """The terms of a text, in order, with repeats; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.regexp_extract_all(lowered, F.lit(TERM), 0)


def text_terms(text: str | None) -> list[str]:
    """The same terms in Python."""
    return _TERM_RE.findall(text.translate(_LOWER_ASCII)) if text else []


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + NORM_FACTOR * m)


def weight(df: int, n_docs: int) -> int:
    """floor(1000 ln((2N + 2) / (2 df + 1))), in doubles."""
    return int(np.floor(WEIGHT_SCALE * np.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0))))


def _counter(vocabulary: frozenset):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: Counter = Counter()
        n_docs = n_terms = 0
        for batch in batches:
            for text in batch["text"]:
                found = text_terms(text)
                if found:
                    n_docs += 1
                    n_terms += len(found)
                    df.update(vocabulary.intersection(found))
        terms_ = [None, *df]
        yield pd.DataFrame({"term": terms_, "df": [n_docs, *df.values()], "l": [n_terms, *([0] * len(df))]})

    return count


def corpus_counts(docs: DataFrame, asked: list[str], text: str = "text") -> tuple[int, int, dict[str, int]]:
    """N, L and the df of the ``asked`` terms, in one pass: each task counts its
    documents and sends one row per asked term it met and one (null term) with
    its N and L; Spark adds them up."""
    parts = docs.select(F.col(text).alias("text")).mapInPandas(_counter(frozenset(asked)), "term string, df long, l long")
    counts = parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("l").alias("l")).collect()
    n_docs, n_terms, df = 0, 0, {}
    for row in counts:
        if row.term is None:
            n_docs, n_terms = int(row.df), int(row.l)
        else:
            df[row.term] = int(row.df)
    return n_docs, n_terms, df


class _Best:
    """The k best (score, doc) of each query so far, in the order of the result."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.score = np.zeros((n_queries, 0), dtype=np.int64)
        self.null = np.zeros((n_queries, 0), dtype=bool)
        self.ids = np.zeros((n_queries, 0), dtype=np.int64)

    def floor(self) -> np.ndarray:
        """Per query the k-th best score, or 0 while fewer are known."""
        if self.score.shape[1] < self.k:
            return np.zeros(self.score.shape[0], dtype=np.int64)
        return self.score[:, self.k - 1]

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """Merge a block of documents: ``scores`` (queries x documents)."""
        n_docs = scores.shape[1]
        score = np.concatenate([self.score, scores], axis=1)
        nulls = np.concatenate([self.null, np.broadcast_to(null, (len(score), n_docs))], axis=1)
        doc = np.concatenate([self.ids, np.broadcast_to(ids, (len(score), n_docs))], axis=1)
        # Falling score, then ascending id with nulls last.
        order = np.lexsort((doc, nulls, -score), axis=1)[:, : self.k]
        self.score = np.take_along_axis(score, order, axis=1)
        self.null = np.take_along_axis(nulls, order, axis=1)
        self.ids = np.take_along_axis(doc, order, axis=1)


def _scan(texts: pd.Series, ids: pd.Series, vocabulary: dict, weights: np.ndarray, n_docs: int, n_terms: int, best: _Best) -> None:
    """Score one block of documents, stratum by stratum."""
    lists = [text_terms(t) for t in texts]
    n = np.array([len(t) for t in lists], dtype=np.int64)
    m = NORM_BASE - NORM_SLOPE + (NORM_SLOPE * n * n_docs) // max(n_terms, 1)
    doc, vid, tf = [], [], []
    for i, found in enumerate(lists):
        for term, count in Counter(t for t in found if t in vocabulary).items():
            doc.append(i)
            vid.append(vocabulary[term])
            tf.append(count)
    if not doc:
        return
    doc, vid, tf = np.array(doc), np.array(vid), np.array(tf, dtype=np.int64)
    post_m = m[doc]
    # Impacts once per (m, tf).
    pairs, back = np.unique(np.stack([post_m, tf]), axis=1, return_inverse=True)
    impacts = impact(pairs[1], pairs[0])[back.ravel()].astype(np.float64)
    null = ids.isna().to_numpy()
    id_values = ids.fillna(0).astype(np.int64).to_numpy()
    strata = np.unique(post_m)
    # Bound of a stratum for each query: weights times the largest impact of each term in it.
    bounds = []
    for s in strata:
        inside = post_m == s
        terms_in, where = np.unique(vid[inside], return_inverse=True)
        top = np.zeros(len(terms_in))
        np.maximum.at(top, where, impacts[inside])
        bounds.append(top @ weights[terms_in])
    for idx in np.argsort([-b.max() for b in bounds], kind="stable"):
        if np.all(bounds[idx] < best.floor()):
            continue
        inside = post_m == strata[idx]
        docs_in, rows = np.unique(doc[inside], return_inverse=True)
        terms_in, cols = np.unique(vid[inside], return_inverse=True)
        block = np.zeros((len(docs_in), len(terms_in)))
        block[rows, cols] = impacts[inside]
        scores = np.rint(block @ weights[terms_in]).astype(np.int64).T  # queries x documents
        best.add(scores, null[docs_in], id_values[docs_in])


def _scorer(vocabulary: dict, weights: np.ndarray, query_ids: np.ndarray, n_docs: int, n_terms: int, k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(len(query_ids), k)
        for batch in batches:
            for start in range(0, len(batch), DOC_BLOCK):
                part = batch.iloc[start : start + DOC_BLOCK]
                _scan(part["text"], part["doc_id"], vocabulary, weights, n_docs, n_terms, best)
        q, j = np.nonzero(best.score > 0)
        ids = pd.array(best.ids[q, j], dtype="Int64")
        ids[best.null[q, j]] = pd.NA
        yield pd.DataFrame({"_item": query_ids[q], "doc_id": ids, "score": best.score[q, j]})

    return score


def search(
    docs: DataFrame,
    queries: DataFrame,
    *,
    k: int = TOP_K,
    id_col: str = "doc_id",
    text: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each query's ``k`` best documents with
    a score above 0, best first."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    asked = queries.select(
        F.col(query_id).cast("long").alias("item_id"), F.array_distinct(terms(F.col(query_text))).alias("_terms")
    )
    # A stated query set: its terms come to the driver, a block at a time.
    items = asked.collect()
    if not items:
        return spark.createDataFrame([], schema)
    pages = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n_docs, n_terms, df = corpus_counts(pages, sorted({t for row in items for t in row._terms}))
    results = []
    for first in range(0, len(items), QUERY_BLOCK):
        block = items[first : first + QUERY_BLOCK]
        vocabulary: dict[str, int] = {}
        for row in block:
            for t in row._terms:
                if t in df and weight(df[t], n_docs) > 0:
                    vocabulary.setdefault(t, len(vocabulary))
        weights = np.zeros((len(vocabulary), len(block)))
        for j, row in enumerate(block):
            for t in row._terms:
                if t in vocabulary:
                    weights[vocabulary[t], j] = weight(df[t], n_docs)
        query_ids = np.arange(first, first + len(block))
        scorer = _scorer(vocabulary, weights, query_ids, n_docs, n_terms, k)
        results.append(pages.mapInPandas(scorer, "_item long, doc_id long, score long"))
    local = results[0]
    for more in results[1:]:
        local = local.unionByName(more)
    place = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = local.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(items)], "_item long, item_id long")
    return ranked.join(F.broadcast(names), "_item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
