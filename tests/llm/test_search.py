"""Ranked lexical search: against scoring every document in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from textrisk.llm import search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """Every document scored for every item, as the contract says."""
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    big_n = len(counted)
    big_l = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    result = []
    for item_id, text in items:
        scores = []
        for row, (doc_id, c) in enumerate(counted):
            n = sum(c.values())
            m = 10 + (90 * n * big_n) // big_l
            score = 0
            for t in set(_terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id if doc_id is not None else 0, row))
        for rank, (neg, _, _, row) in enumerate(sorted(scores)[:k], 1):
            result.append((item_id, rank, counted[row][0], -neg))
    return sorted(result, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    q = spark.createDataFrame(items, ITEMS)
    got = [tuple(r) for r in search.search(d, q, **kw).collect()]
    return sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_search_equals_scoring_every_document(spark):
    rnd = random.Random(7)
    common = ["the", "of", "and", "a", "to"]
    rare = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(300):
        words = [rnd.choice(common) for _ in range(rnd.randint(0, 40))]
        words += [rnd.choice(rare) for _ in range(rnd.randint(0, 6))]
        rnd.shuffle(words)
        docs.append((i, " ".join(words)))
    items = [(j, " ".join(rnd.choice(common + rare) for _ in range(rnd.randint(1, 8)))) for j in range(25)]
    items.append((99, "The OF and"))  # common words only: many candidates, low weights
    assert _run(spark, docs, items) == brute(docs, items)


def test_search_ties_case_and_odd_rows(spark):
    docs = [
        (5, "Apple pie"),
        (3, "apple PIE"),
        (3, "apple PIE"),
        (None, "apple pie"),
        (7, None),
        (8, ""),
        (9, "ÄPPLE straße x1 x1 " + "filler " * 50000),
        (10, "..."),
    ]
    items = [(1, "APPLE pie pie"), (2, None), (3, "äpple STRASSE x1"), (3, "nothing here"), (4, "")]
    got = _run(spark, docs, items)
    assert got == brute(docs, items)
    first = [r for r in got if r[0] == 1]
    # Equal scores: ascending doc_id, null last; repeated rows ranked each.
    assert [r[2] for r in first] == [3, 3, 5, None] and [r[1] for r in first] == [1, 2, 3, 4]
    assert {r[2] for r in got if r[0] == 3} == {9}


def test_search_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 0)], DOCS).selectExpr("*", "1 as term", "2 as _row", "3 as tf", "4 as m")
    items = spark.createDataFrame([(1, "b")], ITEMS).selectExpr("*", "5 as _item", "6 as term")
    got = search.search(docs, items).collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [(1, 1, 1)]
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0


def test_k_below_ten_cuts_by_rank(spark):
    docs = [(i, "x " * (i % 4 + 1) + "y") for i in range(40)]
    items = [(1, "x"), (2, "y x")]
    assert _run(spark, docs, items, k=3) == brute(docs, items, k=3)
