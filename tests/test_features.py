from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from textrisk.functions.numeric import NUMERIC_FEATURES, digit_count, word_count
from textrisk.functions.text import clean_html, collapse_space, strip
from textrisk.functions.tokens import STOP_WORDS, tokenize
from textrisk.functions.identity import url_authority
from textrisk.operators import tfidf
from textrisk.operators.features import with_numeric_features, with_tokens
from textrisk.operators.findings import with_spans

TEXTS = [
    "The quick brown fox, the QUICK fox! mail a@b.co",
    "numbers 12 ٣ ² ½ Ⅷ and under_score x",
    "Ünïcode straße naïve  tab\tnewline\n",
    "",
    None,
    "call 415-555-1234 or http://x.y/z 1.2.3.4",
    "fox fox fox jumps over lazy dogs again",
]


def test_numeric_features(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    rows = {r.i: r for r in with_numeric_features(with_spans(df)).collect()}
    for i, text in enumerate(TEXTS):
        text = text or ""
        assert rows[i].length_chars == len(text)
        assert rows[i].length_words == len(re.findall(r"\w+", text))
        assert rows[i].count_digits == sum(c.isdigit() for c in text)
    assert tuple(rows[5][n] for n in NUMERIC_FEATURES[3:]) == (3.0, 3.0, 0.0, 1.0, 1.0)


def test_digit_and_word_classes(spark):
    """Every character that counts as a digit or belongs to a word, of those this
    Java version knows, against Python."""
    points = [c for c in range(1, 0x3000)] + list(range(0x10A40, 0x10A48)) + list(range(0x1F100, 0x1F110))
    df = spark.createDataFrame([(c, chr(c)) for c in points], "i int, c string")
    known = F.col("c").rlike(r"\P{Cn}")
    rows = df.filter(known).select("i", digit_count(F.col("c")).alias("d"), word_count(F.col("c")).alias("w")).collect()
    assert len(rows) > 9000
    for r in rows:
        assert bool(r.d) == chr(r.i).isdigit(), hex(r.i)
        assert bool(r.w) == bool(re.match(r"\w", chr(r.i))), hex(r.i)


def test_text_cleaning(spark):
    cases = ["  a \x1c b c\x85 ", "<p>a</p><p>b &lt;c&gt;</p>", "a &amp; b", "<b>&amp;lt;</b>", "x < y", "<>", "a<br/>&nbsp;b", ""]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    rows = df.select("c", strip(F.col("c")).alias("s"), collapse_space(F.col("c")).alias("k"), clean_html(F.col("c")).alias("h")).collect()
    for r in rows:
        assert r.s == r.c.strip() and r.k == " ".join(r.c.split())
    assert [r.h for r in rows] == ["a b c", "a b <c>", "a &amp; b", "&lt;", "x < y", "<>", "a b", ""]


def test_authorities(spark):
    urls = {
        "https://example.com/@a/1": "example.com", "http://u:p@h:80?q": "u:p@h:80", "//h/x": "h", "/path": None, "tag:x": None,
        "http://[::1]:80/x": "[::1]:80", "http://[bad/x": None, "http://a b/c": "a b", " https://x.y#f": "x.y", "": None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_authority(F.col("u")).alias("a"))
    assert {r.u: r.a for r in df.collect()} == urls


def python_tokens(text: str | None) -> list[str]:
    return [w for w in re.findall(r"\b\w\w+\b", (text or "").lower()) if w not in STOP_WORDS]


def test_tokens_and_stop_words(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = df.select("text", tokenize(F.col("text")).alias("t"), tokenize(F.col("text"), ["fox"]).alias("u")).collect()
    for r in rows:
        assert r.t == python_tokens(r.text)
    assert "the" in rows[0].u and "fox" not in rows[0].u


def test_tfidf_against_the_formula(spark):
    docs = {str(i): t for i, t in enumerate(TEXTS)}
    df = with_tokens(spark.createDataFrame(list(docs.items()), "record_id string, text string"))
    counts = tfidf.term_counts(df)
    expected = {(i, t): n for i, text in docs.items() for t, n in Counter(python_tokens(text)).items()}
    assert {(r.record_id, r.term): r.tf for r in counts.collect()} == expected

    n = len(docs)
    freq = Counter(t for _, t in expected)
    terms = tfidf.vocabulary(tfidf.document_frequency(df), n)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in freq.items() if d <= 0.8 * n}
    assert {r.term: r.df for r in terms.collect()} == {t: freq[t] for t in idf}

    for bound in (1000, 0):
        weighed = {(r.record_id, r.term): r.weight for r in tfidf.weigh(counts, terms, broadcast_terms=bound).collect()}
        assert set(weighed) == {k for k in expected if k[1] in idf}
        for (i, t), w in weighed.items():
            length = math.sqrt(sum((c * idf[u]) ** 2 for (j, u), c in expected.items() if j == i and u in idf))
            assert abs(w - expected[i, t] * idf[t] / length) < 1e-12


def test_document_frequency_limits():
    assert [tfidf.min_df_for(n) for n in (1, 19, 20, 1000)] == [1, 1, 5, 5]


def test_join_splits_frequent_from_rare_terms(spark):
    """A vocabulary over the bound with one term far above the others."""
    postings = spark.range(30_000).selectExpr("id AS record_id", "IF(id % 2 = 0, 'hot', concat('t', id)) AS term", "1 AS tf")
    terms = tfidf.document_frequency(postings.selectExpr("array(term) AS tokens"))
    joined = tfidf.attach_terms(postings, terms, broadcast_terms=10)
    assert joined.count() == 30_000 and joined.filter("term = 'hot' AND df = 15000").count() == 15_000
    assert "Union" in joined._jdf.queryExecution().optimizedPlan().toString()
