"""Frequent and rare terms of a large vocabulary take different ways to one result."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from textrisk.functions.numeric import NUMERIC_FEATURES
from textrisk.operators import tfidf
from textrisk.plans.analyze import assess
from textrisk.plans.model import RiskModel, Weights


@pytest.fixture(scope="module")
def records(spark):
    texts = [f"alpha beta beta gamma{i % 3} delta{i % 5} " + ("mail a@b.co" if i % 2 else "quiet garden") for i in range(30)]
    texts += ["", None, texts[0], "unknown"]
    rows = [(str(i), f"2024-01-01T00:{i:02}:00Z", t, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "record_id string, created_at string, text string, community string")


@pytest.mark.parametrize("frequent", [0, 2, 1000])
def test_frequent_and_rare_terms_make_one_score(spark, records, monkeypatch, frequent):
    monkeypatch.setattr(tfidf, "_HOT_SHARE", 0)
    terms = [("alpha", 31, 1.1, -0.5), ("beta", 31, 1.1, 0.7), ("gamma0", 10, 2.0, 0.3), ("gamma1", 10, 2.0, 0.3), ("delta4", 6, 2.5, -1.0), ("garden", 15, 1.7, 0.2)]
    table = spark.createDataFrame(terms, "term string, df long, idf double, coef double")
    model = RiskModel(Weights((0.0,) * len(NUMERIC_FEATURES), 0.1, 34, 1), table, frequent_terms=frequent)
    local = {r.record_id: r for r in assess(records, model).collect()}
    rows = assess(records, replace(model, local_terms=0)).collect()
    assert len(rows) == 34 and {r.record_id for r in rows} == set(local)
    for r in rows:
        assert abs(r.p_risk - local[r.record_id].p_risk) < 1e-12 and r.top_terms == local[r.record_id].top_terms


def test_postings_of_frequent_terms_are_not_shuffled(spark):
    """Zipf's law: 20,000 terms, of which the 10,000 most frequent are broadcast."""
    terms = spark.range(1, 20_001).select(F.concat(F.lit("t"), "id").alias("term"), F.expr("1 + 1000000 div id").alias("df"))
    hot = terms.filter(tfidf.frequent_terms(terms, 10_000)).agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("least"), F.sum("df").alias("total")).first()
    assert 9_000 < hot.n <= 10_000 and hot.least > 99
    postings = spark.range(1, 20_001).select(F.concat(F.lit("t"), "id").alias("term"), F.lit(1).alias("tf"))
    assert tfidf.attach_terms(postings, terms, broadcast_terms=0).count() == 20_000
