"""The fit on packed rows, and vocabularies beyond 2^18 terms."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textrisk.operators import tfidf
from textrisk.plans import train as training
from textrisk.plans.analyze import assess
from textrisk.plans.train import train

SCHEMA = "record_id string, created_at string, text string, community string"


def numbered(spark, texts):
    return spark.createDataFrame([(str(i), f"2024-01-01T00:{i:02}:00Z", t, None) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(autouse=True)
def packed(monkeypatch):
    monkeypatch.setattr(training, "VECTOR_TERMS", 0)


@pytest.fixture(scope="module")
def records(spark):
    texts = [f"alpha beta beta gamma{i % 3} delta{i % 5} " + ("mail a@b.co" if i % 2 else "quiet garden") for i in range(30)]
    return numbered(spark, [*texts[:10], "", None, "beta " * 300 + "gamma1", *texts[10:]])


def test_fits_by_hashes_and_by_vectors_agree(records, monkeypatch):
    """Also for rows without terms and with more than 255 of a term, and a few rows to a value."""
    monkeypatch.setattr("textrisk.plans.fit.PACKED", 12)
    packed = train(records, tolerance=1e-5)
    monkeypatch.setattr(tfidf, "have_own_hashes", lambda terms: False)
    vectors = train(records, tolerance=1e-5)
    assert packed.metrics == vectors.metrics and packed.model.n_terms == vectors.model.n_terms
    a = {r.record_id: r for r in assess(records, packed.model).collect()}
    b = {r.record_id: r for r in assess(records, vectors.model).collect()}
    assert len(a) == 33 and all(abs(a[i].p_risk - b[i].p_risk) < 1e-6 for i in a)
    monkeypatch.setattr(training, "VECTOR_TERMS", 1 << 18)
    small = train(records, tolerance=1e-5)
    assert abs(small.model.weights.intercept - packed.model.weights.intercept) < 1e-6


def test_shares_of_the_gradient_are_added_by_spark_where_they_are_large(records, monkeypatch):
    driver = train(records, tolerance=1e-4)
    monkeypatch.setattr("textrisk.plans.fit.COLLECT_BYTES", 0)
    monkeypatch.setattr("textrisk.plans.fit.BLOCK_TERMS", 4)
    monkeypatch.setattr(training, "TASK_ROWS", 4)
    spark = train(records, tolerance=1e-4)
    assert abs(driver.model.weights.intercept - spark.model.weights.intercept) < 1e-6


def test_300_000_terms_need_no_join(spark, monkeypatch):
    """Beyond 2^18 terms every pass went through tables, and so did every score."""

    def joined(*_):
        raise AssertionError("joined")

    monkeypatch.setattr(training, "_fit_joined", joined)
    texts = [f"mail a{i}@b.co " * (i % 2) + " ".join(f"w{i}x{j}" for j in range(20_000)) for i in range(19)]
    result = train(numbered(spark, texts), tolerance=1e-2)
    assert result.model.n_terms > 1 << 18
    plan = result.model.predict(spark.createDataFrame([("some text",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_equal_hashes_are_noticed(spark):
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    assert tfidf.have_own_hashes(terms)
    assert not tfidf.have_own_hashes(terms.unionByName(terms.filter(F.col("term") == "b")))
