from __future__ import annotations

from pyspark.sql import functions as F

from textrisk.functions import scoring
from textrisk.operators import metrics
from textrisk.plans.analyze import analyze, with_combined_score


def test_explanations(spark):
    texts = {
        "nothing here": "No PII detected.",
        "a@b.co": "Detected EMAIL indicators.",
        "a@b.co 415-555-1234": "Detected EMAIL and PHONE indicators.",
        "415-555-1234 a@b.co": "Detected PHONE and EMAIL indicators.",
        "415-555-1234 a@b.co c@d.io": "Detected EMAIL and PHONE indicators.",
        "1.2.3.4 a@b.co 123-45-6789": "Detected SSN and EMAIL indicators.",
    }
    rows = analyze(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.text: r.explanation for r in rows} == texts


def test_counts_keep_first_seen_order(spark):
    df = analyze(spark.createDataFrame([("1.2.3.4 a@b.co 5.6.7.8",)], "text string"))
    row = df.withColumn("keys", F.map_keys("counts_by_type")).first()
    assert row["keys"] == ["IPV4", "EMAIL"]
    assert row.counts_by_type == {"IPV4": 2, "EMAIL": 1}
    assert row.pii_types == ["EMAIL", "IPV4"]
    assert row.rule_score == 45


def test_weights_are_a_parameter(spark):
    counts = F.create_map(F.lit("EMAIL"), F.lit(2), F.lit("OTHER"), F.lit(3))
    row = spark.range(1).select(scoring.rule_score(counts, {"EMAIL": 7}).alias("s")).first()
    assert row.s == 14


def test_combined_score(spark):
    cases = [
        (25, 0.35, 35, 35, "ambiguous_context"),
        (25, 0.36, 36, 36, "contextually_concerning"),
        (60, 0.1, 10, 60, "explicit_pii_dominant"),
        (0, 0.125, 12, 12, "contextually_concerning"),
        (0, 0.135, 14, 14, "contextually_concerning"),
        (10, 0.0, 0, 10, "ambiguous_context"),
        (11, 0.0, 0, 11, "explicit_pii_dominant"),
    ]
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], "rule_score int, p_risk double")
    got = [tuple(r) for r in with_combined_score(df).collect()]
    assert got == cases


def test_outcomes_and_threshold(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.49, 0), (0.49, 1)], "p_risk double, y int")
    pred = scoring.decide(F.col("p_risk"))
    assert [r.o for r in df.select(scoring.outcome(pred, F.col("y")).alias("o")).collect()] == ["TP", "FP", "TN", "FN"]


def test_rates_with_empty_denominators(spark):
    empty = spark.createDataFrame([], "y_risk int, pred_risk int")
    row = metrics.with_rates(metrics.confusion(empty)).first()
    assert tuple(row) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    data = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "y_risk int, pred_risk int")
    row = metrics.with_rates(metrics.confusion(data)).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (1, 1, 1, 2)
    assert abs(row.precision - 2 / 3) < 1e-12 and abs(row.f1 - 2 / 3) < 1e-12


def test_audit_summary_of_nothing(spark):
    row = metrics.audit_summary(spark.createDataFrame([], "bucket string, p_risk double")).first()
    assert tuple(row) == (0, 0, 0, 0, 0, 0.0)
