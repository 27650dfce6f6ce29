"""Analysis of a table of texts, by rule and by model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.functions import scoring
from textrisk.operators.findings import with_rule_columns, with_spans
from textrisk.plans.model import RiskModel


def analyze(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Add spans, rule score, counts, explanation, types, weak label, redaction."""
    return with_rule_columns(with_spans(df, text=text), text=text)


def with_combined_score(df: DataFrame, *, rule: str = "rule_score", p_risk: str = "p_risk") -> DataFrame:
    """Add ``ml_score``, ``final_score`` and ``interpretation``."""
    scored = df.withColumn("ml_score", scoring.ml_score(F.col(p_risk)))
    rule_score, ml = F.col(rule), F.col("ml_score")
    return scored.withColumns(
        {
            "final_score": scoring.final_score(rule_score, ml),
            "interpretation": scoring.interpretation(rule_score, ml),
        }
    )


def assess(df: DataFrame, model: RiskModel, *, text: str = "text") -> DataFrame:
    """``analyze`` plus the model's probability, its top terms and the combined score."""
    return with_combined_score(model.predict(analyze(df, text=text), text=text))
