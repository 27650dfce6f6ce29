"""Findings: spans as a column and as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.functions import scoring
from textrisk.functions.patterns import RULES, Rule
from textrisk.functions.spans import candidate_spans, detect, redact


def with_spans(df: DataFrame, *, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the column ``spans``.  Derive everything else from that column: it is
    the expensive one, and deriving reads it without computing it again."""
    return df.withColumn("spans", detect(text, rules))


def explode_spans(df: DataFrame, *, keep: Sequence[str] = ("record_id",)) -> DataFrame:
    """One row per span, with its position among the spans of its record.

    The array is rebuilt inside the generator because Spark would otherwise add
    a filter on it, move the filter below the detection and detect twice.
    """
    spans = F.transform("spans", lambda s: s)
    return df.select(*keep, F.posexplode(spans).alias("position", "span")).select(*keep, "position", "span.*")


def candidates(df: DataFrame, *, text: str = "text", keep: Sequence[str] = ("record_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per match of any rule, overlapping ones included."""
    found = df.select(*keep, F.explode(candidate_spans(text, rules)).alias("span"))
    return found.select(*keep, "span.*")


def with_rule_columns(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Score, counts, explanation, types, weak label and redacted text from ``spans``."""
    spans, counts = F.col("spans"), F.col("counts_by_type")
    counted = df.withColumns({"counts_by_type": scoring.counts_by_type(spans), "redacted_text": redact(F.col(text), spans)})
    return counted.withColumns(
        {
            "rule_score": scoring.rule_score(counts),
            "explanation": scoring.explanation(counts),
            "pii_types": scoring.pii_types(counts),
            "y_risk": scoring.weak_label(counts),
        }
    )


def with_counts(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Add ``spans`` and ``counts_by_type`` only."""
    return with_spans(df, text=text).withColumn("counts_by_type", scoring.counts_by_type(F.col("spans")))
