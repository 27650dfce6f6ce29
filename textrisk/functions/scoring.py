"""Rule score, weak label, explanation and score combination.

The rule functions take the counts that ``counts_by_type`` makes of a span column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from textrisk.functions.patterns import (
    DECISION_THRESHOLD,
    HIGH_SEVERITY,
    INTERPRETATION_MARGIN,
    MAX_SCORE,
    RISK_THRESHOLD,
    WEIGHTS,
)


def counts_by_type(spans: Column) -> Column:
    """``map<type, count>`` with keys in order of first appearance."""
    kinds = F.array_distinct(F.transform(spans, lambda s: s["type"]))
    counted = F.map_from_arrays(
        kinds, F.transform(kinds, lambda k: F.size(F.filter(spans, lambda s: s["type"] == k)))
    )
    return F.when(F.size(spans) > 0, counted).otherwise(F.create_map().cast("map<string,int>"))


def _weight(kind: Column, weights: Mapping[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def pii_types(counts: Column) -> Column:
    """Distinct types in alphabetical order."""
    return F.sort_array(F.map_keys(counts))


def rule_score(counts: Column, weights: Mapping[str, int] = WEIGHTS) -> Column:
    """Weight times count, summed over the types, at most 100."""
    total = F.aggregate(
        F.map_entries(counts),
        F.lit(0).cast("long"),
        lambda acc, e: acc + _weight(e["key"], weights).cast("long") * e["value"],
    )
    return F.least(total, F.lit(MAX_SCORE)).cast("int")


def explanation(counts: Column, weights: Mapping[str, int] = WEIGHTS) -> Column:
    """A sentence naming the one or two gravest types.

    Heavier types come first, then more frequent ones, then those seen earlier.
    """
    ranked = F.sort_array(
        F.transform(
            F.map_entries(counts),
            lambda e, i: F.struct(
                (-_weight(e["key"], weights)).alias("by_weight"),
                (-e["value"]).alias("by_count"),
                i.alias("by_position"),
                e["key"].alias("type"),
            ),
        )
    )
    top = F.array_join(F.transform(F.slice(ranked, 1, 2), lambda r: r["type"]), " and ")
    return F.when(F.size(counts) == 0, F.lit("No PII detected.")).otherwise(
        F.concat(F.lit("Detected "), top, F.lit(" indicators."))
    )


def weak_label(counts: Column, weights: Mapping[str, int] = WEIGHTS) -> Column:
    """1 if the score reaches the risk threshold or a high-severity type occurs."""
    severe = F.arrays_overlap(F.map_keys(counts), F.array(*[F.lit(t) for t in HIGH_SEVERITY]))
    return ((rule_score(counts, weights) >= RISK_THRESHOLD) | severe).cast("int")


def ml_score(p_risk: Column) -> Column:
    """Probability as whole percent, halves rounded to even."""
    return F.rint(p_risk * 100).cast("int")


def final_score(rule: Column, ml: Column) -> Column:
    return F.greatest(rule, ml)


def interpretation(rule: Column, ml: Column) -> Column:
    """Which of the two scores dominates; a gap of exactly the margin does not."""
    return (
        F.when(rule - ml > INTERPRETATION_MARGIN, F.lit("explicit_pii_dominant"))
        .when(ml - rule > INTERPRETATION_MARGIN, F.lit("contextually_concerning"))
        .otherwise(F.lit("ambiguous_context"))
    )


def decide(p_risk: Column) -> Column:
    """1 from the decision threshold upwards (inclusive)."""
    return (p_risk >= DECISION_THRESHOLD).cast("int")


def outcome(pred: Column, y: Column) -> Column:
    """TP, FP, TN or FN; anything that is not one of the first three is FN."""
    return (
        F.when((pred == 1) & (y == 1), F.lit("TP"))
        .when((pred == 1) & (y == 0), F.lit("FP"))
        .when((pred == 0) & (y == 0), F.lit("TN"))
        .otherwise(F.lit("FN"))
    )
