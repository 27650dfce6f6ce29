"""The eight numeric features of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textrisk.functions.patterns import WORD

# Feature names, in the order of the feature vector.
NUMERIC_FEATURES = (
    "length_chars",
    "length_words",
    "count_digits",
    "num_pii_spans",
    "num_unique_pii_types",
    "count_emails",
    "count_phones",
    "count_urls",
)

# Decimal digits, and the characters that are digits without being decimal ones
# (superscripts, circled digits and the like).  The intersection with all numbers
# comes first because it rules out letters with one test.
_DIGITS = (
    r"[\p{N}&&[\p{Nd}²³¹፩-፱᧚⁰⁴-⁹₀-₉"
    r"①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾"
    r"➀-➈➊-➒\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}"
    r"\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]]"
)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{WORD}]+"))


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_DIGITS))


def numeric_features(text: Column, spans: Column) -> dict[str, Column]:
    """Feature columns by name; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def spans_of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["type"] == kind))

    values = (
        F.length(text),
        word_count(text),
        digit_count(text),
        F.size(spans),
        F.size(F.array_distinct(F.transform(spans, lambda s: s["type"]))),
        spans_of("EMAIL"),
        spans_of("PHONE"),
        spans_of("URL"),
    )
    return {name: value.cast("double") for name, value in zip(NUMERIC_FEATURES, values)}
