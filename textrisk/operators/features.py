"""Feature columns of a record: numeric features and tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.functions.numeric import numeric_features
from textrisk.functions.tokens import STOP_WORDS, tokenize


def with_numeric_features(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Add the eight numeric features; needs the column ``spans``."""
    return df.withColumns(numeric_features(F.col(text), F.col("spans")))


def with_tokens(df: DataFrame, *, text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    return df.withColumn("tokens", tokenize(F.col(text), stop_words))
