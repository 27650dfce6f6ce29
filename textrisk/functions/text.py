"""Text cleaning columns."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textrisk.functions.patterns import SPACE


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def strip(value: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(value, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def collapse_space(value: Column) -> Column:
    """One space for every run of Unicode white space, none at the ends."""
    return F.trim(F.regexp_replace(value, rf"[{SPACE}]+", " "))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_entities(value: Column) -> Column:
    """Resolve HTML5 entities.  Only texts with an ampersand travel to Python."""
    return F.coalesce(_unescape(F.when(value.contains("&"), value)), value)


def clean_html(value: Column) -> Column:
    """Plain text of a post: tags out, entities resolved, white space collapsed.

    Entities are resolved only where the text looks like markup, that is where
    it has both angle brackets.  Null becomes the empty string.
    """
    is_markup = value.contains("<") & value.contains(">")
    stripped = F.when(is_markup, F.regexp_replace(value, "<[^>]+>", " "))
    return collapse_space(F.coalesce(unescape_entities(stripped), value, F.lit("")))
