"""Raw records to the canonical record table.

Each normalizer keeps every input row and adds ``reject_reason`` (null for good
rows), so that nothing is lost silently; ``accepted`` and ``rejected`` split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrisk.functions.identity import account_identifier, author_hash, first_authority
from textrisk.functions.isotime import epoch_to_iso, to_iso_utc
from textrisk.functions.text import blank_to_null, clean_html, strip
from textrisk.schema import RECORD, REQUIRED_COLUMNS

# Fixed value: the corpus of ``from_labelled_dump`` has no timestamps of its own.
DEFAULT_CREATED_AT = "2025-01-01T00:00:00Z"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _canonical(df: DataFrame, early_reason: Column) -> DataFrame:
    """Order the columns, derive the partition columns, find the reject reason."""
    reason = F.coalesce(
        F.when(F.col("malformed"), F.lit("malformed")),
        early_reason,
        *[F.when(F.col(name).isNull(), F.lit(f"missing {name}")) for name in REQUIRED_COLUMNS],
    )
    dated = df.withColumns(
        {"year": F.substring("created_at", 1, 4), "month": F.substring("created_at", 6, 2)}
    )
    return dated.select(*RECORD.fieldNames(), reason.alias("reject_reason"))


def reddit(raw: DataFrame) -> DataFrame:
    """A record with a title or a self text is a post, any other a comment."""
    title, selftext = F.coalesce(_col("title"), F.lit("")), F.coalesce(_col("selftext"), F.lit(""))
    is_post = (title != "") | (selftext != "")
    text = F.when(is_post, strip(F.concat(title, F.lit("\n\n"), selftext))).otherwise(
        strip(F.coalesce(_col("body"), F.lit("")))
    )
    shaped = raw.select(
        "malformed",
        F.lit("reddit").alias("platform"),
        F.when(is_post, F.lit("post")).otherwise(F.lit("comment")).alias("record_type"),
        _col("id").alias("record_id"),
        author_hash(_col("author")).alias("author_id_hash"),
        epoch_to_iso(_col("created_utc")).alias("created_at"),
        text.alias("text"),
        blank_to_null(_col("subreddit")).alias("community"),
        F.when(~is_post, _col("parent_id")).alias("parent_record_id"),
        blank_to_null(_col("link_id")).alias("thread_id"),
    )
    return _canonical(shaped, F.lit(None).cast("string"))


def mastodon(raw: DataFrame) -> DataFrame:
    """Posts with their host as community; a post needs a time and some text."""
    written = F.coalesce(blank_to_null(_col("created_at")), blank_to_null(_col("created_at_utc")))
    content = F.coalesce(blank_to_null(_col("content")), blank_to_null(_col("text")))
    shaped = raw.select(
        "malformed",
        written.isNull().alias("no_time"),
        content.isNull().alias("no_text"),
        F.lit("mastodon").alias("platform"),
        F.lit("post").alias("record_type"),
        _col("id").alias("record_id"),
        author_hash(
            account_identifier(_col("account"), _col("account.id"), _col("account.acct"), _col("account.username"))
        ).alias("author_id_hash"),
        to_iso_utc(written).alias("created_at"),
        clean_html(content).alias("text"),
        first_authority(_col("uri"), _col("url")).alias("community"),
        blank_to_null(_col("in_reply_to_id")).alias("parent_record_id"),
        blank_to_null(_col("conversation_id")).alias("thread_id"),
    )
    reason = (
        F.when(F.col("no_time"), F.lit("missing created_at"))
        .when(F.col("no_text"), F.lit("missing text"))
        .when(F.col("created_at").isNull(), F.lit("unreadable created_at"))
    )
    return _canonical(shaped, reason)


NORMALIZERS = {"reddit": reddit, "mastodon": mastodon}


def _where(labelled: DataFrame, keep: Column, columns: list[str]) -> DataFrame:
    """Rows for which ``keep`` holds.

    A plain filter would be moved below the parsing, which then runs once more
    for every field the reject reason depends on; a generator stays in place.
    """
    row = F.struct(*columns)
    return labelled.select(F.explode(F.when(keep, F.array(row))).alias("row")).select("row.*")


def accepted(labelled: DataFrame) -> DataFrame:
    return _where(labelled, F.col("reject_reason").isNull(), RECORD.fieldNames())


def rejected(labelled: DataFrame) -> DataFrame:
    return _where(labelled, F.col("reject_reason").isNotNull(), labelled.columns)


def ingest_counters(labelled: DataFrame) -> DataFrame:
    """One row: records read, written and skipped."""
    good = F.col("reject_reason").isNull()
    return labelled.agg(
        F.count(F.lit(1)).alias("total_read"),
        F.count_if(good).alias("total_written"),
        F.count_if(~good).alias("total_skipped"),
    )


def from_labelled_dump(raw: DataFrame) -> DataFrame:
    """Rows of a labelled corpus in the shape that mastodon ingest reads."""
    return raw.select(
        "id",
        F.lit(DEFAULT_CREATED_AT).alias("created_at"),
        F.coalesce("text", F.lit("")).alias("text"),
        _col("binary label").alias("binary_label"),
        _col("multi-class label").alias("multi_class_label"),
        _col("multi-label label").alias("multi_label_label"),
    )
