"""Table layouts shared by all modules."""

from __future__ import annotations

from pyspark.sql.types import (
    IntegerType,
    StringType,
    StructField,
    StructType,
)

# One finding; a span column is an array of these.
SPAN = StructType(
    [
        StructField("type", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("match", StringType()),
    ]
)

# One social-media record.  ``created_at`` stays an ISO-8601 UTC string ("...Z").
RECORD = StructType(
    [
        StructField("record_id", StringType(), False),
        StructField("author_id_hash", StringType(), False),
        StructField("created_at", StringType(), False),
        StructField("text", StringType(), False),
        StructField("community", StringType()),
        StructField("parent_record_id", StringType()),
        StructField("thread_id", StringType()),
        StructField("platform", StringType(), False),
        StructField("record_type", StringType(), False),
        StructField("year", StringType(), False),
        StructField("month", StringType(), False),
    ]
)

PARTITION_COLUMNS = ("platform", "record_type", "year", "month")
REQUIRED_COLUMNS = ("platform", "record_type", "record_id", "author_id_hash", "created_at", "text")

REDDIT_FIELDS = (
    "id",
    "author",
    "created_utc",
    "subreddit",
    "title",
    "selftext",
    "body",
    "parent_id",
    "link_id",
)
MASTODON_FIELDS = (
    "id",
    "created_at",
    "created_at_utc",
    "content",
    "text",
    "account",
    "account.id",
    "account.acct",
    "account.username",
    "in_reply_to_id",
    "conversation_id",
    "uri",
    "url",
)
RAW_FIELDS = {"reddit": REDDIT_FIELDS, "mastodon": MASTODON_FIELDS}

AUDIT_COLUMNS = (
    "record_id",
    "created_at",
    "bucket",
    "y_risk",
    "pred_risk",
    "p_risk",
    "rule_score",
    "pii_types",
    "text",
    "redacted_text",
    "community",
)
