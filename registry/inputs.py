"""Tables in the shape the library expects, derived from the given tables.

Expressions that both engines understand are kept as text and used on either
side; they only build inputs and never compute a result that is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One short text per order, so that all kinds of personal data and all kinds of
# overlap occur.  Understood by Spark SQL and DuckDB alike.
_K = "cast(o_orderkey as string)"
_C = "cast(o_custkey as string)"


def _digits(value: str, width: int) -> str:
    return f"lpad(cast(({value}) % {10 ** width} as string), {width}, '0')"


NOTE_TEXT = f"""
CASE o_orderkey % 14
  WHEN 0 THEN 'Mail user' || {_C} || '@example' || cast(o_custkey % 7 as string) || '.org or call 415-555-' || {_digits('o_orderkey', 4)}
  WHEN 1 THEN 'See https://shop.example.com/o/' || {_K} || '?u=a' || {_C} || '@mail.example.com).'
  WHEN 2 THEN 'SSN ' || {_digits('o_custkey', 3)} || '-' || {_digits('o_orderkey', 2)} || '-' || {_digits('o_orderkey', 4)}
       || ' and card 4111 1111 ' || {_digits('o_orderkey', 4)} || ' ' || {_digits('o_custkey', 4)}
  WHEN 3 THEN 'Born ' || cast(1 + o_orderkey % 12 as string) || '/' || cast(1 + o_custkey % 28 as string) || '/19' || {_digits('o_orderkey', 2)}
  WHEN 4 THEN cast(1 + o_custkey % 900 as string) || ' Elm Street near 10.' || cast(o_orderkey % 256 as string) || '.' || cast(o_custkey % 256 as string) || '.7'
  WHEN 5 THEN '+1 (415) 555-' || {_digits('o_orderkey', 4)} || ' then x+1 415 555 ' || {_digits('o_custkey', 4)}
  WHEN 6 THEN '1234 5678 9012 ' || {_digits('o_orderkey', 4)} || ' Elm St'
  WHEN 7 THEN '12-12-2020-' || {_digits('o_orderkey', 4)} || ' 1.2.3.4.5.6.7.' || cast(o_custkey % 256 as string)
  WHEN 8 THEN '10 12/25/1990 Park Ave, 10 Mill St 20 Hill Rd, order ' || {_K}
  WHEN 9 THEN 'a' || {_K} || '@b.co,c@d.io mailto http://x.y/1?t=4155551234&u=a@b.co end'
  WHEN 10 THEN 'Priority ' || o_orderpriority || ', nothing else'
  WHEN 11 THEN 'call 415-555-' || {_digits('o_orderkey', 4)} || ' Oak Rd or 999 123-45-' || {_digits('o_custkey', 4)} || ' elm drive'
  WHEN 12 THEN ''
  ELSE 'Señor order ' || {_K} || ' status ' || o_orderstatus
END
"""


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  The test tables are single row groups, which only one task
    can read, so a small table is dealt out to all cores.  A table that makes
    several tasks per core is left as it is."""
    rows = scan(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 4 * cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records, one per minute."""
    from textrisk.functions.isotime import epoch_to_iso

    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"),
        epoch_to_iso(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"),
        "text",
        F.col("source").alias("community"),
    )


DOCUMENTS = """
SELECT cast(doc_id AS string) AS record_id,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
       text, source AS community
FROM documents
"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short text per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("record_id"), F.expr(NOTE_TEXT).alias("text")
    )


NOTES = f"SELECT cast(o_orderkey AS string) AS record_id, {NOTE_TEXT} AS text FROM orders"


# The same with blanks around some texts.
_PADDED = f"CASE WHEN o_orderkey % 3 = 0 THEN '  ' || ({NOTE_TEXT}) || ' ' || chr(10) ELSE {NOTE_TEXT} END"


def padded_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.expr(_PADDED).alias("text"),
        F.lit("orders").alias("community"),
    )


PADDED_NOTES = (
    "SELECT cast(o_orderkey AS string) AS record_id, '2024-01-01T00:00:00Z' AS created_at, "
    f"{_PADDED} AS text, 'orders' AS community FROM orders"
)


def customer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per customer: the notes of all its orders."""
    noted = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr(NOTE_TEXT).alias("note"))
    gathered = noted.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "note"))).alias("notes"))
    return gathered.select(F.col("o_custkey").cast("string").alias("record_id"), F.array_join("notes.note", " ").alias("text"))


CUSTOMER_NOTES = (
    f"SELECT cast(o_custkey AS string) AS record_id, string_agg({NOTE_TEXT}, ' ' ORDER BY o_orderkey) AS text "
    "FROM orders GROUP BY o_custkey"
)


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells of a CSV dump; written without quotes, the commas in some bodies make further cells."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.expr("'user' || cast(o_custkey AS string)").alias("author"),
        F.expr("CASE WHEN o_orderkey % 5 > 0 THEN cast(unix_timestamp(o_orderdate) AS string) ELSE 'n/a' END").alias("created_utc"),
        F.expr("'t3_' || cast(o_custkey AS string)").alias("parent_id"),
        F.expr("'t3_' || cast(o_custkey AS string)").alias("link_id"),
        F.expr("CASE o_orderkey % 7 WHEN 2 THEN 'one,two' WHEN 3 THEN 'one,two,three' ELSE 'order ' || cast(o_orderkey AS string) END").alias("body"),
    )


def reddit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines of a reddit dump, some of them blank or broken."""
    orders = table(spark, sf_dir, "orders")
    is_post = "o_orderkey % 2 = 0"
    fields = orders.select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderkey % 19 <> 5 THEN cast(o_orderkey AS string) END").alias("id"),
        F.expr("CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_custkey % 7 <> 1 THEN 'user' || cast(o_custkey AS string) END").alias("author"),
        F.expr(
            "CASE o_orderkey % 10 WHEN 3 THEN 'n/a' WHEN 4 THEN '' "
            "WHEN 5 THEN cast(unix_timestamp(o_orderdate) AS string) || '.25' "
            "ELSE cast(unix_timestamp(o_orderdate) AS string) END"
        ).alias("created_utc"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END").alias("subreddit"),
        F.expr(f"CASE WHEN {is_post} THEN 'Order ' || cast(o_orderkey AS string) || ' ' END").alias("title"),
        F.expr(f"CASE WHEN {is_post} AND o_custkey % 3 > 0 THEN '\tstatus ' || o_orderstatus || '\n' WHEN {is_post} THEN '' END").alias("selftext"),
        F.expr(f"CASE WHEN NOT {is_post} THEN ' reply by ' || cast(o_custkey AS string) || '  ' END").alias("body"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 't3_' || cast(o_custkey AS string) END").alias("parent_id"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 't3_' || cast(o_custkey AS string) END").alias("link_id"),
    )
    line = F.to_json(F.struct(*fields.columns[1:]))
    return fields.select(
        F.expr("o_orderkey % 23").alias("_kind"), line.alias("_line")
    ).select(
        F.when(F.col("_kind") == 7, F.lit("  \t"))
        .when(F.col("_kind") == 8, F.expr("substr(_line, 1, length(_line) - 1)"))
        .when(F.col("_kind") == 9, F.expr("_line || ' trailing'"))
        .when(F.col("_kind") == 10, F.expr("_line || _line"))
        .when(F.col("_kind") == 11, F.expr("'[' || _line || ']'"))
        .when(F.col("_kind") == 12, F.expr("'  ' || _line || ' '"))
        .when(F.col("_kind") == 13, F.expr("_line || ']'"))
        .when(F.col("_kind") == 14, F.expr("_line || '] trailing {}'"))
        .when(F.col("_kind") == 15, F.expr("_line || '],[' || _line"))
        .when(F.col("_kind") == 16, F.expr("_line || ',\"member\":' || _line"))
        .otherwise(F.col("_line"))
        .alias("value")
    )


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as JSON lines: the first turn a post, later ones comments."""
    return table(spark, sf_dir, "conversations").select(
        F.to_json(
            F.struct(
                F.expr("cast(conv_id AS string) || '-' || cast(turn AS string)").alias("id"),
                F.col("role").alias("author"),
                (F.lit(1735689600) + F.col("conv_id") * 60 + F.col("turn")).alias("created_utc"),
                F.expr("CASE WHEN turn = 0 THEN text END").alias("selftext"),
                F.expr("CASE WHEN turn > 0 THEN text END").alias("body"),
                F.expr("CASE WHEN turn > 0 THEN cast(conv_id AS string) || '-' || cast(turn - 1 AS string) END").alias("parent_id"),
                F.expr("cast(conv_id AS string)").alias("link_id"),
            )
        ).alias("value")
    )


def mastodon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON lines of a mastodon dump."""
    p = "page_id"
    stamp = "date_format(timestamp_seconds(1735689600 + page_id * 3600), \"yyyy-MM-dd'T'HH:mm:ss\")"
    name = f"cast({p} AS string)"
    return table(spark, sf_dir, "pages").select(
        F.to_json(
            F.struct(
                F.expr(f"CASE WHEN {p} % 17 <> 3 THEN {p} END").alias("id"),
                F.expr(
                    f"CASE {p} % 6 WHEN 0 THEN {stamp} || 'Z' WHEN 1 THEN {stamp} || '+02:00' WHEN 2 THEN {stamp} "
                    f"WHEN 3 THEN {stamp} || '.250000Z' WHEN 4 THEN '' ELSE 'yesterday' END"
                ).alias("created_at"),
                F.expr(f"CASE WHEN {p} % 6 = 4 AND {p} % 5 <> 0 THEN {stamp} || '-0530' END").alias("created_at_utc"),
                F.expr(f"CASE WHEN {p} % 8 < 6 THEN html ELSE '' END").alias("content"),
                F.expr(f"CASE WHEN {p} % 8 = 6 THEN '  plain &amp; simple' || chr(9) || {name} || '  ' END").alias("text"),
                F.expr(
                    f"CASE {p} % 4 WHEN 0 THEN to_json(named_struct('id', {p}, 'acct', 'a')) "
                    f"WHEN 1 THEN to_json(named_struct('id', '', 'acct', 'acct' || {name})) "
                    "WHEN 2 THEN '{broken' END"
                ).alias("account"),
                F.expr(f"CASE WHEN {p} % 3 = 0 THEN 'flat' || {name} END").alias("account.username"),
                F.expr(f"CASE {p} % 5 WHEN 0 THEN '' WHEN 1 THEN {name} END").alias("in_reply_to_id"),
                F.expr(f"CASE {p} % 7 WHEN 0 THEN 'conv-' || {name} END").alias("conversation_id"),
                F.expr(f"CASE {p} % 9 WHEN 0 THEN 'tag:no-authority' WHEN 1 THEN 'http://me:pw@host.example:8080?x' WHEN 2 THEN 'http://[bad/' ELSE '' END").alias("uri"),
                F.col("url"),
            )
        ).alias("value")
    )
