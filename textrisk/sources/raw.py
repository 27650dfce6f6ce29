"""Raw dumps of posts and comments: JSON lines or CSV, batch or streaming.

Every raw table has one string column per known field and a boolean column
``malformed`` for lines that are not one JSON object.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrisk.functions.jsontext import sole_object
from textrisk.functions.patterns import SPACE
from textrisk.functions.text import strip
from textrisk.operators.prefix import ROW_ORDER, first_rows, with_position
from textrisk.schema import RAW_FIELDS

_FORMATS = {".jsonl": "jsonl", ".csv": "csv"}


# Lines that are not blank.
_HAS_TEXT = f"value RLIKE r'[^{SPACE}]'"


def format_of(path: str) -> str:
    """Input format by file name; anything but .jsonl and .csv is an error."""
    for suffix, name in _FORMATS.items():
        if path.lower().endswith(suffix):
            return name
    raise ValueError("Input must be .jsonl or .csv")


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def parse_json_lines(lines: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Table of raw records from a table with a text column ``value``.

    Blank lines vanish.  A line must be one JSON object and nothing else.  Other
    columns of ``lines`` are kept.
    """
    record = ",".join(f"`{name}`:string" for name in fields)
    others = [c for c in lines.columns if c != "value"]
    parsed = lines.filter(_HAS_TEXT).select(*others, sole_object(strip(F.col("value")), f"struct<{record}>").alias("object"))
    return parsed.select(
        *others,
        F.col("object").isNull().alias("malformed"),
        *[F.col("object").getField(name).alias(name) for name in fields],
    )


def _read_csv(spark: SparkSession, path: str, multi_line: bool, positions: bool = False) -> tuple[DataFrame, str]:
    """All columns as text, and the name of a column that holds rows with more or
    fewer cells than the header (null for good rows).

    With ``multi_line`` the records come from ``csv_records``, so that a large file
    with line breaks inside quotes is still read by many tasks.
    """
    reader = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("quote", '"')
        .option("escape", '"')
    )
    names = reader.csv(path).columns
    broken = "_broken"
    while broken in names:
        broken += "_"
    columns = ", ".join(f"`{name.replace('`', '``')}` string" for name in [*names, broken])
    if multi_line:
        options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": broken, "mode": "PERMISSIVE"}
        where = list(ROW_ORDER) if positions else []
        parsed = csv_records(spark, path).select(F.from_csv("record", columns, options).alias("_cells"), *where)
        return parsed.select("_cells.*", *where), broken
    # Without pruning, so that a row's cells are counted whichever columns are asked for.
    whole = reader.option("multiLine", False).option("columnNameOfCorruptRecord", broken).option("columnPruning", False)
    rows = whole.schema(columns).csv(path)
    return (with_position(rows) if positions else rows), broken


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as text, read by as many tasks as the files have
    blocks, line breaks inside quotes included.  Columns: ``_file``, ``_block``,
    ``_row`` (the line where the record starts) and ``record``; the header record
    of each file and blank lines outside quotes are left out, as in Spark's reader.

    Whether a line starts inside quotes depends on all lines before it.  Each
    line's number of quotes modulo 2 says whether it flips the state; a block's
    sum is its transfer (stay or flip), the transfers of the blocks before it in
    its file (one small row per block) give the state at the block's start, and a
    window within the block the state at each line.  A line that starts outside
    quotes starts a record; one that also ends outside is a whole record and stays
    where it is.  Only lines of records over several lines are gathered, by the
    line where their record starts.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("line"),
        ((F.length("value") - F.length(F.regexp_replace("value", '"', ""))) % 2).alias("_flip"),
    )
    start_of = F.struct(F.col("_block").alias("b"), F.col("_row").alias("r"))
    blocks = lines.groupBy("_file", "_block").agg(F.sum("_flip").alias("_turn"), F.min(start_of).alias("_first"))
    earlier_blocks = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    entry = blocks.select(
        "_file",
        "_block",
        (F.coalesce(F.sum("_turn").over(earlier_blocks), F.lit(0)) % 2).alias("_entry"),
        F.min("_first").over(Window.partitionBy("_file")).alias("_file_first"),
    )
    in_block = Window.partitionBy("_file", "_block").orderBy("_row")
    stated = (
        lines.join(F.broadcast(entry), ["_file", "_block"])
        .withColumn("_starts", (F.col("_entry") + F.coalesce(F.sum("_flip").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2 == 0)
        .withColumn("_own", F.max(F.when(F.col("_starts"), start_of)).over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # Lines of a block before its first start belong to the last start of a block before.
    carried = (
        stated.groupBy("_file", "_block")
        .agg(F.max(F.when(F.col("_starts"), start_of)).alias("_last"))
        .select("_file", "_block", F.last("_last", ignorenulls=True).over(earlier_blocks).alias("_from"))
    )
    keyed = stated.join(F.broadcast(carried), ["_file", "_block"]).withColumn("_key", F.coalesce("_own", "_from"))
    single = F.col("_starts") & (F.col("_flip") == 0)
    whole = keyed.where(single).select("_file", "_key", "_file_first", F.col("line").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("_block", "_row", "line")))
    spread = (
        keyed.where(~single)
        .groupBy("_file", "_key")
        .agg(F.first("_file_first").alias("_file_first"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("record"))
    )
    records = whole.unionByName(spread)
    return records.where((F.col("_key") != F.col("_file_first")) & (F.col("record") != "")).select(
        "_file", F.col("_key.b").alias("_block"), F.col("_key.r").alias("_row"), "record"
    )


def _align_csv(rows: DataFrame, broken: str, fields: Sequence[str]) -> DataFrame:
    """The known fields of a CSV table; blank cells are empty strings, absent
    columns are null.  Rows with more or fewer cells than the header are malformed."""
    present = set(rows.columns) - {broken}
    others = [c for c in ROW_ORDER if c in present]
    return rows.select(
        *others,
        _quoted(broken).isNotNull().alias("malformed"),
        *[
            (F.coalesce(_quoted(name), F.lit("")) if name in present else F.lit(None).cast("string")).alias(name)
            for name in fields
        ],
    )


def read_raw(
    spark: SparkSession,
    path: str,
    platform: str,
    *,
    format: str | None = None,
    max_rows: int | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Raw records of a platform ("reddit" or "mastodon").

    ``format`` overrides the file name, for directories and globs.  ``max_rows``
    takes the first rows in file order, malformed ones included.  CSV with line
    breaks inside quotes needs ``multi_line``; without such breaks turn it off,
    so that Spark may split large files.
    """
    fields = RAW_FIELDS[platform]
    kind = format or format_of(path)
    if kind == "jsonl":
        lines = spark.read.text(path)
        if max_rows is not None:
            lines = with_position(lines.filter(_HAS_TEXT))
        rows = parse_json_lines(lines, fields)
    elif kind == "csv":
        rows, broken = _read_csv(spark, path, multi_line, positions=max_rows is not None)
        rows = _align_csv(rows, broken, fields)
    else:
        raise ValueError("Input must be .jsonl or .csv")
    if max_rows is None:
        return rows
    return first_rows(rows, max_rows)


def stream_raw(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """The same raw table as a stream over a directory of JSON-lines files."""
    return parse_json_lines(spark.readStream.text(path), RAW_FIELDS[platform])


def read_labelled_dump(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a labelled text corpus without timestamps; a malformed line
    is an error.  See ``normalize.from_labelled_dump``."""
    return parse_labelled_dump(spark.read.text(path))


def parse_labelled_dump(lines: DataFrame) -> DataFrame:
    fields = ("id", "text", "binary label", "multi-class label", "multi-label label")
    rows = parse_json_lines(lines, fields)
    fail = F.raise_error(F.lit("Malformed JSON line"))
    return rows.select(
        *[F.when(F.col("malformed"), fail.cast("string")).otherwise(_quoted(name)).alias(name) for name in fields]
    )
