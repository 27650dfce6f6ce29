"""The record table on disk, and JSON-lines export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textrisk.operators.prefix import first_rows, with_position
from textrisk.schema import PARTITION_COLUMNS, RECORD


def write_records(records: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write Parquet partitioned by platform, record type, year and month.

    The rebalance hint gathers each partition's rows into few files and lets
    adaptive execution cut a month that holds a large share of the rows into
    pieces of normal size.  ``overwrite`` replaces only the partitions that
    occur in ``records``.
    """
    (
        records.select(*RECORD.fieldNames())
        .hint("rebalance", *PARTITION_COLUMNS)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(path)
    )


def read_records(spark: SparkSession, path: str, *, max_rows: int | None = None) -> DataFrame:
    """The record table; the explicit schema keeps ``month`` a two-digit string.

    ``max_rows`` takes the first rows in the order of the files.
    """
    records = spark.read.schema(RECORD).parquet(path)
    if max_rows is None:
        return records
    return first_rows(with_position(records), max_rows)


def export_jsonl(df: DataFrame, path: str) -> None:
    """All rows as JSON lines, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_sample_jsonl(df: DataFrame, path: str, n: int = 10_000) -> None:
    """The first ``n`` rows of a file scan, in the order of the files, as JSON lines."""
    export_jsonl(first_rows(with_position(df), n), path)
