"""From a raw dump to the record table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textrisk.operators.normalize import NORMALIZERS
from textrisk.schema import PARTITION_COLUMNS
from textrisk.sources.raw import read_raw
from textrisk.sources.records import write_records
from textrisk.storage import Stored, new_path

#: Partition column of the staged rows: ``accepted`` or ``rejected``.
STATUS = "_status"


@dataclass(frozen=True)
class IngestReport:
    total_read: int
    total_written: int
    total_skipped: int


def normalize_dump(spark: SparkSession, path: str, platform: str, **options) -> DataFrame:
    """Every raw row in canonical form with its ``reject_reason``; ``options``
    are those of ``read_raw``."""
    return NORMALIZERS[platform](read_raw(spark, path, platform, **options))


def stage(labelled: DataFrame) -> Stored:
    """Write every labelled row once to the shared folder, partitioned by
    ``STATUS``; the raw dump is parsed by this one job only.

    A rebalance by status and record partition keeps the files few and cuts a
    month with a large share of the rows into pieces of normal size.
    """
    spark = labelled.sparkSession
    path = new_path(spark, "ingest")
    status = F.when(F.col("reject_reason").isNull(), F.lit("accepted")).otherwise(F.lit("rejected"))
    (
        labelled.withColumn(STATUS, status)
        .hint("rebalance", STATUS, *PARTITION_COLUMNS)
        .write.partitionBy(STATUS)
        .parquet(path)
    )
    schema = StructType([*labelled.schema.fields, StructField(STATUS, StringType())])
    return Stored(spark.read.schema(schema).parquet(path), path)


def staged_counters(staged: DataFrame) -> IngestReport:
    """Counters of the committed files: rows per status partition, exact also when
    lost executors made tasks run again."""
    counts = {row[STATUS]: row["n"] for row in staged.groupBy(STATUS).agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = counts.get("accepted", 0), counts.get("rejected", 0)
    return IngestReport(good + bad, good, bad)


def ingest(
    spark: SparkSession,
    path: str,
    platform: str,
    output: str,
    *,
    mode: str = "overwrite",
    rejects: str | None = None,
    **options,
) -> IngestReport:
    """Write the good rows as records, and the others to ``rejects`` if given.

    The dump is parsed once: every row, with its reject reason, is staged in the
    shared folder by status; records, rejects and counters are read from the
    staged files (each by its partition only) and the stage is deleted after.
    """
    staged = stage(normalize_dump(spark, path, platform, **options))
    try:
        table = staged.table
        write_records(table.where(F.col(STATUS) == "accepted"), output, mode=mode)
        if rejects is not None:
            table.where(F.col(STATUS) == "rejected").drop(STATUS).write.mode(mode).parquet(rejects)
        return staged_counters(table)
    finally:
        staged.drop()


def ingest_reddit(spark: SparkSession, path: str, output: str, **options) -> IngestReport:
    return ingest(spark, path, "reddit", output, **options)


def ingest_mastodon(spark: SparkSession, path: str, output: str, **options) -> IngestReport:
    return ingest(spark, path, "mastodon", output, **options)
