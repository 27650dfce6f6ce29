"""Ingest and analysis of dumps that keep arriving.

All row-level functions accept a streaming table as they are; this module only
joins the ends.  Nothing here keeps state, so there is nothing to expire.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textrisk.operators.normalize import NORMALIZERS, accepted
from textrisk.plans.analyze import analyze
from textrisk.schema import PARTITION_COLUMNS
from textrisk.sources.raw import stream_raw


def stream_records(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """Good records from JSON-lines files as they appear in a folder."""
    return accepted(NORMALIZERS[platform](stream_raw(spark, path, platform)))


def stream_analysis(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """The same records with spans, scores, labels and redacted text."""
    return analyze(stream_records(spark, path, platform))


def write_stream(records: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append all files present now to the partitioned record table.

    ``checkpoint`` is a folder that survives the job; it makes a restart go on
    where the last run stopped.
    """
    return (
        records.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*PARTITION_COLUMNS)
        .trigger(availableNow=True)
        .start()
    )
