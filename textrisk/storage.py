"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"
_stand_ins: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only where it is unset and Spark runs on this machine alone (tests) a
    temporary folder stands in.
    """
    configured = spark.conf.get(_DIR_KEY, None) or spark.sparkContext.getConf().get(_DIR_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {_DIR_KEY} to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _stand_ins:
        _stand_ins[application] = tempfile.mkdtemp(prefix="textrisk-")
    return _stand_ins[application]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textrisk/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Stored:
    """A table written to the shared folder, to be dropped when done with."""

    table: DataFrame
    path: str

    def drop(self) -> None:
        """Delete the files; the table must not be read afterwards."""
        context = self.table.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def store(df: DataFrame, name: str) -> Stored:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a cache this survives the loss of executors, and later steps read
    only the columns they need.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return Stored(df.sparkSession.read.schema(df.schema).parquet(path), path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``store`` for tables that stay."""
    return store(df, name).table
