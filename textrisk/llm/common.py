"""What several operators share: names, text identity, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrisk.storage import Stored, store

#: Size up to which a counted table may be broadcast.
BROADCAST_BYTES = 32 << 20
ROWS_PER_FILE = 1 << 18
#: Rows up to which a counted table is worked on by one task instead of being shuffled.
ROWS_AT_ONCE = 1 << 15


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: str | Column) -> Column:
    """Identity of a text: equal for equal texts only."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def sized(small: DataFrame, n_bytes: int) -> DataFrame:
    """``small`` with a broadcast hint where its counted size allows it."""
    return F.broadcast(small) if n_bytes <= BROADCAST_BYTES else small


def compact(df: DataFrame, name: str) -> Stored:
    """``store`` for tables that are often small: few files for few rows.

    All tasks work on the table, which stays on their disks until it has been
    counted; the files are written from there.
    """
    return counted(df, name)[0]


def counted(df: DataFrame, name: str) -> tuple[Stored, int]:
    """``compact`` and the number of rows."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        n_rows = held.count()
        n_files = max(1, -(-n_rows // ROWS_PER_FILE))
        return store(held.coalesce(n_files) if n_files < 10_000 else held, name), n_rows
    finally:
        held.unpersist()


def at_once(table: DataFrame, n_rows: int) -> DataFrame:
    """``table`` as one partition where its counted rows are few: what follows needs no shuffle,
    which would cost a task for each of the session's partitions."""
    return table.coalesce(1) if n_rows <= ROWS_AT_ONCE else table


def pieces(batches: Iterator[pa.RecordBatch], text: str, n_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``n_bytes`` of text, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > n_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if batch.num_rows > start:
            yield batch.slice(start)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> Stored:
    """Components of an undirected graph as a stored table (node, component).

    ``edges`` holds pairs of ids that can be ordered; the component is the
    smallest id in it.  Large-star and small-star steps alternate until the
    edges no longer change, in a number of steps that grows with the logarithm
    of the number of nodes.  Each step is a grouped minimum, which combines
    before the shuffle, and a join back, which can be split; so a node with very
    many neighbours is never gathered.  Each step is written to the shared
    folder and the step before it deleted.
    """
    current, n_edges = counted(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    state = None
    while True:
        # Large star: neighbours above a node move to the smallest id around it.
        both = at_once(current.table.union(current.table.select("v", "u")), 2 * n_edges)
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: neighbours below a node, and itself, move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = at_once(small.union(low.select("u", F.col("m").alias("v"))), 2 * n_edges)
        following, n_edges = counted(stars.where("u <> v").distinct(), "edges")
        current.drop()
        current = following
        seen = current.table.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if state == (seen.n, seen.s):
            break
        state = (seen.n, seen.s)
    nodes = current.table.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return Stored(nodes.union(roots), current.path)
