"""The first rows of a table in a given order, without a global sort.

A plain ``limit`` hands all its rows through one task and says nothing about
which rows it takes.  Both operators here find the last row by counting coarse
groups first and looking closer only at the group in which the count is reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textrisk.storage import materialize

# Position columns of a scanned file: path, offset of the block, row in the task.
ROW_ORDER = ("_file", "_block", "_row")


def _group_reaching(groups: DataFrame, keys: Sequence[str], n: int) -> tuple | None:
    """From groups with a size ``n_rows``: the key of the group that holds row
    number ``n``, how many rows lie before it and how many in it; None if there are
    fewer rows."""
    upto = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    reached = (
        groups.withColumn("upto", F.sum("n_rows").over(upto))
        .filter(F.col("upto") >= n)
        .orderBy("upto")
        .select(*keys, (F.col("upto") - F.col("n_rows")).alias("before"), "n_rows")
        .first()
    )
    if reached is None:
        return None
    return tuple(reached[k] for k in keys), int(reached["before"]), int(reached["n_rows"])


def _row_index_of(rows: DataFrame) -> Column | None:
    """The row's index in its file where the source keeps one (Parquet)."""
    try:
        rows.select(F.col("_metadata.row_index")).schema
    except AnalysisException:
        return None
    return F.col("_metadata.row_index")


def with_position(rows: DataFrame) -> DataFrame:
    """Add where each row of a file scan stands.

    For Parquet: the file and the row's index in it, which do not depend on how
    Spark cuts the files into tasks.  For other sources: the file, the block of
    the task and the row within the task.
    """
    path, block, row = ROW_ORDER
    index = _row_index_of(rows)
    if index is not None:
        return rows.select(
            "*",
            F.col("_metadata.file_path").alias(path),
            F.lit(0).cast("long").alias(block),
            index.alias(row, metadata={"row_index": True}),
        )
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias(path),
        F.col("_metadata.file_block_start").alias(block),
        F.monotonically_increasing_id().alias(row),
    )


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in file order; drops the position columns.

    Only the file block in which row ``n`` lies is numbered row by row, and a
    block is what one task reads.
    """
    path, block, row = ROW_ORDER
    if rows.schema[row].metadata.get("row_index"):
        return _first_rows_by_index(rows, n)
    # Both passes must meet the same blocks.  How Spark cuts files into blocks depends
    # on the number of cores, which on a cluster changes with its executors; there the
    # positions are fixed by storing them with the rows.
    spark = rows.sparkSession
    pinned = spark.conf.get("spark.sql.files.minPartitionNum", None) is not None
    if n > 0 and not pinned and not spark.sparkContext.master.startswith("local"):
        rows = materialize(rows, "positioned")
    plain = rows.drop(*ROW_ORDER)
    if n <= 0:
        return plain.limit(0)
    sizes = rows.groupBy(path, block).agg(F.count(F.lit(1)).alias("n_rows"))
    found = _group_reaching(sizes, (path, block), n)
    if found is None:
        return plain
    (last_path, last_block), before, _ = found
    at = (F.col(path) == last_path) & (F.col(block) == last_block)
    earlier = (F.col(path) < last_path) | ((F.col(path) == last_path) & (F.col(block) < last_block))
    in_block = Window.partitionBy(path, block).orderBy(row)
    tail = rows.filter(at).withColumn("_n", F.row_number().over(in_block)).filter(F.col("_n") <= n - before)
    # A condition on the row number is not deterministic and so is not moved
    # into the scan, where the one on the path would leave out files.
    head = rows.filter(earlier & (F.col(row) >= 0)).drop(*ROW_ORDER)
    return head.unionByName(tail.drop("_n", *ROW_ORDER))


def _first_rows_by_index(rows: DataFrame, n: int) -> DataFrame:
    """``first_rows`` where each row has its index in its file: rows are counted
    per file, and of the file in which row ``n`` lies those below an index are kept."""
    path, _, row = ROW_ORDER
    plain = rows.drop(*ROW_ORDER)
    if n <= 0:
        return plain.limit(0)
    sizes = rows.groupBy(path).agg(F.count(F.lit(1)).alias("n_rows"))
    found = _group_reaching(sizes, (path,), n)
    if found is None:
        return plain
    (last_path,), before, _ = found
    keep = (F.col(path) < last_path) | ((F.col(path) == last_path) & (F.col(row) < n - before))
    return rows.filter(keep).drop(*ROW_ORDER)


def _slices(digest: Column) -> list[Column]:
    """Ever finer groups by a hexadecimal digest, a few thousand per group."""
    return [F.substring(digest, 1, 3), F.substring(digest, 1, 6), digest]


def split_in_order(df: DataFrame, n: int, order: str = "created_at", key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows by ``order`` (as text; null counts as empty) and the rest.

    ``order`` is meant to hold ISO times.  Rows of the same instant follow the
    MD5 of ``key``, which spreads evenly however the keys look, and rows that
    share the key as well follow the MD5 of the whole row.  Each level (hour,
    second, instant, slices of a digest) counts the groups inside the group
    found by the level above, so no step sorts the table or gathers an instant
    that holds many rows; the result is a filter that is pushed into the scan.
    Rows equal in every column are interchangeable and are divided by number.
    """
    if n <= 0:
        return df.limit(0), df
    time = F.col(order)
    value = F.coalesce(time, F.lit(""))
    inside, left, instant = F.lit(True), n, ""
    for level in (F.substring(value, 1, 13), F.substring(value, 1, 19), value):
        found = _level_reaching(df.filter(inside), level, left)
        if found is None:
            return df, df.limit(0)
        instant, left, size = found
        # The first condition is one that a scan can use to skip row groups.
        inside = time.startswith(instant) & (level == instant) if instant else level == instant

    if left == size:  # the whole instant belongs to the first part, as with unique times
        newer = df.filter(time >= instant) if instant else df
        return df.filter(time.isNull() | (time <= instant)).filter(value <= instant), newer.filter(value > instant)

    inside = time == instant if instant else value == ""
    before = F.lit(False)
    by_key = _slices(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    by_row = _slices(F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))
    for levels in (by_key, by_row):
        for level in levels:
            bound, left, _ = _level_reaching(df.filter(inside), level, left)
            before = before | (inside & (level < bound))
            inside = inside & (level == bound)
        size = df.filter(inside).count()
        if left == size:
            before, left, size = before | inside, 0, 0
            break

    # Again the plain comparisons are there for the scan.
    earlier = value < instant
    first = df.filter(time.isNull() | (time <= instant)).filter(earlier | before)
    rest = df.filter(time >= instant) if instant else df
    second = rest.filter(~(earlier | before))
    if size == 0:
        return first, second
    copies = df.filter(inside)
    return first.unionByName(_copies(copies, left)), second.filter(~inside).unionByName(_copies(copies, size - left))


def _level_reaching(rows: DataFrame, level: Column, n: int) -> tuple[str, int, int] | None:
    """The group of ``level`` that holds row ``n``, the place of that row in it and its size."""
    sizes = rows.groupBy(level.alias("bound")).agg(F.count(F.lit(1)).alias("n_rows"))
    found = _group_reaching(sizes, ("bound",), n)
    return None if found is None else (found[0][0], n - found[1], found[2])


def _copies(equal_rows: DataFrame, n: int) -> DataFrame:
    """``n`` copies of the row that all of ``equal_rows`` are, made by many tasks."""
    names = equal_rows.columns
    one = equal_rows.groupBy(*names).agg(F.lit(n).cast("long").alias("_n"))
    chunk = F.lit(1 << 16).cast("long")
    parts = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, chunk)).alias("_from"))
    parts = parts.repartition("_from").withColumn("_size", F.least(chunk, F.col("_n") - F.col("_from")).cast("int"))
    return parts.select(*names, F.explode(F.array_repeat(F.lit(1), F.col("_size"))).alias("_one")).drop("_one")
