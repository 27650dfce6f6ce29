"""Lines that repeat over the pages of a host.

A line is boilerplate on a host if it stands on more than ``ratio`` of the host's
pages, and on ``min_pages`` of them at least.  Lines are compared without blanks
around them; blank lines are never boilerplate.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrisk.llm.common import compact, fresh, sized
from textrisk.storage import Stored

RATIO = 0.05
MIN_PAGES = 5
_BLANKS = " \t\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def _mark(line: Column) -> Column:
    """128 bits for a line, as two numbers."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"))


@dataclass(frozen=True)
class Boilerplate:
    """Marks of the boilerplate lines, one row per host: (host, marks)."""

    stored: Stored
    n_bytes: int


def boilerplate_lines(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> Boilerplate:
    """Find the boilerplate of each host.

    The lines of a page are made distinct in its row, so the count of pages is a
    plain count that combines before the shuffle: a host or a line with a third
    of all rows sends one row per task.  A host keeps fewer than
    (distinct lines per page) / ``ratio`` lines.
    A null host counts as the empty one; null and empty texts have no lines but
    count as pages.
    """
    owned = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), _bare), lambda line: line != "")
    counted = (
        owned.select("host", F.explode(F.array_distinct(lines)).alias("line"))
        .select("host", _mark(F.col("line")).alias("mark"))
        .groupBy("host", F.col("mark.h1").alias("h1"), F.col("mark.h2").alias("h2"))
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    totals = owned.groupBy("host").agg(F.count(F.lit(1)).alias("n_total"))
    kept = counted.join(totals, "host").where(F.col("n_pages") > F.col("n_total") * F.lit(ratio))
    stored = compact(kept.groupBy("host").agg(F.collect_list(F.struct("h1", "h2")).alias("marks")), "boilerplate")
    size = stored.table.agg(F.sum(F.size("marks") * 16 + F.octet_length("host") + 32).alias("n")).first().n
    return Boilerplate(stored, size or 0)


def without_boilerplate(
    pages: DataFrame, found: Boilerplate, host: str = "source", text: str = "text", dropped: str | None = None
) -> DataFrame:
    """``pages`` with the boilerplate lines taken out of ``text``.

    Rows and other columns stay; ``dropped`` names a column for the number of
    lines taken out.  The text moves only where the marks are too large to
    broadcast; a large host is then split by the adaptive join.
    """
    key, marks, kept = fresh(pages, "_host"), fresh(pages, "_marks"), fresh(pages, "_kept")
    small = sized(found.stored.table.select(F.col("host").alias(key), F.col("marks").alias(marks)), found.n_bytes)
    joined = pages.withColumn(key, F.coalesce(F.col(host).cast("string"), F.lit(""))).join(small, key, "left")
    lines = F.split(text, "\n")
    clean = F.filter(
        lines, lambda line: (_bare(line) == "") | F.coalesce(~F.array_contains(marks, _mark(_bare(line))), F.lit(True))
    )
    joined = joined.withColumn(kept, F.when(F.col(marks).isNull(), lines).otherwise(clean))
    if dropped:
        joined = joined.withColumn(dropped, F.coalesce(F.size(lines) - F.size(kept), F.lit(0)))
    return joined.withColumn(text, F.array_join(kept, "\n")).drop(key, marks, kept)


def dedup_lines(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    dropped: str | None = None,
) -> DataFrame:
    """Find and take out the boilerplate of each host."""
    return without_boilerplate(pages, boilerplate_lines(pages, host, text, ratio, min_pages), host, text, dropped)
