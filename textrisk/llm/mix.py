"""Mixing sources to target weights by Sainte-Laguë apportionment.

A document's size is its number of words (runs of characters other than ASCII
blanks; a null text has none).  Sources, ordered by code point with the null
source last, weigh 5, 2, 1, 5, 2, 1, ...; together they share all words of the
corpus.  A source never gets more than ``MAX_REPEATS`` times its own size: what
its weight would give beyond that goes to the others by weight, until no source
is above (water filling, in closed form over the sources ordered by size per
weight).

The mix is then cut into blocks of ``BLOCK_WORDS`` words, dealt to the sources by
the highest quotients target / 1, / 3, / 5, ... (Sainte-Laguë).  A source's words
are dealt once more to its shards (hash of the id, ``SHARD_ROWS`` documents each
on average), by the same rule, so that each shard has an integer quota.  A shard
takes all its documents as often as its quota allows and the rest in blocks of
its word stream, chosen by a seeded hash.  So a source with a third of all rows is
worked on by many tasks, and the only windows without a partition run over one
row per source.

DataFrame functions only.

Defined results: a null or empty text has size 0 and is never taken; a null
``source`` is a source of its own, last in order; an empty table gives an empty
result; repeated rows are documents of their own (equal rows get equal sizes,
the rows they make may swap their ``taken``); other columns are ignored, and the
result has only the columns below, whatever names the input has besides.
Reruns with the same ``seed`` give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textrisk.llm.common import compact, sized

#: Fixed values of the contract: the weights of sources in code point order, repeating,
#: and the most a source may be repeated.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Parameters: words per block of the apportionment, documents per shard, seed.
BLOCK_WORDS = 1000
SHARD_ROWS = 100_000
SEED = 17

WORD = r"[^\x20\x09-\x0D]+"


def _hash32(*parts: Column) -> Column:
    """A seeded 32-bit number from the MD5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def apportion(
    units: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, seats: str, out: str = "quota"
) -> DataFrame:
    """Sainte-Laguë: the ``seats`` of each group go to its units by the highest
    quotients weight / (2k + 1), k = 0, 1, ...; equal quotients go to the unit
    first in ``order``.  ``group`` and ``order`` name columns without nulls
    that tell the units apart.  Adds ``out`` (long) to ``units``.

    Only the quotients that can lie near the last seat are made: with n units of
    positive weight and total V, a unit holds at least ceil(w (N - n/2) / V - 1/2)
    and at most floor(w (N + n/2) / V + 1/2) seats, so some 4n candidates per
    group are ranked, however many seats there are.  Units of weight 0 get none.
    """
    g = Window.partitionBy(*group)
    weighed = units.withColumns(
        {"_w": F.greatest(F.col(weight).cast("double"), F.lit(0.0)), "_n_seats": F.col(seats).cast("long")}
    ).withColumns({"_v": F.sum("_w").over(g), "_n": F.count_if(F.col("_w") > 0).over(g)})
    share = F.col("_w") / F.col("_v")
    low = F.ceil(share * (F.col("_n_seats") - F.col("_n") / 2) - 0.5) - 1
    high = F.floor(share * (F.col("_n_seats") + F.col("_n") / 2) + 0.5) + 1
    bounded = (
        weighed.withColumns(
            {
                "_sure": F.when(F.col("_w") > 0, F.greatest(F.lit(0), low)).otherwise(F.lit(0)).cast("long"),
                "_high": F.when(F.col("_w") > 0, F.greatest(F.lit(0), high)).otherwise(F.lit(0)).cast("long"),
            }
        )
        .withColumn("_left", F.col("_n_seats") - F.sum("_sure").over(g))
    )
    unit = [*group, *order]
    candidates = (
        bounded.where(F.col("_high") > F.col("_sure"))
        .select(*unit, "_left", "_w", F.explode(F.sequence("_sure", F.col("_high") - 1)).alias("_k"))
        .withColumn("_q", F.col("_w") / (2 * F.col("_k") + 1))
    )
    # Equal quotients of one unit come in the order of k, which is that of ``_q``.
    ranked = candidates.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_q"), *order)))
    extra = ranked.where(F.col("_rank") <= F.col("_left")).groupBy(*unit).agg(F.count(F.lit(1)).alias("_extra"))
    return (
        bounded.join(extra, unit, "left")
        .withColumn(out, (F.col("_sure") + F.coalesce("_extra", F.lit(0))).cast("long"))
        .drop("_w", "_n_seats", "_v", "_n", "_sure", "_high", "_left", "_extra")
    )


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source (``source``, ``source_size``): its ``weight`` and ``target``
    words.  Targets share all words by weight and stop at ``max_repeats`` times the
    source's size; the capped ones are a prefix of the sources ordered by
    cap / weight, found with running sums."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = sources.withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("_cap", (F.col("source_size") * max_repeats).cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    running = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    everything = Window.partitionBy(F.lit(1))
    steps = weighted.withColumns(
        {
            "_total": F.sum("source_size").over(everything).cast("double"),
            "_all_w": F.sum("weight").over(everything).cast("double"),
            "_caps": F.sum("_cap").over(running),
            "_ws": F.sum("weight").over(running).cast("double"),
        }
    ).withColumn("_pos", F.row_number().over(by_ratio))
    # With the first j sources capped the rest share (total - their caps) at level
    # (total - caps_j) / (weights without them); the level is the first that no
    # uncapped source exceeds.
    level_after = (F.col("_total") - F.col("_caps")) / (F.col("_all_w") - F.col("_ws"))
    level_before = (F.col("_total") - (F.col("_caps") - F.col("_cap"))) / (F.col("_all_w") - F.col("_ws") + F.col("weight"))
    capped_here = steps.withColumn("_fits", level_before <= F.col("_cap") / F.col("weight"))
    first_fit = F.min(F.when(F.col("_fits"), F.col("_pos"))).over(everything)
    level = F.first(F.when(F.col("_pos") == first_fit, level_before), ignorenulls=True).over(
        everything.orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return capped_here.withColumn("_level", level).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("_total") == 0, F.lit(0.0))
        .when(F.col("_pos") < first_fit, F.col("_cap"))
        .otherwise(F.col("weight") * F.col("_level"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken): ``taken`` words of
    the document are in the mix, repeats counted; never more than ``MAX_REPEATS``
    times its size."""
    # Texts are read once: the sizes are written to the shared folder, and every
    # later step reads the three small columns.
    rows = compact(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    ).table
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    everything = Window.partitionBy(F.lit(1))
    # One row per source: sources get a number in code point order, so that later
    # joins need no null-safe comparison.
    aimed = (
        targets(per_source.select("source", "source_size"))
        .join(per_source.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumns(
            {
                "_sid": F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())),
                "_all": F.lit(1),
                "_blocks": F.floor((F.sum("source_size").over(everything) + block_words // 2) / block_words).cast("long"),
            }
        )
    )
    dealt = apportion(aimed, ["_all"], ["_sid"], "target", "_blocks", "_source_blocks")
    quotas = compact(
        dealt.select(
            "source",
            "_sid",
            "source_size",
            "target",
            F.least(F.col("_source_blocks") * block_words, F.col("source_size") * MAX_REPEATS).alias("_source_words"),
            F.ceil(F.col("_rows") / shard_rows).cast("long").alias("_shards"),
        ),
        "mix-sources",
    )
    counted = quotas.table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("source")).alias("chars")).first()
    placed = (
        rows.join(sized(quotas.table, 64 * counted.n + 4 * (counted.chars or 0)), rows["source"].eqNullSafe(quotas.table["source"]))
        .drop(quotas.table["source"])
        .withColumns(
            {
                "_shard": F.pmod(_hash32(F.lit(seed), F.col("doc_id").cast("string")), F.col("_shards")),
                "_key": F.md5(F.concat_ws(":", F.lit(seed), F.col("_sid").cast("string"), F.col("doc_id").cast("string"))),
            }
        )
    )
    shards = placed.groupBy("_sid", "_shard").agg(
        F.sum("size").alias("_shard_size"), F.first("_source_words").alias("_source_words")
    )
    shard_quota = (
        apportion(shards, ["_sid"], ["_shard"], "_shard_size", "_source_words", "_words")
        .withColumn("_words", F.least(F.col("_words"), F.col("_shard_size") * MAX_REPEATS))
        .withColumn(
            "_passes",
            F.when(F.col("_shard_size") > 0, F.floor(F.col("_words") / F.col("_shard_size"))).otherwise(0).cast("long"),
        )
        .withColumn("_rest", F.col("_words") - F.col("_passes") * F.col("_shard_size"))
        .select("_sid", "_shard", "_shard_size", "_passes", "_rest")
    )
    # The rest of a shard's quota: blocks of its word stream in seeded order, the
    # last one chosen in part, so that the shard takes exactly its quota.
    block_rows = shard_quota.where(F.col("_rest") > 0).select(
        "_sid",
        "_shard",
        "_rest",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_shard_size") - 1) / block_words).cast("long"))).alias("_block"),
        "_shard_size",
    ).withColumn("_len", F.least(F.lit(block_words).cast("long"), F.col("_shard_size") - F.col("_block") * block_words))
    in_shard = Window.partitionBy("_sid", "_shard").orderBy(
        F.md5(F.concat_ws(":", F.lit(seed), F.col("_sid").cast("string"), F.col("_shard").cast("string"), F.col("_block").cast("string"))),
        "_block",
    )
    chosen = (
        block_rows.withColumn("_before", F.coalesce(F.sum("_len").over(in_shard.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("_sid", "_shard", "_block", F.least(F.col("_len"), F.col("_rest") - F.col("_before")).alias("_take"))
        .where(F.col("_take") > 0)
    )

    # Where each document starts in its shard's stream; a shard holds about
    # ``shard_rows`` documents, so the window is bounded.
    stream = Window.partitionBy("_sid", "_shard").orderBy("_key", "doc_id")
    located = placed.withColumns(
        {
            "_start": F.coalesce(F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_pos": F.row_number().over(stream),
        }
    ).join(shard_quota.select("_sid", "_shard", "_passes", "_rest"), ["_sid", "_shard"])
    first_block = F.floor(F.col("_start") / block_words).cast("long")
    last_block = F.floor((F.col("_start") + F.col("size") - 1) / block_words).cast("long")
    spans = located.withColumn(
        "_block",
        F.explode(
            F.when((F.col("_rest") > 0) & (F.col("size") > 0), F.sequence(first_block, last_block)).otherwise(
                F.array(F.lit(-1).cast("long"))
            )
        ),
    )
    # The chosen blocks grow with the words; they are joined by a shuffle, never broadcast.
    picked = spans.join(chosen.hint("merge"), ["_sid", "_shard", "_block"], "left")
    begin = F.greatest(F.col("_start"), F.col("_block") * block_words)
    end = F.least(F.col("_start") + F.col("size"), F.col("_block") * block_words + F.col("_take"))
    # ``least`` and ``greatest`` pass over nulls, so blocks that are not chosen are told apart first.
    overlap = F.when(F.col("_take").isNotNull(), F.greatest(F.lit(0), end - begin)).otherwise(F.lit(0))
    return picked.groupBy("_sid", "_shard", "_pos").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("source").alias("source"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        (F.first("_passes") * F.first("size") + F.sum(overlap)).cast("long").alias("taken"),
    ).drop("_sid", "_shard", "_pos")
