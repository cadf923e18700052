"""Mixing sources to target weights by weighted fair queueing, on DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmart.llm.common import kept

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
#: Times a source may be read.
REPEATS = 2
#: Parts of a source's queue, and of virtual time. Both are fixed: their totals stay small whatever the input.
QUEUE_PARTS_BITS, CLOCK_PARTS = 10, 4096
SEED = 20240601


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``target_words`` for each source of *sizes* (``source_key``, ``source_words``).

    Sources in code point order (null last) take *weights* in turn and share ``share`` times all
    words. No target exceeds ``repeats`` times its source; what is over goes to the others by weight.
    Sources sorted by *limit / weight* fill up in that order, so one pass of running sums finds the level
    (words per weight) at which the rest is shared.
    """
    # One row per source: a source is a playlist or channel, and the rows are sums.
    order = Window.orderBy(F.col("source_key").asc_nulls_last())
    sized = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    sized = sized.withColumn("_limit", F.col("source_words").cast("double") * repeats).withColumn("_full_at", F.col("_limit") / F.col("_w"))
    everyone = Window.partitionBy()
    by_fill = Window.orderBy("_full_at", F.col("source_key").asc_nulls_last())
    filling = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_words").over(everyone) - F.coalesce(F.sum("_limit").over(filling), F.lit(0.0))
    weight = F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(filling), F.lit(0.0))
    level = sized.withColumns({"_level": left / weight, "_i": F.row_number().over(by_fill)})
    # The first source that is not full at its own level sets the level of all that follow.
    first = F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_i", "_level"))).over(everyone)
    level = level.withColumn("_level", first["_level"])
    target = F.least(F.col("_limit"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_limit")))
    return level.select("source_key", "source_words", target.alias("target_words"))


def mix_sources(
    transcripts: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED
) -> DataFrame:
    """How many words of each transcript a mix of all sources takes.

    ``transcripts``: ``video_id``, ``source_key``, ``transcript``; other columns are ignored, whatever their
    names. Each source queues its transcripts in an order dealt by *seed*, ``repeats`` times over. A queued
    transcript has a virtual finish time, its source's words so far divided by the source's target; all
    queues are merged in the order of finish times and the mix ends when the budget (all targets) is
    spent. A transcript that is being read when its source's share is spent is read up to there.

    Returns one row per input row: ``video_id``, ``source_key``, ``n_words``, ``source_words``,
    ``target_words`` (of its source), ``taken_words`` (repeats counted, at most ``repeats`` times its
    words), ``text_hash`` (xxhash64 of the transcript), ``finish`` (virtual time of the first reading) and ``mix_start`` (words of the mix before its first
    taken word; null if none is taken). A null or empty transcript has no words and takes none. A null source is a source. Repeated
    rows queue one after the other. An empty table gives an empty result. Reruns give equal results.

    A source of any size is queued in ``2**QUEUE_PARTS_BITS`` parts, the mix in ``CLOCK_PARTS`` parts of virtual
    time; only the parts' sums are ever put in one order.
    """
    # A key that is never null, so that the parts join by plain equality.
    key = F.coalesce(F.concat(F.lit("="), F.col("source_key").cast("string")), F.lit("~"))
    queued = transcripts.select(
        "video_id", F.col("source_key").cast("string").alias("source_key"), word_count(F.col("transcript").cast("string")).alias("n_words"),
        F.xxhash64(F.col("transcript").cast("string")).alias("text_hash"),
    ).withColumns({"_key": key, "_deal": F.xxhash64(F.lit(seed), F.col("video_id"))})
    # Written out, as four aggregates read these narrow rows and words should be counted once.
    queued = kept(queued.withColumn("_part", F.shiftright("_deal", 64 - QUEUE_PARTS_BITS)))

    parts = queued.groupBy("_key", "_part").agg(F.sum("n_words").alias("_words"), F.first("source_key").alias("source_key"))
    along = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_key", "_part", "source_key", "_words", F.coalesce(F.sum("_words").over(along), F.lit(0)).alias("_before")
    )
    sizes = parts.groupBy("_key").agg(F.first("source_key").alias("source_key"), F.sum("_words").alias("source_words"))
    targets = source_targets(sizes.select("source_key", "source_words"), weights, share, repeats)
    targets = targets.select(
        F.coalesce(F.concat(F.lit("="), "source_key"), F.lit("~")).alias("_key"), "source_words", "target_words"
    )
    parts = parts.select("_key", "_part", "_before").join(targets, "_key")

    own = Window.partitionBy("_key", "_part").orderBy("_deal", "video_id", "n_words")
    placed = queued.withColumns(
        {"_upto": F.sum("n_words").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_row": F.row_number().over(own)}
    ).join(parts, ["_key", "_part"])
    placed = placed.withColumn("_end", F.col("_before") + F.col("_upto")).drop("_before", "_upto", "_deal")

    # One queue entry for each reading; words beyond the source's target are not served.
    served = F.floor("target_words").cast("long")
    entries = placed.withColumn("_reading", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    end = F.col("_end") + F.col("_reading") * F.col("source_words")
    entries = entries.withColumns(
        {
            "finish": F.when(F.col("target_words") > 0, end / F.col("target_words")),
            "_taken": F.least(end, served) - F.least(end - F.col("n_words"), served),
        }
    )
    clock = F.least(F.coalesce("finish", F.lit(1.0)), F.lit(1.0))
    entries = entries.withColumn("_tick", F.floor(clock * CLOCK_PARTS).cast("int"))
    ticks = entries.groupBy("_tick").agg(F.sum("_taken").alias("_words"))
    # At most CLOCK_PARTS + 1 sums.
    before = Window.orderBy("_tick").rowsBetween(Window.unboundedPreceding, -1)
    ticks = ticks.select("_tick", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_passed"))
    # What waits at the end of virtual time takes nothing or is cut there; its order matters to no one, so it is spread by part.
    spread = F.when(F.col("_tick") < CLOCK_PARTS, F.lit(0)).otherwise(F.col("_part"))
    entries = entries.withColumn("_lane", spread)
    lanes = entries.groupBy("_tick", "_lane").agg(F.sum("_taken").alias("_words"))
    across = Window.partitionBy("_tick").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("_tick", "_lane", F.coalesce(F.sum("_words").over(across), F.lit(0)).alias("_aside")).join(ticks, "_tick")
    inside = Window.partitionBy("_tick", "_lane").orderBy("finish", "_key", "_part", "_row", "_reading").rowsBetween(
        Window.unboundedPreceding, 0
    )
    entries = entries.withColumn("_sum", F.sum("_taken").over(inside)).join(lanes, ["_tick", "_lane"])
    entries = entries.withColumn("_start", F.col("_passed") + F.col("_aside") + F.col("_sum") - F.col("_taken"))

    return (
        entries.groupBy("_key", "_part", "_row")
        .agg(
            F.first("video_id").alias("video_id"), F.first("source_key").alias("source_key"), F.first("n_words").alias("n_words"),
            F.first("text_hash").alias("text_hash"), F.first("source_words").alias("source_words"), F.first("target_words").alias("target_words"),
            F.sum("_taken").alias("taken_words"), F.min("finish").alias("finish"),
            F.min(F.when(F.col("_taken") > 0, F.col("_start"))).alias("mix_start"),
        )
        .drop("_key", "_part", "_row")
    )
