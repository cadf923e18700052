"""Sharding by minimax contiguous partition, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
#: Bits of the text hash that name an atomic group: at most 65,536 group sizes are put in order.
GROUP_BITS = 16
#: Cells of a shard in which its rows are numbered.
CELLS = 1024
#: Bytes that each row takes besides its text.
ROW_BYTES = 8


def row_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def group_of(text: Column) -> Column:
    """Atomic group of a text: equal texts, null included, are always in one group."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - GROUP_BITS).cast("int")


def _fits(prefix: Column, count: Column, shards: int, capacity: Column) -> Column:
    """Groups that *shards* greedily filled shards hold, as the array of each shard's end."""

    def upto(limit: Column) -> Column:
        """How many of the ascending prefix sums are at most *limit*, by halving steps."""
        steps = F.array(*[F.lit(1 << b) for b in range(GROUP_BITS, -1, -1)])
        return F.aggregate(
            steps,
            F.lit(0),
            lambda at, step: F.when((at + step <= count) & (F.get(prefix, at + step - 1) <= limit), at + step).otherwise(at),
        )

    def fill(ends: Column, _: Column) -> Column:
        at = F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0))
        full = F.when(at > 0, F.get(prefix, at - 1)).otherwise(F.lit(0).cast("long"))
        return F.concat(ends, F.array(upto(full + capacity)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.array().cast("array<int>"), fill)


def shard_ends(transcripts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row: ``capacity``, the least that *shards* contiguous runs of groups need, and ``ends``, each shard's last group.

    Binary search over capacities; a capacity is tried by filling shard after shard greedily. The
    only rows put in one order are the at most ``2**GROUP_BITS`` group sizes.
    """
    text = F.col("transcript").cast("string")
    groups = transcripts.groupBy(group_of(text).alias("_group")).agg(F.sum(row_bytes(text)).alias("_bytes"))
    along = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, 0)
    line = groups.select("_group", "_bytes", F.sum("_bytes").over(along).alias("_upto"))
    # Written out in order first, so that the searches below read finished arrays.
    one = line.agg(F.array_sort(F.collect_list(F.struct("_group", "_upto"))).alias("_line"), F.max("_bytes").alias("_most"))
    one = one.select(
        F.transform("_line", lambda x: x["_group"]).alias("_groups"), F.transform("_line", lambda x: x["_upto"]).alias("_prefix"), "_most"
    ).filter(F.size("_groups") > 0)
    prefix, count = F.col("_prefix"), F.size("_groups")
    total = F.element_at(prefix, -1)

    def halve(span: Column, _: Column) -> Column:
        mid = F.floor((span["lo"] + span["hi"]) / 2).cast("long")
        enough = F.element_at(_fits(prefix, count, shards, mid), -1) >= count
        return (
            F.when(span["lo"] >= span["hi"], span)
            .when(enough, F.struct(span["lo"].alias("lo"), mid.alias("hi")))
            .otherwise(F.struct((mid + 1).alias("lo"), span["hi"].alias("hi")))
        )

    least = F.greatest(F.col("_most"), F.ceil(total / shards).cast("long"))
    span = F.struct(least.alias("lo"), (least + F.col("_most")).alias("hi"))
    found = one.withColumn("capacity", F.aggregate(F.sequence(F.lit(1), F.lit(50)), span, halve, lambda s: s["hi"]))
    found = found.withColumn("_at", _fits(prefix, count, shards, F.col("capacity")))
    return found.select("capacity", F.transform("_at", lambda i: F.get(F.col("_groups"), i - 1)).alias("ends"))


def with_shard(transcripts: DataFrame, shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """*transcripts* with its shard, row by row; nothing is moved."""
    # One number per shard is all that is fetched.
    found = shard_ends(transcripts.select("transcript"), shards).first()
    ends = sorted(set(found["ends"])) if found else []
    group = group_of(F.col("transcript").cast("string"))
    return transcripts.withColumn(name, sum([(group > e).cast("int") for e in ends], F.lit(0)))


def shard_transcripts(transcripts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put transcripts into *shards* of nearly equal bytes; equal texts stay together.

    ``transcripts``: ``video_id``, ``transcript``; other columns are ignored. Groups of equal texts, in the
    order of their hash, are cut into contiguous runs so that the largest run is as small as it can be.
    The atomic groups are hash classes of ``GROUP_BITS`` bits, so one class may hold several texts
    (never parts of a group), and the search works on a bounded number of sizes.

    Returns one row per input row: ``video_id``, ``n_bytes`` (UTF-8 bytes plus ``ROW_BYTES``), ``text_crc32`` (null
    for a null transcript), ``shard`` (from 0) and ``slot`` (gapless within the shard from 0). Null
    transcripts are one group of ``ROW_BYTES`` each. A group larger than an equal share
    makes its shard that large. Fewer groups than shards leave shards empty. An empty table gives an empty result.

    Rows are numbered in ``CELLS`` cells of each shard, dealt by id, so no shard is sorted as a whole.
    """
    text = F.col("transcript").cast("string")
    narrow = with_shard(transcripts.select("video_id", "transcript"), shards).select(
        "video_id", row_bytes(text).alias("n_bytes"), F.crc32(text).alias("text_crc32"), "shard",
        F.pmod(F.xxhash64("video_id", "transcript"), F.lit(CELLS)).cast("int").alias("_cell"),
    )
    counts = narrow.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    own = Window.partitionBy("shard", "_cell").orderBy("video_id", "text_crc32", "n_bytes")
    numbered = narrow.withColumn("_i", F.row_number().over(own) - 1).join(counts, ["shard", "_cell"])
    return numbered.select(
        "video_id", "n_bytes", "text_crc32", "shard", (F.col("_before") + F.col("_i")).cast("long").alias("slot")
    )
