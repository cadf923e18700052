"""Captions in other scripts: finding them, packing them into lines, taking answers back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmart.functions import text as tx
from clipmart.functions.folds import states_before
from clipmart.functions.ordered import CELL, own_keys, position_bucket, scan, with_cells, without_cells
from clipmart.operators.transcript import interval_overlap_join
from clipmart.session import ensure_checkpoint_dir

LINE_WORDS = 12
PADDING_S = 1.0


def non_latin_words(words: DataFrame) -> DataFrame:
    """Words that hold a letter of a non-Latin script."""
    return words.filter(tx.non_latin("word"))


def romanisation_lines(captions: DataFrame, clips: DataFrame, max_words: int = LINE_WORDS) -> DataFrame:
    """Lines of consecutive non-Latin captions inside the padded clips, at most *max_words* words each.

    ``captions``: (video_id, seg, start_s, end_s, n_words, text). A line starts when the
    previous caption was left out or the line would grow too long. Adds ``idx`` (position of
    the caption) and ``line`` (position of the line's first caption).
    """
    numbered = scan(captions, ["video_id"], position_bucket("seg"), ["seg"], ordinal="idx")
    # Only captions in other scripts go on; they are written out, as everything below reads them again and again.
    ensure_checkpoint_dir(captions.sparkSession)
    foreign = numbered.filter(tx.non_latin("text")).checkpoint()
    padded = clips.select(
        "video_id", (F.col("start_time") - PADDING_S).alias("start_time"), (F.col("end_time") + PADDING_S).alias("end_time")
    )
    inside = interval_overlap_join(padded, foreign.select("video_id", "idx", "start_s", "end_s")).select("video_id", "idx").distinct()
    wanted = foreign.join(inside, ["video_id", "idx"], "left_semi")
    bucket = position_bucket("idx")
    seen = scan(with_cells(wanted, ["video_id"], bucket), ["video_id"], bucket, ["idx"], lag=["idx"])
    opened = seen.withColumn("_open", F.when(~F.coalesce(F.col("prev_idx") == F.col("idx") - 1, F.lit(False)), F.col("idx")))
    islands = without_cells(scan(opened.drop("prev_idx"), ["video_id"], bucket, ["idx"], run_last={"_island": F.col("_open")}))

    def step(used: Column, row: Column) -> Column:
        n = row["n_words"].cast("int")
        full = (used > 0) & (used + n > max_words)
        # A full line counts as max_words: the next caption starts a new one anyway.
        return F.least(F.when(full, n).otherwise(used + n), F.lit(max_words))

    fields = ["n_words", "seg", "text"]
    packed = states_before(islands, ["video_id"], "_island", "idx", fields, step, max_words + 1)
    starts = (F.col("before") == 0) | (F.col("before") + F.col("n_words") > max_words)
    marked = packed.withColumn("_start", F.when(starts, F.col("idx")))
    lined = scan(marked, ["video_id"], bucket, ["idx"], run_last={"line": F.col("_start")})
    return lined.select("video_id", "seg", "idx", "line", "n_words", "text")


def aligned_lines(lines: DataFrame, answers: DataFrame, near: Sequence[str] = ()) -> DataFrame:
    """Accept an answer only if it has as many words as the line and none is blank; else the line stays pending.

    Both tables: (line_id, words array). *near* names columns of both that follow from the id, such as its video: they are
    joined as well, by stand-ins, so lines and answers that lie by them meet where they are.
    """
    told = with_cells(lines, near, {}) if near else lines
    answer = answers.select("line_id", *near, F.col("words").alias("_answer"))
    if near:
        # Never broadcast: the answers are measured by what they were made from, which may be a small part of them.
        answer = with_cells(answer, near, {}).drop(*near, f"{CELL}_m", f"{CELL}_km").hint("merge")
    fits = (F.size("_answer") == F.size("words")) & F.forall("_answer", lambda w: F.coalesce(F.trim(w) != "", F.lit(False)))
    return without_cells(
        told.join(answer, [*own_keys(told), "line_id"], "left")
        .withColumn("accepted", F.col("_answer").isNotNull() & F.coalesce(fits, F.lit(False)))
        .withColumn("answer", F.when(F.col("accepted"), F.transform("_answer", lambda w: F.trim(w))))
        .drop("_answer")
    )
