"""Timed words and what is built from them: captions, lines, windows, cues.

``words``: (video_id, ord, word, start_s, end_s); ``ord`` is a dense position per video.
Long videos are cut into position or time buckets, so no single task or array has to
hold a whole transcript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmart.functions import folds
from clipmart.functions import text as tx
from clipmart.functions.ordered import (
    CELL,
    bare_keys,
    first_per_key,
    grouped,
    last_per_key,
    own_keys,
    position_bucket,
    scan,
    stacked,
    time_bucket,
    with_cells,
    without_cells,
)
from clipmart.functions.ranges import overlap_join
from clipmart.session import kept

PAUSE_S = 0.6
LINE_WORDS = 14
WINDOW_S = 600.0


def ordered_text(ord_col: str, word_col: str) -> Column:
    """The words of a group joined in order."""
    return F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(ord_col, word_col))), lambda x: x[word_col]), " "
    )


def clamp_word_overlaps(words: DataFrame) -> DataFrame:
    """Pull an overlapping word's end back to the next word's start (at least 0.1 s long)."""
    seen = scan(words, ["video_id"], position_bucket("ord"), ["ord"], lead=["start_s"])
    end = F.when(
        F.col("end_s") > F.col("next_start_s"), F.greatest(F.col("start_s") + 0.1, F.col("next_start_s"))
    ).otherwise(F.col("end_s"))
    return seen.withColumn("end_s", end).drop("next_start_s")


def _caption_pattern(max_words: int, whole: bool) -> str:
    """One caption in a string of marks: ``h`` ends it, ``c`` does from the second word on, ``w`` only as the last of *max_words*.

    With *whole*, captions that the string breaks off do not match.
    """
    if max_words == 1:
        return "[hcw]"
    more = "" if whole else "?"
    tail = "[hcw]"
    for _ in range(max_words - 2):
        tail = f"(?:[hc]|w{tail}{more})"
    return f"h|[cw]{tail}{more}"


def _captions(words: DataFrame, max_words: int, keys: list[str]) -> DataFrame:
    """(keys, seg, words, coming): the words of each caption, and the start of the word behind each (none behind the last of all).

    Sentence ends, pauses and the last word always end a caption; else it ends at ``max_words``, or at a clause end with two or
    more words. That needs the running length, an automaton of ``max_words`` states that every hard end resets: words are held in pieces of
    ``PIECE`` positions (which are consecutive) with one mark for each, a pattern cuts the marks into captions, and the state in which a piece
    is left follows from the marks behind its last hard end. Only a piece without any is summarised as a table *entry state -> exit state*.
    A piece also holds the next ``max_words`` words, so it writes out whole captions: those that start in it.
    """
    mark = F.when(tx.ends_caption_sentence("word"), "h").when(tx.ends_clause("word"), "c").otherwise("w")
    celled = with_cells(words, keys, {}).withColumn("mark", mark)
    # The keys are grouped and joined by as well, so what comes out still lies where the words did.
    own = own_keys(celled)
    at = F.floor(F.col("ord") / folds.PIECE)
    back = F.greatest(F.floor((F.col("ord") - max_words) / folds.PIECE), F.lit(0).cast("long"))
    spread = celled.withColumn("_piece", F.explode(F.sequence(F.least(back, at), at)))
    pieces = spread.groupBy(*own, *keys, f"{CELL}_km", "_piece").agg(F.sort_array(F.collect_list(F.struct("ord", "word", "start_s", "end_s", "mark"))).alias("_all"))
    own = [*own, f"{CELL}_km"]

    def marked(w: Column, i: Column) -> Column:
        gap = F.get("_all", i + 1)["start_s"] - w["end_s"]
        return F.when((gap <= PAUSE_S) & (w["mark"] != "h"), w["mark"]).otherwise("h")

    held = pieces.select(
        *own, "_piece", *keys, "_all", F.least(F.size("_all"), (F.col("_piece") + 1) * folds.PIECE - F.col("_all")[0]["ord"]).cast("int").alias("_n"),
        F.array_join(F.transform("_all", marked), "").alias("_marks"),
    )
    states = F.sequence(F.lit(0), F.lit(max_words - 1))

    def left_over(marks: Column) -> Column:
        return F.length(F.regexp_replace(marks, _caption_pattern(max_words, True), ""))

    mine = F.substring("_marks", F.lit(1), F.col("_n"))
    table = F.transform(states, lambda s: left_over(F.concat(F.repeat(F.lit("w"), s), mine)))
    known = F.array_repeat(left_over(F.substring_index(mine, "h", -1)), F.lit(max_words))
    tables = held.filter(F.size("_all") > F.col("_n")).select(*own, "_piece", F.when(F.contains(mine, F.lit("h")), known).otherwise(table).alias("_exit"))
    # Written out, as entry states are found from them several times: some numbers for each piece, but work on every word.
    tables = kept(tables)
    placed = held.join(folds.entry_states(tables, own, max_words), [*own, "_piece"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(0)))
    # The words of an unfinished caption stand before the piece as plain marks.
    found = F.regexp_extract_all(F.concat(F.repeat(F.lit("w"), F.col("_entry")), F.col("_marks")), F.lit(_caption_pattern(max_words, False)), F.lit(0))
    cut = F.aggregate(
        found, F.struct((1 - F.col("_entry")).alias("at"), F.array().cast("array<struct<at: int, n: int>>").alias("cuts")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m)).alias("at"), F.array_append(acc["cuts"], F.struct(acc["at"].alias("at"), F.length(m).alias("n"))).alias("cuts")
        ),
        lambda acc: acc["cuts"],
    )
    opened = lambda c: (c["at"] > F.when(F.col("_entry") > 0, 1 - F.col("_entry")).otherwise(0)) & (c["at"] <= F.col("_n"))

    # Cut out before they are exploded, so no caption drags its whole piece along, and word by word: a slice would unpack the piece each time.
    def written(c: Column) -> Column:
        places = F.sequence(c["at"] - 1, c["at"] + c["n"] - 2)
        return F.struct(
            F.get("_all", c["at"] - 1)["ord"].cast("long").alias("seg"), F.transform(places, lambda i: F.get("_all", i)).alias("words"),
            F.transform(places, lambda i: F.get("_all", i + 1)["start_s"]).alias("coming"),
        )

    return placed.select(*keys, F.explode(F.transform(F.filter(cut, opened), written)).alias("_c")).select(*keys, "_c.seg", "_c.words", "_c.coming")


def caption_positions(words: DataFrame, max_words: int = 5, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Words with ``seg``, the position of the first word of their caption, and ``next_start_s``/``next_seg`` of the word behind them."""
    each = _captions(words, max_words, list(keys)).select(
        *keys, "seg", F.size("words").alias("_n"), F.posexplode(F.arrays_zip(F.col("words").alias("w"), F.col("coming").alias("c"))).alias("_i", "_w")
    )
    # Captions follow each other without gaps, so the next one starts with the next word.
    behind = F.when(F.col("_i") + 1 < F.col("_n"), F.col("seg")).otherwise(F.when(F.col("_w.c").isNotNull(), F.col("_w.w.ord") + 1))
    return each.select(*keys, "_w.w.ord", "_w.w.word", "_w.w.start_s", "_w.w.end_s", "seg", F.col("_w.c").alias("next_start_s"), behind.cast("long").alias("next_seg"))


def group_captions(words: DataFrame, max_words: int = 5, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Captions: (video_id, seg, start_s, end_s, n_words, text)."""
    return _captions(words, max_words, list(keys)).select(
        *keys, "seg", F.col("words")[0]["start_s"].alias("start_s"), F.element_at("words", -1)["end_s"].alias("end_s"),
        F.size("words").cast("long").alias("n_words"), F.array_join("words.word", " ").alias("text"),
    )


def transcript_lines(words: DataFrame, max_words: int = LINE_WORDS) -> DataFrame:
    """Lines of one sentence or *max_words* words: (video_id, line, start_s, end_s, text)."""
    seen = scan(
        words, ["video_id"], position_bucket("ord"), ["ord"],
        prior_last={"_start": F.when(tx.ends_line("word"), F.col("ord") + 1)},
    )
    start = F.coalesce(F.col("_start"), F.lit(0).cast("long"))
    line = start + F.floor((F.col("ord") - start) / max_words) * max_words
    return without_cells(
        grouped(seen.withColumn("line", line.cast("long")), ["video_id"], "line")
        .agg(
            F.min_by("start_s", "ord").alias("start_s"),
            F.max_by("end_s", "ord").alias("end_s"),
            ordered_text("ord", "word").alias("text"),
        )
    )


def caption_hold(captions: DataFrame) -> DataFrame:
    """``held_end_s``: a caption stays until the next one when the gap is at most 0.6 s."""
    seen = scan(captions, ["video_id"], position_bucket("seg"), ["seg"], lead=["start_s"])
    gap = F.col("next_start_s") - F.col("end_s")
    held = F.when((gap >= 0) & (gap <= PAUSE_S), F.col("next_start_s")).otherwise(F.col("end_s"))
    return seen.withColumn("held_end_s", held).drop("next_start_s")


def speech_coverage(captions: DataFrame, videos: DataFrame) -> DataFrame:
    """Captioned share of each video; below 0.15 the transcription is suspect."""
    covered = without_cells(grouped(captions, ["video_id"]).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("covered_s")))
    rows = videos.join(covered, "video_id", "left").withColumn("covered_s", F.coalesce("covered_s", F.lit(0.0)))
    coverage = F.when(F.col("duration_s") > 0, F.col("covered_s") / F.col("duration_s")).otherwise(F.lit(1.0))
    return rows.withColumn("coverage", coverage).withColumn("suspect", F.col("coverage") < 0.15)


def better_transcript_run(runs: DataFrame) -> DataFrame:
    """Keep run 1 unless it covers under 0.15 and run 2 covers more."""
    per_video = runs.groupBy("video_id").agg(
        F.max(F.when(F.col("run") == 1, F.col("coverage"))).alias("first"),
        F.max(F.when(F.col("run") == 2, F.col("coverage"))).alias("second"),
    )
    second = (F.col("first") < 0.15) & (F.coalesce("second", F.lit(0.0)) > F.col("first"))
    return per_video.select(
        "video_id", F.when(second, 2).otherwise(1).alias("run"), F.when(second, F.col("second")).otherwise(F.col("first")).alias("coverage")
    )


def interval_overlap_join(clips: DataFrame, segments: DataFrame, width: float = 30.0) -> DataFrame:
    """Segments (start_s, end_s) that overlap each clip (start_time, end_time), half-open."""
    return overlap_join(clips, segments, "video_id", ("start_time", "end_time"), ("start_s", "end_s"), width=width, look=("left",))


def clip_text(clips: DataFrame, segments: DataFrame, order: str = "seg") -> DataFrame:
    """Transcript text of each clip, in order."""
    pairs = interval_overlap_join(clips.select("video_id", "ord", "start_time", "end_time"), segments)
    return without_cells(grouped(pairs, ["video_id"], "ord").agg(ordered_text(order, "text").alias("text")))


def transcript_windows(lines: DataFrame, width: float = WINDOW_S) -> DataFrame:
    """Lines per fixed window of the start time."""
    return without_cells(grouped(lines, ["video_id"], time_bucket("start_s", width).alias("window_no")).agg(F.count("*").alias("n_lines")))


def choose_window_transcript(primary: DataFrame, merged: DataFrame, width: float = WINDOW_S, share: float = 0.6) -> DataFrame:
    """Per window take the merged lines if they number at least 0.6 of the primary's, else the primary.

    Only windows of the primary exist; both inputs hold (video_id, line, start_s, text).
    """
    # Both kinds of lines of a window are counted beside each other: each is worked out once, and stays where its video lies.
    sides = [
        x.withColumns({"window_no": time_bucket("start_s", width), "origin": F.lit(origin)}).filter("video_id is not null and window_no is not null")
        for x, origin in ((primary, "primary"), (merged, "merged"))
    ]
    lines = stacked(sides, ["video_id"], {})
    inside, is_first = Window.partitionBy(*own_keys(lines), "window_no"), F.col("origin") == "primary"
    counted = lines.withColumns({"_first": F.count(F.when(is_first, 1)).over(inside), "_second": F.count(F.when(~is_first, 1)).over(inside)})
    chosen = counted.filter((F.col("_first") > 0) & (is_first != (F.col("_second") >= F.col("_first") * share)))
    columns = [c for c in primary.columns if c not in ("video_id", "window_no")]
    return without_cells(bare_keys(chosen, ["video_id"])).select("video_id", "window_no", *columns, "origin")


CACHE_KEYS = ("source", "source_size", "speech_model", "language", "words_per_sub", "use_dlp_subs")


def reusable_transcripts(requests: DataFrame, cache: DataFrame, keys: tuple[str, ...] = CACHE_KEYS) -> DataFrame:
    """Requests whose settings all match a cached transcript that has segments (nulls match nulls)."""
    on = None
    for k in keys:
        same = requests[k].eqNullSafe(cache[k])
        on = same if on is None else on & same
    return requests.join(cache, on & (F.coalesce(cache["n_segments"], F.lit(0)) > 0), "left_semi")


def chunk_words(words: DataFrame, size: int = 3) -> DataFrame:
    """Fixed-size chunks of timed words."""
    dense = scan(words, ["video_id"], position_bucket("ord"), ["ord"], ordinal="_n")
    return without_cells(
        grouped(dense, ["video_id"], F.floor((F.col("_n") - 1) / size).alias("chunk"))
        .agg(
            F.min_by("start_s", "ord").alias("start_s"),
            F.max_by("end_s", "ord").alias("end_s"),
            ordered_text("ord", "word").alias("text"),
        )
    )


def speech_sessions(words: DataFrame, gap: float = PAUSE_S) -> DataFrame:
    """Speech bursts separated by a pause longer than *gap*."""
    seen = scan(with_cells(words, ["video_id"], position_bucket("ord")), ["video_id"], position_bucket("ord"), ["ord"], lag=["end_s"])
    opens = F.col("prev_end_s").isNull() | (F.col("start_s") - F.col("prev_end_s") > gap)
    burst = scan(
        seen.withColumn("_opens", opens).drop("prev_end_s"), ["video_id"], position_bucket("ord"), ["ord"],
        run_last={"burst": F.when(F.col("_opens"), F.col("ord"))},
    )
    return without_cells(grouped(burst, ["video_id"], "burst").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n_words")
    ))


# ---- cues ----------------------------------------------------------------------------
def _clip_relative(start: Column, end: Column) -> dict[str, Column]:
    return {
        "cue_start": F.greatest(F.lit(0.0), start - F.col("start_time")),
        "cue_end": F.least(F.col("end_time") - F.col("start_time"), end - F.col("start_time")),
    }


def caption_cues(captions: DataFrame, clips: DataFrame) -> DataFrame:
    """Clip-relative caption times; empty cues are dropped."""
    held = caption_hold(captions)
    pairs = overlap_join(clips, held, "video_id", ("start_time", "end_time"), ("start_s", "held_end_s"), look=("left",))
    return pairs.withColumns(_clip_relative(F.col("start_s"), F.col("held_end_s"))).filter("cue_start < cue_end")


def word_cues(placed: DataFrame, clips: DataFrame) -> DataFrame:
    """Clip-relative word times: a word lasts to the next word of its caption, the last to the held end.

    ``placed`` are words with their caption ``seg``; what comes behind them is looked up where ``caption_positions`` has not told it.
    """
    told = "next_start_s" in placed.columns and "next_seg" in placed.columns
    seen = placed if told else scan(placed, ["video_id"], position_bucket("ord"), ["ord"], lead=["start_s", "seg"])
    gap = F.col("next_start_s") - F.col("end_s")
    same = F.col("next_seg") == F.col("seg")
    until = F.when(same | ((gap >= 0) & (gap <= PAUSE_S)), F.col("next_start_s")).otherwise(F.col("end_s"))
    spans = seen.withColumn("until_s", F.coalesce(until, F.col("end_s"))).drop("next_start_s", "next_seg")
    clip = clips.withColumnRenamed("ord", "clip_ord")
    pairs = overlap_join(clip, spans, "video_id", ("start_time", "end_time"), ("start_s", "until_s"), look=("left",))
    return pairs.withColumns(_clip_relative(F.col("start_s"), F.col("until_s"))).filter("cue_start < cue_end")


# ---- words and styles ------------------------------------------------------------------
def emphasis_lookup(words: DataFrame, plan: DataFrame) -> DataFrame:
    """Styling of the words a clip's plan names; later plan rows win.

    ``words`` and ``plan`` share video_id and clip; the plan has (ord, word, style, scale_level).
    """
    keys = ["video_id", "_key"]
    styled = plan.select(
        "video_id", tx.bare_ascii_word("word").alias("_key"), "style", "scale_level", F.col("ord").alias("_ord")
    )
    styled = last_per_key(styled, keys, ["_ord"]).drop("_ord")
    return words.withColumn("_key", tx.bare_ascii_word("word")).join(styled, keys, "left").drop("_key")


def apply_word_map(words: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace words by a (word, replacement, ord) mapping; the first entry of a word wins."""
    firsts = first_per_key(
        mapping.select(tx.bare_word("word").alias("_key"), "replacement", F.col("ord").alias("_ord")), ["_key"], ["_ord"]
    ).filter(F.col("_key") != "").drop("_ord")
    joined = words.withColumn("_key", tx.bare_word("word")).join(firsts, "_key", "left").drop("_key")
    fresh = F.coalesce("replacement", "word")
    return joined.withColumn("changed", fresh != F.col("word")).withColumn("word", fresh).drop("replacement")
