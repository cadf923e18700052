"""Clip candidates: clean-up, de-overlapping, ranking and cut points on word edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmart.functions import text as tx
from clipmart.functions.ordered import CELL, bare_keys, first_per_key, own_keys, scan, stacked, time_bucket, with_cells, without_cells
from clipmart.functions.ranges import overlap_join
from clipmart.session import ensure_checkpoint_dir, kept

MIN_CLIP_S, MAX_CLIP_S = 30.0, 80.0
SHORT_TOLERANCE = 0.9
MAX_OVERLAP = 0.25
MIN_SCORE = 60
MIN_HASHTAGS, MAX_HASHTAGS = 10, 15
TITLE_CHARS, ON_SCREEN_CHARS, MAX_KEYWORDS = 100, 42, 8
SPAN = "struct<start_time: double, end_time: double>"


def clip_score(value: str | Column) -> Column:
    """``int(float(x))``; missing or unreadable scores are 0."""
    return F.coalesce(tx.col(value).cast("string").try_cast("double").try_cast("int"), F.lit(0))


def _truthy(value: Column) -> Column:
    return F.when(value != 0, value)


# ---- metadata text -------------------------------------------------------------------
def clip_metadata_text(cands: DataFrame) -> DataFrame:
    """Publishable title, headline, hashtags, keywords and description of each candidate.

    Staged so that each long text is cleaned once: a stage only refers to finished columns.
    A hashtag keeps letters, digits and underscores; digit-only tags are dropped. The headline
    loses surrounding quotes and hashtags and is cut at a word boundary.

    All of them keep the beginning of a text only, so its first words are cleaned first; where these
    do not fill the limit (short texts, repeated tags, quotes or hashtags in front), the whole text is.
    """
    tags = F.coalesce(F.when(F.col("hashtags") != "", F.col("hashtags")), F.col("hashtag"), F.lit(""))
    given = F.coalesce("keyword_tags", F.array().cast("array<string>"))

    def bodies(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(tx.squash(text), r"[^\p{L}\p{N}_ ]+", ""), r"(?<![^ ])\p{Nd}+(?![^ ])", "")

    def keywords(items: Column) -> Column:
        return F.filter(F.transform(items, tx.squash), lambda t: t != "")

    def headline(text: str | Column) -> Column:
        bare = tx.squash(F.trim(tx.squash(text), F.lit("\"'“”‘’")))
        return F.array_join(F.filter(F.split(bare, " "), lambda w: ~F.startswith(w, F.lit("#"))), " ")

    def kinds(of: Column) -> Column:
        return F.size(F.array_distinct(of))

    staged = cands.withColumns(
        {
            "hook_text": tx.squash("hook_text"),
            "description_hook": tx.squash("description_hook"),
            "description_context": tx.squash("description_context"),
            "_title": tx.squash(tx.first_words("title", TITLE_CHARS // 2)),
            "_hook": headline(tx.first_words("on_screen_hook", ON_SCREEN_CHARS // 2)),
            "_tag_text": bodies(tx.first_words(tags, 4 * MAX_HASHTAGS)),
            "_words": keywords(F.slice(given, 1, 4 * MAX_KEYWORDS)),
        }
    ).withColumns(
        {
            "_title": F.when(F.length("_title") > TITLE_CHARS, F.col("_title")).otherwise(tx.squash("title")),
            "_hook": F.when(F.length("_hook") > ON_SCREEN_CHARS, F.col("_hook")).otherwise(headline("on_screen_hook")),
            "_tag_text": F.when(kinds(F.array_remove(F.split(F.lower("_tag_text"), " "), "")) >= MAX_HASHTAGS, F.col("_tag_text")).otherwise(bodies(tags)),
            "_words": F.when(kinds(F.transform("_words", F.lower)) >= MAX_KEYWORDS, F.col("_words")).otherwise(keywords(given)),
        }
    ).withColumns(
        {
            "_tags": F.array_remove(F.split("_tag_text", " "), ""),
            "_tag_keys": F.array_remove(F.split(F.lower("_tag_text"), " "), ""),
            "_word_keys": F.transform("_words", F.lower),
            "_title_head": F.substring("_title", 1, TITLE_CHARS),
            "_hook_head": F.substring("_hook", 1, ON_SCREEN_CHARS),
        }
    )

    def before_last_space(head: str) -> Column:
        return F.when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(F.col(head))

    title_cut = F.trim(before_last_space("_title_head"))
    hook_cut = F.rtrim(before_last_space("_hook_head"), F.lit(",;:-–— "))
    shaped = staged.withColumns(
        {
            "title": F.when(F.length("_title") <= TITLE_CHARS, F.col("_title")).otherwise(title_cut),
            "on_screen_hook": F.when(F.length("_hook") <= ON_SCREEN_CHARS, F.col("_hook"))
            .when(hook_cut == "", F.col("_hook_head")).otherwise(hook_cut),
            "_tags": F.transform(
                tx.first_distinct("_tags", "_tag_keys", MAX_HASHTAGS), lambda b: F.concat(F.lit("#"), b)
            ),
            "keyword_tags": tx.first_distinct("_words", "_word_keys", MAX_KEYWORDS),
        }
    ).withColumns({"hashtags": F.array_join("_tags", " "), "n_hashtags": F.size("_tags")})
    parts = F.filter(F.array("description_hook", "description_context", "hashtags"), lambda p: p != "")
    source = F.when(
        F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit("\n\nSource: "), F.col("source_url"))
    ).otherwise(F.lit(""))
    return shaped.withColumn("youtube_description", F.concat(F.array_join(parts, "\n\n"), source)).drop(
        "_title", "_title_head", "_hook", "_hook_head", "_tag_text", "_tags", "_tag_keys", "_words", "_word_keys"
    )


# ---- spans ----------------------------------------------------------------------------
def merge_spans(spans: Column) -> Column:
    """Union of overlapping or touching spans in one (small) array."""

    def add(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["start_time"].alias("start_time"), F.greatest(last["end_time"], s["end_time"]).alias("end_time"))
        return F.when(
            (F.size(acc) > 0) & (s["start_time"] <= last["end_time"]),
            F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), joined),
        ).otherwise(F.array_append(acc, s))

    return F.aggregate(F.sort_array(spans), F.array().cast(f"array<{SPAN}>"), add)


def spans_length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + s["end_time"] - s["start_time"])


def merge_segments(segments: DataFrame, key: str = "video_id", start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Union of overlapping or touching intervals per key, as a table."""
    rows = segments.select(key, F.col(start).alias("_s"), F.col(end).alias("_e"))
    marked = _islands(rows, key, ["_s", "_e"], touching=True)
    return marked.groupBy(key, "_island").agg(F.min("_s").alias(start), F.max("_e").alias(end)).drop("_island")


# ---- selection --------------------------------------------------------------------------
CLIP_ORDER = ["_neg", "ord", "start_time", "end_time"]


def _overlap_share(a_start, a_end, b_start, b_end) -> Column:
    """Overlap as a share of the shorter clip; 0 for empty clips."""
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    shortest = F.least(a_end - a_start, b_end - b_start)
    return F.when((shared > 0) & (shortest > 0), shared / shortest).otherwise(F.lit(0.0))


def _islands(rows: DataFrame, key: str, span: list[str], touching: bool) -> DataFrame:
    """Rows with ``_island``, the start of the run of overlapping (or touching) spans they belong to."""
    start, end = (F.col(c) for c in span)
    seen = scan(with_cells(rows, [key], time_bucket(start)), [key], time_bucket(start), span, prior_max={"_reach": end})
    apart = start > F.col("_reach") if touching else start >= F.col("_reach")
    opened = seen.withColumn("_open", F.when(F.col("_reach").isNull() | apart, start)).drop("_reach")
    return without_cells(scan(opened, [key], time_bucket(start), span, run_last={"_island": F.col("_open")})).drop("_open")


#: Clips of a run that is folded as one array.
RUN_CLIPS = 256


def drop_overlapping_clips(clips: DataFrame, limit: float = MAX_OVERLAP) -> DataFrame:
    """Greedy by score: a clip goes when it overlaps a better kept clip by more than *limit* of the shorter.

    Clips that share no time cannot decide about each other, so a video is cut into runs of overlapping clips. Short runs are
    folded; of longer ones (``RUN_CLIPS``) the clips that clash are joined in pairs and decided in rounds (``_dropped_in_rounds``).
    """
    rows = clips.withColumn("_neg", -clip_score("viral_score"))
    # Empty and upside-down clips overlap nothing; null times neither.
    solid = F.coalesce(F.col("end_time") > F.col("start_time"), F.lit(False))
    runs = kept(_islands(rows.filter(solid), "video_id", ["start_time", "end_time"], touching=False))
    sizes = runs.groupBy("video_id", "_island").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > RUN_CLIPS)
    long = sizes.select(F.col("video_id").alias("_video"), F.col("_island").alias("_run"))
    if long.isEmpty():
        chosen = _folded_runs(runs, limit)
    else:
        same = F.col("video_id").eqNullSafe(F.col("_video")) & (F.col("_island") == F.col("_run"))
        chosen = _folded_runs(runs.join(long, same, "left_anti"), limit).unionByName(_chosen_in_rounds(runs.join(long, same, "left_semi"), limit))
    return chosen.select(*rows.columns).unionByName(rows.filter(~solid)).drop("_neg")


def _folded_runs(runs: DataFrame, limit: float) -> DataFrame:
    """The clips kept of runs that fit one array."""
    payload = [c for c in runs.columns if c not in CLIP_ORDER and c != "video_id"]
    ranked = runs.groupBy("video_id", F.col("_island").alias("_run")).agg(F.sort_array(F.collect_list(F.struct(*CLIP_ORDER, *payload))).alias("_all"))

    def take(chosen: Column, x: Column) -> Column:
        clash = F.exists(
            chosen,
            lambda k: _overlap_share(x["start_time"], x["end_time"], k["start_time"], k["end_time"]) > limit,
        )
        return F.when(clash, chosen).otherwise(F.array_append(chosen, x))

    return ranked.select("video_id", F.explode(F.aggregate("_all", F.slice(F.col("_all"), 1, 0), take)).alias("_c")).select("video_id", "_c.*")


def _chosen_in_rounds(runs: DataFrame, limit: float) -> DataFrame:
    """The clips kept of long runs. Of clips with one and the same span only the best can stay, so only that one is paired."""
    single = first_per_key(runs, ["video_id", "_island", "start_time", "end_time"], CLIP_ORDER)
    rows = kept(single.withColumn("_id", F.monotonically_increasing_id()))
    rank = F.struct(*CLIP_ORDER)
    # Stand-ins for null keys, so that clips of no video meet as well.
    keyed = with_cells(rows, ["video_id"], {})
    group = F.struct(*[c for c in keyed.columns if c.startswith(f"{CELL}_k")])
    a, b = (keyed.select(group.alias("_group"), F.col("_id").alias(f"_id_{s}"), rank.alias(f"_rank_{s}"), F.col("start_time").alias(f"_s_{s}"), F.col("end_time").alias(f"_e_{s}")) for s in "ab")
    met = overlap_join(a, b, "_group", ("_s_a", "_e_a"), ("_s_b", "_e_b")).filter(F.col("_rank_a") < F.col("_rank_b"))
    clash = _overlap_share(F.col("_s_a"), F.col("_e_a"), F.col("_s_b"), F.col("_e_b")) > limit
    dropped = _dropped_in_rounds(met.filter(clash).select(F.col("_id_a").alias("better"), F.col("_id_b").alias("worse")))
    return rows.join(dropped, "_id", "left_anti").drop("_id")


def _dropped_in_rounds(clashes: DataFrame) -> DataFrame:
    """(_id) of the clips that a kept one drops, from the pairs (better, worse) that clash.

    In each round the clips that no open one beats are kept, and what they clash with is dropped; pairs with a dropped clip are
    settled. A round decides all local bests at once: scores in any order take about log(n) rounds. The bound is the length of the
    longest chain of clashing clips with falling rank, half of which rounds a run that only falls along time would take.
    """
    open_pairs, dropped = kept(clashes), []
    while not open_pairs.isEmpty():
        best = open_pairs.select(F.col("better").alias("_id")).distinct().join(open_pairs.select(F.col("worse").alias("_id")), "_id", "left_anti")
        gone = kept(open_pairs.join(best, F.col("better") == F.col("_id"), "left_semi").select(F.col("worse").alias("_id")).distinct())
        dropped.append(gone)
        settled = open_pairs.join(gone, F.col("worse") == F.col("_id"), "left_anti").join(gone, F.col("better") == F.col("_id"), "left_anti")
        open_pairs = kept(settled)
    out = dropped[0] if dropped else clashes.select(F.col("worse").alias("_id"))
    for more in dropped[1:]:
        out = out.unionByName(more)
    return out


def drop_weak_clips(clips: DataFrame, minimum: int = MIN_SCORE) -> DataFrame:
    """Drop clips under the minimum score where the video has one at or above it."""
    best = clips.groupBy("video_id").agg(F.max(clip_score("viral_score")).alias("_best"))
    return (
        clips.join(best, "video_id")
        .filter((F.col("_best") < minimum) | (clip_score("viral_score") >= minimum))
        .drop("_best")
    )


def rank_clips(clips: DataFrame) -> DataFrame:
    """Rank 1..n per video by score, ties in input order."""
    rows = clips.drop("rank").withColumn("_neg", -clip_score("viral_score"))
    buckets = {"_score_bucket": F.col("_neg"), "_ord_bucket": F.floor(F.col("ord") / 4096)}
    return scan(rows, ["video_id"], buckets, CLIP_ORDER, ordinal="rank").drop("_neg")


# ---- normalisation -------------------------------------------------------------------------
def _timed(cands: DataFrame, min_s: float, max_s: float) -> DataFrame:
    """Start and end with their fallbacks, trimmed to the maximum; too short clips are dropped.

    A start or end of 0 falls through to the next field.
    """
    start = F.coalesce(_truthy(F.col("start_time")), _truthy(F.col("clip_start")), F.col("start"), F.lit(0.0))
    end = F.coalesce(_truthy(F.col("end_time")), _truthy(F.col("clip_end")), F.col("end"), F.lit(0.0))
    timed = cands.withColumns({"_s": start, "_e": end}).withColumn("_span", F.col("_e") - F.col("_s"))
    return timed.withColumns(
        {"start_time": F.col("_s"), "end_time": F.when(F.col("_span") > max_s, F.col("_s") + max_s).otherwise(F.col("_e"))}
    ).filter(F.least(F.col("_span"), F.lit(max_s)) >= min_s * SHORT_TOLERANCE)


def clean_candidates(cands: DataFrame, min_s: float = MIN_CLIP_S, max_s: float = MAX_CLIP_S) -> DataFrame:
    """Row-wise clean-up of raw candidates: timing, hook, keep-segments, text and warnings."""
    floor_s = min_s * SHORT_TOLERANCE
    timed = _timed(cands, min_s, max_s)

    has_hook = F.col("hook_start_time").isNotNull() & F.col("hook_end_time").isNotNull()
    hook_start = F.least(F.greatest("hook_start_time", "start_time"), F.col("end_time"))
    hook_end = F.least(F.greatest(F.col("hook_end_time"), hook_start), F.col("end_time"))
    hook_ok = has_hook & (hook_end > hook_start)
    lost_hook = has_hook & (hook_end <= hook_start)

    clamped = F.filter(
        F.transform(
            "keep_segments",
            lambda s: F.struct(
                F.greatest(s["start_time"], F.col("start_time")).alias("start_time"),
                F.least(s["end_time"], F.col("end_time")).alias("end_time"),
            ),
        ),
        lambda s: s["end_time"] > s["start_time"],
    )
    shaped = clip_metadata_text(
        timed.withColumns(
            {
                "_hook_start": F.when(hook_ok, hook_start).when(~has_hook, F.col("hook_start_time")),
                "_hook_end": F.when(hook_ok, hook_end).when(~has_hook, F.col("hook_end_time")),
                "_lost_hook": lost_hook,
                "_given": F.coalesce(F.size("keep_segments"), F.lit(0)) > 0,
                "_merged": merge_spans(F.coalesce(clamped, F.array().cast(f"array<{SPAN}>"))),
            }
        ).withColumn("_kept_s", spans_length(F.col("_merged")))
    )
    short_trim = F.col("_given") & ((F.size("_merged") == 0) | (F.col("_kept_s") < floor_s))

    def warn(condition: Column, message: Column | str) -> Column:
        return F.when(condition, F.lit(message) if isinstance(message, str) else message)

    limit_text = f"{max_s:g}"
    warnings = F.array(
        warn(F.col("_span") > max_s, F.format_string(f"cut to {limit_text}s, was %.1fs", F.col("_span"))),
        warn(F.col("_lost_hook"), "hook ends before it begins, default hook used"),
        warn(F.col("hook_text") == "", "no hook text"),
        warn(short_trim, F.format_string("kept segments last only %.1fs, whole clip used", F.col("_kept_s"))),
        warn(F.col("title") == "", "no title"),
        warn(
            F.col("n_hashtags") < MIN_HASHTAGS,
            F.format_string(f"%d of {MIN_HASHTAGS} to {MAX_HASHTAGS} hashtags", F.col("n_hashtags")),
        ),
        warn(F.col("description_hook") == "", "no opening line in the description"),
        warn(F.col("description_context") == "", "no context in the description"),
        warn(F.size("keyword_tags") < 5, F.format_string("%d of 5 to 8 keyword tags", F.size("keyword_tags"))),
        warn(F.length("youtube_description") < 30, "description under 30 characters"),
    )
    return shaped.withColumns(
        {
            "hook_start_time": F.col("_hook_start"),
            "hook_end_time": F.col("_hook_end"),
            "keep_segments": F.when(F.col("_given") & ~short_trim, F.col("_merged")),
            "viral_score": clip_score("viral_score"),
            "warnings": F.array_compact(warnings),
        }
    ).drop("_s", "_e", "_span", "_hook_start", "_hook_end", "_lost_hook", "_given", "_merged", "_kept_s")


def select_clips(clips: DataFrame, limit: float = MAX_OVERLAP, minimum: int = MIN_SCORE) -> DataFrame:
    """De-overlapped, weak clips dropped, ranked."""
    return rank_clips(drop_weak_clips(drop_overlapping_clips(clips, limit), minimum))


def normalize_clips(cands: DataFrame, min_s: float = MIN_CLIP_S, max_s: float = MAX_CLIP_S) -> DataFrame:
    """The whole candidate job: clean, drop overlaps, drop weak clips, rank.

    The selection needs times and scores only, so it runs on narrow rows first; text is
    cleaned for the clips that stay. (video_id, ord) identifies a candidate.
    """
    cands = cands.drop("rank")
    narrow = _timed(cands, min_s, max_s).select(
        "video_id", "ord", "start_time", "end_time", clip_score("viral_score").alias("viral_score")
    )
    chosen = select_clips(narrow).select("video_id", "ord", "rank")
    # The stand-ins are joined as well, so candidates that lie by video stay there with their texts, and the ranks come to them.
    texts, ranks = (with_cells(x, ["video_id"], {}) for x in (cands, chosen))
    found = texts.join(ranks.hint("merge").drop(f"{CELL}_m", f"{CELL}_km"), [*own_keys(texts), "video_id", "ord"])
    return clean_candidates(without_cells(found).select("video_id", "ord", *[c for c in cands.columns if c not in ("video_id", "ord")], "rank"), min_s, max_s)


def rendered_duration(clips: DataFrame) -> DataFrame:
    """Kept seconds when there are two or more keep-segments, else the clip length."""
    kept = F.when(F.size("keep_segments") > 1, spans_length(F.col("keep_segments")))
    return clips.withColumn("duration", F.round(F.coalesce(kept, F.col("end_time") - F.col("start_time")), 2))


def clip_preview(clips: DataFrame) -> DataFrame:
    """One flat row per clip for a listing."""
    title = F.coalesce("title", F.lit(""))
    short = F.when(F.length(title) <= 52, title).otherwise(F.concat(F.substring(title, 1, 49), F.lit("...")))
    clock = F.format_string("%d:%04.1f", F.floor(F.col("start_time") / 60), F.col("start_time") % 60)
    account = F.coalesce("account_classification.account_type", F.lit("-"))
    return clips.select(
        "video_id", "rank", "viral_score", clock.alias("start"),
        F.round(F.col("end_time") - F.col("start_time"), 1).alias("duration"), short.alias("title"), account.alias("account"),
    )


def clip_render_plan(clips: DataFrame, turns: DataFrame, hook_s: float = 3.0, teaser_offset: float = 2.0) -> DataFrame:
    """Hook window, teaser, multi-segment and speaker-layout flags of each clip."""
    speakers = turns.groupBy("video_id").agg(F.count_distinct("speaker").alias("n_speakers"))
    hook_start = F.coalesce("hook_start_time", "start_time")
    many = F.coalesce("n_speakers", F.lit(0)) >= 2
    return (
        clips.join(speakers, "video_id", "left")
        .withColumn("hook_start", hook_start)
        .withColumn("hook_end", F.coalesce(F.col("hook_end_time"), F.col("hook_start") + hook_s))
        .withColumn("use_teaser", F.col("hook_start") - F.col("start_time") >= teaser_offset)
        .withColumn("use_segments", F.coalesce(F.size("keep_segments"), F.lit(0)) > 1)
        .withColumn("can_split", many)
        .withColumn("n_speakers", F.coalesce("n_speakers", F.lit(0)))
    )


# ---- cut points -------------------------------------------------------------------------------
LEAD_IN_S, TAIL_S, SNAP_EPS = 0.12, 0.35, 0.05
EXTEND_S, RETREAT_S = 2.5, 6.0


BEFORE_ALL = -1e12  # time of the entry that stands before a video's first word


def _lookup(words: DataFrame, probes: DataFrame) -> DataFrame:
    """As-of lookup: for each probe (video_id, t, payload) the last word starting at or before ``t``.

    ``at`` is that word with its neighbours. Before the first word it is an entry without
    start or end whose ``next_start_s`` is the first word; in a video without words it is null.
    The stand-ins of the video come along, for what is grouped by it next.
    """
    entry = F.struct(*AT_FIELDS)
    none = F.lit(None).cast("double")
    start = F.struct(
        none.alias("start_s"), none.alias("end_s"), none.alias("prev_end_s"), F.col("start_s").alias("next_start_s"),
        F.lit(False).alias("is_end"), F.lit(None).cast(words.schema["last_sentence"].dataType).alias("last_sentence"),
        F.col("next_sentence"),
    )
    opening = F.struct(F.lit(BEFORE_ALL).alias("t"), F.lit(0.0).alias("_tie"), start.alias("w"))
    own = F.struct(F.col("start_s").alias("t"), F.col("end_s").alias("_tie"), entry.alias("w"))
    items = F.when(F.col("prev_end_s").isNull(), F.array(opening, own)).otherwise(F.array(own))
    w = words.select("video_id", F.explode(items).alias("x")).select(
        "video_id", "x.t", F.lit(0).alias("kind"), "x._tie", "x.w",
        F.lit(None).cast(probes.schema["payload"].dataType).alias("payload"),
    )
    p = probes.select(
        "video_id", "t", F.lit(1).alias("kind"), F.lit(0.0).alias("_tie"),
        F.lit(None).cast(w.schema["w"].dataType).alias("w"), "payload",
    )
    seen = scan(stacked([w, p], ["video_id"], time_bucket("t")), ["video_id"], time_bucket("t"), ["t", "kind", "_tie"], run_last={"at": F.col("w")})
    return bare_keys(seen.filter("kind = 1"), ["video_id"]).select(*own_keys(seen), f"{CELL}_km", "video_id", "payload", "at")


def _clean_words(words: DataFrame) -> DataFrame:
    return words.filter("end_s > start_s").select(
        "video_id", "start_s", "end_s", tx.ends_cut_sentence("word").alias("is_end")
    )


def _snapped_end(at: Column, t: Column) -> Column:
    """End of the word at ``t`` plus a tail that stops short of the next word."""
    tail = F.least(at["end_s"] + TAIL_S, F.coalesce(at["next_start_s"] - SNAP_EPS, at["end_s"] + TAIL_S))
    return F.when(at["start_s"].isNull(), t).otherwise(F.greatest(at["end_s"], tail))


def _snapped_start(at: Column, t: Column) -> Column:
    """Start of the word that covers ``t``, else of the next word, with a little lead-in."""
    covers = at["end_s"].isNotNull() & (at["end_s"] > t)
    word_start = F.when(covers, at["start_s"]).otherwise(at["next_start_s"])
    before = F.coalesce(F.when(covers, at["prev_end_s"]).otherwise(at["end_s"]), F.lit(0.0))
    snapped = F.greatest(word_start - LEAD_IN_S, F.least(before, word_start), F.lit(0.0))
    return F.when(word_start.isNull(), t).otherwise(snapped)


def _sentence_words(words: DataFrame) -> DataFrame:
    """Words with the previous word's end and the nearest sentence ends.

    A sentence end carries its snapped end. Looking it up by its own end time finds the word
    itself, unless words overlap or are very short: those are marked ``odd``.
    """
    cells = with_cells(words, ["video_id"], time_bucket("start_s"))
    near = scan(cells, ["video_id"], time_bucket("start_s"), ["start_s", "end_s"], lag=["end_s"], lead=["start_s"])
    probe, tail = F.col("end_s") - SNAP_EPS, F.col("end_s") + TAIL_S
    snap = F.greatest("end_s", F.least(tail, F.coalesce(F.col("next_start_s") - SNAP_EPS, tail)))
    odd = F.coalesce(F.col("next_start_s") <= probe, F.lit(False)) | (F.col("start_s") > probe)
    sentence = F.when(F.col("is_end"), F.struct("start_s", "end_s", snap.alias("snap_s"), odd.alias("odd")))
    found = scan(
        near.withColumn("_sentence", sentence),
        ["video_id"], time_bucket("start_s"), ["start_s", "end_s"],
        run_last={"last_sentence": F.col("_sentence")}, next_first={"next_sentence": F.col("_sentence")},
    )
    return without_cells(found).drop("_sentence")


AT_FIELDS = ["start_s", "end_s", "prev_end_s", "next_start_s", "is_end", "last_sentence", "next_sentence"]


def _look_again(points: DataFrame, words: DataFrame, t: Column) -> DataFrame:
    """The same rows with ``at`` looked up at another time."""
    rest = [c for c in points.columns if c != "at"]
    found = _lookup(words, points.select("video_id", t.alias("t"), F.struct(*rest).alias("payload")))
    return found.select("payload.*", "at").select(*points.columns)


def _finish_points(points: DataFrame, words: DataFrame, min_s: float) -> DataFrame:
    """Move ``end_time`` onto a sentence end: forward within 2.5 s, else back up to 6 s but not below the minimum.

    ``points`` (small, checkpointed) hold the word around the end before it was snapped; that
    is still the right one unless words overlap, which is checked.
    """
    probe, at = F.col("end_time") - SNAP_EPS, F.col("at")
    same = F.coalesce(at["start_s"] <= probe, F.lit(True)) & F.coalesce(at["next_start_s"] > probe, F.lit(True))
    moved = points.filter(~same)
    if not moved.isEmpty():
        points = points.filter(same).unionByName(_look_again(moved, words, probe))
    coming, past = at["next_sentence"], at["last_sentence"]
    extend = coming.isNotNull() & (coming["end_s"] - F.col("end_time") <= EXTEND_S)
    earliest = F.col("start_time") + min_s * SHORT_TOLERANCE
    retreat = past.isNotNull() & (F.col("end_time") - past["end_s"] <= RETREAT_S) & (past["end_s"] >= earliest)
    inside = at["start_s"].isNotNull() & ~at["is_end"]
    points = points.withColumn("_goal", F.when(inside, F.when(extend, coming).when(retreat, past)))
    odd = points.filter("_goal.odd")
    snapped = F.coalesce(F.col("_goal.snap_s"), F.col("end_time"))
    done = points.withColumn("end_time", F.round(snapped, 3))
    if not odd.isEmpty():
        again = _look_again(odd, words, F.col("_goal.end_s") - SNAP_EPS)
        exact = again.withColumn("end_time", F.round(_snapped_end(at, F.col("_goal.end_s")), 3))
        done = done.filter("_goal is null or not _goal.odd").unionByName(exact)
    return done.drop("at", "_goal")


def finish_sentence(clips: DataFrame, words: DataFrame, min_s: float = MIN_CLIP_S) -> DataFrame:
    """Move clip ends onto sentence ends (clips and words as in ``snap_clips_to_words``).

    Word ends must not decrease in start order (see ``clamp_word_overlaps``).
    """
    ensure_checkpoint_dir(clips.sparkSession)
    indexed = _sentence_words(_clean_words(words))
    probes = clips.select(
        "video_id", (F.col("end_time") - SNAP_EPS).alias("t"), F.struct(*clips.columns).alias("payload")
    )
    points = _lookup(indexed, probes).select("payload.*", "at").checkpoint()
    return _finish_points(points, indexed, min_s)


def snap_clips_to_words(clips: DataFrame, words: DataFrame, min_s: float = MIN_CLIP_S) -> DataFrame:
    """Snap clip, hook and keep-segment edges to word edges and end clips on a sentence end.

    ``clips``: (video_id, ord, start_time, end_time, hook_start_time, hook_end_time, keep_segments).
    Videos without words keep their clips unchanged. The words are passed over once: the
    snapped spans, a few rows per clip, are checkpointed and everything else works on them.
    """
    ensure_checkpoint_dir(clips.sparkSession)
    indexed = _sentence_words(_clean_words(words))
    spans = F.array_compact(
        F.concat(
            F.array(
                F.struct(F.lit("clip").alias("part"), F.lit(0).alias("k"), F.col("start_time").alias("s"), F.col("end_time").alias("e")),
                F.when(
                    F.col("hook_start_time").isNotNull() & F.col("hook_end_time").isNotNull(),
                    F.struct(F.lit("hook").alias("part"), F.lit(0).alias("k"), F.col("hook_start_time").alias("s"), F.col("hook_end_time").alias("e")),
                ),
            ),
            F.coalesce(
                F.transform(
                    "keep_segments",
                    lambda s, i: F.struct(F.lit("keep").alias("part"), i.alias("k"), s["start_time"].alias("s"), s["end_time"].alias("e")),
                ),
                F.array().cast("array<struct<part: string, k: int, s: double, e: double>>"),
            ),
        )
    )
    parts = clips.select("video_id", "ord", F.explode(spans).alias("x")).select("video_id", "ord", "x.*")
    probes = parts.withColumn(
        "edge", F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("s").alias("t")), F.struct(F.lit("end").alias("side"), (F.col("e") - SNAP_EPS).alias("t"))))
    ).select("video_id", "edge.t", F.struct("ord", "part", "k", "s", "e", "edge.side").alias("payload"))
    found = _lookup(indexed, probes)
    p, at = F.col("payload"), F.col("at")
    value = F.when(p["side"] == "start", _snapped_start(at, p["s"])).otherwise(_snapped_end(at, p["e"]))
    is_end = p["side"] == "end"
    # Both edges of a span meet where the words are; the word itself is needed at the end of a clip only. What is left, one row for each span, is written out.
    snapped = without_cells(
        found.withColumn("v", value)
        .groupBy(*own_keys(found), f"{CELL}_km", "video_id", p["ord"].alias("ord"), p["part"].alias("part"), p["k"].alias("k"), p["s"].alias("s"), p["e"].alias("e"))
        .agg(
            F.max(F.when(~is_end, F.col("v"))).alias("ns"),
            F.max(F.when(is_end, F.col("v"))).alias("ne"),
            F.first(F.when(is_end & (p["part"] == "clip"), at), ignorenulls=True).alias("at"),
        )
    ).checkpoint()
    upside_down = F.col("ne") <= F.col("ns")
    snapped = snapped.withColumns(
        {"_ns": F.when(upside_down, F.col("s")).otherwise(F.round("ns", 3)), "_ne": F.when(upside_down, F.col("e")).otherwise(F.round("ne", 3))}
    )
    main = snapped.filter("part = 'clip' and at is not null").select(
        "video_id", "ord", F.col("_ns").alias("start_time"), F.col("_ne").alias("end_time"), F.col("e").alias("old_end"),
        F.col("_ne").alias("raw_end"), "at",
        # A video is punctuated when there is a sentence end before or after any of its points.
        F.coalesce("at.last_sentence", "at.next_sentence").isNotNull().alias("punctuated"),
    )
    main = _finish_points(main, indexed, min_s).withColumn(
        "end_time", F.when(F.col("punctuated"), F.col("end_time")).otherwise(F.col("raw_end"))
    )
    pieces = snapped.filter("part <> 'clip'").groupBy("video_id", "ord").agg(
        F.max(F.when(F.col("part") == "hook", F.struct("_ns", "_ne"))).alias("hook"),
        F.sort_array(F.collect_list(F.when(F.col("part") == "keep", F.struct("k", "_ns", "_ne", "e")))).alias("keeps"),
    )
    moved = main.join(pieces, ["video_id", "ord"], "left")
    kept = F.filter(
        F.transform(
            "keeps",
            lambda g: F.struct(
                F.greatest(g["_ns"], F.col("start_time")).alias("start_time"),
                F.least(
                    F.when(F.abs(g["e"] - F.col("old_end")) <= 1.0, F.col("end_time")).otherwise(g["_ne"]), F.col("end_time")
                ).alias("end_time"),
            ),
        ),
        lambda s: s["end_time"] > s["start_time"],
    )
    moved = moved.select(
        "video_id", "ord", F.col("start_time").alias("_start"), F.col("end_time").alias("_end"),
        F.greatest("hook._ns", "start_time").alias("_hs"), F.least("hook._ne", "end_time").alias("_he"),
        F.col("hook").isNotNull().alias("_hook"), kept.alias("_kept"), F.lit(True).alias("_done"),
    )
    done = F.coalesce(F.col("_done"), F.lit(False))
    out = clips.join(moved, ["video_id", "ord"], "left")
    return out.withColumns(
        {
            "start_time": F.when(done, F.col("_start")).otherwise(F.col("start_time")),
            "end_time": F.when(done, F.col("_end")).otherwise(F.col("end_time")),
            "hook_start_time": F.when(done & F.col("_hook"), F.col("_hs")).otherwise(F.col("hook_start_time")),
            "hook_end_time": F.when(done & F.col("_hook"), F.col("_he")).otherwise(F.col("hook_end_time")),
            "keep_segments": F.when(done & (F.size("_kept") > 0), merge_spans(F.col("_kept"))).otherwise(F.col("keep_segments")),
        }
    ).drop("_start", "_end", "_hs", "_he", "_hook", "_kept", "_done")
