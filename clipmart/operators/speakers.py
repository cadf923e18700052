"""Who is talking and where: speaker turns, face samples and layout decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmart.functions.links import on_path
from clipmart.functions.ordered import haloed, position_bucket, scan, time_bucket, with_cells, without_cells
from clipmart.functions.ranges import overlap_join
from clipmart.operators.transcript import interval_overlap_join
from clipmart.session import kept

MIN_ACTIVITY, LEAD_MARGIN, ACTIVITY_WINDOW_S = 0.012, 1.3, 1.5
MIN_FACE_SHARE = 0.3
SMOOTH_SAMPLES = 12


# ---- turns -------------------------------------------------------------------------
def merge_turns(turns: DataFrame, max_gap: float = 0.5) -> DataFrame:
    """Join consecutive turns of one speaker closer than *max_gap*; the end is the last turn's end."""
    cells = with_cells(turns, ["video_id"], position_bucket("ord"))
    seen = scan(cells, ["video_id"], position_bucket("ord"), ["ord"], lag=["speaker", "end_s"])
    joins = (F.col("prev_speaker") == F.col("speaker")) & (F.col("start_s") - F.col("prev_end_s") < max_gap)
    opened = seen.withColumn("_open", F.when(~F.coalesce(joins, F.lit(False)), F.col("ord"))).drop("prev_speaker", "prev_end_s")
    marked = scan(opened, ["video_id"], position_bucket("ord"), ["ord"], run_last={"turn": F.col("_open")})
    return marked.groupBy("video_id", "turn", "speaker").agg(
        F.min_by("start_s", "ord").alias("start_s"), F.max_by("end_s", "ord").alias("end_s")
    )


def active_speakers_at(samples: DataFrame, turns: DataFrame) -> DataFrame:
    """Distinct speakers at each sample time (ends included), in turn order, and the first of them.

    ``samples``: (video_id, ord, idx, t); samples without a speaker keep an empty list.
    """
    keys = ["video_id", "ord", "idx"]
    said = turns.select("video_id", F.col("ord").alias("_turn"), "speaker", "start_s", "end_s")
    pairs = overlap_join(samples.select(*keys, "t"), said, "video_id", ("t", "t"), ("start_s", "end_s"), closed=True)
    firsts = pairs.groupBy(*keys, "speaker").agg(F.min("_turn").alias("_turn"))
    active = firsts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_turn", "speaker")))["speaker"].alias("speakers"))
    return samples.join(active, keys, "left").withColumn(
        "speakers", F.coalesce("speakers", F.array().cast("array<string>"))
    ).withColumn("first_speaker", F.get("speakers", 0))


def speaking_time(clips: DataFrame, turns: DataFrame) -> DataFrame:
    """Seconds each speaker talks in each clip, ranked; silent speakers of the video are kept."""
    keys = ["video_id", "ord", "speaker"]
    said = turns.select("video_id", "speaker", "start_s", "end_s")
    pairs = interval_overlap_join(clips.select("video_id", "ord", "start_time", "end_time"), said)
    talk = pairs.groupBy(*keys).agg(
        F.sum(F.least("end_s", "end_time") - F.greatest("start_s", "start_time")).alias("seconds")
    )
    everyone = clips.select("video_id", "ord").join(turns.select("video_id", "speaker").distinct(), "video_id")
    best = Window.partitionBy("video_id", "ord").orderBy(F.desc("seconds"), "speaker")
    return (
        everyone.join(talk, keys, "left")
        .withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
        .withColumn("place", F.row_number().over(best))
    )


# ---- faces ----------------------------------------------------------------------------
def face_share(samples: DataFrame) -> DataFrame:
    """Share of samples with a face; clips that rarely show one get the ``fill`` layout."""
    share = samples.groupBy("clip_id").agg(F.avg((F.col("faces") > 0).cast("double")).alias("face_share"))
    return share.withColumn("layout", F.when(F.col("face_share") < MIN_FACE_SHARE, "fill").otherwise("crop"))


def max_faces(samples: DataFrame) -> DataFrame:
    """Most faces in any frame (at least 1) and the speaker bounds it suggests."""
    return samples.groupBy("clip_id").agg(F.greatest(F.max("faces"), F.lit(1)).alias("min_speakers")).withColumn(
        "max_speakers", F.col("min_speakers") + 2
    )


def frame_summary(frames: DataFrame) -> DataFrame:
    """One row per frame from one row per face: face count, outermost positions, active speakers."""
    return frames.groupBy("clip_id", "idx").agg(
        F.count("*").alias("n_faces"),
        F.min("cx").alias("left_x"),
        F.max("cx").alias("right_x"),
        F.sort_array(F.collect_set("speaker")).alias("speakers"),
    )


def canonical_positions(frames: DataFrame) -> DataFrame:
    """Median position of each speaker over frames with one face and one speaker."""
    solo = frame_summary(frames).filter((F.col("n_faces") == 1) & (F.size("speakers") == 1))
    return solo.groupBy("clip_id", F.col("speakers")[0].alias("speaker")).agg(F.median("left_x").alias("cx"))


def solo_speakers(frames: DataFrame) -> DataFrame:
    """A speaker is solo when seen alone in more frames than in company."""
    each = frame_summary(frames).withColumn("speaker", F.explode("speakers"))
    alone = (F.col("n_faces") == 1) & (F.size("speakers") == 1)
    return each.groupBy("clip_id", "speaker").agg(
        F.count_if(alone).alias("solo_frames"), F.count_if(F.col("n_faces") >= 2).alias("shared_frames")
    ).withColumn("is_solo", F.col("solo_frames") > F.col("shared_frames"))


def left_right_positions(frames: DataFrame, width: float) -> DataFrame:
    """Median leftmost and rightmost position over frames with several faces; quarters of the width otherwise."""
    several = F.col("n_faces") >= 2
    return frame_summary(frames).groupBy("clip_id").agg(
        F.coalesce(F.median(F.when(several, F.col("left_x"))), F.lit(width * 0.25)).alias("left_x"),
        F.coalesce(F.median(F.when(several, F.col("right_x"))), F.lit(width * 0.75)).alias("right_x"),
    )


def neighbour_distance(frames: DataFrame, width: float) -> DataFrame:
    """Distance of each face to the nearest other face of its frame (frame width when alone)."""
    across = Window.partitionBy("clip_id", "idx").orderBy("cx", "face_no")
    near = F.least(F.col("cx") - F.lag("cx").over(across), F.lead("cx").over(across) - F.col("cx"))
    return frames.withColumn("distance", F.coalesce(near.cast("double"), F.lit(float(width))))


def min_face_distance(frames: DataFrame, width: float) -> DataFrame:
    return neighbour_distance(frames, width).groupBy("clip_id").agg(F.min("distance").alias("min_distance"))


def nearest_speaker(frames: DataFrame, canonical: DataFrame, width: float) -> DataFrame:
    """Single-face frames go to the speaker whose usual position is nearest (frame centre when unknown).

    ``canonical``: (clip_id, speaker, cx), one row per speaker of the clip.
    """
    single = frame_summary(frames).filter("n_faces = 1").select("clip_id", "idx", F.col("left_x").alias("x"))
    usual = canonical.select("clip_id", "speaker", F.coalesce("cx", F.lit(width / 2)).alias("_home"))
    gap = F.abs(F.col("x") - F.col("_home"))
    return single.join(usual, "clip_id").groupBy("clip_id", "idx").agg(
        F.min("x").alias("x"), F.min_by("speaker", F.struct(gap, "speaker")).alias("speaker")
    )


def mouth_activity(faces: DataFrame, step: float = 0.25) -> DataFrame:
    """Centred rolling deviation of the mouth opening per track; 0 with fewer than three values."""
    half = max(1, round(ACTIVITY_WINDOW_S / step / 2))

    def measured(window):
        near = window.rangeBetween(-half, half)
        return F.when(F.count("mouth").over(near) >= 3, F.stddev_pop("mouth").over(near)).otherwise(F.lit(0.0))

    return haloed(faces, ["clip_id", "track"], "idx", half, half, {"activity": measured})


def clear_talker(activity: DataFrame) -> DataFrame:
    """Per frame with two or more faces: the clearly most active one (null when unclear).

    ``activity``: (clip_id, idx, track, activity); ties go to the lower track.
    """
    ranked = activity.groupBy("clip_id", "idx").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("activity")).alias("neg"), "track"))).alias("r")
    ).filter(F.size("r") >= 2)
    top, second = -F.col("r")[0]["neg"], -F.col("r")[1]["neg"]
    clear = (top >= MIN_ACTIVITY) & (top >= second * LEAD_MARGIN)
    return ranked.select("clip_id", "idx", F.when(clear, F.col("r")[0]["track"]).alias("talker"))


def forward_fill_positions(samples: DataFrame) -> DataFrame:
    """A missed detection keeps the last position; a leading gap takes the first hit.

    Clips without any detection are dropped.
    """
    filled = scan(
        samples, ["clip_id"], position_bucket("idx"), ["idx"],
        run_last={"_past": F.col("cx")}, next_first={"_coming": F.col("cx")},
    )
    return filled.withColumn("filled_x", F.coalesce("_past", "_coming")).filter("filled_x is not null").drop("_past", "_coming")


def stable_face_count(samples: DataFrame, window_rows: int = SMOOTH_SAMPLES) -> DataFrame:
    """Most frequent face count of the last samples of a scene; ties go to the smaller count."""

    def recent(window):
        return F.collect_list("faces").over(window.rangeBetween(-(window_rows - 1), 0))

    seen = haloed(samples, ["clip_id", "scene"], "idx", window_rows - 1, 0, {"_recent": recent})
    votes = F.transform(
        F.array_distinct("_recent"),
        lambda v: F.struct(F.size(F.filter("_recent", lambda x: x == v)).alias("n"), (-v).alias("neg")),
    )
    return seen.withColumn("stable_count", -F.array_max(votes)["neg"]).drop("_recent")


def confirmed_runs(series: DataFrame, hold: int, absent_hold: int | None = None) -> DataFrame:
    """A new value counts only once it has lasted *hold* samples; the change is dated back to its start.

    ``series``: (clip_id, idx, value) without gaps. The first value counts at once. A null value (nobody is there) has a hold of its own,
    *absent_hold*, so that a short loss of a face does not drop the person.
    """
    bucket = position_bucket("idx")
    seen = scan(with_cells(series, ["clip_id"], bucket), ["clip_id"], bucket, ["idx"], lag=["idx", "value"])
    opens = F.col("prev_idx").isNull() | ~F.col("prev_value").eqNullSafe(F.col("value"))
    opened = seen.withColumns({"_open": F.when(opens, F.col("idx")), "_first": F.col("prev_idx").isNull()})
    runs = without_cells(
        scan(opened.drop("prev_idx", "prev_value"), ["clip_id"], bucket, ["idx"], run_last={"_run": F.col("_open")})
    )
    lengths = runs.groupBy("clip_id", "_run").agg(
        F.count("*").alias("_n"), F.max("_first").alias("_first"), F.first("value").alias("_value")
    )
    needed = F.when(F.col("_value").isNull(), hold if absent_hold is None else absent_hold).otherwise(hold)
    lasting = F.when(F.col("_first") | (F.col("_n") >= needed), F.struct("_value"))
    states = scan(lengths, ["clip_id"], position_bucket("_run"), ["_run"], run_last={"_kept": lasting})
    return runs.join(states.select("clip_id", "_run", "_kept"), ["clip_id", "_run"]).select(
        *series.columns, F.col("_kept._value").alias("confirmed")
    )


# ---- timelines ----------------------------------------------------------------------------
CLIP = ["video_id", "ord"]
#: Clips with sample numbers below this are folded as one array, longer ones follow links.
FOLDED = 512
OUT = "array<struct<idx: bigint, layout: string, speaker: string>>"


def _by_length(rows: DataFrame, fold, follow) -> DataFrame:
    """*fold* of the clips that fit one array and *follow* of the others, both with the same columns."""
    long = rows.filter(F.col("idx") >= FOLDED).select(*[F.col(c).alias(f"_{c}") for c in CLIP]).distinct()
    if long.isEmpty():
        return fold(rows)
    same = F.col("video_id").eqNullSafe(F.col("_video_id")) & F.col("ord").eqNullSafe(F.col("_ord"))
    return fold(rows.join(long, same, "left_anti")).unionByName(follow(kept(rows.join(long, same, "left_semi"))))


def _folded(rows: DataFrame, fields: list[str], start: Column, step) -> DataFrame:
    """The timeline of short clips: *step* leads from state (layout, speaker, last) and sample to the next state."""
    clips = rows.groupBy(*CLIP).agg(F.sort_array(F.collect_list(F.struct("idx", "t", *fields))).alias("_s"))

    def write(acc: Column, s: Column) -> Column:
        layout, speaker, last = step(acc, s)
        row = F.struct(s["idx"].cast("long").alias("idx"), layout.alias("layout"), speaker.alias("speaker"))
        return F.struct(layout.alias("layout"), speaker.alias("speaker"), last.alias("last"), F.array_append(acc["out"], row).alias("out"))

    first = F.struct(*[start[c].alias(c) for c in ("layout", "speaker", "last")], F.array().cast(OUT).alias("out"))
    return clips.select(*CLIP, F.explode(F.aggregate("_s", first, write, lambda acc: acc["out"])).alias("_o")).select(
        *CLIP, F.col("_o.idx").cast(dict(rows.dtypes)["idx"]).alias("idx"), "_o.layout", "_o.speaker"
    )


def _start(layout: str, last: float) -> Column:
    return F.struct(F.lit(layout).alias("layout"), F.lit(None).cast("string").alias("speaker"), F.lit(last).alias("last"))


def _linked(nodes: DataFrame, hold: float, target: Column) -> DataFrame:
    """Nodes with ``no``, ``later`` (the first *target* at or after ``t + hold`` whose token differs) and ``next_other`` (the next non-target)."""
    bucket = position_bucket("idx")
    one = F.when(target, F.struct("token"))
    seen = scan(with_cells(nodes, CLIP, bucket), CLIP, bucket, ["idx"], prior_last={"_one": one}, ordinal="no")
    opens = target & (F.col("_one").isNull() | ~F.col("_one.token").eqNullSafe(F.col("token")))
    placed = without_cells(scan(
        seen.withColumn("_opens", opens), CLIP, bucket, ["idx"],
        later_first={"_change": F.when(F.col("_opens"), F.col("no")), "next_other": F.when(~target, F.col("no"))},
    )).drop("_one", "_opens")
    # As-of: the first target from the end of the hold on; where it has the same token, the next change after it.
    columns = [*CLIP, "idx", "t", "no", "token", "next_other", *[c for c in placed.columns if c not in {*CLIP, "idx", "t", "no", "token", "next_other"}]]
    asks = placed.select(*columns, (F.col("t") + hold).alias("_at"), F.lit(0).alias("_kind"))
    told = placed.filter(target).select(*columns, F.col("t").alias("_at"), F.lit(1).alias("_kind"))
    found = scan(
        asks.unionByName(told), CLIP, time_bucket("_at"), ["_at", "_kind", "no"],
        next_first={"_found": F.when(F.col("_kind") == 1, F.struct("no", "token", "_change"))},
    ).filter("_kind = 0")
    later = F.when(F.col("_found.token") == F.col("token"), F.col("_found._change")).otherwise(F.col("_found.no"))
    return found.withColumn("later", later).drop("_at", "_kind", "_found", "_change")


def _held(samples: DataFrame, taken: DataFrame, layout: Column) -> DataFrame:
    """Each sample with what was taken last: ``_now`` (token, layout)."""
    rows = samples.withColumns({"_kind": F.lit(1), "_taken": F.lit(None).cast("struct<token: string, layout: string>")})
    news = taken.select(*CLIP, "idx", F.lit(0).alias("_kind"), F.struct("token", layout.alias("layout")).alias("_taken"))
    both = rows.unionByName(news, allowMissingColumns=True)
    return scan(both, CLIP, position_bucket("idx"), ["idx", "_kind"], run_last={"_now": F.col("_taken")}).filter("_kind = 1").drop("_kind", "_taken")


def _silent_again(linked: DataFrame) -> DataFrame:
    """(clip, _many, token, _exit): for a shot of several people and one of them, the next such shot without this person."""
    seen = linked.filter("many").select(*CLIP, "no", "next_other", F.explode(F.array_distinct("speakers")).alias("token"))
    keys, bucket = [*CLIP, "token"], position_bucket("no")
    each = scan(with_cells(seen, keys, bucket), keys, bucket, ["no"], lead=["no"])
    gone = F.when(~F.col("next_no").eqNullSafe(F.col("next_other")) | F.col("next_other").isNull(), F.struct("next_other"))
    known = scan(each.withColumn("_gone", gone), keys, bucket, ["no"], next_first={"_exit": F.col("_gone")})
    return known.select(*[F.col(c).alias(f"_{c}") for c in [*CLIP, "token"]], F.col("no").alias("_many"), F.struct(F.col("_exit.next_other").alias("no")).alias("_exit"))


def speaker_switch_timeline(samples: DataFrame, solo: DataFrame, hold: float = 2.0) -> DataFrame:
    """Speaker on camera per sample.

    ``samples``: (video_id, ord, idx, t, speakers), one row for each ``idx``, ``t`` does not decrease along it; ``solo``: (video_id, speaker) of
    speakers mostly seen alone. One active speaker takes over once ``t`` is *hold* seconds past the last change; when several talk and the
    current one is silent, the first takes over at once, and a scene of shared shots is blurred;
    silence keeps the current speaker.

    Short clips are folded. In longer ones, the state after a change depends on its sample alone: each possible change links to the one that
    would follow it, and the changes are those on the path from the first. No array holds a long clip's samples.
    """
    alone = solo.groupBy("video_id").agg(F.collect_set("speaker").alias("_solo"))
    n = F.size("speakers")
    # The series is passed over several times; written out, plans do not grow with the product of these passes.
    rows = kept(samples.join(alone, "video_id", "left").select(
        *CLIP, "idx", "t", "speakers", n.alias("n"),
        ((n >= 2) & ~F.coalesce(F.arrays_overlap("speakers", "_solo"), F.lit(False))).alias("shared"),
    ))
    return _by_length(rows, lambda r: _folded_switches(r, hold), lambda r: _linked_switches(r, hold))


def _folded_switches(rows: DataFrame, hold: float) -> DataFrame:
    def step(acc: Column, s: Column) -> tuple[Column, Column, Column]:
        n, first, now, shared = s["n"], F.get(s["speakers"], 0), acc["speaker"], s["shared"]
        silent = now.isNull() | ~F.array_contains(s["speakers"], now)
        take_many = (n >= 2) & ~shared & silent
        take_one = (n == 1) & (now.isNull() | ((first != now) & (s["t"] >= acc["last"] + hold)))
        take = F.coalesce(take_many | take_one, F.lit(False))
        layout = F.when(shared | ((n == 0) & now.isNull()), "blur").otherwise("crop")
        return layout, F.when(take, first).otherwise(now), F.when(take, s["t"]).otherwise(acc["last"])

    return _folded(rows, ["speakers", "n", "shared"], _start("blur", 0.0), step)


def _linked_switches(rows: DataFrame, hold: float) -> DataFrame:
    many = F.col("n") >= 2
    nodes = rows.filter("n >= 1 and not shared").select(
        *CLIP, "idx", "t", F.when(many, F.col("speakers")).alias("speakers"), F.col("speakers")[0].alias("token"), many.alias("many")
    )
    linked = kept(_linked(nodes, hold, ~F.col("many")))
    same = F.lit(True)
    for c in [*CLIP, "token"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = linked.join(_silent_again(linked), same & (F.col("next_other") == F.col("_many")), "left")
    at_once = F.when(F.col("_exit").isNotNull(), F.col("_exit.no")).otherwise(F.col("next_other"))
    taken = on_path(known.select(*CLIP, "no", F.least("later", at_once).alias("link"), "idx", "token"), CLIP, ["idx", "token"])
    held = _held(rows.select(*CLIP, "idx", "n", "shared"), taken, F.lit("crop"))
    blurred = F.col("shared") | ((F.col("n") == 0) & F.col("_now").isNull())
    return held.select(*CLIP, "idx", F.when(blurred, "blur").otherwise("crop").alias("layout"), F.col("_now.token").alias("speaker"))


def layout_timeline(samples: DataFrame, hold: float = 2.0) -> DataFrame:
    """Full frame for one active speaker, split for several, with a minimum hold between changes.

    A change counts once ``t`` is *hold* seconds past the last one; it is a change of layout or, in full frame, of the speaker. Long clips follow
    links as in ``speaker_switch_timeline``: shots of several people are one more speaker, which a clip starts with.
    """
    rows = kept(samples.select(*CLIP, "idx", "t", "speakers", F.size("speakers").alias("n")))
    return _by_length(rows, lambda r: _folded_layouts(r, hold), lambda r: _linked_layouts(r, hold))


def _folded_layouts(rows: DataFrame, hold: float) -> DataFrame:
    def step(acc: Column, s: Column) -> tuple[Column, Column, Column]:
        n, first = s["n"], F.get(s["speakers"], 0)
        wanted = F.when(n == 1, "full").when(n >= 2, "split").otherwise(acc["layout"])
        rested = s["t"] >= acc["last"] + hold
        change = (wanted != acc["layout"]) & rested
        layout = F.when(change, wanted).otherwise(acc["layout"])
        speaker = F.when(change, first).otherwise(acc["speaker"])
        # A layout change restarts the hold, so the speaker can only follow in a later sample.
        follow = ~change & rested & (layout == "full") & (n == 1) & ~first.eqNullSafe(speaker)
        return layout, F.when(follow, first).otherwise(speaker), F.when(change | follow, s["t"]).otherwise(acc["last"])

    return _folded(rows, ["speakers", "n"], _start("split", -float(hold)), step)


def _linked_layouts(rows: DataFrame, hold: float) -> DataFrame:
    several = F.lit("")
    token = F.when(F.col("n") == 1, F.concat(F.lit("1"), F.col("speakers")[0])).otherwise(several)
    nodes = rows.filter("n >= 1").select(*CLIP, "idx", "t", token.alias("token"), F.col("speakers")[0].alias("first"))
    # The opening split rests already when the clip starts.
    opening = rows.select(*CLIP).distinct().select(
        *CLIP, F.lit(-1).cast(dict(rows.dtypes)["idx"]).alias("idx"), F.lit(-float(hold)).alias("t"), several.alias("token"), F.lit(None).cast("string").alias("first")
    )
    linked = _linked(nodes.unionByName(opening), hold, F.lit(True))
    taken = on_path(linked.select(*CLIP, "no", F.col("later").alias("link"), "idx", "token", "first"), CLIP, ["idx", "token", "first"]).filter("idx >= 0")
    full = F.when(F.col("token") == several, "split").otherwise("full")
    news = taken.select(*CLIP, "idx", F.col("first").alias("token"), full.alias("layout"))
    held = _held(rows.select(*CLIP, "idx"), news, F.col("layout"))
    return held.select(*CLIP, "idx", F.coalesce("_now.layout", F.lit("split")).alias("layout"), F.col("_now.token").alias("speaker"))
