"""Publishing: manifests, upload queue, quotas, schedules and performance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmart.functions import text as tx
from clipmart.functions.ordered import last_per_key
from clipmart.session import ensure_checkpoint_dir

PUBLISH_CAP_24H = 50
MANIFEST_ORDER = ("job_id", "rank")


def at(value: str | Column) -> Column:
    return F.to_timestamp(F.lit(value)) if isinstance(value, str) else value


def hours(n: Column | float) -> Column:
    """An interval of *n* hours, fractions included."""
    seconds = (n if isinstance(n, Column) else F.lit(float(n))) * 3600
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A global 1-based position ``i`` along columns of any type (nulls first).

    Rows are range-partitioned and sorted within their partition, whose number of rows shifts the
    positions of later partitions: only one count for each partition is put in one order. The ranges are drawn from a
    sample, so the numbered rows are written out once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    along = [F.asc_nulls_first(c) for c in order]
    placed = df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    rows = placed.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    position = F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(offsets, "_part").withColumn("i", position).select(*df.columns, "i")


# ---- what can be uploaded -----------------------------------------------------------
def upload_candidates(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Rendered successfully, and the file exists and is not empty."""
    present = files.filter("length > 0").select(F.col("path").alias("video_path")).distinct()
    return manifest.filter("status = 'success'").join(present, "video_path", "left_semi")


def pending_uploads(manifest: DataFrame, platform: str = "youtube") -> DataFrame:
    if platform == "instagram":
        return manifest.filter(~_filled("ig_media_id"))
    done = _filled("youtube_video_id") & (F.coalesce("youtube_upload_status", F.lit("")) == "uploaded")
    return manifest.filter(~done)


def inflight_containers(manifest: DataFrame) -> DataFrame:
    return manifest.filter(_filled("ig_container_id") & ~_filled("ig_media_id"))


def runnable_links(links: DataFrame, state: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Links not done yet; failed ones only when retrying."""
    skip = ["done"] if retry_failed else ["done", "failed"]
    return links.join(state.filter(F.col("status").isin(*skip)).select("video_key"), "video_key", "left_anti")


def future_scheduled(videos: DataFrame, now: str | Column) -> DataFrame:
    """Private videos whose publish time is still to come."""
    when = F.try_to_timestamp(F.col("publish_at"))
    return videos.withColumn("publish_ts", when).filter((F.col("privacy") == "private") & (F.col("publish_ts") > at(now)))


def base_name(path: str) -> Column:
    return F.element_at(F.split(F.coalesce(F.col(path), F.lit("")), "/"), -1)


def job_clip_listing(manifest: DataFrame) -> DataFrame:
    """Clips of each job with file name and download path."""
    return manifest.withColumn("filename", base_name("video_path")).withColumn(
        "download_url", F.concat(F.lit("/api/outputs/"), F.col("job_id").cast("string"), F.lit("/"), F.col("filename"))
    )


def _display_title(df: DataFrame) -> Column:
    """The edited title where the manifest has one, else the clip's own, else its rank."""
    titles = [F.when(_filled(c), F.col(c)) for c in ("youtube_title_final", "title") if c in df.columns]
    return F.coalesce(*titles, F.concat(F.lit("Clip "), F.col("rank").cast("string")))


def uploadable_clips(jobs: DataFrame, manifest: DataFrame, queue: DataFrame) -> DataFrame:
    """Rendered clips of completed jobs that are neither uploaded nor waiting."""
    waiting = queue.filter(F.col("status").isin("queued", "uploading")).select("job_id", "rank")
    ready = manifest.filter(
        (F.col("status") == "success") & (F.coalesce("youtube_upload_status", F.lit("")) != "uploaded")
    )
    listed = (
        job_clip_listing(ready)
        .join(jobs.filter("status = 'completed'").select("job_id"), "job_id")
        .join(waiting, ["job_id", "rank"], "left_anti")
    )
    return listed.withColumn("title", _display_title(listed))


def uploadable_jobs(jobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Completed jobs with at least one rendered clip."""
    counts = manifest.filter("status = 'success'").groupBy("job_id").agg(
        F.count("*").alias("clip_count"),
        F.sum(F.when(F.col("youtube_upload_status") == "uploaded", 1).otherwise(0)).alias("uploaded_count"),
    )
    return jobs.filter("status = 'completed'").select("job_id", "url").join(counts, "job_id")


# ---- manifests ---------------------------------------------------------------------------
def _matched(manifest: DataFrame, other: DataFrame, columns: Sequence[str], prefer_last: bool) -> DataFrame:
    """Rows of *other* next to their manifest row: by path, else by rank where no path matches.

    Adds structs ``_by_path`` and ``_by_rank`` (null when unmatched). Several rows for one
    clip fold to one, the first or last of each column by ``ord``.
    """
    pick = F.max_by if prefer_last else F.min_by

    def folded(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        picked = [pick(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in columns]
        return rows.groupBy(*keys).agg(F.struct(*picked).alias(name))

    keyed = other.select("job_id", "rank", "video_path", "ord", *columns)
    paths = manifest.filter(_filled("video_path")).select("job_id", "video_path").distinct()
    on_path = keyed.join(paths, ["job_id", "video_path"], "left_semi")
    on_rank = keyed.join(paths, ["job_id", "video_path"], "left_anti")
    return manifest.join(folded(on_path, ["job_id", "video_path"], "_by_path"), ["job_id", "video_path"], "left").join(
        folded(on_rank, ["job_id", "rank"], "_by_rank"), ["job_id", "rank"], "left"
    )


def merge_previous_results(manifest: DataFrame, previous: DataFrame, prefix: str) -> DataFrame:
    """Carry ``<prefix>*`` fields over from an earlier manifest; present values stay."""
    columns = [c for c in previous.columns if c.startswith(prefix)]
    rows = _matched(manifest, previous, columns, prefer_last=False)
    fresh = {
        c: F.coalesce(*([F.col(c)] if c in manifest.columns else []), F.col(f"_by_path.{c}"), F.col(f"_by_rank.{c}"))
        for c in columns
    }
    return rows.withColumns(fresh).drop("_by_path", "_by_rank")


def apply_upload_results(manifest: DataFrame, results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Write outcome fields back; the last result of a clip applies, unmatched rows stay."""
    rows = _matched(manifest, results, columns, prefer_last=True)
    hit = F.col("_by_path").isNotNull() | F.col("_by_rank").isNotNull()
    fresh = {
        c: F.when(hit, F.coalesce(F.col(f"_by_path.{c}"), F.col(f"_by_rank.{c}"))).otherwise(
            F.col(c) if c in manifest.columns else F.lit(None)
        )
        for c in columns
    }
    return rows.withColumns(fresh).drop("_by_path", "_by_rank")


def apply_reschedule(manifest: DataFrame, plan: DataFrame, now: str | Column) -> DataFrame:
    """Overwrite the schedule of the videos in the plan (video id, new time)."""
    moved = plan.select(F.col("video_id").alias("youtube_video_id"), F.col("new_publish_at").alias("_new"))
    old = F.col("youtube_scheduled_at") if "youtube_scheduled_at" in manifest.columns else F.lit(None).cast("timestamp")
    return (
        manifest.join(moved, "youtube_video_id", "left")
        .withColumn("youtube_scheduled_at", F.coalesce(F.col("_new"), old))
        .withColumn("youtube_rescheduled_at", F.when(F.col("_new").isNotNull(), at(now)))
        .drop("_new")
    )


def union_manifests(*manifests: DataFrame) -> DataFrame:
    """Manifests of several runs in one table; missing columns become null."""
    out = manifests[0]
    for other in manifests[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def queue_manifest(state: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rendered clips of finished videos, best first. ``state``: (video_key, url, status)."""
    done = state.filter("status = 'done'").select(
        F.col("video_key").alias("job_id"), F.col("video_key").alias("queue_video_key"), F.col("url").alias("queue_source_url")
    )
    return manifest.filter("status = 'success'").join(done, "job_id").orderBy(F.desc(F.coalesce("viral_score", F.lit(0))))


def queue_totals(state: DataFrame) -> DataFrame:
    done = F.col("status") == "done"
    return state.agg(
        F.count_if(done).alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(done, F.coalesce("clips", F.lit(0)))), F.lit(0)).alias("clips"),
    )


# ---- quotas ---------------------------------------------------------------------------------
def uploads_per_local_day(history: DataFrame, tz: str, per_day: int | None = None) -> DataFrame:
    """Uploads per local calendar day; with a cap also what remains of it."""
    days = history.groupBy(F.to_date(F.from_utc_timestamp("uploaded_at", tz)).alias("day")).agg(F.count("*").alias("uploads"))
    if per_day is None:
        return days
    return days.withColumn("remaining", F.greatest(F.lit(per_day) - F.col("uploads"), F.lit(0)))


def recent_publish_count(manifest: DataFrame, now: str | Column, window_hours: int = 24, cap: int = PUBLISH_CAP_24H) -> DataFrame:
    recent = F.col("ig_published_at") >= at(now) - hours(window_hours)
    return manifest.agg(F.count_if(recent).alias("recent")).withColumn("remaining", F.greatest(F.lit(cap) - F.col("recent"), F.lit(0)))


def last_publish_time(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.max("ig_published_at").alias("last_publish"))


def latest_scheduled(videos: DataFrame, now: str | Column, cap: int) -> DataFrame:
    """Furthest scheduled slot, queue length and whether the queue has room."""
    return future_scheduled(videos, now).agg(F.max("publish_ts").alias("latest"), F.count("*").alias("queued")).withColumn(
        "has_room", F.col("queued") < cap
    )


RUNNING = ("downloading", "transcribing", "analyzing", "rendering")


def job_counts(jobs: DataFrame) -> DataFrame:
    """Dashboard counts; ``n_clips`` is the clip count of a job."""
    done = F.col("status") == "completed"
    return jobs.agg(
        F.count_if(F.col("status").isin(*RUNNING)).alias("running"),
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.count_if(done).alias("completed"),
        F.coalesce(F.sum(F.when(done, F.col("n_clips"))), F.lit(0)).alias("total_clips"),
    )


# ---- schedules --------------------------------------------------------------------------------
def cap_per_run(pending: DataFrame, n: int | Column, order: Sequence[str] = MANIFEST_ORDER) -> DataFrame:
    """The first *n* pending items; *n* is a number or a scalar of the plan (such as what a quota leaves)."""
    if isinstance(n, int):
        return pending.orderBy(*order).limit(n)
    return in_order(pending, order).filter(F.col("i") <= n).drop("i")


def publish_slots(
    pending: DataFrame, first: str | Column, interval_h: float, minimum_h: float = 0.0,
    order: Sequence[str] = MANIFEST_ORDER,
) -> DataFrame:
    """The i-th pending item is published at ``first + i * interval``."""
    gap = max(interval_h, minimum_h)
    numbered = in_order(pending, order)
    return numbered.withColumn("slot", at(first) + hours((F.col("i") - 1) * gap))


def first_publish_time(
    scheduled: DataFrame, now: str | Column, interval_h: float, start: str | None = None
) -> DataFrame:
    """One row: explicit start, else after the last scheduled slot, else the next full hour 30 minutes out."""
    hour = F.date_trunc("hour", at(now) + hours(0.5))
    fallback = F.when(hour <= at(now), hour + hours(1)).otherwise(hour)
    latest = future_scheduled(scheduled, now).agg(F.max("publish_ts").alias("latest"))
    given = at(start) if start else F.lit(None).cast("timestamp")
    return latest.select(F.coalesce(given, F.col("latest") + hours(interval_h), fallback).alias("first"))


def reschedule_plan(
    videos: DataFrame, now: str | Column, interval_h: float, start: str | None = None
) -> DataFrame:
    """Future private videos in time order, re-spaced from the first slot; ``unsafe`` slots are too close."""
    future = future_scheduled(videos, now)
    first = at(start) if start else future.agg(F.min("publish_ts").alias("first")).scalar()
    numbered = in_order(future, ["publish_ts", "video_id"])
    return numbered.withColumn("new_publish_at", first + hours((F.col("i") - 1) * interval_h)).withColumn(
        "unsafe", F.col("new_publish_at") <= at(now) + hours(0.25)
    )


def due_time(column: str = "scheduled_at") -> Column:
    """Unreadable times are due at once."""
    return F.coalesce(F.try_to_timestamp(F.col(column)), F.to_timestamp(F.lit("0001-01-01 00:00:00")))


def enqueue_slots(
    queue: DataFrame, refs: DataFrame, manifest: DataFrame, start: str | Column, interval_min: float,
) -> DataFrame:
    """New queue items for the (job_id, rank, ord) references, after the latest waiting item.

    Skipped references (already queued unless failed, or not rendered) take no slot; a
    reference given twice is queued twice. The first item gets the latest waiting time itself.
    """
    taken = queue.filter("status <> 'failed'").select("job_id", "rank")
    titles = [c for c in ("youtube_title_final", "title") if c in manifest.columns]
    ready = manifest.filter("status = 'success'").select("job_id", "rank", *titles, "video_path")
    fresh = refs.join(taken, ["job_id", "rank"], "left_anti").join(ready, ["job_id", "rank"])
    waiting = queue.filter("status = 'queued'").agg(F.max(due_time()).alias("latest")).scalar()
    base = F.greatest(at(start), waiting)
    numbered = in_order(fresh, ["ord", "rank"])
    return numbered.withColumn("scheduled_at", base + hours((F.col("i") - 1) * interval_min / 60)).withColumn(
        "title", _display_title(numbered)
    )


def best_first(manifest: DataFrame) -> DataFrame:
    """References for ``enqueue_slots`` to all rendered clips: job by job, each job's clips best first."""
    order = F.struct("job_id", (-F.coalesce("viral_score", F.lit(0))).alias("score"))
    return manifest.filter("status = 'success'").select("job_id", "rank", order.alias("ord"))


def instagram_slots(
    pending: DataFrame, manifest: DataFrame, now: str | Column, interval_h: float,
    order: Sequence[str] = MANIFEST_ORDER,
) -> DataFrame:
    """Publish one clip when the interval has elapsed; the others are deferred to the next slot."""
    last = last_publish_time(manifest).scalar()
    due = last.isNull() | (at(now) >= last + hours(interval_h))
    numbered = in_order(pending, order)
    goes = due & ((F.col("i") == 1) | F.lit(interval_h <= 0))
    return numbered.withColumn("outcome", F.when(goes, "published").otherwise("deferred")).withColumn(
        "next_slot", F.when(goes, F.lit(None).cast("timestamp")).when(due, at(now) + hours(interval_h)).otherwise(last + hours(interval_h))
    )


def instagram_plan(
    manifest: DataFrame, now: str | Column, interval_h: float, window_hours: int = 24, cap: int = PUBLISH_CAP_24H,
    order: Sequence[str] = MANIFEST_ORDER,
) -> DataFrame:
    """Pending clips within what the rolling quota leaves, with their outcome and slots."""
    left = recent_publish_count(manifest, now, window_hours, cap).select("remaining").scalar()
    allowed = cap_per_run(pending_uploads(manifest, "instagram"), left, order)
    return instagram_slots(allowed, manifest, now, interval_h, order)


def next_due(queue: DataFrame, now: str | Column) -> DataFrame:
    """The earliest waiting item that is due (none: no row)."""
    due = queue.withColumn("due_at", due_time()).filter((F.col("status") == "queued") & (F.col("due_at") <= at(now)))
    return due.orderBy("due_at", "job_id", "rank").limit(1)


def queue_by_time(queue: DataFrame) -> DataFrame:
    return queue.withColumn("due_at", due_time()).orderBy("due_at", "job_id", "rank")


# ---- jobs ----------------------------------------------------------------------------------------
# Dashboard status of each processing step.
STEP_STATUS = {"download": "downloading", "transcribe": "transcribing", "analyze": "analyzing", "render": "rendering"}


def step_status_map(events: DataFrame) -> DataFrame:
    """Dashboard status of each event's step (null for other steps)."""
    pairs = F.create_map(*[F.lit(x) for kv in STEP_STATUS.items() for x in kv])
    return events.withColumn("dashboard_status", pairs[F.col("step")])


def jobs_newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id"))


def log_tail(events: DataFrame, n: int = 500) -> DataFrame:
    """The last *n* log lines of each job (the row limit is applied before the shuffle too)."""
    newest = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id"))
    line = F.concat(F.lit("["), F.col("step"), F.lit("] "), F.col("message"))
    return events.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn").withColumn("line", line)


# ---- performance ------------------------------------------------------------------------------------
API_VIDEO = (
    "id string, snippet struct<title: string, publishedAt: string, thumbnails: struct<medium: struct<url: string>>>, "
    "status struct<privacyStatus: string>, statistics struct<viewCount: string, likeCount: string, commentCount: string>"
)
CLIP_FIELDS = ("on_screen_hook", "hook_text", "duration", "viral_score", "reason", "language", "hashtags")


def _number(name: str, default: int | None = 0) -> Column:
    value = F.col(name).try_cast("long")
    return value if default is None else F.coalesce(value, F.lit(default))


def performance_rows(api: DataFrame, history: DataFrame, fetched_at: str | Column) -> DataFrame:
    """Statistics payloads (``payload`` JSON) joined to the last upload-history entry of each video."""
    video = api.select(F.from_json("payload", API_VIDEO).alias("v")).select("v.*")
    extra = [c for c in CLIP_FIELDS if c in history.columns]
    latest = last_per_key(history.select("video_id", "title", "ord", *extra), ["video_id"], ["ord"]).select(
        F.col("video_id").alias("id"), F.col("title").alias("_title"), *extra
    )
    return video.join(latest, "id", "left").select(
        F.col("id").alias("video_id"),
        F.coalesce(F.when(F.col("snippet.title") != "", F.col("snippet.title")), F.col("_title")).alias("title"),
        F.try_to_timestamp("snippet.publishedAt").alias("published_at"),
        F.col("status.privacyStatus").alias("privacy"),
        _number("statistics.viewCount").alias("views"),
        _number("statistics.likeCount").alias("likes"),
        _number("statistics.commentCount").alias("comments"),
        at(fetched_at).alias("fetched_at"),
        *extra,
    )


def channel_video_listing(api: DataFrame, n: int = 25) -> DataFrame:
    """First *n* videos of each channel in listing order; absent like and comment counts stay null."""
    rows = api.select("channel_id", "ord", F.from_json("payload", API_VIDEO).alias("v")).select("channel_id", "ord", "v.*")
    first = Window.partitionBy("channel_id").orderBy("ord")
    return rows.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n).select(
        "channel_id",
        F.col("id").alias("video_id"),
        F.col("snippet.title").alias("title"),
        F.col("status.privacyStatus").alias("privacy_status"),
        _number("statistics.viewCount").alias("view_count"),
        _number("statistics.likeCount", None).alias("like_count"),
        _number("statistics.commentCount", None).alias("comment_count"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("id")).alias("url"),
    )


API_CHANNEL = "id string, snippet struct<title: string>, statistics struct<subscriberCount: string, viewCount: string, videoCount: string>"


def channel_totals(api: DataFrame) -> DataFrame:
    rows = api.select(F.from_json("payload", API_CHANNEL).alias("c")).select("c.*")
    return rows.select(
        F.col("id").alias("channel_id"),
        F.col("snippet.title").alias("title"),
        _number("statistics.subscriberCount").alias("subscriber_count"),
        _number("statistics.viewCount").alias("view_count"),
        _number("statistics.videoCount").alias("video_count"),
    )


def performance_summary(performance: DataFrame, history: DataFrame) -> DataFrame:
    """Saved, public and no-longer-online counts, from one tagged union."""
    ids = history.select("video_id").distinct()
    gone = ids.join(performance.select("video_id"), "video_id", "left_anti").agg(F.count("*").alias("missing"))
    saved = performance.agg(F.count("*").alias("saved"), F.count_if(F.col("privacy") == "public").alias("public"))
    zero = F.lit(0).cast("long")
    both = saved.withColumn("missing", zero).unionByName(gone.withColumns({"saved": zero, "public": zero}))
    return both.agg(*[F.sum(c).alias(c) for c in ("saved", "public", "missing")])


def top_public(performance: DataFrame, n: int = 3) -> DataFrame:
    return performance.filter("privacy = 'public'").orderBy(F.desc("views"), "video_id").limit(n)


MIN_VIDEOS, MIN_AGE_HOURS, SCORE_DAYS = 6, 48, 7


def best_and_worst(performance: DataFrame, now: str | Column, k: int = 4) -> DataFrame:
    """Best and weakest public clips of each channel by views per day over their first week.

    Clips younger than 48 hours and channels with fewer than 6 clips do not count. Both top
    and bottom lists are limited before the shuffle, so a large channel needs no full sort.
    """
    age_h = (F.coalesce("fetched_at", at(now)).cast("double") - F.col("published_at").cast("double")) / 3600
    scored = performance.filter((F.col("privacy") == "public") & F.col("published_at").isNotNull())
    scored = scored.withColumn("_age", age_h).filter(F.col("_age") >= MIN_AGE_HOURS)
    days = F.greatest(F.lit(1.0), F.least(F.col("_age") / 24, F.lit(float(SCORE_DAYS))))
    scored = scored.withColumn("score", F.coalesce("views", F.lit(0)) / days).drop("_age")
    sizes = scored.groupBy("channel_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= MIN_VIDEOS).select(
        "channel_id", F.least(F.lit(k), F.floor(F.col("_n") / 2)).alias("_k")
    )
    down = Window.partitionBy("channel_id").orderBy(F.desc("score"), "video_id")
    up = Window.partitionBy("channel_id").orderBy("score", F.desc("video_id"))

    def side(window, name: str) -> DataFrame:
        ranked = scored.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k)
        return ranked.join(sizes, "channel_id").filter(F.col("_rn") <= F.col("_k")).withColumn("side", F.lit(name))

    return side(down, "best").unionByName(side(up, "worst")).drop("_rn", "_k")


# ---- text --------------------------------------------------------------------------------------------
DESCRIPTION_CHARS, CAPTION_CHARS, TITLE_CHARS, TAG_CHARS = 5000, 2200, 100, 500
SOURCE_MARK = "\n\nSource:"


def tidy_description(text: Column) -> Column:
    """Line breaks kept, other whitespace squashed, no angle brackets, at most 5000 characters."""
    plain = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "[<>]", "")
    lines = F.regexp_replace(F.regexp_replace(plain, r"(?U)[\s&&[^\n]]+", " "), r" ?\n ?", "\n")
    return F.substring(F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"), F.lit(" \n")), 1, DESCRIPTION_CHARS)


def publish_text(manifest: DataFrame, public_base_url: str | None = None) -> DataFrame:
    """Publishable title, description with the clip's hashtags, caption and public URL."""
    staged = manifest.withColumns(
        {
            "_desc": F.coalesce("youtube_description_final", F.lit("")),
            "_tags": F.filter(F.split(tx.squash("hashtags"), " "), lambda t: F.startswith(t, F.lit("#")) & (F.length(t) > 1)),
        }
    ).withColumn("_low", F.lower("_desc"))
    staged = staged.withColumn(
        "_line", F.array_join(F.filter("_tags", lambda t: F.instr(F.col("_low"), F.lower(t)) == 0), " ")
    ).withColumn("_at", F.instr("_desc", SOURCE_MARK))
    space = F.lit(" \n\t\r\f")
    marked = F.concat(
        F.rtrim(F.substring("_desc", F.lit(1), F.col("_at") - 1), space), F.lit("\n\n"), F.col("_line"),
        F.substring("_desc", F.col("_at"), F.length("_desc")),
    )
    plain = F.concat(F.rtrim("_desc", space), F.lit("\n\n"), F.col("_line"))
    full = F.when(F.col("_line") == "", F.col("_desc")).when(F.col("_at") > 0, marked).otherwise(plain)
    title = F.coalesce(
        F.when(_filled("youtube_title_final"), F.col("youtube_title_final")), F.when(_filled("title"), F.col("title")),
        F.concat(F.lit("Clip Rank "), F.coalesce(F.col("rank").cast("string"), F.lit("?"))),
    )
    out = staged.withColumn("_full", full).withColumns(
        {"publish_title": F.substring(tx.squash(title), 1, TITLE_CHARS), "description": tidy_description(F.col("_full"))}
    )
    caption = F.when(
        F.col("description") != "", F.trim(F.concat("publish_title", F.lit("\n\n"), "description"), F.lit(" \n"))
    ).otherwise(F.col("publish_title"))
    explicit = [F.when(_filled(c), F.col(c)) for c in ("ig_video_url", "public_video_url") if c in manifest.columns]
    fallback = F.concat(F.lit(f"{public_base_url}/"), base_name("video_path")) if public_base_url else F.lit(None).cast("string")
    return out.withColumns(
        {"caption": F.substring(caption, 1, CAPTION_CHARS), "public_url": F.coalesce(*explicit, fallback)}
    ).drop("_desc", "_tags", "_low", "_line", "_at", "_full")


def budgeted_tags(manifest: DataFrame, budget: int = TAG_CHARS) -> DataFrame:
    """Distinct tags, then hashtag words, within a character budget; a tag that does not fit is skipped.

    A tag costs its length, a comma after the first, and two quotes when it holds a space.
    """
    none = F.array().cast("array<string>")
    first = F.coalesce(
        *[F.when(F.size(c) > 0, F.col(c)) for c in ("youtube_tags_final", "keyword_tags") if c in manifest.columns], none
    )
    words = F.filter(F.split(tx.squash("hashtags"), " "), lambda t: F.startswith(t, F.lit("#")) & (F.length(t) > 1))
    items = F.transform(
        F.concat(first, F.transform(words, lambda t: F.ltrim(t, F.lit("#")))),
        lambda t: F.regexp_replace(tx.squash(t), "[<>]", ""),
    )
    start = F.struct(none.alias("tags"), none.alias("seen"), F.lit(0).alias("used"))

    def add(acc: Column, tag: Column) -> Column:
        key = F.replace(F.lower(tag), F.lit(" "), F.lit(""))
        cost = F.length(tag) + F.when(F.instr(tag, " ") > 0, 2).otherwise(0) + F.when(F.size(acc["tags"]) > 0, 1).otherwise(0)
        fits = (tag != "") & ~F.array_contains(acc["seen"], key) & (acc["used"] + cost <= budget)
        return F.when(
            fits,
            F.struct(
                F.array_append(acc["tags"], tag).alias("tags"), F.array_append(acc["seen"], key).alias("seen"),
                (acc["used"] + cost).alias("used"),
            ),
        ).otherwise(acc)

    return manifest.withColumn("_items", items).withColumn("_acc", F.aggregate("_items", start, add)).withColumns(
        {"upload_tags": F.col("_acc.tags"), "upload_tag_chars": F.col("_acc.used")}
    ).drop("_items", "_acc")
