"""Catalogue reads: channels, sources, videos and their statuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmart.functions.ordered import last_per_key

STATUSES = ("used", "unused", "candidate", "skipped")
NOT_USED_YET = ("unused", "candidate", "skipped")


def effective_status(column: str = "status") -> Column:
    """A video without a status row counts as ``unused``."""
    return F.coalesce(F.col(column), F.lit("unused"))


def _status_counts(suffix: str = "_count", prefix: str = "") -> list[Column]:
    return [
        F.sum(F.when(effective_status() == s, 1).otherwise(0)).alias(f"{prefix}{s}{suffix}") for s in STATUSES
    ]


def _contains(columns: Sequence[str], text: str) -> Column:
    """SQL LIKE search, case-insensitive; ``%`` and ``_`` in *text* stay wildcards."""
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    return hit


def videos_with_status(videos: DataFrame, status: DataFrame) -> DataFrame:
    """Every video, its status defaulted."""
    return videos.join(status, "video_id", "left").withColumn("status", effective_status())


def filter_status(df: DataFrame, status: str | None) -> DataFrame:
    if not status or status == "all":
        return df
    if status == "not_used_yet":
        return df.filter(effective_status().isin(*NOT_USED_YET))
    return df.filter(effective_status() == status)


def filter_presence(df: DataFrame, mode: str | None) -> DataFrame:
    if mode == "present":
        return df.filter(F.col("is_present"))
    if mode == "missing":
        return df.filter(~F.col("is_present"))
    return df


def nested_sources(links: DataFrame, sources: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per video with the ordered array of sources it appears in.

    The array is bounded by the number of sources, and ``collect_list`` combines map-side.
    """
    entry = F.struct("source_type", "title", "source_id", *extra)
    return (
        links.join(sources.select("source_id", "source_type", "title"), "source_id")
        .groupBy("video_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("sources"))
    )


def search_videos(
    videos: DataFrame, status: DataFrame, links: DataFrame, sources: DataFrame, text: str,
    wanted: str | None = None, limit: int = 200,
) -> DataFrame:
    """Substring search over title, channel, clip title and notes: first *limit* by title."""
    found = videos_with_status(videos, status).filter(_contains(["title", "channel_name", "clip_title", "notes"], text))
    top = filter_status(found, wanted).orderBy("title", "video_id").limit(limit)
    return top.join(nested_sources(links.join(top.select("video_id"), "video_id", "left_semi"), sources), "video_id", "left")


def source_video_join(links: DataFrame, videos: DataFrame, status: DataFrame) -> DataFrame:
    """Links with their videos, and the status where there is one."""
    return links.join(videos, "video_id").join(status, "video_id", "left")


def source_videos_view(
    links: DataFrame, videos: DataFrame, status: DataFrame, *, source_id: int | None = None,
    wanted: str | None = None, present: str | None = None, text: str | None = None, sort: str = "position",
) -> DataFrame:
    """Videos of one source (or all): status, presence and text filters, source count per video."""
    counts = links.groupBy("video_id").agg(F.count("*").alias("source_count"))
    chosen = links if source_id is None else links.filter(F.col("source_id") == source_id)
    rows = source_video_join(filter_presence(chosen, present), videos, status).withColumn("status", effective_status())
    rows = filter_status(rows, wanted)
    if text:
        rows = rows.filter(_contains(["title", "channel_name"], text))
    order = {
        "title": ["title"],
        "channel": ["channel_name", "title"],
        "duration": [F.desc("duration_seconds")],
        "status": ["status", "title"],
        "date": [F.desc("upload_date")],
    }.get(sort, ["position", "title"])
    return rows.join(counts, "video_id").orderBy(*order)


def channel_videos_view(
    videos: DataFrame, status: DataFrame, links: DataFrame, sources: DataFrame, *,
    channel_id: int | None = None, wanted: str | None = None, text: str | None = None,
) -> DataFrame:
    """Videos of one channel (or all), newest first, with their sources."""
    chosen = videos if channel_id is None else videos.filter(F.col("channel_id") == channel_id)
    rows = filter_status(videos_with_status(chosen, status), wanted)
    if text:
        rows = rows.filter(_contains(["title"], text))
    return rows.join(nested_sources(links, sources), "video_id", "left").orderBy(F.desc("created_at"))


def video_detail(
    videos: DataFrame, status: DataFrame, channels: DataFrame, links: DataFrame, sources: DataFrame,
    video_id: int | None = None,
) -> DataFrame:
    """Video, status, channel and sources with position and presence."""
    if video_id is not None:
        videos = videos.filter(F.col("video_id") == video_id)
        links = links.filter(F.col("video_id") == video_id)
    owner = channels.select(
        "channel_id", F.col("name").alias("ch_name"), F.col("url").alias("ch_url"), F.col("handle").alias("ch_handle")
    )
    return (
        videos_with_status(videos, status)
        .join(owner, "channel_id", "left")
        .join(nested_sources(links, sources, ("position", "is_present")), "video_id", "left")
    )


def refreshable_sources(sources: DataFrame) -> DataFrame:
    """Playlists that have a URL."""
    return sources.filter((F.col("source_type") == "playlist") & (F.coalesce("url", F.lit("")) != ""))


# ---- joins -------------------------------------------------------------------
def stats_join(sources: DataFrame, links: DataFrame, status: DataFrame) -> DataFrame:
    """Sources with links and statuses; a source without links keeps one empty row."""
    return (
        sources.join(links.select("source_id", "video_id"), "source_id", "left")
        .join(status.select("video_id", "status"), "video_id", "left")
    )


def missing_from_pull(links: DataFrame, pulled: DataFrame) -> DataFrame:
    """Present links of the pulled sources that the pull did not contain."""
    touched = pulled.select("source_id").distinct()
    return (
        links.filter("is_present")
        .join(touched, "source_id", "left_semi")
        .join(pulled.select("source_id", "video_id"), ["source_id", "video_id"], "left_anti")
    )


def entries_to_fetch(entries: DataFrame, videos: DataFrame) -> DataFrame:
    return entries.join(videos.select("video_id"), "video_id", "left_anti")


def entries_known(entries: DataFrame, videos: DataFrame) -> DataFrame:
    return entries.join(videos.select("video_id"), "video_id", "left_semi")


# ---- aggregates ----------------------------------------------------------------
def source_stats(sources: DataFrame, links: DataFrame, status: DataFrame, *, strict: bool = False) -> DataFrame:
    """Videos and status counts per source, ordered by type and title.

    A source without links counts one ``unused`` by default (its empty joined row does);
    ``strict`` removes that. Links are unique per (source, video), so they are counted
    per source first and the small result is joined to the sources.
    """
    per_source = (
        links.select("source_id", "video_id")
        .join(status.select("video_id", "status"), "video_id", "left")
        .groupBy("source_id")
        .agg(F.count("video_id").alias("total_videos"), *_status_counts())
    )
    empty = {"unused_count": 0 if strict else 1}
    filled = [
        F.coalesce(c, F.lit(empty.get(c, 0))).alias(c)
        for c in ["total_videos"] + [f"{s}_count" for s in STATUSES]
    ]
    return (
        sources.join(per_source, "source_id", "left")
        .select(*sources.columns, *filled)
        .orderBy("source_type", "title")
    )


def latest_pull_run(pulls: DataFrame) -> DataFrame:
    """The last run of each source."""
    return last_per_key(pulls, ["source_id"], ["run_id"])


def source_detail(
    sources: DataFrame, links: DataFrame, status: DataFrame, pulls: DataFrame, source_id: int | None = None
) -> DataFrame:
    """Statistics of one source (or all) with its latest run."""
    if source_id is not None:
        sources, links, pulls = (d.filter(F.col("source_id") == source_id) for d in (sources, links, pulls))
    latest = latest_pull_run(pulls).select(
        "source_id", F.col("run_id").alias("latest_run_id"), F.col("status").alias("latest_run_status"),
        F.col("videos_found").alias("latest_videos_found"),
    )
    return source_stats(sources, links, status).join(latest, "source_id", "left")


def _per_channel(videos: DataFrame, status: DataFrame) -> DataFrame:
    return (
        videos.select("video_id", "channel_id")
        .join(status.select("video_id", "status"), "video_id", "left")
        .groupBy("channel_id")
        .agg(F.count("video_id").alias("total_videos"), *_status_counts())
    )


def channel_stats(channels: DataFrame, videos: DataFrame, status: DataFrame) -> DataFrame:
    """Channels that have videos, largest first."""
    return channels.join(_per_channel(videos, status), "channel_id").orderBy(F.desc("total_videos"))


def channel_detail(
    channels: DataFrame, videos: DataFrame, status: DataFrame, channel_id: int | None = None
) -> DataFrame:
    """Counts of one channel (or all); a channel without videos counts one ``unused``."""
    if channel_id is not None:
        channels, videos = (d.filter(F.col("channel_id") == channel_id) for d in (channels, videos))
    joined = channels.join(_per_channel(videos, status), "channel_id", "left")
    counts = {f"{s}_count": F.coalesce(f"{s}_count", F.lit(1 if s == "unused" else 0)) for s in STATUSES}
    return joined.withColumns({"total_videos": F.coalesce("total_videos", F.lit(0)), **counts}).withColumn(
        "not_used_yet", F.col("unused_count") + F.col("candidate_count") + F.col("skipped_count")
    )


def global_stats(sources: DataFrame, videos: DataFrame, channels: DataFrame, status: DataFrame) -> DataFrame:
    """Dashboard totals: one row, built from one tagged union of per-table counts."""
    names = ["total_sources", "total_videos", "total_channels"] + [f"total_{s}" for s in STATUSES]

    def padded(counts: DataFrame) -> DataFrame:
        return counts.select(*[F.col(n) if n in counts.columns else F.lit(0).cast("long").alias(n) for n in names])

    per_status = videos.select("video_id").join(status.select("video_id", "status"), "video_id", "left").agg(
        F.count("*").alias("total_videos"), *_status_counts(suffix="", prefix="total_")
    )
    parts = [
        sources.agg(F.count("*").alias("total_sources")),
        channels.agg(F.count("*").alias("total_channels")),
        per_status,
    ]
    total = padded(parts[0])
    for part in parts[1:]:
        total = total.unionByName(padded(part))
    return total.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def duplicate_videos(
    videos: DataFrame, links: DataFrame, status: DataFrame, sources: DataFrame, wanted: str | None = None
) -> DataFrame:
    """Videos that appear in more than one source."""
    repeated = links.groupBy("video_id").agg(F.count("source_id").alias("source_count")).filter("source_count > 1")
    rows = filter_status(videos_with_status(videos, status), wanted).join(repeated, "video_id")
    return rows.join(nested_sources(links, sources), "video_id").orderBy(F.desc("source_count"), "title")


def duplicate_totals(duplicates: DataFrame) -> DataFrame:
    return duplicates.agg(
        F.count("*").alias("duplicate_videos"),
        F.coalesce(F.sum("source_count"), F.lit(0)).alias("total_duplicate_source_links"),
    )


def status_shares(stats: DataFrame) -> DataFrame:
    """Percentage of each status among a source's videos, one decimal."""
    share = {
        f"{s}_pct": F.round(F.try_divide(F.col(f"{s}_count") * F.lit(100.0), F.col("total_videos")), 1) for s in STATUSES
    }
    return stats.filter("total_videos > 0").withColumns(share)


def pull_run_stats(entries: DataFrame, videos: DataFrame, links: DataFrame) -> DataFrame:
    """Found, added, already known and missing per pulled source.

    ``entries`` may list one new video several times: only its first sighting adds it.
    """
    first = (
        entries_to_fetch(entries, videos)
        .groupBy("video_id")
        .agg(F.min(F.struct("source_id", "position")).alias("_first"))
        .select("_first.source_id")
        .groupBy("source_id")
        .agg(F.count("*").alias("videos_added"))
    )
    found = entries.groupBy("source_id").agg(F.count("*").alias("videos_found"))
    gone = missing_from_pull(links, entries).groupBy("source_id").agg(F.count("*").alias("videos_missing"))
    out = found.join(first, "source_id", "left").join(gone, "source_id", "left").na.fill(0)
    return out.withColumn("videos_already_exists", F.col("videos_found") - F.col("videos_added"))


# ---- top lists -------------------------------------------------------------------
def recently_used(videos: DataFrame, status: DataFrame, limit: int = 100) -> DataFrame:
    used = status.filter("status = 'used'")
    return (
        videos.join(used, "video_id")
        .orderBy(F.desc(F.coalesce("used_at", "updated_at")), F.desc("updated_at"), "video_id")
        .limit(limit)
    )


def random_unused(
    videos: DataFrame, status: DataFrame, links: DataFrame, sources: DataFrame, seed: str = "0", pool: int = 50
) -> DataFrame:
    """One repeatable random pick among the newest unused videos, with the sources it appears in.

    A video is as new as its publication, else its upload date, else its row.
    """
    unused = videos.join(status.filter("status = 'unused'").select("video_id", "status"), "video_id")
    dates = [F.col(c).cast("timestamp") for c in ("published_at", "upload_date", "created_at") if c in videos.columns]
    newest = unused.orderBy(F.desc(F.coalesce(*dates)), "video_id")
    lot = F.md5(F.concat_ws("-", F.lit(seed), F.col("video_id").cast("string")))
    pick = newest.limit(pool).orderBy(lot).limit(1)
    # The sources of one video are read, not those of all.
    return pick.join(nested_sources(links.join(pick.select("video_id"), "video_id", "left_semi"), sources), "video_id", "left")


def recent_pull_runs(pulls: DataFrame, limit: int = 50) -> DataFrame:
    return pulls.orderBy(F.desc("run_id")).limit(limit)
