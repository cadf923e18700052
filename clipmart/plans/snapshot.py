"""The snapshot job: one playlist pull applied to every catalogue table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmart.operators import catalogue as cat
from clipmart.operators import maintenance as m
from clipmart.session import kept


def apply_playlist_pull(
    tables: Mapping[str, DataFrame], entries: DataFrame, now: str, headers: DataFrame | None = None, fast: bool = False
) -> dict[str, DataFrame]:
    """Merge a pull into the catalogue. The entries are written out once, and all outputs start from there.

    ``entries`` holds one row per (source, position) with the video's metadata and ``run_id``.
    Entries of known videos without metadata (``fast``) still link and count. ``headers``, one row per pulled
    playlist (``source_key``, ``title``, ``url``, ``owner_channel_id``, ``owner_channel_name``, ``owner_channel_url``), adds or
    renews the playlists and their owners. Runs that are not there yet are opened, all are closed.
    Returns the new tables and ``stats`` (found, added, known, missing per run).
    """
    entries = kept(entries)
    stats = cat.pull_run_stats(entries, tables["videos"], tables["source_videos"]).join(
        entries.groupBy("source_id").agg(F.max("run_id").alias("run_id")), "source_id"
    )
    batch = entries.withColumns(
        {"ord": F.struct("source_id", "position"), "metadata_source": F.lit("playlist_pull_fast" if fast else "playlist_pull")}
    )
    channel_batch = batch.select("channel_id", F.col("channel_name").alias("name"), "handle", "ord")
    sources = tables["sources"]
    if headers is not None:
        first = F.lit(None).cast(entries.schema["source_id"].dataType), F.lit(None).cast(entries.schema["position"].dataType)
        owners = headers.filter("owner_channel_id is not null").select(
            F.col("owner_channel_id").cast(entries.schema["channel_id"].dataType).alias("channel_id"),
            F.col("owner_channel_name").alias("name"), F.col("owner_channel_url").alias("url"),
            F.struct(first[0].alias("source_id"), first[1].alias("position")).alias("ord"),
        )
        # What an entry says of its own channel is newer than the playlist's word for its owner.
        channel_batch = channel_batch.unionByName(owners, allowMissingColumns=True)
        sources = m.upsert_sources(sources, headers.withColumn("ord", F.col("source_key")), now).drop("was_new", "touched")
    linked = m.link_source_videos(tables["source_videos"], batch, now)
    return {
        "channels": m.upsert_channels(tables["channels"], channel_batch, now),
        "videos": m.upsert_videos(tables["videos"], batch, now),
        "video_status": m.ensure_status(tables["video_status"], entries, now),
        "pull_run_videos": m.record_pull(tables["pull_run_videos"], entries),
        "source_videos": m.mark_missing(linked, entries, now),
        "pull_runs": m.finish_pull_run(m.open_pull_runs(tables["pull_runs"], entries, now), stats, now),
        "sources": m.touch_sources(sources, entries, now),
        "stats": stats,
    }
