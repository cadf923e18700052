"""The publish plan: which clips go out next and when, within every limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmart.operators import publishing as pub


@dataclass(frozen=True)
class PublishLimits:
    now: str
    tz: str = "Asia/Kolkata"
    per_day: int = 6
    per_run: int = 5
    interval_h: float = 2.0
    min_interval_h: float = 1.0
    max_queue: int = 50
    start: str | None = None


def publish_plan(
    manifest: DataFrame, previous: DataFrame, files: DataFrame, history: DataFrame, scheduled: DataFrame,
    limits: PublishLimits,
) -> DataFrame:
    """Daily cap, carried-over results, pending clips, per-run cap, minimum spacing, queue cap, slots.

    The caps are scalar subqueries of the plan: nothing passes through the driver. The per-run
    cap keeps at most ``per_run`` rows before they are numbered.
    """
    gap = max(limits.interval_h, limits.min_interval_h)
    today = F.to_date(F.from_utc_timestamp(pub.at(limits.now), limits.tz))
    uploads_today = history.filter(F.to_date(F.from_utc_timestamp("uploaded_at", limits.tz)) == today).agg(
        F.count("*").alias("n")
    )
    queued = pub.future_scheduled(scheduled, limits.now).agg(F.count("*").alias("n"))
    first = pub.first_publish_time(scheduled, limits.now, gap, limits.start)
    carried = pub.merge_previous_results(manifest, previous, "youtube_")
    pending = pub.pending_uploads(pub.upload_candidates(carried, files))
    chosen = pub.cap_per_run(pending, limits.per_run).filter(
        (uploads_today.scalar() < limits.per_day) & (queued.scalar() < limits.max_queue)
    )
    return pub.publish_slots(chosen, first.scalar(), gap)
