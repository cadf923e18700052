"""Catalogue upkeep as whole-table transforms: ``new table = f(current table, batch)``.

Several rows for one key in a batch fold to the last non-null value per column, which is
what applying them one after the other gives. The fold is an aggregate, so it combines
map-side and a hot key is no trouble.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmart.functions.ordered import first_per_key, last_per_key
from clipmart.operators.catalogue import missing_from_pull


def at(now: str | Column) -> Column:
    return F.to_timestamp(F.lit(now)) if isinstance(now, str) else now


def fold_batch(batch: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """Last non-null value of each column per key."""
    return batch.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )


def _upsert(
    current: DataFrame, batch: DataFrame, key: str, columns: Sequence[str], order: str, now: str | Column,
    defaults: Mapping[str, Column] | None = None, keep_old: Sequence[str] = (),
) -> DataFrame:
    """Full outer merge: new non-null values win, ``keep_old`` columns never change once set.

    Adds ``was_new`` and ``touched``; ``created_at`` and ``updated_at`` are maintained.
    """
    columns = [c for c in columns if c in current.columns]
    given = [c for c in columns if c in batch.columns]
    folded = fold_batch(batch.filter(F.col(key).isNotNull()), [key], given, order)
    old, new = current.alias("old"), folded.withColumn("_in", F.lit(True)).alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    was_new = F.col(f"old.{key}").isNull()
    touched = F.coalesce(F.col("new._in"), F.lit(False))
    out = {key: F.coalesce(f"new.{key}", f"old.{key}")}
    for c in columns:
        fresh = F.col(f"new.{c}") if c in given else F.lit(None)
        value = F.coalesce(F.col(f"old.{c}"), fresh) if c in keep_old else F.coalesce(fresh, F.col(f"old.{c}"))
        if defaults and c in defaults:
            value = F.when(was_new, F.coalesce(value, defaults[c])).otherwise(value)
        out[c] = value
    out["created_at"] = F.when(was_new, at(now)).otherwise(F.col("old.created_at"))
    out["updated_at"] = F.when(touched, at(now)).otherwise(F.col("old.updated_at"))
    # What the batch does not speak of stays as it is; new rows have nulls there.
    out |= {c: F.col(f"old.{c}") for c in current.columns if c not in out}
    out["was_new"], out["touched"] = was_new, touched
    return joined.select(*[c.alias(n) for n, c in out.items()])


CHANNEL_COLUMNS = ("name", "url", "handle", "thumbnail_url", "raw_json")
SOURCE_COLUMNS = (
    "source_type", "playlist_id", "title", "url", "thumbnail_url", "owner_channel_id", "owner_channel_name",
    "owner_channel_url", "raw_json",
)
VIDEO_COLUMNS = (
    "title", "url", "thumbnail_url", "duration_seconds", "upload_date", "published_at", "description", "channel_id",
    "channel_name", "channel_url", "raw_json",
)


def upsert_channels(current: DataFrame, batch: DataFrame, now, order: str = "ord") -> DataFrame:
    return _upsert(current, batch, "channel_id", CHANNEL_COLUMNS, order, now)


def upsert_sources(current: DataFrame, batch: DataFrame, now, order: str = "ord") -> DataFrame:
    """The type of a source is set on insert only."""
    return _upsert(
        current, batch, "source_key", SOURCE_COLUMNS, order, now,
        {"title": F.lit("Untitled"), "source_type": F.lit("playlist")}, keep_old=("source_type",),
    )


def upsert_videos(current: DataFrame, batch: DataFrame, now, order: str = "ord") -> DataFrame:
    url = F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("new.video_id").cast("string"))
    return _upsert(
        current, batch, "video_id", VIDEO_COLUMNS, order, now, {"title": F.lit("Untitled"), "url": url}
    )


def link_source_videos(links: DataFrame, batch: DataFrame, now, order: str = "ord") -> DataFrame:
    """Links seen again become present; new ones start now. ``batch``: source, video, position, run."""
    keys = ["source_id", "video_id"]
    own = [c for c in links.columns if c not in keys]
    extra = [c for c in ("metadata_source",) if c in batch.columns]
    folded = fold_batch(batch, keys, ["position", "run_id", *extra], order)
    old, new = links.alias("old"), folded.withColumn("_in", F.lit(True)).alias("new")
    on = (F.col("old.source_id") == F.col("new.source_id")) & (F.col("old.video_id") == F.col("new.video_id"))
    joined = old.join(new, on, "full_outer")
    seen, was_new = F.coalesce(F.col("new._in"), F.lit(False)), F.col("old.source_id").isNull()
    out = {k: F.coalesce(f"new.{k}", f"old.{k}") for k in keys}
    out["position"] = F.coalesce("new.position", "old.position")
    out["first_seen_run"] = F.when(was_new, F.col("new.run_id")).otherwise(F.col("old.first_seen_run"))
    out["last_seen_run"] = F.coalesce("new.run_id", "old.last_seen_run")
    out["is_present"] = F.when(seen, F.lit(True)).otherwise(F.col("old.is_present"))
    out["missing_since"] = F.when(seen, F.lit(None).cast("timestamp")).otherwise(F.col("old.missing_since"))
    out["last_seen_at"] = F.when(seen, at(now)).otherwise(F.col("old.last_seen_at"))
    out["added_at"] = F.when(was_new, at(now)).otherwise(F.col("old.added_at"))
    for c in extra:
        out[c] = F.coalesce(f"new.{c}", f"old.{c}") if c in links.columns else F.col(f"new.{c}")
    out |= {c: F.col(f"old.{c}") for c in own if c not in out}
    return joined.select(*[c.alias(n) for n, c in out.items()])


def mark_missing(links: DataFrame, pulled: DataFrame, now) -> DataFrame:
    """Present links absent from the pull of their source become missing."""
    keys = ["source_id", "video_id"]
    gone = missing_from_pull(links, pulled).select(*keys).withColumn("_gone", F.lit(True))
    flagged = F.coalesce(F.col("_gone"), F.lit(False))
    return (
        links.join(gone, keys, "left")
        .withColumn("is_present", F.col("is_present") & ~flagged)
        .withColumn("missing_since", F.when(flagged, F.coalesce("missing_since", at(now))).otherwise(F.col("missing_since")))
        .drop("_gone")
    )


def ensure_status(status: DataFrame, videos: DataFrame, now) -> DataFrame:
    """Insert ``unused`` where a video has no status row."""
    fresh = (
        videos.select("video_id").distinct().join(status.select("video_id"), "video_id", "left_anti")
        .withColumn("status", F.lit("unused")).withColumn("updated_at", at(now))
    )
    return status.unionByName(fresh, allowMissingColumns=True)


PATCH_FIELDS = ("status", "used_at", "clip_title", "local_output_path", "published_url", "notes")


def update_status(status: DataFrame, videos: DataFrame, patches: DataFrame, now, order: str = "ord") -> DataFrame:
    """Apply field patches; ``patch`` is a map that holds only the fields to write.

    Moving to ``used`` stamps ``used_at`` if unset; any other status clears it unless the
    patch gives one. Unknown videos are ignored; the last patch of a video applies.
    """
    known = last_per_key(patches.select("video_id", "patch", order), ["video_id"], [order]).drop(order)
    known = known.join(videos.select("video_id"), "video_id", "left_semi")
    base = ensure_status(status, known, now)
    rows = base.join(known, "video_id", "left")
    has = {f: F.coalesce(F.array_contains(F.map_keys("patch"), f), F.lit(False)) for f in PATCH_FIELDS}
    given = {f: F.col("patch").getItem(f) for f in PATCH_FIELDS}
    fresh = {}
    for f in PATCH_FIELDS:
        if f in base.columns and f != "used_at":
            fresh[f] = F.when(has[f], given[f]).otherwise(F.col(f))
    fresh["used_at"] = (
        F.when(has["used_at"], F.try_to_timestamp(given["used_at"]))
        .when(has["status"] & (given["status"] == "used"), F.coalesce("used_at", at(now)))
        .when(has["status"], F.lit(None).cast("timestamp"))
        .otherwise(F.col("used_at"))
    )
    wrote = F.lit(False)
    for f in PATCH_FIELDS:
        wrote = wrote | has[f]
    fresh["updated_at"] = F.when(wrote, at(now)).otherwise(F.col("updated_at"))
    return rows.withColumns(fresh).drop("patch")


def bulk_status(status: DataFrame, videos: DataFrame, ids: DataFrame, new_status: str, now) -> DataFrame:
    """One status for a list of videos; unknown ids are ignored. ``touched`` marks the rows written."""
    wanted = ids.select("video_id").distinct().join(videos.select("video_id"), "video_id", "left_semi")
    base = ensure_status(status, wanted, now)
    rows = base.join(wanted.withColumn("_hit", F.lit(True)), "video_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    used_at = F.coalesce(F.col("used_at"), at(now)) if new_status == "used" else F.lit(None).cast("timestamp")
    return rows.withColumns(
        {
            "status": F.when(hit, F.lit(new_status)).otherwise(F.col("status")),
            "used_at": F.when(hit, used_at).otherwise(F.col("used_at")),
            "updated_at": F.when(hit, at(now)).otherwise(F.col("updated_at")),
            "touched": hit,
        }
    ).drop("_hit")


def record_pull(snapshot: DataFrame, entries: DataFrame, order: str = "position") -> DataFrame:
    """Add a run's snapshot rows; the first row of a (run, video) wins."""
    keys = ["run_id", "video_id"]
    fresh = first_per_key(entries.select(*keys, "position", "source_id"), keys, [order, "source_id"])
    return snapshot.unionByName(fresh.join(snapshot.select(*keys), keys, "left_anti"), allowMissingColumns=True)


STAT_COLUMNS = ("videos_found", "videos_added", "videos_already_exists", "videos_missing")


def open_pull_runs(pulls: DataFrame, entries: DataFrame, now) -> DataFrame:
    """Add a running run for every (run, source) of *entries* that has no row yet."""
    fresh = entries.filter("run_id is not null").groupBy("run_id").agg(F.min("source_id").alias("source_id"))
    fresh = fresh.join(pulls.select("run_id"), "run_id", "left_anti").withColumns({"status": F.lit("running"), "started_at": at(now)})
    return pulls.unionByName(fresh, allowMissingColumns=True)


def finish_pull_run(pulls: DataFrame, stats: DataFrame, now, status: str = "success") -> DataFrame:
    """Close the runs listed in ``stats`` (one row per run)."""
    fresh = stats.select("run_id", *[F.col(c).alias(f"_{c}") for c in STAT_COLUMNS], F.lit(True).alias("_hit"))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = {
        c: F.when(hit, F.coalesce(F.col(f"_{c}"), F.lit(0))).otherwise(
            F.col(c) if c in pulls.columns else F.lit(0)
        )
        for c in STAT_COLUMNS
    }
    finished = F.col("finished_at") if "finished_at" in pulls.columns else F.lit(None).cast("timestamp")
    out["status"] = F.when(hit, F.lit(status)).otherwise(F.col("status"))
    out["finished_at"] = F.when(hit, at(now)).otherwise(finished)
    return pulls.join(fresh, "run_id", "left").withColumns(out).drop("_hit", *[f"_{c}" for c in STAT_COLUMNS])


def reset_interrupted(pulls: DataFrame) -> DataFrame:
    """Runs still marked running after a restart have failed."""
    stuck = F.col("status") == "running"
    error = F.col("error_message") if "error_message" in pulls.columns else F.lit(None).cast("string")
    return pulls.withColumn("error_message", F.when(stuck, F.lit("stopped by a restart")).otherwise(error)).withColumn(
        "status", F.when(stuck, F.lit("failed")).otherwise(F.col("status"))
    )


def delete_source(
    doomed: DataFrame, sources: DataFrame, links: DataFrame, pulls: DataFrame, pull_videos: DataFrame
) -> dict[str, DataFrame]:
    """Remove sources with their links, runs and snapshots; videos stay."""
    ids = doomed.select("source_id").distinct()
    gone_runs = pulls.join(ids, "source_id", "left_semi").select("run_id")
    return {
        "sources": sources.join(ids, "source_id", "left_anti"),
        "source_videos": links.join(ids, "source_id", "left_anti"),
        "pull_runs": pulls.join(ids, "source_id", "left_anti"),
        "pull_run_videos": pull_videos.join(gone_runs, "run_id", "left_anti"),
    }


def upsert_settings(settings: DataFrame, batch: DataFrame, order: str = "ord") -> DataFrame:
    """Key-value settings: the last value of a key wins, even a null one."""
    fresh = last_per_key(batch.select("key", "value", order), ["key"], [order]).select(
        "key", F.struct("value").alias("_new")
    )
    return settings.join(fresh, "key", "full_outer").select(
        "key", F.when(F.col("_new").isNotNull(), F.col("_new.value")).otherwise(F.col("value")).alias("value")
    )


def requeue_stranded(queue: DataFrame) -> DataFrame:
    """Uploads interrupted by a restart go back to the queue."""
    return queue.withColumn("status", F.when(F.col("status") == "uploading", "queued").otherwise(F.col("status")))


def history_rows(uploads: DataFrame, tz: str) -> DataFrame:
    """Upload-history rows with their local date, ready to append."""
    local = F.from_utc_timestamp("uploaded_at", tz)
    return uploads.withColumn("date", F.to_date(local)).withColumn("uploaded_local", local)


def append_history(uploads: DataFrame, tz: str, path: str, batch: str) -> None:
    """Append a batch of uploads; a retry of the batch replaces what it wrote before, so it counts once."""
    history_rows(uploads, tz).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All batches of the upload history."""
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def add_manual_videos(
    videos: DataFrame, status: DataFrame, links: DataFrame, batch: DataFrame, manual_source: int, now,
    order: str = "ord",
) -> dict[str, DataFrame]:
    """Add single videos by hand: known ones are rejected, new ones go to the manual source."""
    known = videos.select("video_id")
    accepted = batch.join(known, "video_id", "left_anti")
    to_link = accepted.select(
        F.lit(manual_source).cast("long").alias("source_id"), "video_id", F.lit(None).cast("long").alias("position"),
        F.lit(None).cast("long").alias("run_id"), F.lit("manual").alias("metadata_source"), order,
    )
    return {
        "videos": upsert_videos(videos, accepted, now, order),
        "video_status": ensure_status(status, accepted, now),
        "source_videos": link_source_videos(links, to_link, now, order),
        "rejected": batch.join(known, "video_id", "left_semi"),
    }


def touch_sources(sources: DataFrame, pulled: DataFrame, now) -> DataFrame:
    """Stamp the last pull time of the pulled sources."""
    hit = pulled.select("source_id").distinct().withColumn("_hit", F.lit(True))
    old = F.col("last_pulled_at") if "last_pulled_at" in sources.columns else F.lit(None).cast("timestamp")
    return (
        sources.join(hit, "source_id", "left")
        .withColumn("last_pulled_at", F.when(F.col("_hit"), at(now)).otherwise(old))
        .drop("_hit")
    )


def set_thumbnails(channels: DataFrame, patch: DataFrame, order: str = "ord") -> DataFrame:
    """Overwrite channel thumbnails; the last patch of a channel wins."""
    fresh = last_per_key(patch.select("channel_id", F.col("thumbnail_url").alias("_thumb"), order), ["channel_id"], [order])
    old = F.col("thumbnail_url") if "thumbnail_url" in channels.columns else F.lit(None).cast("string")
    return (
        channels.join(fresh.select("channel_id", F.struct("_thumb").alias("_new")), "channel_id", "left")
        .withColumn("thumbnail_url", F.when(F.col("_new").isNotNull(), F.col("_new._thumb")).otherwise(old))
        .drop("_new")
    )


# ---- constraints -------------------------------------------------------------------
UNIQUE = {
    "channels": ["channel_id"],
    "sources": ["source_id"],
    "videos": ["video_id"],
    "video_status": ["video_id"],
    "source_videos": ["source_id", "video_id"],
    "pull_runs": ["run_id"],
    "pull_run_videos": ["run_id", "video_id"],
}
ALLOWED = {
    ("sources", "source_type"): ["playlist", "manual", "channel"],
    ("pull_runs", "status"): ["running", "success", "failed"],
    ("video_status", "status"): ["unused", "candidate", "used", "skipped"],
}
REQUIRED = [("sources", "title"), ("videos", "title"), ("videos", "url"), ("source_videos", "video_id")]
REFERENCES = [
    ("videos", "channel_id", "channels"),
    ("source_videos", "source_id", "sources"),
    ("source_videos", "video_id", "videos"),
    ("video_status", "video_id", "videos"),
    ("pull_runs", "source_id", "sources"),
    ("pull_run_videos", "run_id", "pull_runs"),
    ("pull_run_videos", "video_id", "videos"),
]


def catalogue_constraints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of unique, allowed-value, required and reference rules: (rule, table_name, key, n).

    Each table is read once: its rows tell which keys they hold, which they refer to and which of their values are bad. One
    aggregate over (entity, key) then sees duplicates (held twice), orphans (referred to, not held) and bad values together.
    """
    told = [c for t, df in tables.items() if (c := _claims(t, df, tables)) is not None]
    union = told[0]
    for other in told[1:]:
        union = union.unionByName(other)
    role = F.col("role")
    references = [r for r in REFERENCES if r[0] in tables and r[2] in tables]
    counts = union.groupBy("entity", "key").agg(
        F.count_if(role == "own").alias("own"), F.count_if(role == "bad").alias("bad"),
        *[F.count_if(role == f"{t}.{c}").alias(f"_ref{i}") for i, (t, c, _) in enumerate(references)],
    )
    part = F.split("entity", " ")

    def finding(when: Column, rule: Column, table: Column, n: str) -> Column:
        return F.when(when, F.struct(rule.alias("rule"), table.alias("table_name"), F.col(n).cast("long").alias("n")))

    findings = [
        finding(F.col("own") > 1, F.lit("unique"), F.col("entity"), "own"),
        finding(F.col("bad") > 0, F.get(part, F.lit(0)), F.get(part, F.lit(1)), "bad"),
        *[
            finding((F.col(f"_ref{i}") > 0) & (F.col("own") == 0), F.lit(f"reference:{c}"), F.lit(t), f"_ref{i}")
            for i, (t, c, _) in enumerate(references)
        ],
    ]
    found = counts.select("key", F.explode(F.array_compact(F.array(*findings))).alias("_f"))
    return found.select("_f.rule", "_f.table_name", F.translate("key", _SEPARATOR, "/").alias("key"), "_f.n")


#: Stands between the parts of a key while rows are grouped.
_SEPARATOR = "\x01"


def _claims(table: str, rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """(entity, key, role) of a table's rows: what they hold (``own``), refer to (``table.column``) and get wrong (``bad``)."""
    key = lambda *names: F.concat_ws(_SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names])

    def claim(entity: str, value: Column, role: str) -> Column:
        return F.struct(F.lit(entity).alias("entity"), value.alias("key"), F.lit(role).alias("role"))

    claims = [claim(table, key(*UNIQUE[table]), "own")] if table in UNIQUE else []
    for (t, column), values in ALLOWED.items():
        if t == table:
            claims.append(F.when(~F.col(column).isin(*values), claim(f"allowed:{column} {t}", key(column), "bad")))
    for t, column in REQUIRED:
        if t == table and column in rows.columns:
            claims.append(F.when(F.col(column).isNull(), claim(f"required:{column} {t}", key(*UNIQUE[t]), "bad")))
    for t, column, parent in REFERENCES:
        if t == table and parent in tables:
            claims.append(F.when(F.col(column).isNotNull(), claim(parent, key(column), f"{t}.{column}")))
    if not claims:
        return None
    return rows.select(F.explode(F.array_compact(F.array(*claims))).alias("_c")).select("_c.*")
