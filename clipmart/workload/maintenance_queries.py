"""Catalogue upkeep: each query applies a whole batch to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmart.operators import maintenance as m
from clipmart.plans.snapshot import apply_playlist_pull
from clipmart.sources.files import scratch_path
from clipmart.workload.catalogue_queries import stamp
from clipmart.workload.registry import query

NOW = "2024-06-01 12:00:00"
OLD = "2024-01-01 00:00:00"


def aged(df):
    return df.withColumns({"created_at": m.at(OLD), "updated_at": m.at(OLD)})


def batch(t):
    return t.incoming.withColumn("ord", F.col("position"))


def links(t):
    return t.source_videos.withColumns(
        {"missing_since": F.lit(None).cast("timestamp"), "last_seen_at": m.at(OLD), "added_at": m.at(OLD)}
    )


LAST = "arg_max({c}, position) filter (where {c} is not null) as {c}"


def fold_sql(key, cols):
    return (
        f"(select {key}, {', '.join(LAST.format(c=c) for c in cols)} from fx_incoming where {key} is not null "
        f"group by {key})"
    )


@query(f"""select coalesce(b.channel_id, c.channel_id) as channel_id, coalesce(b.channel_name, c.name) as name,
  coalesce(b.handle, c.handle) as handle, c.channel_id is null as was_new,
  case when c.channel_id is null then '{NOW}' else '{OLD}' end as created_at,
  case when b.channel_id is null then '{OLD}' else '{NOW}' end as updated_at
  from fx_channels c full join {fold_sql('channel_id', ['channel_name', 'handle'])} b on b.channel_id = c.channel_id""")
def upsert_channels(t):
    fresh = batch(t).withColumnRenamed("channel_name", "name")
    out = m.upsert_channels(aged(t.channels), fresh, NOW)
    return out.select("channel_id", "name", "handle", "was_new", stamp("created_at"), stamp("updated_at"))


@query(f"""select coalesce(b.video_id, v.video_id) as video_id,
  case when v.video_id is null then coalesce(b.title, 'Untitled') else coalesce(b.title, v.title) end as title,
  case when v.video_id is null then concat('https://www.youtube.com/watch?v=', b.video_id) else v.url end as url,
  coalesce(b.duration_seconds, v.duration_seconds) as duration_seconds, coalesce(b.channel_id, v.channel_id) as channel_id,
  v.video_id is null as was_new from fx_videos v
  full join {fold_sql('video_id', ['title', 'duration_seconds', 'channel_id'])} b on b.video_id = v.video_id""")
def upsert_videos(t):
    out = m.upsert_videos(aged(t.videos), batch(t), NOW)
    return out.select("video_id", "title", "url", "duration_seconds", "channel_id", "was_new")


@query(f"""select coalesce(s.source_key, b.source_key) as source_key, coalesce(b.title, s.title, 'Untitled') as title,
  coalesce(s.source_type, 'playlist') as source_type, coalesce(b.url, s.url) as url, s.source_key is null as was_new
  from (select *, concat(source_type, ':', source_id) as source_key from fx_sources) s full join
  (select source_key, arg_max(title, position) filter (where title is not null) as title,
          arg_max(url, position) filter (where url is not null) as url from (
     select concat('playlist:', source_id + position % 40) as source_key, title, position,
     case when duration_seconds > 300 then concat('https://tube.example/p/', position) end as url from fx_incoming)
   group by source_key) b on b.source_key = s.source_key""")
def upsert_sources(t):
    current = aged(t.sources.withColumn("source_key", F.concat_ws(":", "source_type", "source_id")))
    fresh = batch(t).select(
        F.expr("concat('playlist:', source_id + position % 40)").alias("source_key"), "title", "ord",
        F.expr("case when duration_seconds > 300 then concat('https://tube.example/p/', position) end").alias("url"),
    )
    return m.upsert_sources(current, fresh, NOW).select("source_key", "title", "source_type", "url", "was_new")


LINK_SQL = f"""select coalesce(b.source_id, l.source_id) as source_id, coalesce(b.video_id, l.video_id) as video_id,
  coalesce(b.position, l.position) as position, coalesce(l.first_seen_run, case when l.source_id is null then 9999 end)
  as first_seen_run, case when b.source_id is null then l.last_seen_run else 9999 end as last_seen_run,
  b.source_id is not null or l.is_present as is_present,
  case when b.source_id is null then '{OLD}' else '{NOW}' end as last_seen_at
  from fx_source_videos l full join (select source_id, video_id, max(position) as position from fx_incoming group by 1, 2) b
  on b.source_id = l.source_id and b.video_id = l.video_id"""


@query(LINK_SQL)
def link_source_videos(t):
    out = m.link_source_videos(links(t), batch(t).withColumn("run_id", F.lit(9999).cast("long")), NOW)
    return out.select(
        "source_id", "video_id", "position", "first_seen_run", "last_seen_run", "is_present", stamp("last_seen_at")
    )


@query(f"""select source_id, video_id, is_present and not gone as is_present,
  case when is_present and gone then '{NOW}' end as missing_since from (
  select l.*, source_id in (select source_id from fx_incoming) and not exists (select 1 from fx_incoming x
    where x.source_id = l.source_id and x.video_id = l.video_id) as gone from fx_source_videos l)""")
def mark_missing(t):
    out = m.mark_missing(links(t), t.incoming, NOW)
    return out.select("source_id", "video_id", "is_present", stamp("missing_since"))


@query("""select video_id, status from fx_video_status union all
  select distinct video_id, 'unused' from fx_incoming where video_id not in (select video_id from fx_video_status)""")
def ensure_status(t):
    return m.ensure_status(t.video_status, t.incoming, NOW).select("video_id", "status")


@query(f"""with p as (select video_id, arg_max(position, position) as position, arg_max(coalesce(title, '-'), position)
    as note from fx_incoming group by video_id), known as (select p.* from p join fx_videos using (video_id)),
  base as (select video_id, status, used_at, notes from fx_video_status union all
    select video_id, 'unused', null, null from known where video_id not in (select video_id from fx_video_status))
  select b.video_id, case k.position % 4 when 0 then 'used' when 1 then 'skipped' else b.status end as status,
  strftime(case k.position % 4 when 0 then coalesce(b.used_at, timestamp '{NOW}') when 1 then null else b.used_at end,
    '%Y-%m-%d %H:%M:%S') as used_at, case when k.position % 4 = 2 then k.note else b.notes end as notes
  from base b left join known k using (video_id)""")
def update_status(t):
    patches = t.incoming.select(
        "video_id",
        F.col("position").alias("ord"),
        F.expr(
            "case position % 4 when 0 then map('status', 'used') when 1 then map('status', 'skipped') "
            "when 2 then map('notes', coalesce(title, '-')) else cast(map() as map<string, string>) end"
        ).alias("patch"),
    )
    out = m.update_status(t.video_status, t.videos, patches, NOW)
    return out.select("video_id", "status", stamp("used_at"), "notes")


@query(f"""with ids as (select distinct video_id from fx_incoming where video_id in (select video_id from fx_videos)),
  base as (select video_id, status, used_at from fx_video_status union all
    select video_id, 'unused', null from ids where video_id not in (select video_id from fx_video_status))
  select b.video_id, case when i.video_id is null then b.status else 'used' end as status,
  strftime(case when i.video_id is null then b.used_at else coalesce(b.used_at, timestamp '{NOW}') end,
    '%Y-%m-%d %H:%M:%S') as used_at, i.video_id is not null as touched
  from base b left join ids i using (video_id)""")
def bulk_status(t):
    out = m.bulk_status(t.video_status, t.videos, t.incoming, "used", NOW)
    return out.select("video_id", "status", stamp("used_at"), "touched")


def next_run(t):
    return t.incoming.withColumn("run_id", F.col("source_id") * 1000 + 999)


@query("""select run_id, video_id, position from fx_pull_run_videos union all
  select source_id * 1000 + 999 as run_id, video_id, min(position) from fx_incoming group by 1, 2""")
def record_pull(t):
    return m.record_pull(t.pull_run_videos, next_run(t)).select("run_id", "video_id", "position")


@query(f"""select p.run_id, case when s.run_id is null then p.status else 'success' end as status,
  coalesce(s.n, p.videos_found) as videos_found, case when s.run_id is not null then '{NOW}' end as finished_at
  from fx_pull_runs p left join (select run_id, sum(progress_total) as n from fx_pull_runs where status = 'running'
  group by run_id) s using (run_id)""")
def finish_pull_run(t):
    stats = t.pull_runs.filter("status = 'running'").select(
        "run_id", F.col("progress_total").alias("videos_found"), F.lit(0).alias("videos_added"),
        F.lit(0).alias("videos_already_exists"), F.lit(0).alias("videos_missing"),
    )
    out = m.finish_pull_run(t.pull_runs, stats, NOW)
    return out.select("run_id", "status", "videos_found", stamp("finished_at"))


@query("""select run_id, case status when 'running' then 'failed' else status end as status,
  case status when 'running' then 'stopped by a restart' end as error_message from fx_pull_runs""")
def reset_interrupted(t):
    return m.reset_interrupted(t.pull_runs).select("run_id", "status", "error_message")


@query("""with doomed as (select source_id from fx_sources where source_type = 'channel')
  select 'sources' as table_name, count(*) as n from fx_sources where source_id not in (select source_id from doomed)
  union all select 'source_videos', count(*) from fx_source_videos where source_id not in (select source_id from doomed)
  union all select 'pull_runs', count(*) from fx_pull_runs where source_id not in (select source_id from doomed)
  union all select 'pull_run_videos', count(*) from fx_pull_run_videos where source_id not in (select source_id from doomed)""")
def delete_source(t):
    doomed = t.sources.filter("source_type = 'channel'")
    kept = m.delete_source(doomed, t.sources, t.source_videos, t.pull_runs, t.pull_run_videos)
    out = None
    for name, df in kept.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""select coalesce(b.key, s.key) as key, case when b.key is null then s.value else b.v.value end as value
  from (select p_brand as key, max(p_type) as value from part group by p_brand) s full join
  (select key, arg_max({'value': title}, position) as v from (select concat('Brand#', position % 40) as key, title, position
   from fx_incoming) group by key) b on b.key = s.key""")
def upsert_settings(t):
    settings = t.part.groupBy(F.col("p_brand").alias("key")).agg(F.max("p_type").alias("value"))
    fresh = batch(t).select(F.expr("concat('Brand#', position % 40)").alias("key"), F.col("title").alias("value"), "ord")
    return m.upsert_settings(settings, fresh)


@query("select job_id, rank, case status when 'uploading' then 'queued' else status end as status from fx_upload_queue")
def requeue_stranded(t):
    return m.requeue_stranded(t.upload_queue).select("job_id", "rank", "status")


@query("""select video_id, strftime(uploaded_at + interval '330' minute, '%Y-%m-%d') as date,
  strftime(uploaded_at + interval '330' minute, '%Y-%m-%d %H:%M:%S') as uploaded_local from fx_history""")
def append_history(t):
    path = scratch_path(t.spark, "upload-history")
    halves = [t.history.filter(f"video_id % 2 = {i}") for i in (0, 1)]
    m.append_history(halves[0], "Asia/Kolkata", path, "0")
    m.append_history(halves[1], "Asia/Kolkata", path, "1")
    # The second batch runs again, as after a failure.
    m.append_history(halves[1], "Asia/Kolkata", path, "1")
    rows = m.read_history(t.spark, path)
    return rows.select("video_id", F.date_format("date", "yyyy-MM-dd").alias("date"), stamp("uploaded_local"))


@query("""select 'rejected' as outcome, position, video_id from fx_incoming where video_id in (select video_id from fx_videos)
  union all select 'linked', null, video_id from (select distinct video_id from fx_incoming
    where video_id not in (select video_id from fx_videos))""")
def add_manual_videos(t):
    out = m.add_manual_videos(t.videos.withColumn("updated_at", m.at(OLD)), t.video_status, links(t), batch(t), 900, NOW)
    rejected = out["rejected"].select(F.lit("rejected").alias("outcome"), "position", "video_id")
    linked = out["source_videos"].filter("source_id = 900").select(
        F.lit("linked").alias("outcome"), F.lit(None).cast("long").alias("position"), "video_id"
    )
    return rejected.unionByName(linked)


@query(f"""select source_id, case when source_id in (select source_id from fx_incoming) then '{NOW}' end as last_pulled_at
  from fx_sources""")
def touch_sources(t):
    return m.touch_sources(t.sources, t.incoming, NOW).select("source_id", stamp("last_pulled_at"))


@query("""select c.channel_id, p.url as thumbnail_url from fx_channels c left join (select channel_id,
  concat('https://img.example/', max(position)) as url from fx_incoming where channel_id is not null group by channel_id) p
  using (channel_id)""")
def set_thumbnails(t):
    patch = batch(t).filter("channel_id is not null").select(
        "channel_id", "ord", F.expr("concat('https://img.example/', position)").alias("thumbnail_url")
    )
    return m.set_thumbnails(t.channels, patch).select("channel_id", "thumbnail_url")


@query("""select 'unique' as rule, 'source_videos' as table_name, concat_ws('/', source_id, video_id) as key, count(*) as n
    from fx_incoming group by source_id, video_id having count(*) > 1
  union all select 'reference:video_id', 'source_videos', cast(video_id as varchar), count(*) from fx_incoming
    where video_id not in (select video_id from fx_videos) group by video_id
  union all select 'unique', 'videos', cast(video_id as varchar), count(*) from fx_videos group by video_id having count(*) > 1
  union all select 'unique', 'channels', cast(channel_id as varchar), count(*) from fx_channels group by channel_id
    having count(*) > 1
  union all select 'reference:channel_id', 'videos', cast(channel_id as varchar), count(*) from fx_videos
    where channel_id not in (select channel_id from fx_channels) group by channel_id
  union all select 'allowed:status', 'pull_runs', status, count(*) from fx_jobs
    where status not in ('running', 'success', 'failed') group by status
  union all select 'reference:source_id', 'pull_runs', cast(job_id as varchar), count(*) from fx_jobs
    where job_id not in (select source_id from fx_sources) group by job_id""")
def catalogue_constraints(t):
    runs = t.jobs.select(F.col("job_id").alias("run_id"), F.col("job_id").alias("source_id"), "status")
    return m.catalogue_constraints(
        {
            "channels": t.channels, "sources": t.sources, "videos": t.videos, "video_status": t.video_status,
            "source_videos": t.incoming, "pull_runs": runs,
        }
    )


# A fast pull brings no metadata for videos that are known; playlists bring headers with their owners.
PULLED = f"""with inc as (select source_id, position, video_id, source_id * 1000 + 999 as run_id, {", ".join(
    f"case when video_id not in (select video_id from fx_videos) then {c} end as {c}"
    for c in ("title", "duration_seconds", "channel_id", "channel_name", "handle")
  )} from fx_incoming),
  cb as (select channel_id, channel_name as name, handle, source_id as s, position as p from inc where channel_id is not null
    union all select source_id * 5, concat('Owner ', source_id), null, -1, -1 from fx_sources where source_type = 'playlist'),
  cf as (select channel_id, arg_max(name, (s, p)) filter (where name is not null) as name,
    arg_max(handle, (s, p)) filter (where handle is not null) as handle from cb group by 1),
  vf as (select video_id, {", ".join(f"arg_max({c}, (source_id, position)) filter (where {c} is not null) as {c}" for c in ("title", "duration_seconds", "channel_id"))}
    from inc group by 1),
  lf as (select source_id, video_id, max(position) as position, max(run_id) as run_id from inc group by 1, 2),
  st as (select i.source_id, max(i.run_id) as run_id, count(*) as found, coalesce(any_value(a.added), 0) as added, coalesce(any_value(g.missing), 0) as missing
    from inc i left join (select source_id, count(*) as added from (select source_id, row_number() over (partition by video_id
      order by source_id, position) as rn from inc where video_id not in (select video_id from fx_videos)) where rn = 1 group by 1) a using (source_id)
    left join (select source_id, count(*) as missing from fx_source_videos l where is_present and source_id in (select source_id from inc)
      and not exists (select 1 from inc x where x.source_id = l.source_id and x.video_id = l.video_id) group by 1) g using (source_id) group by 1)
  select 'channels' as table_name, cast(coalesce(b.channel_id, c.channel_id) as varchar) as key,
    concat_ws('|', coalesce(b.name, c.name, '-'), coalesce(b.handle, c.handle, '-'), c.channel_id is null) as value
    from fx_channels c full join cf b on b.channel_id = c.channel_id
  union all select 'videos', cast(coalesce(b.video_id, v.video_id) as varchar), concat_ws('|', case when v.video_id is null then
    coalesce(b.title, 'Untitled') else coalesce(b.title, v.title) end, coalesce(b.duration_seconds, v.duration_seconds, -1),
    coalesce(b.channel_id, v.channel_id, -1), v.video_id is null) from fx_videos v full join vf b on b.video_id = v.video_id
  union all select 'video_status', cast(video_id as varchar), status from (select video_id, status from fx_video_status
    union all select distinct video_id, 'unused' from inc where video_id not in (select video_id from fx_video_status))
  union all select 'pull_run_videos', concat_ws('/', run_id, video_id), cast(position as varchar) from (select run_id, video_id, position
    from fx_pull_run_videos union all select run_id, video_id, min(position) from inc group by 1, 2)
  union all select 'source_videos', concat_ws('/', coalesce(b.source_id, l.source_id), coalesce(b.video_id, l.video_id)), concat_ws('|',
    coalesce(l.first_seen_run, b.run_id), coalesce(b.run_id, l.last_seen_run), b.source_id is not null or (l.is_present and
    l.source_id not in (select source_id from inc)), b.source_id is null and l.is_present and l.source_id in (select source_id from inc),
    case when b.source_id is null then '-' else 'playlist_pull_fast' end)
    from fx_source_videos l full join lf b on b.source_id = l.source_id and b.video_id = l.video_id
  union all select 'pull_runs', cast(run_id as varchar), concat_ws('|', source_id, status, found, added, missing) from (
    select run_id, source_id, status, videos_found as found, 0 as added, 0 as missing from fx_pull_runs
    union all select run_id, source_id, 'success', found, added, missing from st)
  union all select 'sources', concat(source_type, ':', source_id), concat_ws('|', case when source_type = 'playlist' then concat('Pulled ', title)
    else title end, coalesce(case when source_id in (select source_id from inc) then '{NOW}' end, '-')) from fx_sources
  union all select 'stats', cast(source_id as varchar), concat_ws('|', found, added, found - added, missing) from st"""


def told(name: str, key: list[str], values: list, out):
    """Rows of one table as (table_name, key, value)."""
    shown = [F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit(none)) for v, none in values]
    return out[name].select(F.lit(name).alias("table_name"), F.concat_ws("/", *key).alias("key"), F.concat_ws("|", *shown).alias("value"))


@query(PULLED)
def apply_playlist_pull(t, run=apply_playlist_pull):
    sources = t.sources.withColumn("source_key", F.concat_ws(":", "source_type", "source_id"))
    tables = {
        "channels": aged(t.channels), "videos": aged(t.videos), "video_status": t.video_status,
        "pull_run_videos": t.pull_run_videos, "source_videos": links(t), "pull_runs": t.pull_runs, "sources": aged(sources),
    }
    known = t.videos.select("video_id", F.lit(True).alias("known"))
    metadata = ("title", "duration_seconds", "channel_id", "channel_name", "handle")
    entries = next_run(t).join(known, "video_id", "left").withColumns({c: F.when(F.col("known").isNull(), F.col(c)) for c in metadata})
    headers = sources.filter("source_type = 'playlist'").select(
        "source_key", F.concat(F.lit("Pulled "), "title").alias("title"), "url", (F.col("source_id") * 5).alias("owner_channel_id"),
        F.concat(F.lit("Owner "), F.col("source_id").cast("string")).alias("owner_channel_name"), F.lit(None).cast("string").alias("owner_channel_url"),
    )
    out = run(tables, entries.drop("known"), NOW, headers, fast=True)
    counts = [(c, "0") for c in ("videos_found", "videos_added", "videos_missing")]
    parts = [
        told("channels", ["channel_id"], [("name", "-"), ("handle", "-"), ("was_new", "-")], out),
        told("videos", ["video_id"], [("title", "-"), ("duration_seconds", "-1"), ("channel_id", "-1"), ("was_new", "-")], out),
        told("video_status", ["video_id"], [("status", "-")], out),
        told("pull_run_videos", ["run_id", "video_id"], [("position", "-")], out),
        told("source_videos", ["source_id", "video_id"], [
            ("first_seen_run", "-"), ("last_seen_run", "-"), ("is_present", "-"), (F.col("missing_since").isNotNull(), "-"), ("metadata_source", "-"),
        ], out),
        told("pull_runs", ["run_id"], [("source_id", "-"), ("status", "-"), *counts], out),
        told("sources", ["source_key"], [("title", "-"), (stamp("last_pulled_at"), "-")], out),
        told("stats", ["source_id"], [*counts[:2], ("videos_already_exists", "0"), counts[2]], out),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every
