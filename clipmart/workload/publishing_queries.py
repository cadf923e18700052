"""Publishing operators over every manifest row, queue entry and performance row."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmart.operators import publishing as pub
from clipmart.plans.publish import PublishLimits, publish_plan as plan_publishing
from clipmart.workload.registry import query

NOW = "1999-06-01 10:40:00"


def stamp(name, alias=None):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(alias or name)


def ts(expr):
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


READY = "(select m.* from fx_manifest m where status = 'success' and (viral_score * 7919 + rank) % 23 > 0)"
YT_PENDING = "not (coalesce(youtube_video_id, '') <> '' and coalesce(youtube_upload_status, '') = 'uploaded')"


@query(f"select job_id, rank, video_path from {READY}")
def upload_candidates(t):
    return pub.upload_candidates(t.manifest, t.files).select("job_id", "rank", "video_path")


@query(f"select 'youtube' as platform, job_id, rank from fx_manifest where {YT_PENDING} union all "
       "select 'instagram', job_id, rank from fx_manifest where ig_media_id is null")
def pending_uploads(t):
    sides = [
        pub.pending_uploads(t.manifest, p).select(F.lit(p).alias("platform"), "job_id", "rank") for p in ("youtube", "instagram")
    ]
    return sides[0].unionByName(sides[1])


@query("select job_id, rank, ig_container_id from fx_manifest where ig_container_id is not null and ig_media_id is null")
def inflight_containers(t):
    return pub.inflight_containers(t.manifest).select("job_id", "rank", "ig_container_id")


STATE = """(select o_orderkey as video_key, concat('https://tube.example/v/', o_custkey) as url,
  case o_orderstatus when 'F' then 'done' when 'O' then 'failed' else 'running' end as status from orders)"""


def state_of(t):
    return t.orders.selectExpr(
        "o_orderkey as video_key", "concat('https://tube.example/v/', o_custkey) as url",
        "case o_orderstatus when 'F' then 'done' when 'O' then 'failed' else 'running' end as status",
    )


@query(f"""select o_orderkey as video_key, false as retry from orders where o_orderkey not in
  (select video_key from {STATE} where status in ('done', 'failed')) union all select o_orderkey, true from orders where
  o_orderkey not in (select video_key from {STATE} where status = 'done')""")
def runnable_links(t):
    links = t.orders.select(F.col("o_orderkey").alias("video_key"))
    sides = [
        pub.runnable_links(links, state_of(t), retry).withColumn("retry", F.lit(retry)) for retry in (False, True)
    ]
    return sides[0].unionByName(sides[1])


FUTURE = f"(select video_id, try_cast(publish_at as timestamp) as publish_ts from fx_scheduled where privacy = 'private' and try_cast(publish_at as timestamp) > timestamp '{NOW}')"


@query(f"select video_id, {ts('publish_ts')} as publish_ts from {FUTURE}")
def future_scheduled(t):
    return pub.future_scheduled(t.scheduled, NOW).select("video_id", stamp("publish_ts"))


@query("""select job_id, rank, concat('clip_', rank, '.mp4') as filename,
  concat('/api/outputs/', job_id, '/clip_', rank, '.mp4') as download_url from fx_manifest""")
def job_clip_listing(t):
    return pub.job_clip_listing(t.manifest).select("job_id", "rank", "filename", "download_url")


@query("""select m.job_id, m.rank, coalesce(nullif(m.youtube_title_final, ''), m.title, concat('Clip ', m.rank)) as title from fx_manifest m
  join fx_jobs j on j.job_id = m.job_id and j.status = 'completed' where m.status = 'success'
  and coalesce(m.youtube_upload_status, '') <> 'uploaded' and not exists (select 1 from fx_upload_queue q
  where q.job_id = m.job_id and q.rank = m.rank and q.status in ('queued', 'uploading'))""")
def uploadable_clips(t):
    return pub.uploadable_clips(t.jobs, t.manifest, t.upload_queue).select("job_id", "rank", "title")


@query("""select j.job_id, j.url, count(*) as clip_count,
  sum(case when m.youtube_upload_status = 'uploaded' then 1 else 0 end) as uploaded_count
  from fx_jobs j join fx_manifest m on m.job_id = j.job_id and m.status = 'success' where j.status = 'completed'
  group by j.job_id, j.url""")
def uploadable_jobs(t):
    return pub.uploadable_jobs(t.jobs, t.manifest)


def previous(t):
    """An earlier manifest: some rows without path, some whose path is gone, some pointing at the next clip."""
    return t.manifest.select(
        "job_id", "rank",
        F.expr(
            "case viral_score % 3 when 0 then concat('/out/', job_id, '/clip_', rank + 1, '.mp4') when 1 then null "
            "else concat(video_path, '.old') end"
        ).alias("video_path"),
        F.col("rank").alias("ord"),
        F.lit("uploaded").alias("youtube_upload_status"),
        F.expr("concat('p', video_id)").alias("youtube_video_id"),
        F.expr("case when viral_score > 80 then concat('https://youtu.example/', rank) end").alias("youtube_url"),
    )


MATCHES = """prev as (select job_id, rank, case viral_score % 3 when 0 then concat('/out/', job_id, '/clip_', rank + 1, '.mp4')
    when 2 then concat(video_path, '.old') end as video_path, 'uploaded' as s, concat('p', video_id) as v,
    case when viral_score > 80 then concat('https://youtu.example/', rank) end as u from fx_manifest),
  placed as (select p.*, m.video_path is not null as on_path from prev p left join fx_manifest m
    on m.job_id = p.job_id and m.video_path = p.video_path)"""


def matches(agg):
    def fold(cond, keys):
        cols = ", ".join(f"{agg}({c}, rank) filter (where {c} is not null) as {c}" for c in "svu")
        return f"(select {keys}, true as hit, {cols} from placed where {cond} group by {keys})"

    return (
        f"fx_manifest m left join {fold('on_path', 'job_id, video_path')} a using (job_id, video_path) "
        f"left join {fold('not on_path', 'job_id, rank')} b using (job_id, rank)"
    )


@query(f"""with {MATCHES} select m.job_id, m.rank, coalesce(m.youtube_upload_status, a.s, b.s) as youtube_upload_status,
  coalesce(m.youtube_video_id, a.v, b.v) as youtube_video_id, coalesce(a.u, b.u) as youtube_url from {matches('arg_min')}""")
def merge_previous_results(t):
    return pub.merge_previous_results(t.manifest, previous(t), "youtube_").select(
        "job_id", "rank", "youtube_upload_status", "youtube_video_id", "youtube_url"
    )


@query(f"""with {MATCHES} select m.job_id, m.rank, case when a.hit or b.hit then coalesce(a.v, b.v) else m.youtube_video_id end
  as youtube_video_id, case when a.hit or b.hit then coalesce(a.u, b.u) end as youtube_url from {matches('arg_max')}""")
def apply_upload_results(t):
    out = pub.apply_upload_results(t.manifest, previous(t), ["youtube_video_id", "youtube_url"])
    return out.select("job_id", "rank", "youtube_video_id", "youtube_url")


PLAN = f"""(select video_id, publish_ts, min(publish_ts) over () + (row_number() over (order by publish_ts, video_id) - 1)
  * interval '90' minute as new_publish_at from {FUTURE})"""


@query(f"""select video_id, {ts('new_publish_at')} as new_publish_at,
  new_publish_at <= timestamp '{NOW}' + interval '15' minute as unsafe from {PLAN}""")
def reschedule_plan(t):
    return pub.reschedule_plan(t.scheduled, NOW, 1.5).select("video_id", stamp("new_publish_at"), "unsafe")


@query(f"""select m.job_id, m.rank, {ts('p.new_publish_at')} as youtube_scheduled_at,
  case when p.video_id is not null then '{NOW}' end as youtube_rescheduled_at
  from fx_manifest m left join {PLAN} p on p.video_id = m.job_id""")
def apply_reschedule(t):
    rows = t.manifest.withColumn("youtube_video_id", F.col("job_id"))
    out = pub.apply_reschedule(rows, pub.reschedule_plan(t.scheduled, NOW, 1.5), NOW)
    return out.select("job_id", "rank", stamp("youtube_scheduled_at"), stamp("youtube_rescheduled_at"))


@query(f"""select m.job_id, m.rank, s.url as queue_source_url, m.viral_score from fx_manifest m join {STATE} s
  on s.video_key = m.job_id and s.status = 'done' where m.status = 'success'""")
def queue_manifest(t):
    return pub.queue_manifest(state_of(t), t.manifest).select("job_id", "rank", "queue_source_url", "viral_score")


@query("""select job_id, rank, case when status = 'success' then youtube_video_id end as youtube_video_id,
  case when status <> 'success' then ig_media_id end as ig_media_id from fx_manifest""")
def union_manifests(t):
    done = t.manifest.filter("status = 'success'").select("job_id", "rank", "youtube_video_id")
    rest = t.manifest.filter("status <> 'success'").select("job_id", "rank", "ig_media_id")
    return pub.union_manifests(done, rest)


@query(f"""select count(*) filter (where status = 'done') as done, count(*) filter (where status = 'failed') as failed,
  sum(case when status = 'done' then coalesce(n, 0) else 0 end) as clips from {STATE}
  left join (select job_id, count(*) as n from fx_manifest where status = 'success' group by job_id) on job_id = video_key""")
def queue_totals(t):
    clips = t.manifest.filter("status = 'success'").groupBy(F.col("job_id").alias("video_key")).agg(F.count("*").alias("clips"))
    return pub.queue_totals(state_of(t).join(clips, "video_key", "left"))


@query("""select strftime(uploaded_at + interval '330' minute, '%Y-%m-%d') as day, count(*) as uploads,
  greatest(6 - count(*), 0) as remaining from fx_history group by 1""")
def uploads_per_local_day(t):
    return pub.uploads_per_local_day(t.history, "Asia/Kolkata", 6).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "uploads", "remaining"
    )


@query(f"""select count(*) as recent, greatest(50 - count(*), 0) as remaining from fx_manifest
  where ig_published_at >= timestamp '{NOW}' - interval '24' hour""")
def recent_publish_count(t):
    return pub.recent_publish_count(t.manifest, NOW)


@query(f"select {ts('max(ig_published_at)')} as last_publish from fx_manifest")
def last_publish_time(t):
    return pub.last_publish_time(t.manifest).select(stamp("last_publish"))


@query(f"select {ts('max(publish_ts)')} as latest, count(*) as queued, count(*) < 100000 as has_room from {FUTURE}")
def latest_scheduled(t):
    return pub.latest_scheduled(t.scheduled, NOW, 100000).select(stamp("latest"), "queued", "has_room")


@query("""select count(*) filter (where status = 'rendering') as running, count(*) filter (where status = 'queued') as queued,
  count(*) filter (where status = 'completed') as completed, sum(case when status = 'completed' then coalesce(n, 0) else 0 end)
  as total_clips from fx_jobs left join (select job_id, count(*) as n from fx_manifest group by job_id) using (job_id)""")
def job_counts(t):
    clips = t.manifest.groupBy("job_id").agg(F.count("*").alias("n_clips"))
    return pub.job_counts(t.jobs.join(clips, "job_id", "left"))


@query(f"select job_id, rank from {READY} where {YT_PENDING} order by job_id, rank limit 7")
def cap_per_run(t):
    pending = pub.pending_uploads(pub.upload_candidates(t.manifest, t.files))
    return pub.cap_per_run(pending, 7).select("job_id", "rank")


@query(f"""select job_id, rank, {ts(f"timestamp '{NOW}' + (row_number() over (order by job_id, rank) - 1) * interval '2' hour")}
  as slot from fx_manifest where {YT_PENDING}""")
def publish_slots(t):
    return pub.publish_slots(pub.pending_uploads(t.manifest), NOW, 1.0, 2.0).select("job_id", "rank", stamp("slot"))


@query(f"""select 'queue' as kind, {ts("max(publish_ts) + interval '8' hour")} as first from {FUTURE}
  union all select 'fallback', '2030-01-01 12:00:00'
  union all select 'start', '2024-05-05 05:05:00'""")
def first_publish_time(t):
    cases = {"queue": (NOW, None), "fallback": ("2030-01-01 11:31:00", None), "start": (NOW, "2024-05-05 05:05:00")}
    out = None
    for kind, (now, start) in cases.items():
        row = pub.first_publish_time(t.scheduled, now, 8, start).select(F.lit(kind).alias("kind"), stamp("first"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""with taken as (select job_id, rank from fx_upload_queue where status <> 'failed'),
  fresh as (select m.job_id, m.rank from fx_manifest m where status = 'success' and
    not exists (select 1 from taken k where k.job_id = m.job_id and k.rank = m.rank)),
  base as (select greatest(timestamp '{NOW}', max(try_cast(scheduled_at as timestamp))) as t from fx_upload_queue
    where status = 'queued')
  select job_id, rank, {ts("(select t from base) + (row_number() over (order by job_id, rank) - 1) * interval '30' minute")}
  as scheduled_at from fresh""")
def enqueue_slots(t):
    refs = t.manifest.select("job_id", "rank", F.expr("job_id * 100 + rank").alias("ord"))
    out = pub.enqueue_slots(t.upload_queue, refs, t.manifest, NOW, 30)
    return out.select("job_id", "rank", stamp("scheduled_at"))


@query(f"""with taken as (select job_id, rank from fx_upload_queue where status <> 'failed'),
  fresh as (select m.job_id, m.rank, m.viral_score from fx_manifest m where status = 'success' and
    not exists (select 1 from taken k where k.job_id = m.job_id and k.rank = m.rank)),
  base as (select greatest(timestamp '{NOW}', max(try_cast(scheduled_at as timestamp))) as t from fx_upload_queue
    where status = 'queued')
  select job_id, rank, {ts("(select t from base) + (row_number() over (order by job_id, coalesce(viral_score, 0) desc, rank) - 1) * interval '30' minute")}
  as scheduled_at from fresh""")
def enqueue_job_clips(t):
    out = pub.enqueue_slots(t.upload_queue, pub.best_first(t.manifest), t.manifest, NOW, 30)
    return out.select("job_id", "rank", stamp("scheduled_at"))


#: What numbered clips take along: numbering writes them out.
INSTAGRAM = ("job_id", "rank", "ig_media_id", "ig_published_at")


@query(f"""with last as (select max(ig_published_at) as t from fx_manifest), p as (select job_id, rank,
    row_number() over (order by job_id, rank) as i from fx_manifest where ig_media_id is null)
  select job_id, rank, case when i = 1 then 'published' else 'deferred' end as outcome,
    case when i > 1 then '2030-01-01 06:00:00' end as next_slot, 'late' as run from p
  union all select job_id, rank, 'deferred', {ts("(select t from last) + interval '6' hour")}, 'early' from p""")
def instagram_slots(t):
    manifest = t.manifest.select(*INSTAGRAM)
    pending = pub.pending_uploads(manifest, "instagram")
    late = pub.instagram_slots(pending, manifest, "2030-01-01 00:00:00", 6).withColumn("run", F.lit("late"))
    early = pub.instagram_slots(pending, manifest, NOW, 6).withColumn("run", F.lit("early"))
    return late.unionByName(early).select("job_id", "rank", "outcome", stamp("next_slot"), "run")


@query("""with used as (select count(*) as n, max(ig_published_at) as last from fx_manifest
    where ig_published_at >= timestamp '1998-08-01 00:00:00' - interval '720' hour),
  p as (select job_id, rank, row_number() over (order by job_id, rank) as i from fx_manifest where ig_media_id is null),
  caps as (select unnest([1000000, 2, (select n from used) + 3]) as cap)
  select cap, job_id, rank, 'deferred' as outcome,
    strftime((select max(ig_published_at) from fx_manifest) + interval '6' hour, '%Y-%m-%d %H:%M:%S') as next_slot
  from caps join p on i <= greatest(cap - (select n from used), 0) where cap <> 1000000 or i <= 1000000""")
def instagram_plan(t):
    now, manifest = "1998-08-01 00:00:00", t.manifest.select(*INSTAGRAM)
    used = pub.recent_publish_count(manifest, now, 720).first()["recent"]
    out = None
    for cap in (1000000, 2, used + 3):
        plan = pub.instagram_plan(manifest, now, 6, 720, cap).select(F.lit(cap).cast("long").alias("cap"), "job_id", "rank", "outcome", stamp("next_slot"))
        out = plan if out is None else out.unionByName(plan)
    return out


@query("""select job_id, rank from (select *, coalesce(try_cast(scheduled_at as timestamp), timestamp '0001-01-01') as due
  from fx_upload_queue where status = 'queued') where due <= timestamp '2024-01-01 10:00:00' order by due, job_id, rank limit 1""")
def next_due(t):
    return pub.next_due(t.upload_queue, "2024-01-01 10:00:00").select("job_id", "rank")


@query("select job_id, rank, status, try_cast(scheduled_at as timestamp) is null as at_once from fx_upload_queue")
def queue_by_time(t):
    out = pub.queue_by_time(t.upload_queue)
    return out.select("job_id", "rank", "status", (F.year("due_at") == 1).alias("at_once"))


@query("""select event_id, case step when 'download' then 'downloading' when 'transcribe' then 'transcribing'
  when 'analyze' then 'analyzing' when 'render' then 'rendering' end as dashboard_status from fx_job_events""")
def step_status_map(t):
    return pub.step_status_map(t.job_events).select("event_id", "dashboard_status")


@query(f"select job_id, status, {ts('created_at')} as created_at from fx_jobs")
def jobs_newest_first(t):
    return pub.jobs_newest_first(t.jobs).select("job_id", "status", stamp("created_at"))


@query("""select job_id, event_id, concat('[', step, '] ', status) as line from (select *, row_number() over
  (partition by job_id order by ts desc, event_id desc) as rn from fx_job_events) where rn <= 50""")
def log_tail(t):
    return pub.log_tail(t.job_events.withColumn("message", F.col("status")), 50).select("job_id", "event_id", "line")


def api_videos(t):
    """Statistics payloads as the platform returns them: numbers are strings, some are absent."""
    payload = F.to_json(
        F.struct(
            F.col("o_orderkey").cast("string").alias("id"),
            F.struct(
                F.expr("case when o_orderkey % 3 <> 0 then concat('Video ', o_orderkey) end").alias("title"),
                F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
            ).alias("snippet"),
            F.struct(F.expr("case when o_orderstatus = 'F' then 'public' else 'private' end").alias("privacyStatus")).alias("status"),
            F.struct(
                F.floor("o_totalprice").cast("string").alias("viewCount"),
                F.expr("case when o_custkey % 2 = 0 then cast(o_custkey as string) end").alias("likeCount"),
                F.expr("case when o_custkey % 7 = 0 then 'n/a' else '4' end").alias("commentCount"),
            ).alias("statistics"),
        )
    )
    return t.orders.select(payload.alias("payload"), (F.col("o_custkey") % 10).alias("channel_id"), F.col("o_orderkey").alias("ord"))


@query(f"""select cast(o_orderkey as varchar) as video_id,
  coalesce(case when o_orderkey % 3 <> 0 then concat('Video ', o_orderkey) end, h.title) as title,
  {ts('o_orderdate')} as published_at, case when o_orderstatus = 'F' then 'public' else 'private' end as privacy,
  cast(floor(o_totalprice) as bigint) as views, case when o_custkey % 2 = 0 then o_custkey else 0 end as likes,
  case when o_custkey % 7 = 0 then 0 else 4 end as comments
  from orders left join (select l_orderkey as id, arg_max(concat('Line ', l_linenumber), l_linenumber) as title
    from lineitem group by l_orderkey) h on h.id = o_orderkey""")
def performance_rows(t):
    history = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("video_id"), F.expr("concat('Line ', l_linenumber)").alias("title"),
        F.col("l_linenumber").alias("ord"),
    )
    out = pub.performance_rows(api_videos(t), history, NOW)
    return out.select("video_id", "title", stamp("published_at"), "privacy", "views", "likes", "comments")


@query("""select channel_id, cast(o_orderkey as varchar) as video_id, cast(floor(o_totalprice) as bigint) as view_count,
  case when o_custkey % 2 = 0 then o_custkey end as like_count, case when o_custkey % 7 <> 0 then 4 end as comment_count
  from (select *, o_custkey % 10 as channel_id, row_number() over (partition by o_custkey % 10 order by o_orderkey) as rn
  from orders) where rn <= 25""")
def channel_video_listing(t):
    return pub.channel_video_listing(api_videos(t)).select("channel_id", "video_id", "view_count", "like_count", "comment_count")


@query("""select cast(s_suppkey as varchar) as channel_id, s_name as title, s_nationkey as subscriber_count,
  cast(floor(greatest(s_acctbal, 0)) as bigint) as view_count, 0 as video_count from supplier""")
def channel_totals(t):
    payload = F.to_json(
        F.struct(
            F.col("s_suppkey").cast("string").alias("id"), F.struct(F.col("s_name").alias("title")).alias("snippet"),
            F.struct(
                F.col("s_nationkey").cast("string").alias("subscriberCount"),
                F.floor(F.greatest("s_acctbal", F.lit(0.0))).cast("string").alias("viewCount"),
            ).alias("statistics"),
        )
    )
    return pub.channel_totals(t.supplier.select(payload.alias("payload")))


@query("""select count(*) as saved, count(*) filter (where privacy = 'public') as public,
  (select count(*) from fx_history where video_id not in (select video_id from fx_performance where privacy <> 'unlisted'))
  as missing from fx_performance where privacy <> 'unlisted'""")
def performance_summary(t):
    return pub.performance_summary(t.performance.filter("privacy <> 'unlisted'"), t.history)


@query("select video_id, views, title from fx_performance where privacy = 'public' order by views desc, video_id limit 3")
def top_public(t):
    return pub.top_public(t.performance).select("video_id", "views", "title")


@query("""with scored as (select *, views / greatest(1.0, least(h / 24.0, 7.0)) as score from (select *,
    date_diff('hour', published_at, fetched_at) as h from fx_performance where privacy = 'public') where h >= 48),
  r as (select *, count(*) over (partition by channel_id) as n,
    row_number() over (partition by channel_id order by score desc, video_id) as a,
    row_number() over (partition by channel_id order by score, video_id desc) as b from scored)
  select channel_id, video_id, round(score, 3) as score, 'best' as side from r where n >= 6 and a <= least(4, n // 2)
  union all select channel_id, video_id, round(score, 3), 'worst' from r where n >= 6 and b <= least(4, n // 2)""")
def best_and_worst(t):
    return pub.best_and_worst(t.performance, NOW).select("channel_id", "video_id", F.round("score", 3).alias("score"), "side")


WS = r"[\p{Z}\t\r\f\x0b\x85]+"


@query(rf"""with d as (select doc_id, text, lang, source, case when doc_id % 3 = 0 then text || chr(10) || chr(10) || 'Source: https://x' else text end
     as body, list_filter(['#' || lang, '#' || source, '#the', '#'], lambda x: length(x) > 1) as tags from documents),
  m as (select *, array_to_string(list_filter(tags, lambda x: instr(lower(body), lower(x)) = 0), ' ') as line,
     instr(body, chr(10) || chr(10) || 'Source:') as cut from d),
  f as (select *, case when line = '' then body when cut > 0 then rtrim(left(body, cut - 1), chr(10) || ' ' || chr(9) || chr(13) || chr(12)) || chr(10) || chr(10)
     || line || substr(body, cut) else rtrim(body, chr(10) || ' ' || chr(9) || chr(13) || chr(12)) || chr(10) || chr(10) || line end as full_text from m),
  g as (select *, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(full_text, chr(13) || chr(10), chr(10)),
     '[<>]', '', 'g'), '{WS}', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)), 5000) as description,
     case when doc_id % 4 = 0 then left(trim(regexp_replace(text, '[\s\p{{Z}}\x0b\x85]+', ' ', 'g')), 100) else concat('Clip Rank ', doc_id) end
     as publish_title from f)
  select doc_id, publish_title, description, left(trim(publish_title || chr(10) || chr(10) || description, ' ' || chr(10)), 2200) as caption,
    concat('https://cdn.example/', doc_id, '.mp4') as public_url from g""")
def publish_text(t):
    rows = t.documents.select(
        "doc_id", F.col("doc_id").alias("rank"),
        F.expr("case when doc_id % 4 = 0 then text end").alias("title"),
        F.lit(None).cast("string").alias("youtube_title_final"),
        F.expr("case when doc_id % 3 = 0 then concat(text, '\n\nSource: https://x') else text end").alias("youtube_description_final"),
        F.expr("concat('#', lang, ' #', source, ' #the #')").alias("hashtags"),
        F.expr("concat('/out/', doc_id, '.mp4')").alias("video_path"),
    )
    return pub.publish_text(rows, "https://cdn.example").select("doc_id", "publish_title", "description", "caption", "public_url")


@query(r"""with recursive items as materialized (select doc_id, list_transform(list_concat(string_split(text, '.'), [lang, source, 'The', 'the']),
     lambda x: regexp_replace(trim(regexp_replace(x, '[\s\p{Z}\x0b\x85]+', ' ', 'g')), '[<>]', '', 'g')) as tags from documents),
  walk as (select doc_id, 0 as i, [] :: varchar[] as tags, [] :: varchar[] as seen, 0 as used from documents
    union all select w.doc_id, w.i + 1,
      case when ok then list_append(w.tags, tag) else w.tags end, case when ok then list_append(w.seen, key) else w.seen end,
      case when ok then w.used + cost else w.used end
    from (select *, tag <> '' and not list_contains(seen, key) and used + cost <= 500 as ok from (
      select w.*, x.tags[w.i + 1] as tag, replace(lower(x.tags[w.i + 1]), ' ', '') as key, length(x.tags[w.i + 1])
        + case when instr(x.tags[w.i + 1], ' ') > 0 then 2 else 0 end + case when len(w.tags) > 0 then 1 else 0 end as cost
      from walk w join items x on x.doc_id = w.doc_id where w.i < len(x.tags))) w)
  select doc_id, array_to_string(arg_max(tags, i), '|') as tags, max(used) as used from walk group by doc_id""")
def budgeted_tags(t):
    rows = t.documents.select(
        "doc_id", F.split("text", "[.]").alias("youtube_tags_final"),
        F.expr("concat('#', lang, ' #', source, ' #The #the # x')").alias("hashtags"),
    )
    return pub.budgeted_tags(rows).select(
        "doc_id", F.array_join("upload_tags", "|").alias("tags"), F.col("upload_tag_chars").alias("used")
    )


@query(f"""with {MATCHES.replace('from fx_manifest)', "from fx_manifest where status = 'failed')", 1)}, merged as (select m.*, coalesce(m.youtube_upload_status, a.s, b.s) as st,
    coalesce(m.youtube_video_id, a.v, b.v) as vid from {matches('arg_min')}),
  pending as (select job_id, rank from merged where status = 'success' and (viral_score * 7919 + rank) % 23 > 0
    and not (coalesce(vid, '') <> '' and coalesce(st, '') = 'uploaded') order by job_id, rank limit 5),
  gate as (select (select count(*) from fx_history where cast(uploaded_at + interval '330' minute as date) =
      cast(timestamp '{NOW}' + interval '330' minute as date)) < 6 and (select count(*) from {FUTURE}) < 100000 as open),
  first as (select coalesce((select max(publish_ts) + interval '2' hour from {FUTURE}), timestamp '1999-06-01 11:00:00') as t)
  select job_id, rank, {ts("(select t from first) + (row_number() over (order by job_id, rank) - 1) * interval '2' hour")} as slot
  from pending where (select open from gate)""")
def publish_plan(t):
    # The earlier run covered failed renders only, so clips stay pending.
    earlier = previous(t).join(t.manifest.filter("status = 'failed'").select("job_id", "rank"), ["job_id", "rank"], "left_semi")
    limits = PublishLimits(now=NOW, max_queue=100000)
    out = plan_publishing(t.manifest, earlier, t.files, t.history, t.scheduled, limits)
    return out.select("job_id", "rank", stamp("slot"))
