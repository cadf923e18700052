"""Catalogue reads over the whole catalogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmart.operators import catalogue as cat
from clipmart.workload.registry import query


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def source_list(extra=()):
    """The nested sources as one string, so both engines hash the same value."""
    parts = ["source_type", "title", "source_id", *extra]
    return F.concat_ws(
        "|", F.transform("sources", lambda s: F.concat_ws(":", *[s[p].cast("string") for p in parts]))
    ).alias("sources")


NESTED = """(select video_id, string_agg(concat_ws(':', s.source_type, s.title, s.source_id), '|'
             order by s.source_type, s.title, s.source_id) as sources
             from fx_source_videos l join fx_sources s using (source_id) group by video_id)"""
COUNTS = """sum(case when coalesce(st.status, 'unused') = 'used' then 1 else 0 end) as used_count,
  sum(case when coalesce(st.status, 'unused') = 'unused' then 1 else 0 end) as unused_count,
  sum(case when coalesce(st.status, 'unused') = 'candidate' then 1 else 0 end) as candidate_count,
  sum(case when coalesce(st.status, 'unused') = 'skipped' then 1 else 0 end) as skipped_count"""
SOURCE_STATS = f"""select s.source_id, s.source_type, s.title, count(distinct l.video_id) as total_videos, {COUNTS}
  from fx_sources s left join fx_source_videos l on l.source_id = s.source_id
  left join fx_video_status st on st.video_id = l.video_id group by s.source_id, s.source_type, s.title"""


def _source_stats(t):
    return cat.source_stats(t.sources, t.source_videos, t.video_status)


@query(SOURCE_STATS)
def source_stats(t):
    return _source_stats(t).drop("url")


@query(f"""select a.*, p.run_id as latest_run_id, p.status as latest_run_status, p.videos_found as latest_videos_found
  from ({SOURCE_STATS}) a left join (select source_id, max(run_id) as run_id from fx_pull_runs group by source_id) m
  on m.source_id = a.source_id left join fx_pull_runs p on p.run_id = m.run_id""")
def source_detail(t):
    return cat.source_detail(t.sources, t.source_videos, t.video_status, t.pull_runs).drop("url")


CHANNEL_STATS = f"""select c.channel_id, c.name, c.handle, count(distinct v.video_id) as total_videos, {COUNTS}
  from fx_channels c left join fx_videos v on v.channel_id = c.channel_id
  left join fx_video_status st on st.video_id = v.video_id group by c.channel_id, c.name, c.handle"""


@query(CHANNEL_STATS + " having count(distinct v.video_id) > 0")
def channel_stats(t):
    return cat.channel_stats(t.channels, t.videos, t.video_status).drop("url")


@query(f"select *, unused_count + candidate_count + skipped_count as not_used_yet from ({CHANNEL_STATS})")
def channel_detail(t):
    return cat.channel_detail(t.channels, t.videos, t.video_status).drop("url")


@query("""select (select count(*) from fx_sources) as total_sources, count(*) as total_videos,
  (select count(*) from fx_channels) as total_channels,
  sum(case when coalesce(st.status, 'unused') = 'used' then 1 else 0 end) as total_used,
  sum(case when coalesce(st.status, 'unused') = 'unused' then 1 else 0 end) as total_unused,
  sum(case when coalesce(st.status, 'unused') = 'candidate' then 1 else 0 end) as total_candidate,
  sum(case when coalesce(st.status, 'unused') = 'skipped' then 1 else 0 end) as total_skipped
  from fx_videos v left join fx_video_status st using (video_id)""")
def global_stats(t):
    return cat.global_stats(t.sources, t.videos, t.channels, t.video_status)


DUPLICATES = f"""select v.video_id, v.title, coalesce(st.status, 'unused') as status, d.source_count, n.sources
  from (select video_id, count(*) as source_count from fx_source_videos group by video_id having count(*) > 1) d
  join fx_videos v using (video_id) left join fx_video_status st using (video_id) join {NESTED} n using (video_id)"""


def _duplicates(t, wanted=None):
    return cat.duplicate_videos(t.videos, t.source_videos, t.video_status, t.sources, wanted)


@query(DUPLICATES)
def duplicate_videos(t):
    return _duplicates(t).select("video_id", "title", "status", "source_count", source_list())


@query(f"""select count(*) as duplicate_videos, coalesce(sum(source_count), 0) as total_duplicate_source_links
  from ({DUPLICATES}) where status <> 'used'""")
def duplicate_totals(t):
    return cat.duplicate_totals(_duplicates(t, "not_used_yet"))


@query(f"""select source_id, round(100.0 * used_count / total_videos, 1) as used_pct,
  round(100.0 * unused_count / total_videos, 1) as unused_pct,
  round(100.0 * candidate_count / total_videos, 1) as candidate_pct,
  round(100.0 * skipped_count / total_videos, 1) as skipped_pct from ({SOURCE_STATS}) where total_videos > 0""")
def status_shares(t):
    return cat.status_shares(_source_stats(t)).select(
        "source_id", "used_pct", "unused_pct", "candidate_pct", "skipped_pct"
    )


@query("""select i.source_id, count(*) as videos_found, count(*) - coalesce(any_value(a.added), 0) as videos_already_exists,
  coalesce(any_value(a.added), 0) as videos_added, coalesce(any_value(m.missing), 0) as videos_missing
  from fx_incoming i
  left join (select source_id, count(*) as added from (
      select source_id, row_number() over (partition by video_id order by source_id, position) as rn
      from fx_incoming where video_id not in (select video_id from fx_videos)) where rn = 1 group by source_id) a
    on a.source_id = i.source_id
  left join (select source_id, count(*) as missing from fx_source_videos l where is_present
      and source_id in (select source_id from fx_incoming)
      and not exists (select 1 from fx_incoming x where x.source_id = l.source_id and x.video_id = l.video_id)
      group by source_id) m on m.source_id = i.source_id
  group by i.source_id""")
def pull_run_stats(t):
    return cat.pull_run_stats(t.incoming, t.videos, t.source_videos)


@query("""select v.video_id, v.title, coalesce(st.status, 'unused') as status, st.clip_title
  from fx_videos v left join fx_video_status st using (video_id)""")
def videos_with_status(t):
    return cat.videos_with_status(t.videos, t.video_status).select("video_id", "title", "status", "clip_title")


@query("""select v.video_id, coalesce(st.status, 'unused') as status from fx_videos v
  left join fx_video_status st using (video_id) where coalesce(st.status, 'unused') in ('unused', 'candidate', 'skipped')""")
def filter_status(t):
    rows = cat.filter_status(cat.videos_with_status(t.videos, t.video_status), "not_used_yet")
    return rows.select("video_id", "status")


@query("select source_id, video_id from fx_source_videos where not is_present")
def filter_presence(t):
    return cat.filter_presence(t.source_videos, "missing").select("source_id", "video_id")


@query(f"""select v.video_id, v.title, v.status, n.sources from (
  select v.video_id, v.title, coalesce(st.status, 'unused') as status from fx_videos v
  left join fx_video_status st using (video_id)
  where v.title ilike '%ring%' or v.channel_name ilike '%ring%' or st.clip_title ilike '%ring%' or st.notes ilike '%ring%'
  order by v.title, v.video_id limit 200) v left join {NESTED} n using (video_id)""")
def search_videos(t):
    rows = cat.search_videos(t.videos, t.video_status, t.source_videos, t.sources, "ring")
    return rows.select("video_id", "title", "status", source_list())


@query("""select l.source_id, v.video_id, v.title, coalesce(st.status, 'unused') as status, l.position,
  c.source_count from fx_source_videos l join fx_videos v using (video_id) left join fx_video_status st using (video_id)
  join (select video_id, count(*) as source_count from fx_source_videos group by video_id) c using (video_id)
  where not l.is_present and coalesce(st.status, 'unused') <> 'used'
  and (v.title ilike '%red%' or v.channel_name ilike '%red%')""")
def source_videos_view(t):
    rows = cat.source_videos_view(
        t.source_videos, t.videos, t.video_status, wanted="not_used_yet", present="missing", text="RED", sort="channel"
    )
    return rows.select("source_id", "video_id", "title", "status", "position", "source_count")


@query(f"""select v.channel_id, v.video_id, v.title, coalesce(st.status, 'unused') as status, n.sources
  from fx_videos v left join fx_video_status st using (video_id) left join {NESTED} n using (video_id)""")
def channel_videos_view(t):
    rows = cat.channel_videos_view(t.videos, t.video_status, t.source_videos, t.sources)
    return rows.select("channel_id", "video_id", "title", "status", source_list())


@query("""select v.video_id, v.title, coalesce(st.status, 'unused') as status, c.name as ch_name, c.handle as ch_handle,
  n.sources from fx_videos v left join fx_video_status st using (video_id) left join fx_channels c using (channel_id)
  left join (select video_id, string_agg(concat_ws(':', s.source_type, s.title, s.source_id, l.position,
     case when l.is_present then 'true' else 'false' end), '|' order by s.source_type, s.title, s.source_id) as sources
     from fx_source_videos l join fx_sources s using (source_id) group by video_id) n using (video_id)""")
def video_detail(t):
    rows = cat.video_detail(t.videos, t.video_status, t.channels, t.source_videos, t.sources)
    return rows.select(
        "video_id", "title", "status", "ch_name", "ch_handle", source_list(("position", "is_present"))
    )


@query("select source_id, title, url from fx_sources where source_type = 'playlist' and coalesce(url, '') <> ''")
def refreshable_sources(t):
    return cat.refreshable_sources(t.sources).select("source_id", "title", "url")


@query("""select l.source_id, l.video_id, v.title, st.status from fx_source_videos l join fx_videos v using (video_id)
  left join fx_video_status st using (video_id)""")
def source_video_join(t):
    return cat.source_video_join(t.source_videos, t.videos, t.video_status).select(
        "source_id", "video_id", "title", "status"
    )


@query("""select s.source_id, l.video_id, st.status from fx_sources s left join fx_source_videos l using (source_id)
  left join fx_video_status st using (video_id)""")
def stats_join(t):
    return cat.stats_join(t.sources, t.source_videos, t.video_status).select("source_id", "video_id", "status")


@query(f"select video_id, sources from {NESTED}")
def nested_sources(t):
    return cat.nested_sources(t.source_videos, t.sources).select("video_id", source_list())


@query("""select source_id, video_id from fx_source_videos l where is_present
  and source_id in (select source_id from fx_incoming)
  and not exists (select 1 from fx_incoming x where x.source_id = l.source_id and x.video_id = l.video_id)""")
def missing_from_pull(t):
    return cat.missing_from_pull(t.source_videos, t.incoming).select("source_id", "video_id")


@query("select source_id, position, video_id from fx_incoming where video_id not in (select video_id from fx_videos)")
def entries_to_fetch(t):
    return cat.entries_to_fetch(t.incoming, t.videos).select("source_id", "position", "video_id")


@query("select source_id, position, video_id from fx_incoming where video_id in (select video_id from fx_videos)")
def entries_known(t):
    return cat.entries_known(t.incoming, t.videos).select("source_id", "position", "video_id")


@query("""select run_id, source_id, status, videos_found from fx_pull_runs
  where run_id in (select max(run_id) from fx_pull_runs group by source_id)""")
def latest_pull_run(t):
    return cat.latest_pull_run(t.pull_runs).select("run_id", "source_id", "status", "videos_found")


@query("""select v.video_id, v.title, strftime(st.used_at, '%Y-%m-%d %H:%M:%S') as used_at from fx_videos v
  join fx_video_status st using (video_id) where st.status = 'used'
  order by coalesce(st.used_at, st.updated_at) desc, st.updated_at desc, v.video_id limit 100""")
def recently_used(t):
    return cat.recently_used(t.videos, t.video_status).select("video_id", "title", stamp("used_at"))


@query("""with pick as (select video_id, title from (select v.video_id, v.title from fx_videos v join fx_video_status st using (video_id)
   where st.status = 'unused' order by case when v.video_id % 3 = 0 then timestamp '2020-06-01' + v.video_id * interval '7' hour
     else v.upload_date end desc, v.video_id limit 50)
  order by md5(concat('7-', video_id)) limit 1)
  select video_id, title, (select string_agg(concat(s.source_type, ':', s.source_id), ',' order by s.source_type, s.title, s.source_id)
    from fx_source_videos l join fx_sources s using (source_id) where l.video_id = pick.video_id) as sources from pick""")
def random_unused(t):
    published = F.when(F.col("video_id") % 3 == 0, F.expr("timestamp '2020-06-01' + make_dt_interval(0, cast(video_id * 7 as int))"))
    out = cat.random_unused(t.videos.withColumn("published_at", published), t.video_status, t.source_videos, t.sources, seed="7")
    shown = F.transform("sources", lambda s: F.concat_ws(":", s["source_type"], s["source_id"].cast("string")))
    return out.select("video_id", "title", F.when(F.col("sources").isNotNull(), F.array_join(shown, ",")).alias("sources"))


@query("select run_id, source_id, status from fx_pull_runs order by run_id desc limit 50")
def recent_pull_runs(t):
    return cat.recent_pull_runs(t.pull_runs).select("run_id", "source_id", "status")
