"""Streaming jobs run over the whole event tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmart.sources.files import scratch_path
from clipmart.streaming import jobs
from clipmart.workload.registry import query
from clipmart.workload.tables import Tables


class Streams(Tables):
    """The same tables, with the named ones read as streams.

    A table is one Parquet file or a folder of them. Its files are in no order of time, so one trigger takes them all: with several, rows
    of a later one would be behind the watermark.
    """

    def __init__(self, t: Tables, *streamed: str):
        super().__init__(t.spark, t.folder)
        self._streamed = streamed

    def raw(self, name):
        if name in self._streamed:
            # A pattern with one match: the file source takes a plain path for a folder.
            return jobs.read_stream(self.spark, f"{self.folder}/{name}.parque[t]", "*", None)
        return super().raw(name)


@query("""select job_id, arg_max(status, (ts, event_id)) as status, arg_max(percent, (ts, event_id)) as percent
  from fx_job_events group by job_id""")
def job_status_stream(t):
    events = Streams(t, "events").job_events
    return jobs.job_status(jobs.run_latest(events, scratch_path(t.spark, "job-status"), ["job_id"])).select("job_id", "status", "percent")


CHANGES = """select job_id, event_id, status, percent from (select *, lag(state) over w as prev, max(case when status in
  ('completed', 'failed', 'cancelled') then 1 end) over (partition by job_id order by ts, event_id
  rows between unbounded preceding and 1 preceding) as over_ from (select *, concat_ws('|', status, percent) as state
  from fx_job_events) window w as (partition by job_id order by ts, event_id))
  where over_ is null and (prev is null or prev <> state)"""


@query(CHANGES)
def job_changes(t):
    return jobs.job_changes(t.job_events)


@query(CHANGES)
def job_changes_stream(t):
    events = Streams(t, "events").job_events
    return jobs.run_changes(jobs.job_changes_stream(events), scratch_path(t.spark, "job-changes")).drop("sealed")


@query("""select user_id as run_id, arg_max(cast(floor(value) as bigint), (ts, event_id)) as current, 400 as total,
  cast(floor(100 * arg_max(floor(value), (ts, event_id)) / 400) as bigint) as percent from events group by user_id""")
def pull_progress_stream(t):
    events = Streams(t, "events").events.select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.floor("value").alias("current"), F.lit(400).alias("total")
    )
    return jobs.pull_progress(jobs.run_latest(events, scratch_path(t.spark, "pull-progress"), ["run_id"]))


@query("""select strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n, greatest(50 - count(*), 0) as remaining from (
  select date_trunc('hour', ts) - unnest(range(24)) * interval '1' hour as start from events where event_type = 'purchase')
  group by 1""")
def publish_rate_stream(t):
    events = Streams(t, "events").events.filter("event_type = 'purchase'").select(F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.run_windows(jobs.publish_rate(events), scratch_path(t.spark, "publish-rate"), ["start"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "remaining")


@query("""select strftime(ts + interval '330' minute, '%Y-%m-%d') as day, count(*) as uploads from events group by 1""")
def daily_upload_stream(t):
    events = Streams(t, "events").events.select(F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.run_windows(jobs.daily_uploads(events, "Asia/Kolkata"), scratch_path(t.spark, "daily-uploads"), ["day"])
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "uploads")


@query("""select video_id, min(start_s) as start_s, max(end_s) as end_s, count(*) as n_words from (
  select *, sum(opens) over (partition by video_id order by ord) as b from (select *, case when start_s -
   lag(end_s) over (partition by video_id order by ord) <= 0.6 then 0 else 1 end as opens from fx_words))
  group by video_id, b""")
def speech_sessions_stream(t):
    words = Streams(t, "documents").words
    return jobs.run_sessions(jobs.speech_sessions(words), scratch_path(t.spark, "speech-sessions")).select("video_id", "start_s", "end_s", "n_words")


@query("""select h.video_id, h.title, p.views, p.channel_id from fx_history h left join fx_performance p on p.video_id = h.video_id""")
def performance_refresh_stream(t):
    history = Streams(t, "orders").history
    clips = t.performance.select("video_id", "views", "channel_id")
    out = jobs.run_once(jobs.performance_refresh(history, clips), scratch_path(t.spark, "performance-refresh"))
    return out.select("video_id", "title", "views", "channel_id")
