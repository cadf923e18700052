"""Speaker and face operators over every turn, sample and frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmart.operators import speakers as sp
from clipmart.workload.registry import query

WIDTH = 1920


def r(name, digits=3):
    return F.round(name, digits).alias(name)


@query("""select video_id, min(ord) as turn, any_value(speaker) as speaker, arg_min(start_s, ord) as start_s,
  arg_max(end_s, ord) as end_s from (select *, sum(opens) over (partition by video_id order by ord) as g from (
   select *, case when lag(speaker) over w = speaker and start_s - lag(end_s) over w < 0.5 then 0 else 1 end as opens
   from fx_turns window w as (partition by video_id order by ord))) group by video_id, g""")
def merge_turns(t):
    return sp.merge_turns(t.turns)


ACTIVE = """(select g.video_id, g.ord, g.idx, g.rel_t, coalesce(a.speakers, [] :: varchar[]) as speakers from fx_grid g left join (
  select video_id, ord, idx, list(speaker order by first_turn) as speakers from (
   select g.video_id, g.ord, g.idx, t.speaker, min(t.ord) as first_turn from fx_grid g join fx_turns t
   on t.video_id = g.video_id and t.start_s <= g.t and t.end_s >= g.t group by 1, 2, 3, 4) group by 1, 2, 3) a
  using (video_id, ord, idx))"""


@query(f"select video_id, ord, idx, array_to_string(speakers, ',') as speakers, speakers[1] as first_speaker from {ACTIVE}")
def active_speakers_at(t):
    out = sp.active_speakers_at(t.grid, t.turns)
    return out.select("video_id", "ord", "idx", F.array_join("speakers", ",").alias("speakers"), "first_speaker")


@query("""select video_id, ord, speaker, round(seconds, 3) as seconds, row_number() over (partition by video_id, ord
  order by seconds desc, speaker) as place from (select c.video_id, c.ord, s.speaker, coalesce(sum(greatest(
   least(t.end_s, c.end_time) - greatest(t.start_s, c.start_time), 0)), 0) as seconds from fx_conv_clips c
   join (select distinct video_id, speaker from fx_turns) s using (video_id)
   left join fx_turns t on t.video_id = c.video_id and t.speaker = s.speaker group by 1, 2, 3)""")
def speaking_time(t):
    return sp.speaking_time(t.conv_clips, t.turns).select("video_id", "ord", "speaker", r("seconds"), "place")


@query("""select clip_id, round(avg(case when faces > 0 then 1.0 else 0.0 end), 4) as face_share,
  case when avg(case when faces > 0 then 1.0 else 0.0 end) < 0.3 then 'fill' else 'crop' end as layout
  from fx_samples group by clip_id""")
def face_share(t):
    return sp.face_share(t.samples).select("clip_id", r("face_share", 4), "layout")


@query("""select clip_id, greatest(max(faces), 1) as min_speakers, greatest(max(faces), 1) + 2 as max_speakers
  from fx_samples group by clip_id""")
def max_faces(t):
    return sp.max_faces(t.samples)


SUMMARY = """(select clip_id, idx, count(*) as n_faces, min(cx) as left_x, max(cx) as right_x,
  count(distinct speaker) as n_speakers, min(speaker) as one from fx_frame_faces group by clip_id, idx)"""


@query(f"select clip_id, one as speaker, median(left_x) as cx from {SUMMARY} where n_faces = 1 and n_speakers = 1 group by 1, 2")
def canonical_positions(t):
    return sp.canonical_positions(t.frame_faces)


@query(f"""select clip_id, speaker, sum(case when n_faces = 1 then 1 else 0 end) as solo_frames,
  sum(case when n_faces >= 2 then 1 else 0 end) as shared_frames,
  sum(case when n_faces = 1 then 1 else 0 end) > sum(case when n_faces >= 2 then 1 else 0 end) as is_solo
  from (select distinct clip_id, idx, speaker from fx_frame_faces) join {SUMMARY} using (clip_id, idx) group by 1, 2""")
def solo_speakers(t):
    return sp.solo_speakers(t.frame_faces)


@query(f"""select clip_id, coalesce(median(left_x) filter (where n_faces >= 2), {WIDTH} * 0.25) as left_x,
  coalesce(median(right_x) filter (where n_faces >= 2), {WIDTH} * 0.75) as right_x from {SUMMARY} group by clip_id""")
def left_right_positions(t):
    return sp.left_right_positions(t.frame_faces, WIDTH)


DIST = f"""(select clip_id, idx, face_no, cast(coalesce(least(cx - lag(cx) over w, lead(cx) over w - cx), {WIDTH}) as double) as distance
  from fx_frame_faces window w as (partition by clip_id, idx order by cx, face_no))"""


@query(f"select * from {DIST}")
def neighbour_distance(t):
    return sp.neighbour_distance(t.frame_faces, WIDTH).select("clip_id", "idx", "face_no", "distance")


@query(f"select clip_id, min(distance) as min_distance from {DIST} group by clip_id")
def min_face_distance(t):
    return sp.min_face_distance(t.frame_faces, WIDTH)


@query(f"""with canon as (select s.clip_id, s.speaker, coalesce(c.cx, {WIDTH / 2}) as home from
    (select distinct clip_id, speaker from fx_frame_faces) s left join (select clip_id, one as speaker, median(left_x) as cx
     from {SUMMARY} where n_faces = 1 and n_speakers = 1 group by 1, 2) c using (clip_id, speaker))
  select clip_id, idx, x, speaker from (select f.clip_id, f.idx, f.left_x as x, c.speaker, row_number() over
    (partition by f.clip_id, f.idx order by abs(f.left_x - c.home), c.speaker) as rn
    from {SUMMARY} f join canon c using (clip_id) where f.n_faces = 1) where rn = 1""")
def nearest_speaker(t):
    everyone = t.frame_faces.select("clip_id", "speaker").distinct()
    canonical = everyone.join(sp.canonical_positions(t.frame_faces), ["clip_id", "speaker"], "left")
    return sp.nearest_speaker(t.frame_faces, canonical, WIDTH)


@query("""select clip_id, track, idx, round(case when count(mouth) over w >= 3 then stddev_pop(mouth) over w else 0 end, 6) as activity
  from fx_faces window w as (partition by clip_id, track order by idx range between 3 preceding and 3 following)""")
def mouth_activity(t):
    return sp.mouth_activity(t.faces).select("clip_id", "track", "idx", r("activity", 6))


@query("""select clip_id, idx, case when a >= 0.012 and a >= b * 1.3 then face_no end as talker from (
  select clip_id, idx, face_no, mouth as a, lead(mouth) over w as b, row_number() over w as rn, count(*) over
   (partition by clip_id, idx) as n from fx_frame_faces window w as (partition by clip_id, idx order by mouth desc, face_no))
  where rn = 1 and n >= 2""")
def clear_talker(t):
    faces = t.frame_faces.select("clip_id", "idx", F.col("face_no").alias("track"), F.col("mouth").alias("activity"))
    return sp.clear_talker(faces)


@query("""select clip_id, idx, coalesce(last_value(cx ignore nulls) over (partition by clip_id order by idx rows unbounded preceding),
  first_value(cx ignore nulls) over (partition by clip_id order by idx rows between current row and unbounded following)) as filled_x
  from fx_samples where clip_id in (select clip_id from fx_samples where cx is not null)""")
def forward_fill_positions(t):
    return sp.forward_fill_positions(t.samples).select("clip_id", "idx", "filled_x")


@query("""with s as (select a.clip_id, a.idx, b.faces, count(*) as n from fx_samples a join fx_samples b
   on b.clip_id = a.clip_id and b.scene = a.scene and b.idx between a.idx - 11 and a.idx group by 1, 2, 3)
  select clip_id, idx, faces as stable_count from (select *, row_number() over (partition by clip_id, idx
   order by n desc, faces) as rn from s) where rn = 1""")
def stable_face_count(t):
    return sp.stable_face_count(t.samples).select("clip_id", "idx", "stable_count")


@query("""with o as (select clip_id, idx, nullif(faces, 0) as v, case when row_number() over w > 1 and lag(nullif(faces, 0)) over w
    is not distinct from nullif(faces, 0) then 0 else 1 end as opens from fx_samples window w as (partition by clip_id order by idx)),
  g as (select *, sum(opens) over (partition by clip_id order by idx) as run from o),
  k as (select clip_id, run, count(*) as len, {'v': any_value(v)} as v from g group by 1, 2)
  select g.clip_id, g.idx, (select arg_max(v, run) from k where k.clip_id = g.clip_id and k.run <= g.run
    and (k.len >= case when k.v.v is null then 2 else 3 end or k.run = 1)).v as confirmed from g""")
def confirmed_runs(t):
    series = t.samples.select("clip_id", "idx", F.nullif("faces", F.lit(0)).alias("value"))
    return sp.confirmed_runs(series, 3, absent_hold=2).select("clip_id", "idx", "confirmed")


def timeline_samples(t):
    return sp.active_speakers_at(t.grid, t.turns).select("video_id", "ord", "idx", F.col("rel_t").alias("t"), "speakers")


@query(f"""with recursive act as (select * from {ACTIVE}),
  solo as (select video_id, list(speaker) as solo from (select video_id, speaker from fx_turns group by 1, 2 having count(*) >= 3) group by 1),
  a as (select act.*, coalesce(solo, [] :: varchar[]) as solo from act left join solo using (video_id)),
  f as (select video_id, ord, -1 :: bigint as idx, 'blur' as layout, null :: varchar as speaker, 0 :: double as last from fx_conv_clips
    union all select video_id, ord, idx, case when shared or (n = 0 and now is null) then 'blur' else 'crop' end,
      case when take then first else now end, case when take then rel_t else last end
    from (select *, coalesce((n >= 2 and not shared and (now is null or not list_contains(speakers, now)))
        or (n = 1 and (now is null or (first <> now and rel_t - last >= 2))), false) as take from (
      select a.video_id, a.ord, a.idx, a.rel_t, a.speakers, len(a.speakers) as n, a.speakers[1] as first, f.speaker as now, f.last,
        len(a.speakers) >= 2 and not list_has_any(a.speakers, a.solo) as shared
      from f join a on a.video_id = f.video_id and a.ord = f.ord and a.idx = f.idx + 1)))
  select video_id, ord, idx, layout, speaker from f where idx >= 0""")
def speaker_switch_timeline(t):
    solo = t.turns.groupBy("video_id", "speaker").count().filter("count >= 3").select("video_id", "speaker")
    return sp.speaker_switch_timeline(timeline_samples(t), solo)


@query(f"""with recursive a as (select * from {ACTIVE}),
  f as (select video_id, ord, -1 :: bigint as idx, 'split' as layout, null :: varchar as speaker, -2 :: double as last from fx_conv_clips
    union all select video_id, ord, idx, case when change then wanted else layout end,
      case when change or follow then first else now end, case when change or follow then rel_t else last end
    from (select *, not change and rel_t - last >= 2 and layout = 'full' and n = 1 and first is distinct from now as follow from (
     select *, wanted <> layout and rel_t - last >= 2 as change from (
      select a.video_id, a.ord, a.idx, a.rel_t, len(a.speakers) as n, a.speakers[1] as first, f.speaker as now, f.last, f.layout,
        case when len(a.speakers) = 1 then 'full' when len(a.speakers) >= 2 then 'split' else f.layout end as wanted
      from f join a on a.video_id = f.video_id and a.ord = f.ord and a.idx = f.idx + 1))))
  select video_id, ord, idx, layout, speaker from f where idx >= 0""")
def layout_timeline(t):
    return sp.layout_timeline(timeline_samples(t))
