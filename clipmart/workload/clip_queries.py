"""Clip operators over every candidate."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmart.operators import clips as cl
from clipmart.workload.registry import query
from clipmart.workload.transcript_queries import r3

RANKED = """(select *, row_number() over (partition by video_id order by viral_score desc, ord, start_time, end_time) as rn
  from fx_clips)"""


@query("""select video_id, ord, start_time, end_time, viral_score,
  row_number() over (partition by video_id order by viral_score desc, ord, start_time, end_time) as rank from fx_clips""")
def rank_clips(t):
    return cl.rank_clips(t.clips)


def greedy_sql(ranked, ratio=0.25):
    """Greedy selection as a recursion over the rank of each video."""
    return f"""with recursive ranked as (select * from {ranked}),
  g as (select video_id, rn, [{{'rn': rn, 's': start_time, 'e': end_time}}] as kept from ranked where rn = 1
    union all select r.video_id, r.rn, case when len(list_filter(g.kept, lambda k:
        least(k.e, r.end_time) - greatest(k.s, r.start_time) > 0 and least(k.e - k.s, r.end_time - r.start_time) > 0
        and (least(k.e, r.end_time) - greatest(k.s, r.start_time)) / least(k.e - k.s, r.end_time - r.start_time) > {ratio})) > 0
      then g.kept else list_append(g.kept, {{'rn': r.rn, 's': r.start_time, 'e': r.end_time}}) end
    from g join ranked r on r.video_id = g.video_id and r.rn = g.rn + 1),
  picked as (select video_id, unnest(kept).rn as rn from (select video_id, arg_max(kept, rn) as kept from g group by video_id))"""


@query(greedy_sql(RANKED) + """ select video_id, ord, start_time, end_time, viral_score from ranked join picked using (video_id, rn)""")
def drop_overlapping_clips(t):
    return cl.drop_overlapping_clips(t.clips)


@query("""select c.* from fx_clips c join (select video_id, max(viral_score) as best from fx_clips group by video_id)
  using (video_id) where best < 98 or viral_score >= 98""")
def drop_weak_clips(t):
    return cl.drop_weak_clips(t.clips, 98)


MERGED = """(select video_id, min(start_time) as start_time, max(end_time) as end_time from (
  select *, sum(fresh) over (partition by video_id order by start_time, end_time, ord rows unbounded preceding) as island from (
   select *, case when start_time <= max(end_time) over (partition by video_id order by start_time, end_time, ord
     rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from fx_clips)) group by video_id, island)"""


@query(f"select * from {MERGED}")
def merge_segments(t):
    return cl.merge_segments(t.clips)


SQUASH = r"trim(regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}\x0b\x85]+', ' ', 'g'))"


def squash(c):
    return SQUASH.format(c=c)


META = rf"""meta as (select c.video_id, c.ord, case when length(tt) <= 100 then tt when instr(left(tt, 100), ' ') > 0
      then rtrim(regexp_extract(left(tt, 100), '(?s)^(.*) ', 1)) else left(tt, 100) end as title,
    case when length(hook) <= 42 then hook else rtrim(case when instr(left(hook, 42), ' ') > 0 then
      regexp_extract(left(hook, 42), '(?s)^(.*) ', 1) else left(hook, 42) end, ',;:-–— ') end as on_screen_hook,
    coalesce(h.hashtags, '') as hashtags, coalesce(n_hashtags, 0) as n_hashtags, coalesce(keywords, '') as keywords,
    coalesce(n_keywords, 0) as n_keywords, description_hook, coalesce(description_context, '') as description_context,
    concat_ws(chr(10) || chr(10), nullif(description_hook, ''), nullif(coalesce(description_context, ''), ''),
      nullif(coalesce(h.hashtags, ''), '')) || coalesce(chr(10) || chr(10) || 'Source: ' || source_url, '') as description
  from (select *, {squash('title')} as tt,
      array_to_string(list_filter(string_split(trim({squash('on_screen_hook')}, '"''“”‘’ '), ' '), lambda w: w not like '#%'), ' ') as hook
    from fx_candidates) c
  left join (select video_id, ord, string_agg(tag, ' ' order by n) as hashtags, count(*) as n_hashtags from (
     select video_id, ord, arg_min(tag, pos) as tag, row_number() over (partition by video_id, ord order by min(pos)) as n from (
      select video_id, ord, pos, '#' || body as tag from (select video_id, ord, unnest(range(len(parts))) as pos,
        regexp_replace(ltrim(unnest(parts), '#'), '[^\p{{L}}\p{{N}}_]', '', 'g') as body from (
          select video_id, ord, string_split({squash("case when hashtags <> '' then hashtags else hashtag end")}, ' ') as parts
          from fx_candidates)) where body <> '' and not regexp_full_match(body, '\p{{Nd}}+'))
      group by video_id, ord, lower(tag)) where n <= 15 group by video_id, ord) h using (video_id, ord)
  left join (select video_id, ord, string_agg(tag, '|' order by n) as keywords, count(*) as n_keywords from (
     select video_id, ord, arg_min(tag, pos) as tag, row_number() over (partition by video_id, ord order by min(pos)) as n from (
      select video_id, ord, pos, tag from (select video_id, ord, unnest(range(len(keyword_tags))) as pos,
        {squash('unnest(keyword_tags)')} as tag from fx_candidates) where tag <> '')
      group by video_id, ord, lower(tag)) where n <= 8 group by video_id, ord) k using (video_id, ord))"""


@query(f"""with {META} select video_id, ord, title, on_screen_hook, hashtags, n_hashtags, keywords, description from meta""")
def clip_metadata_text(t):
    return cl.clip_metadata_text(t.candidates).select(
        "video_id", "ord", "title", "on_screen_hook", "hashtags", "n_hashtags",
        F.array_join("keyword_tags", "|").alias("keywords"), F.col("youtube_description").alias("description"),
    )


LOW, HIGH = 35.0, 50.0
TIMED = f"""timed as (select *, least(span, {HIGH}) as kept_span from (
    select video_id, ord, coalesce(nullif(start_time, 0), nullif(clip_start, 0), 0) as s,
      end_time as e, end_time - coalesce(nullif(start_time, 0), nullif(clip_start, 0), 0) as span,
      coalesce(cast(trunc(try_cast(viral_score as double)) as int), 0) as score, hook_start_time as hs, hook_end_time as he,
      coalesce(hook_text, '') as hook_text from fx_candidates) where least(span, {HIGH}) >= {LOW} * 0.9),
  cut as (select *, case when span > {HIGH} then s + {HIGH} else e end as e2 from timed),
  hooked as (select *, least(greatest(hs, s), e2) as h1, least(greatest(he, least(greatest(hs, s), e2)), e2) as h2 from cut),
  shaped as (select *, hs is not null and he is not null as has_hook, case when ord in (1, 3) then least(s + 20, e2) - s
      + greatest(e2 - (s + 22), 0) when ord = 4 then least(s + 6, e2) - s end as trimmed from hooked)"""
PICK = f"""(select *, row_number() over (partition by video_id order by viral_score desc, ord, start_time, end_time) as rn
  from (select video_id, ord, s as start_time, e2 as end_time, score as viral_score from shaped))"""


@query(
    greedy_sql(PICK).replace("with recursive ", f"with recursive {META}, {TIMED}, ")
    + f""", kept as (select r.* from ranked r join picked using (video_id, rn)),
  strong as (select k.* from kept k join (select video_id, max(viral_score) as best from kept group by video_id) using (video_id)
    where best < 60 or viral_score >= 60)
  select video_id, ord, row_number() over (partition by video_id order by k.viral_score desc, ord) as rank, k.viral_score,
    round(start_time, 3) as start_time, round(end_time, 3) as end_time,
    case when has_hook and h2 <= h1 then null when has_hook then round(h1, 3) else round(hs, 3) end as hook_start_time,
    case when has_hook and h2 <= h1 then null when has_hook then round(h2, 3) else round(he, 3) end as hook_end_time,
    case when trimmed >= {LOW} * 0.9 then round(trimmed, 3) end as kept_s, title, hashtags,
    concat_ws('; ', case when span > {HIGH} then printf('cut to 50s, was %.1fs', span) end,
      case when has_hook and h2 <= h1 then 'hook ends before it begins, default hook used' end,
      case when hook_text = '' then 'no hook text' end,
      case when trimmed < {LOW} * 0.9 then printf('kept segments last only %.1fs, whole clip used', trimmed) end,
      case when title = '' then 'no title' end,
      case when n_hashtags < 10 then printf('%d of 10 to 15 hashtags', n_hashtags) end,
      case when description_hook = '' then 'no opening line in the description' end,
      case when description_context = '' then 'no context in the description' end,
      case when n_keywords < 5 then printf('%d of 5 to 8 keyword tags', n_keywords) end,
      case when length(description) < 30 then 'description under 30 characters' end) as warnings
  from strong k join shaped using (video_id, ord) join meta using (video_id, ord)"""
)
def normalize_clips(t):
    out = cl.normalize_clips(t.candidates, LOW, HIGH)
    return out.select(
        "video_id", "ord", "rank", "viral_score", r3("start_time"), r3("end_time"), r3("hook_start_time"), r3("hook_end_time"),
        F.when(F.col("keep_segments").isNotNull(), F.round(cl.spans_length(F.col("keep_segments")), 3)).alias("kept_s"),
        "title", "hashtags", F.array_join("warnings", "; ").alias("warnings"),
    )


@query("""select video_id, ord, round(case when ord <> 2 then 12 + (e - 0.5 - s - 14) else e - s end, 2) as duration
  from (select video_id, ord, round(start_time, 1) as s, round(end_time, 1) as e from fx_doc_clips)""")
def rendered_duration(t):
    rounded = t.snap_input.withColumns(
        {
            "start_time": F.round("start_time", 1),
            "end_time": F.round("end_time", 1),
            "keep_segments": F.transform(
                "keep_segments",
                lambda s: F.struct(F.round(s["start_time"], 1).alias("start_time"), F.round(s["end_time"], 1).alias("end_time")),
            ),
        }
    )
    return cl.rendered_duration(rounded).select("video_id", "ord", "duration")


@query("""select c.video_id, row_number() over (partition by c.video_id order by viral_score desc, ord, start_time, end_time) as rank,
  viral_score, printf('%d:%04.1f', cast(floor(start_time / 60) as int), start_time % 60) as start,
  round(end_time - start_time, 1) as duration,
  case when length(v.title || ' ' || v.url || ' ' || v.url) <= 52 then v.title || ' ' || v.url || ' ' || v.url
   else left(v.title || ' ' || v.url || ' ' || v.url, 49) || '...' end as title, coalesce(st.status, '-') as account
  from fx_clips c join fx_videos v using (video_id) left join fx_video_status st using (video_id)""")
def clip_preview(t):
    titled = t.videos.select("video_id", F.concat_ws(" ", "title", "url", "url").alias("title"))
    kind = t.video_status.select("video_id", F.struct(F.col("status").alias("account_type")).alias("account_classification"))
    clips = cl.rank_clips(t.clips).join(titled, "video_id").join(kind, "video_id", "left")
    return cl.clip_preview(clips)


@query("""select c.video_id, ord, round(case when ord = 1 then start_time else start_time + 2.5 end, 3) as hook_start,
  round(case when ord = 1 then start_time + 3 else start_time + 5.5 end, 3) as hook_end, ord <> 1 as use_teaser,
  false as use_segments, coalesce(n, 0) >= 2 as can_split, coalesce(n, 0) as n_speakers from fx_conv_clips c
  left join (select video_id, count(distinct speaker) as n from fx_turns group by video_id) using (video_id)""")
def clip_render_plan(t):
    clips = t.conv_clips.withColumns(
        {
            "hook_start_time": F.expr("case when ord <> 1 then start_time + 2.5D end"),
            "hook_end_time": F.lit(None).cast("double"),
            "keep_segments": F.lit(None).cast("array<struct<start_time: double, end_time: double>>"),
        }
    )
    return cl.clip_render_plan(clips, t.turns).select(
        "video_id", "ord", r3("hook_start"), r3("hook_end"), "use_teaser", "use_segments", "can_split", "n_speakers"
    )


ENDS = r"""bare <> '' and instr('.?!…।॥؟。！？', right(bare, 1)) > 0"""
SNAP = rf"""w as (select *, row_number() over (partition by video_id order by start_s, end_s) as i,
     lag(end_s) over (partition by video_id order by start_s, end_s) as prev_end,
     lead(start_s) over (partition by video_id order by start_s, end_s) as nxt, {ENDS} as is_end
   from (select *, rtrim(trim(word), '"''”’»)]') as bare from fx_words)),
  first_word as (select video_id, min(start_s) as first_start, bool_or(is_end) as punctuated from w group by video_id),
  spans as (select video_id, ord, 'clip' as part, 0 as k, start_time as s, end_time as e from fx_doc_clips
    union all select video_id, ord, 'hook', 0, start_time + 1.03, start_time + 6.11 from fx_doc_clips where ord <> 1
    union all select video_id, ord, 'keep', 0, start_time, start_time + 12 from fx_doc_clips where ord <> 2
    union all select video_id, ord, 'keep', 1, start_time + 14, end_time - 0.5 from fx_doc_clips where ord <> 2),
  a as (select p.*, w.start_s as ws, w.end_s as we, w.prev_end, w.nxt from spans p asof left join w
     on w.video_id = p.video_id and w.start_s <= p.s),
  b as (select a.*, w.end_s as ee, w.nxt as enxt from a asof left join w on w.video_id = a.video_id and w.start_s <= a.e - 0.05),
  c as (select b.*, case when f.first_start is null then s
       when ws is null then greatest(first_start - 0.12, least(0, first_start), 0)
       when we > s then greatest(ws - 0.12, least(coalesce(prev_end, 0), ws), 0)
       when nxt is null then s else greatest(nxt - 0.12, least(we, nxt), 0) end as ns,
     case when ee is null then e else greatest(ee, least(ee + 0.35, coalesce(enxt - 0.05, ee + 0.35))) end as ne,
     f.punctuated from b left join first_word f using (video_id)),
  d as (select *, case when ne <= ns then s else round(ns, 3) end as s2, case when ne <= ns then e else round(ne, 3) end as e2 from c),
  se as (select *, greatest(end_s, least(end_s + 0.35, coalesce(nxt - 0.05, end_s + 0.35))) as snap from w where is_end),
  m as (select d.*, w.i, w.is_end from d asof left join w on w.video_id = d.video_id and w.start_s <= d.e2 - 0.05
     where d.part = 'clip'),
  m1 as (select m.*, x.end_s as fe, x.snap as fsnap from m asof left join se x on x.video_id = m.video_id and x.i >= m.i),
  m2 as (select m1.*, x.end_s as pe, x.snap as psnap from m1 asof left join se x on x.video_id = m1.video_id and x.i <= m1.i),
  fin as (select video_id, ord, s2 as start_time, e as old_end, round(case when i is null or is_end then e2
     when fe - e2 <= 2.5 then fsnap when e2 - pe <= 6.0 and pe >= s2 + 27.0 then psnap else e2 end, 3) as end_time from m2)"""


@query(f"""with {SNAP}, segs as (select d.video_id, d.ord, d.k, greatest(d.s2, f.start_time) as s,
     least(case when abs(d.e - f.old_end) <= 1.0 then f.end_time else d.e2 end, f.end_time) as e
     from d join fin f using (video_id, ord) where d.part = 'keep')
  select f.video_id, f.ord, f.start_time, f.end_time, case when h.s2 is not null then round(greatest(h.s2, f.start_time), 3) end as hook_start_time,
    case when h.e2 is not null then round(least(h.e2, f.end_time), 3) end as hook_end_time,
    (select string_agg(printf('%.3f-%.3f', s, e), '|' order by s) from segs where segs.video_id = f.video_id
      and segs.ord = f.ord and e > s) as keeps
  from fin f left join (select * from d where part = 'hook') h using (video_id, ord)""")
def snap_clips_to_words(t):
    out = cl.snap_clips_to_words(t.snap_input, t.words)
    keeps = F.array_join(
        F.transform("keep_segments", lambda s: F.format_string("%.3f-%.3f", s["start_time"], s["end_time"])), "|"
    )
    return out.select(
        "video_id", "ord", r3("start_time"), r3("end_time"), r3("hook_start_time"), r3("hook_end_time"), keeps.alias("keeps")
    )


@query(rf"""with w as (select *, row_number() over (partition by video_id order by start_s, end_s) as i,
     lead(start_s) over (partition by video_id order by start_s, end_s) as nxt, {ENDS} as is_end
   from (select *, rtrim(trim(word), '"''”’»)]') as bare from fx_words)),
  se as (select *, greatest(end_s, least(end_s + 0.35, coalesce(nxt - 0.05, end_s + 0.35))) as snap from w where is_end),
  m as (select c.*, w.i, w.is_end from fx_doc_clips c asof left join w on w.video_id = c.video_id and w.start_s <= c.end_time - 0.05),
  m1 as (select m.*, x.end_s as fe, x.snap as fsnap from m asof left join se x on x.video_id = m.video_id and x.i >= m.i),
  m2 as (select m1.*, x.end_s as pe, x.snap as psnap from m1 asof left join se x on x.video_id = m1.video_id and x.i <= m1.i)
  select video_id, ord, round(case when i is null or is_end then end_time when fe - end_time <= 2.5 then fsnap
    when end_time - pe <= 6.0 and pe >= start_time + 27.0 then psnap else end_time end, 3) as end_time from m2""")
def finish_sentence(t):
    return cl.finish_sentence(t.doc_clips, t.words).select("video_id", "ord", "end_time")
