"""Transcript operators over every document's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmart.functions.text import bare_word
from clipmart.operators import transcript as tr
from clipmart.workload.registry import query


def r3(name):
    return F.round(name, 3).alias(name)


@query("""select video_id, ord, word, start_s, round(case when nxt < end_s then greatest(start_s + 0.1, nxt) else end_s end, 3)
  as end_s from (select *, lead(start_s) over (partition by video_id order by ord) as nxt from fx_raw_words)""")
def clamp_word_overlaps(t):
    return tr.clamp_word_overlaps(t.raw_words).select("video_id", "ord", "word", "start_s", r3("end_s"))


@query("select video_id, seg, start_s, end_s, n_words, text from fx_captions")
def group_captions(t):
    return tr.group_captions(t.words)


LINES = r"""(select video_id, line, min(start_s) as start_s, max(end_s) as end_s, string_agg(word, ' ' order by ord) as text
  from (select *, island + ((ord - island) // 14) * 14 as line from (select *, coalesce(max(case when
      rtrim(word, '"''') <> '' and instr('.?!', right(rtrim(word, '"'''), 1)) > 0 then ord + 1 end)
      over (partition by video_id order by ord rows between unbounded preceding and 1 preceding), 0) as island
    from fx_words)) group by video_id, line)"""


@query(f"select * from {LINES}")
def transcript_lines(t):
    return tr.transcript_lines(t.words)


@query("""select video_id, seg, end_s, case when nxt - end_s between 0 and 0.6 then nxt else end_s end as held_end_s
  from (select *, lead(start_s) over (partition by video_id order by seg) as nxt from fx_captions)""")
def caption_hold(t):
    return tr.caption_hold(t.captions).select("video_id", "seg", "end_s", "held_end_s")


@query("""select doc_id as video_id, round(coalesce(c, 0), 3) as covered_s,
  round(case when n_chars > 0 then coalesce(c, 0) / (n_chars * 0.2) else 1 end, 4) as coverage,
  case when n_chars > 0 then coalesce(c, 0) / (n_chars * 0.2) else 1 end < 0.15 as suspect
  from documents left join (select video_id, sum(end_s - start_s) as c from fx_captions group by video_id) on doc_id = video_id""")
def speech_coverage(t):
    videos = t.documents.select(F.col("doc_id").alias("video_id"), (F.col("n_chars") * 0.2).alias("duration_s"))
    return tr.speech_coverage(t.captions, videos).select(
        "video_id", r3("covered_s"), F.round("coverage", 4).alias("coverage"), "suspect"
    )


@query("""select doc_id as video_id, case when a < 0.15 and b > a then 2 else 1 end as run,
  case when a < 0.15 and b > a then b else a end as coverage
  from (select doc_id, (n_chars * 37 % 100) / 250.0 as a, (n_chars * 53 % 100) / 200.0 as b from documents)""")
def better_transcript_run(t):
    both = t.documents.select(
        F.col("doc_id").alias("video_id"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("run"), F.expr("(n_chars * 37 % 100) / 250.0D").alias("coverage")),
                F.struct(F.lit(2).alias("run"), F.expr("(n_chars * 53 % 100) / 200.0D").alias("coverage")),
            )
        ).alias("r"),
    )
    return tr.better_transcript_run(both.select("video_id", "r.*"))


PAIRS = """fx_doc_clips c join fx_captions s on s.video_id = c.video_id and s.end_s > c.start_time and s.start_s < c.end_time"""


@query(f"select c.video_id, c.ord, s.seg from {PAIRS}")
def interval_overlap_join(t):
    return tr.interval_overlap_join(t.doc_clips, t.captions).select("video_id", "ord", "seg")


@query(f"select c.video_id, c.ord, string_agg(s.text, ' ' order by s.seg) as text from {PAIRS} group by c.video_id, c.ord")
def clip_text(t):
    return tr.clip_text(t.doc_clips, t.captions)


@query(f"""select video_id, cast(floor(start_s / 600) as bigint) as window_no, count(*) as n_lines from {LINES}
  group by 1, 2""")
def transcript_windows(t):
    return tr.transcript_windows(tr.transcript_lines(t.words))


@query("""with p as (select video_id, ord as line, start_s, word as text, cast(floor(start_s / 60) as bigint) as w from fx_words),
  m as (select video_id, seg as line, start_s, text, cast(floor(start_s / 60) as bigint) as w from fx_captions),
  v as (select video_id, w, coalesce(n2, 0) >= 0.3 * n1 as use_merged from (select video_id, w, count(*) as n1 from p group by 1, 2)
        left join (select video_id, w, count(*) as n2 from m group by 1, 2) using (video_id, w))
  select video_id, w as window_no, line, text, 'primary' as origin from p join v using (video_id, w) where not use_merged
  union all select video_id, w, line, text, 'merged' from m join v using (video_id, w) where use_merged""")
def choose_window_transcript(t):
    primary = t.words.select("video_id", F.col("ord").alias("line"), "start_s", F.col("word").alias("text"))
    merged = t.captions.select("video_id", F.col("seg").alias("line"), "start_s", "text")
    out = tr.choose_window_transcript(primary, merged, width=60.0, share=0.3)
    return out.select("video_id", "window_no", "line", "text", "origin")


REUSE = """select doc_id as request, source, lang as language, n_chars % 7 as source_size from documents"""


@query(f"""with r as ({REUSE}), c as (select distinct source, lang as language, case when n_chars % 7 = 3 then null
  else n_chars % 7 end as source_size, n_chars % 2 as n_segments from documents)
  select request from r where exists (select 1 from c where c.source = r.source and c.language = r.language
  and c.source_size is not distinct from (case when r.source_size = 3 then null else r.source_size end) and c.n_segments > 0)""")
def reusable_transcripts(t):
    size = F.expr("case when n_chars % 7 = 3 then null else n_chars % 7 end").alias("source_size")
    fixed = [F.lit("large").alias("speech_model"), F.lit(5).alias("words_per_sub"), F.lit(False).alias("use_dlp_subs")]
    request = t.documents.select(F.col("doc_id").alias("request"), "source", F.col("lang").alias("language"), size, *fixed)
    cache = t.documents.select(
        "source", F.col("lang").alias("language"), size, *fixed, F.expr("n_chars % 2").alias("n_segments")
    ).distinct()
    return tr.reusable_transcripts(request, cache).select("request")


@query("""select video_id, (n - 1) // 3 as chunk, min(start_s) as start_s, max(end_s) as end_s,
  string_agg(word, ' ' order by ord) as text
  from (select *, row_number() over (partition by video_id order by ord) as n from fx_words) group by 1, 2""")
def chunk_words(t):
    return tr.chunk_words(t.words)


@query("""select video_id, min(ord) as burst, min(start_s) as start_s, max(end_s) as end_s, count(*) as n_words from (
  select *, sum(opens) over (partition by video_id order by ord) as b from (select *, case when start_s -
   lag(end_s) over (partition by video_id order by ord) <= 0.6 then 0 else 1 end as opens from fx_words))
  group by video_id, b""")
def speech_sessions(t):
    return tr.speech_sessions(t.words)


@query("""select c.video_id, c.ord, s.seg, round(greatest(0, s.start_s - c.start_time), 3) as cue_start,
  round(least(c.end_time - c.start_time, s.held - c.start_time), 3) as cue_end from fx_doc_clips c join
  (select *, case when nxt - end_s between 0 and 0.6 then nxt else end_s end as held from (
    select *, lead(start_s) over (partition by video_id order by seg) as nxt from fx_captions)) s
  on s.video_id = c.video_id and s.held > c.start_time and s.start_s < c.end_time""")
def caption_cues(t):
    return tr.caption_cues(t.captions, t.doc_clips).select("video_id", "ord", "seg", r3("cue_start"), r3("cue_end"))


@query("""select c.video_id, c.ord as clip_ord, s.ord, round(greatest(0, s.start_s - c.start_time), 3) as cue_start,
  round(least(c.end_time - c.start_time, s.until - c.start_time), 3) as cue_end from fx_doc_clips c join
  (select p.*, case when nseg = p.seg then nxt when nxt - end_s between 0 and 0.6 then nxt else end_s end as until from (
    select *, lead(start_s) over w as nxt, lead(seg) over w as nseg from fx_placed window w as
    (partition by video_id order by ord)) p) s
  on s.video_id = c.video_id and s.until > c.start_time and s.start_s < c.end_time""")
def word_cues(t):
    return tr.word_cues(t.placed, t.doc_clips).select("video_id", "clip_ord", "ord", r3("cue_start"), r3("cue_end"))


PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


@query(f"""with plan as (select doc_id as video_id, unnest(string_split(lower(left_words), ' ')) as word, 1 as ord, 'accent' as style
    from (select doc_id, source || ' ' || lang || ' The' as left_words from documents)
    union all select doc_id, 'the', 2, 'main' from documents where n_chars % 3 = 0),
  k as (select video_id, word, arg_max(style, ord) as style from plan group by 1, 2)
  select w.video_id, w.ord, w.word, k.style from fx_words w left join k on k.video_id = w.video_id
   and k.word = trim(lower(w.word), {PUNCT})""")
def emphasis_lookup(t):
    words = F.split(F.concat_ws(" ", "source", "lang", F.lit("The")), " ")
    first = t.documents.select(
        F.col("doc_id").alias("video_id"), F.explode(words).alias("word"), F.lit(1).alias("ord"), F.lit("accent").alias("style")
    )
    later = t.documents.filter("n_chars % 3 = 0").select(
        F.col("doc_id").alias("video_id"), F.lit("THE.").alias("word"), F.lit(2).alias("ord"), F.lit("main").alias("style")
    )
    plan = first.unionByName(later).withColumn("scale_level", F.lit(2))
    return tr.emphasis_lookup(t.words, plan).select("video_id", "ord", "word", "style")


@query(r"""with m as (select key, arg_min(replacement, ord) as replacement from (
    select regexp_replace(lower(trim(text)), '^[\p{P}$+<=>^`|~]+|[\p{P}$+<=>^`|~]+$', '', 'g') as key,
           regexp_replace(lower(trim(text)), '^[\p{P}$+<=>^`|~]+|[\p{P}$+<=>^`|~]+$', '', 'g') || cast(ord as varchar)
           as replacement, ord
    from (select unnest(string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ')) as text, item_id as ord from benchmark))
   where key <> '' group by key)
  select video_id, w.ord, coalesce(m.replacement, word) as word, coalesce(m.replacement, word) <> word as changed
  from fx_words w left join m on m.key = regexp_replace(lower(w.word), '^[\p{P}$+<=>^`|~]+|[\p{P}$+<=>^`|~]+$', '', 'g')""")
def apply_word_map(t):
    mapping = t.benchmark.select(
        F.col("item_id").alias("ord"), F.explode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("word")
    ).withColumn("replacement", F.concat(bare_word("word"), F.col("ord").cast("string")))
    return tr.apply_word_map(t.words, mapping).select("video_id", "ord", "word", "changed")
