"""Ingestion, files, story recipes and scripts: payloads are built from the whole input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmart.functions.ordered import grouped, without_cells
from clipmart.operators import romanise as ro
from clipmart.operators import story as st
from clipmart.sources import files as io
from clipmart.sources import ingest
from clipmart.workload.registry import query
from clipmart.workload.tables import LINE_ORDER
from clipmart.workload.transcript_queries import r3

# ---- links -----------------------------------------------------------------------------
LINK_TEXT = (
    "case when page_id % 9 = 0 then concat('  # ', url) else concat(url, ', ftp://x ', url, '#again\thttps://youtu.be/', "
    "substr(md5(cast(page_id % 40 as {s})), 1, 11), '?t=', page_id) end"
)


@query(f"""select video_key, arg_min(tok, line_no * 1000 + pos) as url, min(line_no) as line_no from (
   select *, coalesce(nullif(regexp_extract(tok, '(?:v=|/shorts/|/live/|/embed/|youtu\\.be/)([A-Za-z0-9_-]{{11}})', 1), ''),
     'v_' || left(sha1(tok), 10)) as video_key from (
    select page_id as line_no, unnest(range(len(toks))) as pos, unnest(toks) as tok from (
     select page_id, regexp_split_to_array(v, '[\\s,]+') as toks from (
      select page_id, {LINK_TEXT.format(s='varchar')} as v from pages) where v not like '  #%'))
   where tok like 'http://%' or tok like 'https://%') group by video_key""")
def read_links(t):
    lines = t.pages.select(F.col("page_id").alias("line_no"), F.expr(LINK_TEXT.format(s="string")).alias("value"))
    return ingest.read_links(lines).select("video_key", "url", "line_no")


URLS = (
    "case page_id % 6 when 0 then concat('https://www.youtube.com/watch?v=', substr(md5(url), 1, 11)) "
    "when 1 then concat('https://www.youtube.com/playlist?list=PL', substr(md5(url), 1, 20)) "
    "when 2 then concat('https://www.youtube.com/watch?v=', substr(md5(url), 1, 11), '&list=PL', substr(md5(url), 5, 9)) "
    "when 3 then substr(md5(url), 1, 11) when 4 then concat('https://drive.example/file/d/', substr(md5(url), 1, 15), '/view') "
    "else url end"
)


@query(rf"""select page_id, coalesce(case when regexp_full_match(u, '[A-Za-z0-9_-]{{11}}') then u end, nullif(regexp_extract(u,
   '(?:youtube\.com/watch\?.*v=|youtu\.be/|youtube\.com/embed/|youtube\.com/v/|youtube\.com/shorts/)([A-Za-z0-9_-]{{11}})', 1), '')) as video_id,
  coalesce(case when regexp_full_match(u, '[A-Za-z0-9_-]{{10,}}') then u end,
    nullif(regexp_extract(u, 'youtube\.com/playlist\?.*list=([A-Za-z0-9_-]+)', 1), ''),
    nullif(regexp_extract(u, 'youtube\.com/watch\?.*list=([A-Za-z0-9_-]+)', 1), '')) as playlist_id,
  case when page_id % 6 in (1, 2, 3) then 'playlist' when page_id % 6 = 0 then 'video' end as kind,
  coalesce(nullif(regexp_extract(u, '/d/([a-zA-Z0-9_-]+)', 1), ''), nullif(regexp_extract(u, '[?&]id=([a-zA-Z0-9_-]+)', 1), '')) as drive_file_id
  from (select page_id, {URLS} as u from pages)""")
def classify_urls(t):
    rows = t.pages.select("page_id", F.expr(URLS).alias("url"))
    return ingest.classify_urls(rows).select("page_id", "video_id", "playlist_id", "kind", "drive_file_id")


@query("select p_name, min(p_partkey) as p_partkey, arg_min(p_brand, p_partkey) as p_brand from part group by p_name")
def distinct_first(t):
    return ingest.distinct_first(t.part.select("p_name", "p_partkey", "p_brand"), "p_name", ["p_partkey"])


# ---- metadata ---------------------------------------------------------------------------
@query("""select concat('v', p_partkey) as video_id, case when p_size = 1 then 'Untitled' else p_name end as title,
  case when p_partkey % 3 = 0 then 'https://w.example/' || p_partkey else 'https://www.youtube.com/watch?v=v' || p_partkey end as url,
  case when p_partkey % 4 = 0 then 'https://t.example/b' when p_partkey % 4 = 1 then 'https://t.example/a' end as thumbnail_url,
  case when p_partkey % 5 <> 0 then p_size * 10 end as duration_seconds, '2024-0' || (1 + p_partkey % 9) || '-17' as upload_date,
  case when p_partkey % 2 = 0 then p_brand else '@u' || p_size end as channel_id, '@u' || p_size as handle from part""")
def ingest_videos(t):
    payload = F.expr("""to_json(named_struct(
        'id', case when p_partkey % 7 <> 0 then concat('v', p_partkey) else '' end, 'display_id', concat('v', p_partkey),
        'title', case when p_size = 1 then '  ' else concat(' ', p_name, ' ') end,
        'webpage_url', case when p_partkey % 3 = 0 then concat('https://w.example/', p_partkey) end,
        'thumbnail', case when p_partkey % 4 = 1 then 'https://t.example/a' end,
        'thumbnails', case when p_partkey % 4 = 0 then array(named_struct('url', 'https://t.example/0'),
            named_struct('url', 'https://t.example/b'), named_struct('url', '')) end,
        'duration', case when p_partkey % 5 <> 0 then cast(p_size * 10 as string) else 'live' end,
        'upload_date', concat('20240', 1 + p_partkey % 9, '17'),
        'channel_id', case when p_partkey % 2 = 0 then p_brand end, 'uploader_id', concat('@u', p_size)))""")
    rows = ingest.ingest_videos(t.part.select(payload.alias("payload")))
    return rows.select("video_id", "title", "url", "thumbnail_url", "duration_seconds", "upload_date", "channel_id", "handle")


@query("""select 'playlist:PL' || c_custkey as source_key, case when c_acctbal < 0 then 'Untitled Playlist' else c_name end as title,
  case when c_custkey % 2 = 0 then 'https://p.example/' || c_custkey else 'https://www.youtube.com/playlist?list=PL' || c_custkey end as url,
  c_mktsegment as channel_name from customer""")
def ingest_playlists(t):
    payload = F.expr("""to_json(named_struct('id', concat('PL', c_custkey), 'title', case when c_acctbal >= 0 then c_name end,
        'webpage_url', case when c_custkey % 2 = 0 then concat('https://p.example/', c_custkey) end, 'uploader', c_mktsegment))""")
    rows = ingest.ingest_playlists(t.customer.select(payload.alias("payload")))
    return rows.select("source_key", "title", "url", "channel_name")


@query("""select playlist_id, url as video_url from (select *, row_number() over (partition by playlist_id order by pos) as rn from (
   select o_custkey as playlist_id, url, min(pos) as pos from (select o_custkey, row_number() over
     (partition by o_custkey order by o_orderkey) as pos, o_orderpriority = '5-LOW' as hidden,
     'https://www.youtube.com/watch?v=v' || o_orderkey % 50 as url from orders) where not hidden group by 1, 2)) where rn <= 5""")
def expand_playlist_entries(t):
    entry = F.expr("""named_struct('k', o_orderkey, 'e', named_struct('id', concat('v', o_orderkey % 50),
        'url', case when o_orderkey % 2 = 0 then concat('https://www.youtube.com/watch?v=v', o_orderkey % 50) else 'v' end,
        'title', case when o_orderpriority = '5-LOW' then ' [Private Video]' else 'Talk' end))""")
    lists = t.orders.groupBy(F.col("o_custkey").alias("playlist_id")).agg(F.sort_array(F.collect_list(entry)).alias("x"))
    payload = F.to_json(F.struct(F.transform("x", lambda x: x["e"]).alias("entries")))
    rows = ingest.expand_playlist_entries(lists.select("playlist_id", payload.alias("payload")), 5)
    return rows.select("playlist_id", "video_url")


@query(r"""select doc_id, source as channel, array_to_string(string_split(text, ' ')[1:25], '|') as tags, left(text, 1500) as description,
  array_to_string(list_filter(string_split(text, '.'), lambda x: x <> '')[1:30], '|') as chapters from documents""")
def source_info(t):
    payload = F.to_json(
        F.struct(
            F.col("source").alias("uploader"), F.split("text", " ").alias("tags"), F.col("text").alias("description"),
            F.transform(F.split("text", "[.]"), lambda x: F.struct(x.alias("title"))).alias("chapters"),
        )
    )
    rows = ingest.source_info(t.documents.select("doc_id", payload.alias("payload")))
    return rows.select(
        "doc_id", "channel", F.array_join("tags", "|").alias("tags"), "description", F.array_join("chapters", "|").alias("chapters")
    )


# ---- captions -----------------------------------------------------------------------------
@query(r"""with ev as (select video_id, ord // 10 as ev, (ord % 10) // 5 as sg, string_agg(word, ' ' order by ord) as body,
    min(ord) as first from fx_words group by 1, 2, 3),
  cl as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '<[^>]+>', '', 'g'),
     '\[[\p{L}\p{N}_\s]+\]', '', 'g'), '>>\s*', '', 'g'), '[♪♫♬♩]', '', 'g'), '^\s*-\s+', '')) as clean,
    ev * 4.7 :: double + sg * 2.0 :: double as s0, case when sg = 0 and (video_id, ev) in (select (video_id, ev) from ev where sg = 1)
      then ev * 4.7 :: double + 2.0 else ev * 4.7 :: double + case when ev % 3 = 0 then 6.0 else 4.0 end end as s1 from ev),
  w as (select video_id, ev, sg, s0, (s1 - s0) / len(parts) as per, unnest(range(len(parts))) as w, unnest(parts) as word
    from (select *, string_split(regexp_replace(clean, '\s+', ' ', 'g'), ' ') as parts from cl where clean <> '')),
  n as (select video_id, row_number() over (partition by video_id order by ev, sg, w) - 1 as ord, word, s0 + w * per as start_s,
    s0 + w * per + per as end_s from w)
  select video_id, ord, word, round(start_s, 3) as start_s, round(case when nxt < end_s then greatest(start_s + 0.1, nxt) else end_s end, 3)
    as end_s from (select *, lead(start_s) over (partition by video_id order by ord) as nxt from n)""")
def words_from_json3(t):
    # Events of ten words in two segments, straight from each document's word array.
    words = F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " ")), " ")
    docs = t.texts.select(F.col("doc_id").alias("video_id"), words.alias("w")).filter("w[0] <> ''")
    segment = (
        "named_struct('utf8', concat({mark}, array_join(slice(w, e * 10 + {at} + 1, 5), ' '), '</i>\n'), 'tOffsetMs', {at} * 400)"
    )
    first, second = segment.format(mark="'>> <i>[Music]'", at=0), segment.format(mark="'♪ '", at=5)
    docs = docs.withColumn(
        "events",
        F.expr(
            "transform(sequence(0, (size(w) - 1) div 10), e -> named_struct('tStartMs', e * 4700, "
            "'dDurationMs', case when e % 3 = 0 then 6000 else 4000 end, "
            f"'segs', case when size(w) > e * 10 + 5 then array({first}, {second}) else array({first}) end))"
        ),
    )
    payload = F.to_json(F.struct("events"))
    rows = ingest.words_from_json3(docs.select("video_id", payload.alias("payload")))
    return rows.select("video_id", "ord", "word", r3("start_s"), r3("end_s"))


@query("""select doc_id as video_id, x.ord as line, x.ord * 1.5 :: double as start_s, x.ord * 1.5 :: double + 1 as end_s,
  trim(regexp_replace(x.s, '[ \t\n\r\f]+', ' ', 'g')) as text from (select doc_id, unnest(list_transform(list_zip(range(len(p)), p),
   lambda z: {'ord': z[1], 's': z[2]})) as x from (select doc_id, string_split(text, '.') as p from documents)) where x.ord % 4 <> 3""")
def read_transcript_lines(t):
    lines = t.documents.select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "[.]")).alias("line", "s"))
    clean = F.trim(F.regexp_replace("s", r"[ \t\n\r\f]+", " "))
    stamp = F.format_string(" [ %.1f - %.1f ] ", F.col("line") * 1.5, F.col("line") * 1.5 + 1)
    value = F.when(F.expr("line % 4 = 3"), F.concat(F.lit("note: "), clean)).otherwise(F.concat(stamp, clean))
    return ingest.read_transcript_lines(lines.select("video_id", "line", value.alias("value")))


@query("""select video_id, ord, start_time, end_time, cast(viral_score as varchar) as viral_score, case when ord % 2 = 0 then 'T' || ord
  else 'M' || ord end as title from fx_doc_clips""")
def ingest_clip_candidates(t):
    clip = F.expr("""named_struct('start_time', start_time, 'end_time', end_time, 'viral_score', viral_score,
        'title', case when ord % 2 = 0 then concat('T', ord) end,
        'metadata', named_struct('title', concat('M', ord), 'viral_score', 1))""")
    docs = t.doc_clips.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("ord", clip.alias("c")))).alias("x"))
    items = F.transform("x", lambda x: x["c"])
    plain, wrapped = F.to_json(items), F.to_json(F.struct(F.lit("ok").alias("state"), items.alias("clips")))
    payload = F.when(F.expr("video_id % 2 = 0"), plain).otherwise(wrapped)
    rows = ingest.ingest_clip_candidates(docs.select("video_id", payload.alias("payload")))
    return rows.select("video_id", "ord", "start_time", "end_time", "viral_score", "title")


# ---- files -----------------------------------------------------------------------------------
MANIFEST_SHAPE = "job_id bigint, rank bigint, status string, viral_score bigint"


@query("select job_id, rank, status, viral_score from fx_manifest")
def read_json_rows(t):
    lists = t.manifest.groupBy("job_id").agg(F.collect_list(F.struct("job_id", "rank", "status", "viral_score")).alias("x"))
    path = io.scratch_path(t.spark, "manifests")
    lists.select(F.to_json("x").alias("value")).write.text(path)
    return io.read_json_rows(t.spark, path, MANIFEST_SHAPE, multi_line=False)


@query("select job_id, rank, status, viral_score from fx_manifest where status = 'success'")
def write_rows(t):
    path = io.scratch_path(t.spark, "rows")
    io.write_rows(t.manifest.select("job_id", "rank", "status", "viral_score"), path)
    io.write_rows(t.manifest.filter("status = 'success'").select("job_id", "rank", "status", "viral_score"), path)
    return t.spark.read.parquet(path)


@query("""select cast(v.video_id as varchar) as video_id, v.title, v.url, cast(v.duration_seconds as varchar) as duration_seconds,
  strftime(v.upload_date, '%Y-%m-%d') as upload_date, v.channel_name, null :: varchar as channel_url, coalesce(s.status, 'unused') as status,
  strftime(s.used_at, '%Y-%m-%dT%H:%M:%S.000Z') as used_at, s.clip_title, s.notes, null :: varchar as local_output_path,
  null :: varchar as published_url from fx_videos v left join fx_video_status s using (video_id)""")
def export_videos_csv(t):
    path = io.scratch_path(t.spark, "videos-csv")
    io.export_videos_csv(t.videos, t.video_status, path)
    return t.spark.read.option("header", True).csv(path).select(*io.CSV_COLUMNS)


@query("""select 'stats' as dataset, 'all' as key, concat_ws('|', (select count(*) from fx_sources), count(*), (select count(*) from fx_channels),
   count(*) filter (where status = 'used')) as value from fx_videos left join fx_video_status using (video_id)
  union all select 'sources', cast(s.source_id as varchar), concat_ws('|', s.title, count(distinct l.video_id),
   count(*) filter (where st.status = 'used')) from fx_sources s left join fx_source_videos l using (source_id)
   left join fx_video_status st on st.video_id = l.video_id group by s.source_id, s.title
  union all select 'videos', cast(video_id as varchar), concat_ws('|', title, coalesce(status, 'unused')) from fx_videos
   left join fx_video_status using (video_id)""")
def export_snapshot_json(t):
    path = io.scratch_path(t.spark, "snapshot")
    io.export_snapshot_json(t.sources, t.videos, t.channels, t.video_status, t.source_videos, path)

    def dataset(name, shape, key, *values):
        rows = t.spark.read.schema(shape).json(f"{path}/{name}")
        return rows.select(F.lit(name).alias("dataset"), key.cast("string").alias("key"), F.concat_ws("|", *values).alias("value"))

    stats = dataset(
        "stats", "total_sources bigint, total_videos bigint, total_channels bigint, total_used bigint", F.lit("all"),
        "total_sources", "total_videos", "total_channels", "total_used",
    )
    sources = dataset("sources", "source_id bigint, title string, total_videos bigint, used_count bigint", F.col("source_id"), "title", "total_videos", "used_count")
    videos = dataset("videos", "video_id bigint, title string, status string", F.col("video_id"), "title", "status")
    return stats.unionByName(sources).unionByName(videos)


@query("""select l_orderkey as asset_id, l_partkey as link from (select *, row_number() over (partition by l_orderkey order by
  case when l_linestatus = 'F' then 0 else 1 end, l_quantity desc, l_linenumber desc, l_partkey) as rn from lineitem
  where l_returnflag <> 'A') where rn = 1""")
def best_rendition(t):
    files = t.lineitem.selectExpr(
        "l_orderkey as asset_id", "case when l_returnflag = 'A' then 'video/webm' else 'video/mp4' end as file_type",
        "case when l_linestatus = 'F' then 'hd' else 'sd' end as quality", "l_quantity as width", "l_linenumber as height",
        "l_partkey as ord", "l_partkey as link",
    )
    return ingest.best_rendition(files).select("asset_id", "link")


TRACK = (
    "case l_linenumber when 1 then 'en' when 2 then 'en-US' when 3 then 'hi-orig' when 4 then 'EN' when 5 then 'fr' "
    "when 6 then 'en-orig' else 'de' end"
)


@query(f"""select video_id, track, row_number() over (partition by video_id order by p, ord, track) as place from (
  select video_id, track, min(p * 1000000 + ord) // 1000000 as p, min(p * 1000000 + ord) % 1000000 as ord from (
   select *, case when kind = 'manual' and lower(split_part(track, '-', 1)) = base then 0 when kind = 'auto' and track like '%-orig'
     then 1 when kind = 'auto' and lower(track) = base then 2 end as p from (
    select l_orderkey as video_id, {TRACK} as track, case when l_returnflag = 'A' then 'manual' else 'auto' end as kind,
     case when l_orderkey % 3 = 0 then 'fr' else 'en' end as base, l_partkey as ord from lineitem)) where p is not null group by 1, 2)""")
def subtitle_preference(t):
    tracks = t.lineitem.selectExpr(
        "l_orderkey as video_id", "case when l_orderkey % 3 = 0 then 'fr-CA' else 'EN' end as language", f"{TRACK} as track",
        "case when l_returnflag = 'A' then 'manual' else 'auto' end as kind", "l_partkey as ord",
    )
    return ingest.subtitle_preference(tracks)


# ---- story ---------------------------------------------------------------------------------------
@query("select clip_id, scene_idx, source_id from fx_scenes where source_id not in (select source_id from fx_story_sources)")
def dangling_scene_sources(t):
    return st.dangling_scene_sources(t.scenes, t.story_sources).select("clip_id", "scene_idx", "source_id")


@query("""select source_id, platform, case when local_path is not null then 'ok' else 'failed' end as status,
  case when local_path is not null then round(bytes / 1048576.0, 2) end as size_mb from fx_story_sources""")
def story_source_status(t):
    cached = t.story_sources.filter("local_path is not null").select("source_id", F.col("local_path").alias("path"), "bytes")
    return st.story_source_status(t.story_sources, cached).select("source_id", "platform", "status", "size_mb")


@query("""select clip_id, hook_scenes, highlight_scenes, case when hook_scenes > 0 and highlight_scenes > 0 then 'ok'
  when hook_scenes + highlight_scenes > 0 then 'partial' else 'failed' end as status from (select clip_id,
   count(*) filter (where ok and section = 'hook') as hook_scenes, count(*) filter (where ok and section = 'highlight') as highlight_scenes
   from (select *, start_s is not null and end_s is not null and source_id in (select source_id from fx_story_sources) as ok
   from fx_scenes) group by clip_id)""")
def story_manifest(t):
    return st.story_manifest(t.scenes, t.story_sources)


@query("select source_id, coalesce(n, 0) as segment_count from fx_story_sources left join (select source_id, count(*) as n from fx_scenes group by 1) using (source_id)")
def story_transcript_index(t):
    return st.story_transcript_index(t.story_sources, t.scenes)


SOURCE_RULES = """select rule, key, count(*) as n from (
  select 'source: unknown platform' as rule, cast(source_id as varchar) as key from fx_story_sources where platform = 'vimeo'
  union all select 'source: local without path', cast(source_id as varchar) from fx_story_sources where platform = 'local' and local_path is null
  union all select 'source: no url', cast(source_id as varchar) from fx_story_sources where platform not in ('local', 'vimeo') and url is null"""


@query(SOURCE_RULES + """  union all select 'scene: only one time', concat_ws('/', clip_id, section, scene_idx) from fx_scenes where (start_s is null) <> (end_s is null)
  union all select 'scene: end before start', concat_ws('/', clip_id, section, scene_idx) from fx_scenes where end_s <= start_s
  union all select 'scene: unknown source', concat_ws('/', clip_id, section, scene_idx) from fx_scenes
    where source_id not in (select source_id from fx_story_sources)
  union all select 'clip: no hook scenes', cast(clip_id as varchar) from fx_scenes group by clip_id having count(*) filter (where section = 'hook') = 0
  union all select 'clip: no highlight scenes', cast(clip_id as varchar) from fx_scenes group by clip_id
    having count(*) filter (where section = 'highlight') = 0) group by rule, key""")
def story_validation(t):
    return st.story_validation(t.story_sources, t.scenes).groupBy("rule", "key").agg(F.count("*").alias("n"))


# Recipes as files: some ids are repeated or are no integers, some times are no numbers.
RECIPES = """with c as (select *, case when clip_id % 40 = 1 then clip_id - 1 else clip_id end as id, clip_id // 4000 as recipe,
    row_number() over (partition by clip_id, section order by scene_idx, source_id, start_s nulls first, end_s nulls first) - 1 as i, scene_idx = 3 and clip_id % 7 = 0 as soon from fx_scenes),
  s as (select *, concat_ws('/', id, section, i) as place from c),
  clips as (select clip_id, id, recipe, count(*) filter (where section = 'hook') as h, count(*) filter (where section = 'highlight') as g from s group by 1, 2, 3)
"""


@query(RECIPES + SOURCE_RULES + """
  union all select 'clip: id is no integer', cast(id as varchar) from clips where clip_id % 60 = 5
  union all select 'clip: no hook scenes', cast(id as varchar) from clips where h = 0
  union all select 'clip: no highlight scenes', cast(id as varchar) from clips where g = 0
  union all select 'clip: duplicate id', cast(id as varchar) from clips group by recipe, id having count(*) > 1
  union all select 'scene: only one time', place from s where (start_s is null and not soon) <> (end_s is null)
  union all select 'scene: time is no number', place from s where soon
  union all select 'scene: end before start', place from s where end_s <= start_s and not soon
  union all select 'scene: unknown source', place from s where source_id not in (select source_id from fx_story_sources)) group by rule, key""")
def recipe_validation(t):
    time = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    start = F.when(F.expr("scene_idx = 3 and clip_id % 7 = 0"), '"soon"').otherwise(time("start_s"))
    scene = F.concat(F.lit('{"source_id": "'), F.col("source_id").cast("string"), F.lit('", "start": '), start, F.lit(', "end": '), time("end_s"), F.lit("}"))
    entry = F.struct("scene_idx", "source_id", "start_s", "end_s", scene.alias("text"))
    clips = t.scenes.groupBy("clip_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("section") == s, entry)))["text"].alias(s) for s in ("hook", "highlight")]
    )
    number = F.expr("cast(case when clip_id % 40 = 1 then clip_id - 1 else clip_id end as string)")
    shown = F.when(F.expr("clip_id % 60 = 5"), F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    sections = [x for s in ("hook", "highlight") for x in (F.lit(f', "{s}": {{"scenes": ['), F.array_join(s, ", "), F.lit("]}"))]
    texts = clips.select(F.expr("clip_id div 4000").alias("recipe"), F.concat(F.lit('{"clip_id": '), shown, F.lit(', "title": "t"'), *sections, F.lit("}")).alias("clip"))
    recipes = texts.groupBy("recipe").agg(F.concat(F.lit('{"clips": ['), F.array_join(F.collect_list("clip"), ",\n"), F.lit("]}")).alias("value"))
    path = io.scratch_path(t.spark, "recipes")
    recipes.write.partitionBy("recipe").text(path)
    found = st.recipe_validation(t.story_sources, io.read_recipes(t.spark, path))
    return found.groupBy("rule", "key").agg(F.count("*").alias("n"))


@query("select cast(source_id as varchar) as source_id, name, platform, url from fx_story_sources")
def read_story_sources(t):
    one = F.struct(F.col("source_id").cast("string").alias("id"), "name", "platform", "url", "local_path")
    path = io.scratch_path(t.spark, "registries")
    # One registry file per platform, as a user would keep them.
    docs = t.story_sources.groupBy("platform").agg(F.collect_list(one).alias("sources"))
    docs.select("platform", F.to_json(F.struct("sources")).alias("value")).write.partitionBy("platform").text(path)
    return io.read_story_sources(t.spark, path).select("source_id", "name", "platform", "url")


SCENE_ORDER = ", ".join(LINE_ORDER[1:])


@query(f"""select l_orderkey as clip_id, case when l_linenumber % 2 = 0 then 'hook' else 'highlight' end as section,
  row_number() over (partition by l_orderkey, l_linenumber % 2 order by l_partkey, l_quantity, l_extendedprice) - 1 as scene_idx,
  cast(l_partkey as varchar) as source_id, case when l_quantity > 5 then l_quantity end as start_s, '9:16' as ratio,
  cast(case when l_orderkey % 2 = 0 then 20 else 15 end as double) as min_duration from lineitem""")
def read_story_scenes(t):
    scene = F.struct("l_partkey", "l_quantity", "l_extendedprice")
    shaped = lambda c: F.transform(
        F.sort_array(c),
        lambda s: F.struct(
            s["l_partkey"].cast("string").alias("source_id"), F.when(s["l_quantity"] > 5, s["l_quantity"]).alias("start"),
        ),
    )
    clips = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.expr("l_linenumber % 2 = 0"), scene)).alias("h"),
        F.collect_list(F.when(F.expr("l_linenumber % 2 = 1"), scene)).alias("g"),
    )
    clip = F.struct(
        F.col("l_orderkey").alias("clip_id"), F.lit("Story").alias("title"),
        F.struct(shaped(F.col("h")).alias("scenes")).alias("hook"), F.struct(shaped(F.col("g")).alias("scenes")).alias("highlight"),
    )
    # Recipes of some hundred clips, one file each.
    recipes = clips.groupBy(F.expr("l_orderkey div 4000").alias("no"), F.expr("l_orderkey % 2").alias("odd")).agg(F.collect_list(clip).alias("clips"))
    settings = F.struct(F.expr("case when odd = 0 then 20.0D end").alias("min_duration"))
    recipe = F.to_json(F.struct(F.lit("p").alias("project_name"), settings.alias("default_settings"), "clips"))
    path = io.scratch_path(t.spark, "stories")
    recipes.select("no", "odd", recipe.alias("value")).write.partitionBy("no", "odd").text(path)
    return io.read_story_scenes(t.spark, path).select("clip_id", "section", "scene_idx", "source_id", "start_s", "ratio", "min_duration")


# ---- scripts ---------------------------------------------------------------------------------------
@query(r"select video_id, ord, word from fx_script_words where regexp_matches(regexp_replace(word, '\p{Latin}', '', 'g'), '\p{L}')")
def non_latin_words(t):
    return ro.non_latin_words(t.script_words).select("video_id", "ord", "word")


@query("""select video_id, seg, seg % 3 <> 0 as accepted, case when seg % 3 <> 0 then
  array_to_string(list_transform(string_split(text, ' '), lambda x: x || '~'), ' ') end as answer
  from fx_captions""")
def aligned_lines(t):
    line = F.struct("video_id", "seg")
    lines = t.captions.select(line.alias("line_id"), "video_id", "seg", F.split("text", " ").alias("words"))
    good = F.transform("words", lambda w: F.concat(F.lit(" "), w, F.lit("~")))
    answer = F.when(F.expr("line_id.seg % 3 <> 0"), good).when(F.size("words") > 1, F.slice("words", 1, 1)).otherwise(F.array(F.lit(" ")))
    out = ro.aligned_lines(lines, lines.select("line_id", "video_id", "seg", answer.alias("words")), near=["video_id", "seg"])
    return out.select("line_id.video_id", "line_id.seg", "accepted", F.array_join("answer", " ").alias("answer"))


@query(r"""with recursive numbered as (select video_id, ord // 4 as idx, count(*) as n, min(start_s) as s, max(end_s) as e,
    string_agg(word, ' ' order by ord) as text from fx_script_words group by 1, 2),
  wanted as (select * from numbered k where regexp_matches(regexp_replace(text, '\p{Latin}', '', 'g'), '\p{L}') and exists (
    select 1 from fx_doc_clips c where c.video_id = k.video_id and k.e > c.start_time - 1 and k.s < c.end_time + 1)),
  isl as (select *, idx - row_number() over (partition by video_id order by idx) as isl from wanted),
  walk as (select video_id, isl, idx, n as used, idx as line from isl k where not exists
      (select 1 from isl p where p.video_id = k.video_id and p.idx = k.idx - 1)
    union all select k.video_id, k.isl, k.idx, case when w.used + k.n > 12 then k.n else w.used + k.n end,
      case when w.used + k.n > 12 then k.idx else w.line end
    from walk w join isl k on k.video_id = w.video_id and k.idx = w.idx + 1)
  select video_id, idx + 1 as idx, line + 1 as line from walk""")
def romanisation_lines(t):
    captions = without_cells(grouped(t.script_words, ["video_id"], F.expr("ord div 4").alias("seg")).agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n_words"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]), " ").alias("text"),
    ))
    return ro.romanisation_lines(captions, t.doc_clips).select("video_id", "idx", "line")
