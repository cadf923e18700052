"""From raw payloads to typed tables. JSON arrives as one string column, ``payload``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmart.functions import text as tx
from clipmart.functions.ordered import first_per_key

# URL patterns of the video platforms.
KEY_PATTERN = r"(?:v=|/shorts/|/live/|/embed/|youtu\.be/)([A-Za-z0-9_-]{11})"
VIDEO_PATTERN = (
    r"(?:youtube\.com/watch\?.*v=|youtu\.be/|youtube\.com/embed/|youtube\.com/v/|youtube\.com/shorts/)([A-Za-z0-9_-]{11})"
)
LIST_PATTERNS = (r"youtube\.com/playlist\?.*list=([A-Za-z0-9_-]+)", r"youtube\.com/watch\?.*list=([A-Za-z0-9_-]+)")
DRIVE_PATTERNS = (r"/d/([a-zA-Z0-9_-]+)", r"[?&]id=([a-zA-Z0-9_-]+)")
WATCH_URL, LIST_URL = "https://www.youtube.com/watch?v=", "https://www.youtube.com/playlist?list="
UNUSABLE_TITLES = ("[private video]", "[deleted video]")


def _some(value: Column) -> Column:
    """Empty strings count as missing."""
    return F.when(value != "", value)


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def _found(url: Column, pattern: str) -> Column:
    return _some(F.regexp_extract(url, pattern, 1))


def video_key(url: Column) -> Column:
    """A stable key per video: the platform id, else a short hash of the URL."""
    return F.coalesce(_found(url, KEY_PATTERN), F.concat(F.lit("v_"), F.substring(F.sha1(_stripped(url)), 1, 10)))


def classify_urls(urls: DataFrame) -> DataFrame:
    """Video id, playlist id, kind, key and drive file id of each URL."""
    url = _stripped(F.col("url"))
    video = F.coalesce(F.when(url.rlike("^[A-Za-z0-9_-]{11}$"), url), _found(url, VIDEO_PATTERN))
    playlist = F.coalesce(F.when(url.rlike("^[A-Za-z0-9_-]{10,}$"), url), *[_found(url, p) for p in LIST_PATTERNS])
    return urls.withColumns(
        {
            "video_id": video,
            "playlist_id": playlist,
            "kind": F.when(playlist.isNotNull(), "playlist").when(video.isNotNull(), "video"),
            "video_key": video_key(F.col("url")),
            "drive_file_id": F.coalesce(*[_found(F.col("url"), p) for p in DRIVE_PATTERNS]),
        }
    )


def read_links(lines: DataFrame) -> DataFrame:
    """Distinct video links of a text, (line_no, value): the first link of a video wins."""
    kept = lines.filter(~F.ltrim("value").startswith("#"))
    tokens = kept.select("line_no", F.posexplode(F.split("value", r"(?U)[\s,]+")).alias("pos", "url"))
    links = tokens.filter(F.col("url").startswith("http://") | F.col("url").startswith("https://"))
    keyed = links.withColumn("video_key", video_key(F.col("url")))
    return first_per_key(keyed, ["video_key"], ["line_no", "pos"])


def distinct_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First-seen rows per key, in a defined order (``dropDuplicates`` has none)."""
    return first_per_key(df, [key], order)


VIDEO_PAYLOAD = (
    "id string, display_id string, title string, channel string, channel_id string, channel_url string, uploader string, "
    "uploader_id string, uploader_url string, webpage_url string, url string, duration string, upload_date string, "
    "thumbnail string, thumbnails array<struct<url: string>>, description string, view_count bigint, like_count bigint, "
    "comment_count bigint, categories array<string>, tags array<string>, availability string, live_status string"
)
VIDEO_RAW = (
    "id title description duration upload_date channel channel_id channel_url uploader uploader_id view_count like_count "
    "comment_count categories tags webpage_url availability live_status"
).split()


def _thumbnail(i: Column) -> Column:
    usable = F.filter(i["thumbnails"], lambda t: F.coalesce(t["url"], F.lit("")) != "")
    return F.coalesce(_some(i["thumbnail"]), F.get(usable, F.size(usable) - 1)["url"])


def _owner(i: Column) -> dict[str, Column]:
    return {
        "channel_id": F.coalesce(_some(i["channel_id"]), _some(i["uploader_id"])),
        "channel_name": F.coalesce(_some(i["channel"]), _some(i["uploader"])),
        "channel_url": F.coalesce(_some(i["channel_url"]), _some(i["uploader_url"])),
    }


def ingest_videos(raw: DataFrame) -> DataFrame:
    """Raw video metadata → videos; rows without an id are dropped."""
    parsed = raw.withColumn("i", F.from_json("payload", VIDEO_PAYLOAD))
    i = F.col("i")
    day = _stripped(i["upload_date"])
    dated = F.when(F.length(day) == 8, F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))
    video_id = F.coalesce(_some(i["id"]), _some(i["display_id"]))
    out = parsed.withColumns(
        {
            "video_id": video_id,
            "title": F.coalesce(_some(_stripped(i["title"])), F.lit("Untitled")),
            "url": F.coalesce(_some(i["webpage_url"]), _some(i["url"]), F.concat(F.lit(WATCH_URL), video_id)),
            "thumbnail_url": _thumbnail(i),
            "duration_seconds": i["duration"].try_cast("double").try_cast("int"),
            "upload_date": F.coalesce(dated, _some(day)),
            **_owner(i),
            "handle": F.when(i["uploader_id"].startswith("@"), i["uploader_id"]),
            "description": _some(_stripped(i["description"])),
            "raw_json": F.to_json(F.struct(*[i[k].alias(k) for k in VIDEO_RAW])),
        }
    ).filter(F.col("video_id").isNotNull())
    return out.withColumn("published_at", F.col("upload_date")).drop("i", "payload")


LIST_PAYLOAD = (
    "id string, title string, description string, channel string, channel_id string, channel_url string, uploader string, "
    "uploader_id string, uploader_url string, webpage_url string, thumbnail string, thumbnails array<struct<url: string>>, "
    "playlist_count bigint, modified_date string"
)
LIST_RAW = (
    "id title description channel channel_id channel_url uploader uploader_id webpage_url playlist_count modified_date"
).split()


def ingest_playlists(raw: DataFrame) -> DataFrame:
    """Raw playlist headers → sources."""
    parsed = raw.withColumn("i", F.from_json("payload", LIST_PAYLOAD))
    i = F.col("i")
    return parsed.withColumns(
        {
            "playlist_id": i["id"],
            "source_key": F.concat(F.lit("playlist:"), i["id"]),
            "title": F.coalesce(_some(_stripped(i["title"])), F.lit("Untitled Playlist")),
            "url": F.coalesce(_some(i["webpage_url"]), F.concat(F.lit(LIST_URL), i["id"])),
            "thumbnail_url": _thumbnail(i),
            **_owner(i),
            "raw_json": F.to_json(F.struct(*[i[k].alias(k) for k in LIST_RAW])),
        }
    ).drop("i", "payload")


ENTRIES_PAYLOAD = "title string, entries array<struct<id: string, url: string, title: string>>"


def playlist_url(url: Column) -> Column:
    """Canonical playlist address of a link that names a list, else null."""
    host, name = F.parse_url(url, F.lit("HOST")), F.parse_url(url, F.lit("QUERY"), F.lit("list"))
    ours = host.contains("youtube.com") | host.contains("youtu.be")
    return F.when(ours & (name != ""), F.concat(F.lit(LIST_URL), name))


def expand_playlist_entries(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Usable video URLs of each playlist (``playlist_id``, ``payload``), distinct, in order."""
    lists = raw.withColumn("p", F.from_json("payload", ENTRIES_PAYLOAD))
    each = lists.select(
        "playlist_id", F.coalesce(_some(F.col("p.title")), F.lit("Playlist")).alias("playlist_title"),
        F.posexplode("p.entries").alias("pos", "e"),
    )
    title = F.lower(_stripped(F.coalesce(F.col("e.title"), F.lit(""))))
    given = F.coalesce(F.col("e.url"), F.lit(""))
    url = F.when((F.coalesce(F.col("e.id"), F.lit("")) != "") & ~given.startswith("http"), F.concat(F.lit(WATCH_URL), F.col("e.id"))).otherwise(given)
    usable = each.filter(F.col("e").isNotNull() & ~title.isin(*UNUSABLE_TITLES)).withColumn("video_url", url).filter("video_url <> ''")
    distinct = usable.groupBy("playlist_id", "playlist_title", "video_url").agg(F.min("pos").alias("pos"))
    if limit is None:
        return distinct
    order = Window.partitionBy("playlist_id").orderBy("pos")
    return distinct.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).drop("_rn")


def source_info(raw: DataFrame) -> DataFrame:
    """Trimmed context of each video: at most 25 tags, 1500 characters of description, 30 chapter titles."""
    shape = (
        "title string, channel string, uploader string, upload_date string, language string, webpage_url string, "
        "categories array<string>, tags array<string>, description string, chapters array<struct<title: string>>"
    )
    i = F.col("i")
    none = F.array().cast("array<string>")
    titles = F.filter(F.transform(i["chapters"], lambda c: c["title"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return raw.withColumn("i", F.from_json("payload", shape)).select(
        *[c for c in raw.columns if c != "payload"],
        i["title"].alias("title"),
        F.coalesce(_some(i["channel"]), i["uploader"]).alias("channel"),
        i["upload_date"].alias("upload_date"),
        i["language"].alias("language"),
        i["webpage_url"].alias("webpage_url"),
        F.coalesce(i["categories"], none).alias("categories"),
        F.slice(F.coalesce(i["tags"], none), 1, 25).alias("tags"),
        F.substring(F.coalesce(i["description"], F.lit("")), 1, 1500).alias("description"),
        F.slice(F.coalesce(titles, none), 1, 30).alias("chapters"),
    )


CAPTION_PAYLOAD = "events array<struct<tStartMs: bigint, dDurationMs: bigint, segs array<struct<utf8: string, tOffsetMs: bigint>>>>"
# Caption clean-up, applied in this order (pattern, replacement).
CAPTION_CLEANUP = (
    (r"<[^>]+>", ""),
    (r"\[[\p{L}\p{N}_\p{IsWhite_Space}]+\]", ""),
    (r">>\s*|[♪♫♬♩]", ""),
    (r"^\s*-\s+", ""),
)


def words_from_json3(raw: DataFrame) -> DataFrame:
    """Caption-event files (video_id, payload) → timed words.

    A segment ends where the next one of its event starts, the last with the event; segments
    without length last one second. Text is cleaned once for each segment, split evenly into words, and word ends
    are pulled back from the following word.
    """
    # One payload is one video's file: words are numbered and clamped inside its row, so no word is shuffled.
    seconds = lambda ms: F.coalesce(ms, F.lit(0)) / F.lit(1000.0).cast("double")
    events = F.from_json("payload", CAPTION_PAYLOAD)["events"]

    def segment(e: Column, s: Column, i: Column) -> Column:
        begin = seconds(e["tStartMs"])
        start = begin + seconds(s["tOffsetMs"])
        following = begin + seconds(F.get(e["segs"], i + 1)["tOffsetMs"])
        end = F.when(i < F.size(e["segs"]) - 1, following).otherwise(begin + seconds(e["dDurationMs"]))
        # Line breaks, runs of blanks and blanks in front are left to the squash.
        clean = F.rtrim(F.replace(F.coalesce(s["utf8"], F.lit("")), F.lit("\u200b"), F.lit("")), F.lit(tx.BLANKS))
        for pattern, replacement in CAPTION_CLEANUP:
            clean = F.regexp_replace(clean, "(?U)" + pattern, replacement)
        return F.struct(start.alias("s0"), F.when(end <= start, start + 1.0).otherwise(end).alias("s1"), tx.squash(clean).alias("clean"))

    timed = F.flatten(F.transform(F.filter(events, lambda e: e["segs"].isNotNull()), lambda e: F.transform(e["segs"], lambda s, i: segment(e, s, i))))
    parts = F.transform(
        F.filter(timed, lambda x: x["clean"] != ""),
        lambda x: F.struct(x["s0"].alias("s0"), x["s1"].alias("s1"), F.split(x["clean"], " ").alias("parts")),
    )

    # What is the same for all words of a segment is worked out for the segment. The generator keeps its array from being worked out again for every use.
    paced = F.transform(parts, lambda x: F.struct(x["s0"].alias("s0"), ((x["s1"] - x["s0"]) / F.size(x["parts"])).alias("per"), x["parts"].alias("parts")))
    whole = raw.select("video_id", F.explode(F.array(paced)).alias("_parts"))

    def repeated(x: Column, i: Column) -> Column:
        n = F.size(x["parts"])
        return F.array_repeat(F.struct(x["s0"].alias("s0"), x["per"].alias("per"), n.alias("n"), F.get("_parts", i + 1)["s0"].alias("behind")), n)

    zipped = F.arrays_zip(
        F.flatten("_parts.parts").alias("word"), F.flatten(F.transform("_parts", repeated)).alias("of"),
        F.flatten(F.transform("_parts", lambda x: F.sequence(F.lit(0), F.size(x["parts"]) - 1))).alias("i"),
    )
    numbered = whole.select("video_id", F.posexplode(zipped).alias("ord", "w")).select("video_id", F.col("ord").cast("long").alias("ord"), "w.word", "w.of.*", "w.i")
    start = lambda i: F.col("s0") + i * F.col("per")
    end, coming = start(F.col("i")) + F.col("per"), F.when(F.col("i") + 1 < F.col("n"), start(F.col("i") + 1)).otherwise(F.col("behind"))
    clamped = F.when(end > coming, F.greatest(start(F.col("i")) + 0.1, coming)).otherwise(end)
    return numbered.select("video_id", "ord", "word", start(F.col("i")).alias("start_s"), clamped.alias("end_s"))


CANDIDATE = (
    "rank string, viral_score string, start_time double, clip_start double, start double, end_time double, clip_end double, "
    "`end` double, hook_start_time double, hook_end_time double, hook_text string, on_screen_hook string, bgm_mood string, "
    "title string, hashtags string, hashtag string, description_hook string, description_context string, "
    "keyword_tags array<string>, reason string, source_url string, keep_segments array<struct<start_time: double, end_time: double>>, "
    "no string, account_classification struct<account_type: string, reason: string, alternative_account: struct<account_type: string, reason: string>>, "
    "typography_plan array<struct<word: string, style: string, scale_level: string>>"
)


def ingest_clip_candidates(raw: DataFrame) -> DataFrame:
    """AI answers (video_id, payload) → one row per clip, in order.

    An answer is an array, an object that wraps the array (``clips``, ``data`` or
    ``highlights``), or one clip. Fields below ``metadata`` fill fields that are missing.
    """
    body = F.ltrim("payload")
    wrapped = [F.get_json_object("payload", f"$.{k}") for k in ("clips", "data", "highlights")]
    listed = F.when(body.startswith("["), body)
    for w in wrapped:
        listed = F.coalesce(listed, F.when(w.startswith("["), w))
    listed = F.coalesce(listed, F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))))
    # Element by element, so that one entry that is no object does not spoil the others.
    items = raw.select("video_id", F.posexplode(F.from_json(listed, "array<string>")).alias("ord", "item"))
    clips = items.filter(F.col("item").startswith("{")).withColumn(
        "c", F.from_json("item", f"{CANDIDATE}, metadata struct<{CANDIDATE}>")
    )
    names = [f.split(" ")[0].strip("`") for f in _top_level(CANDIDATE)]
    found = clips.select(
        "video_id", F.col("ord").cast("long").alias("ord"),
        *[F.coalesce(F.col("c")[n], F.col("c.metadata")[n]).alias(n) for n in names],
    )
    return found.withColumn("rank", F.coalesce("rank", "no"))


def _top_level(ddl: str) -> list[str]:
    """Field declarations of a DDL string (commas inside <> do not separate)."""
    parts, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    return [p.strip() for p in parts]


LINE_PATTERN = r"^\s*\[\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*\]\s*(.*)$"


def read_transcript_lines(lines: DataFrame) -> DataFrame:
    """``[start - end] text`` lines (column ``value``) → typed lines; other lines are dropped."""
    typed = lines.filter(F.col("value").rlike(LINE_PATTERN))
    return typed.withColumns(
        {
            "start_s": F.regexp_extract("value", LINE_PATTERN, 1).try_cast("double"),
            "end_s": F.regexp_extract("value", LINE_PATTERN, 2).try_cast("double"),
            "text": _stripped(F.regexp_extract("value", LINE_PATTERN, 3)),
        }
    ).drop("value")


STORY_SOURCES = "sources array<struct<id: string, name: string, platform: string, url: string, local_path: string>>"
SECTION = "struct<scenes: array<struct<source_id: string, start: double, `end`: double, label: string>>, transition: string>"
STORY_RECIPE = (
    "project_name string, default_settings struct<ratio: string, font_style: string, use_subtitle: boolean, use_bgm: boolean, "
    f"bgm_mood: string, min_duration: double>, clips array<struct<clip_id: bigint, title: string, hook: {SECTION}, highlight: {SECTION}>>"
)


def story_sources(raw: DataFrame) -> DataFrame:
    """Source registries (payload) → one row per source."""
    each = raw.select(F.explode(F.from_json("payload", STORY_SOURCES)["sources"]).alias("s")).select("s.*")
    return each.withColumnRenamed("id", "source_id")


def story_scenes(raw: DataFrame) -> DataFrame:
    """Story recipes (payload) → one row per scene, with the recipe's settings or their defaults."""
    recipe = raw.select(F.from_json("payload", STORY_RECIPE).alias("r"))
    setting = lambda name, default: F.coalesce(F.col(f"r.default_settings.{name}"), F.lit(default)).alias(name)
    clips = recipe.select(
        setting("ratio", "9:16"), setting("font_style", "HORMOZI"), setting("use_subtitle", True), setting("use_bgm", True),
        setting("bgm_mood", "upbeat"), setting("min_duration", 15.0), F.explode("r.clips").alias("c"),
    )
    sections = F.array(
        F.struct(F.lit("hook").alias("section"), F.col("c.hook.scenes").alias("scenes")),
        F.struct(F.lit("highlight").alias("section"), F.col("c.highlight.scenes").alias("scenes")),
    )
    each = clips.withColumn("x", F.explode(sections)).select("*", F.posexplode("x.scenes").alias("scene_idx", "s"))
    return each.select(
        F.col("c.clip_id").alias("clip_id"), F.col("c.title").alias("title"), F.col("x.section").alias("section"),
        F.col("scene_idx").cast("long").alias("scene_idx"), F.col("s.source_id").alias("source_id"),
        F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.coalesce("s.label", F.lit("")).alias("label"),
        "ratio", "font_style", "use_subtitle", "use_bgm", "bgm_mood", "min_duration",
    )


def best_rendition(files: DataFrame) -> DataFrame:
    """Best MP4 file of each asset: HD first, then the widest, then the tallest."""
    mp4 = files.filter("file_type = 'video/mp4'")
    order = [
        (F.coalesce("quality", F.lit("")) != "hd").alias("a"), (-F.coalesce("width", F.lit(0))).alias("b"),
        (-F.coalesce("height", F.lit(0))).alias("c"), F.col("ord").alias("d"),
    ]
    return first_per_key(mp4, ["asset_id"], order)


def subtitle_preference(tracks: DataFrame) -> DataFrame:
    """Subtitle tracks worth fetching per video, best first.

    Uploaded tracks in the spoken language, then original-language automatic captions, then
    automatic captions named exactly like the language. ``tracks``: (video_id, language,
    kind, track, ord).
    """
    base = F.lower(F.split(F.coalesce("language", F.lit("")), "-")[0])
    own = F.lower(F.split("track", "-")[0]) == base
    manual, auto = F.col("kind") == "manual", F.col("kind") == "auto"
    level = (
        F.when(manual & (base != "") & own, 0).when(auto & F.col("track").endswith("-orig"), 1)
        .when(auto & (base != "") & (F.lower("track") == base), 2)
    )
    best = tracks.withColumn("_p", level).filter("_p is not null").groupBy("video_id", "track").agg(
        F.min(F.struct("_p", "ord")).alias("_best")
    )
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("_best", "track"))
    return best.select("video_id", "track", place.alias("place"))
