"""Story recipes: checks, source status and per-clip outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLATFORMS = ("youtube", "tiktok", "instagram", "gdrive", "local")


def dangling_scene_sources(scenes: DataFrame, sources: DataFrame) -> DataFrame:
    """Scenes whose source is not registered."""
    return scenes.join(sources.select("source_id"), "source_id", "left_anti")


def story_source_status(sources: DataFrame, cached: DataFrame) -> DataFrame:
    """``ok`` or ``failed`` and the cached size of each source. ``cached``: (source_id, path, bytes)."""
    files = cached.select("source_id", F.col("path").alias("cached_path"), F.col("bytes").alias("_bytes"))
    return (
        sources.join(files, "source_id", "left")
        .withColumn("status", F.when(F.col("cached_path").isNotNull(), "ok").otherwise("failed"))
        .withColumn("size_mb", F.round(F.col("_bytes") / 1048576, 2))
        .drop("_bytes")
    )


def story_manifest(scenes: DataFrame, files: DataFrame) -> DataFrame:
    """Outcome of each clip: both sections usable, one, or none.

    A scene is usable with both times and an existing source file. ``files``: (source_id).
    """
    present = files.select("source_id").distinct().withColumn("_file", F.lit(True))
    usable = F.col("start_s").isNotNull() & F.col("end_s").isNotNull() & F.coalesce("_file", F.lit(False))
    counts = scenes.join(present, "source_id", "left").groupBy("clip_id").agg(
        F.count_if(usable & (F.col("section") == "hook")).alias("hook_scenes"),
        F.count_if(usable & (F.col("section") == "highlight")).alias("highlight_scenes"),
    )
    both = (F.col("hook_scenes") > 0) & (F.col("highlight_scenes") > 0)
    some = (F.col("hook_scenes") > 0) | (F.col("highlight_scenes") > 0)
    return counts.withColumn("status", F.when(both, "ok").when(some, "partial").otherwise("failed"))


def story_transcript_index(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments per transcribed source."""
    counts = segments.groupBy("source_id").agg(F.count("*").alias("segment_count"))
    return sources.select("source_id").join(counts, "source_id", "left").withColumn(
        "segment_count", F.coalesce("segment_count", F.lit(0))
    )


def _source_findings(sources: DataFrame) -> DataFrame:
    """Broken rules of registered sources."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    sid = F.coalesce(F.col("source_id").cast("string"), F.lit("?"))
    local = F.col("platform") == "local"
    source_rules = F.array_compact(
        F.array(
            F.when(empty("source_id") | empty("name") | empty("platform"), F.lit("source: missing field")),
            F.when(~F.col("platform").isin(*PLATFORMS), F.lit("source: unknown platform")),
            F.when(local & empty("local_path"), F.lit("source: local without path")),
            F.when(F.col("platform").isin(*PLATFORMS) & ~local & empty("url"), F.lit("source: no url")),
        )
    )
    doubled = sources.groupBy("source_id").count().filter("count > 1").select(F.lit("source: duplicate id").alias("rule"), sid.alias("key"))
    return sources.select(F.explode(source_rules).alias("rule"), sid.alias("key")).unionByName(doubled)


def story_validation(sources: DataFrame, scenes: DataFrame) -> DataFrame:
    """Every broken rule of exploded scenes as (rule, key), where the reader would stop at the first; whole recipes:
    ``recipe_validation``."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    place = F.concat_ws("/", F.col("clip_id").cast("string"), "section", F.col("scene_idx").cast("string"))
    start, end = F.col("start_s"), F.col("end_s")
    both = start.isNotNull() & end.isNotNull()
    scene_rules = F.array_compact(
        F.array(
            F.when(empty("source_id"), F.lit("scene: no source")),
            F.when(start.isNull() != end.isNull(), F.lit("scene: only one time")),
            F.when(both & (start < 0), F.lit("scene: negative start")),
            F.when(both & (end <= start), F.lit("scene: end before start")),
            F.when(F.col("clip_id").cast("string").try_cast("long").isNull(), F.lit("clip: id is no integer")),
        )
    )
    dangling = dangling_scene_sources(scenes.filter(F.col("source_id").isNotNull()), sources).select(
        F.lit("scene: unknown source").alias("rule"), place.alias("key")
    )
    sections = scenes.groupBy("clip_id").agg(
        F.count_if(F.col("section") == "hook").alias("h"), F.count_if(F.col("section") == "highlight").alias("l")
    )
    missing = F.array_compact(
        F.array(
            F.when(F.col("h") == 0, F.lit("clip: no hook scenes")), F.when(F.col("l") == 0, F.lit("clip: no highlight scenes"))
        )
    )
    out = _source_findings(sources)
    for part in (
        scenes.select(F.explode(scene_rules).alias("rule"), place.alias("key")),
        dangling,
        sections.select(F.explode(missing).alias("rule"), F.col("clip_id").cast("string").alias("key")),
    ):
        out = out.unionByName(part)
    return out


#: Recipes as they are written: a field that is left out is null, a field written as null is a variant null.
RECIPE = (
    "clips array<struct<clip_id: variant, title: variant, hook: struct<scenes: array<struct<source_id: variant, start: variant, `end`: variant>>>, "
    "highlight: struct<scenes: array<struct<source_id: variant, start: variant, `end`: variant>>>>>"
)


def recipe_validation(sources: DataFrame, recipes: DataFrame) -> DataFrame:
    """Every broken rule of whole recipes (``payload``) as (rule, key): clips without scenes, repeated clip ids, fields
    that are left out and times that are no numbers are still seen here, which exploded scenes no longer show."""
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    text = lambda c: F.try_variant_get(c, "$", "string")
    number = lambda c: F.when(kind(c).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(c, "$", "double"))
    parsed = recipes.select(F.from_json("payload", RECIPE)["clips"].alias("clips"))
    # Ids are counted as rows: a recipe may hold any number of clips, so they are not compared with each other.
    numbered = parsed.select(F.monotonically_increasing_id().alias("_recipe"), "clips")
    ids = numbered.select("_recipe", F.explode(F.transform("clips", lambda c: text(c["clip_id"]))).alias("key"))
    doubled = ids.filter("key is not null").groupBy("_recipe", "key").count().filter("count > 1")
    clips = parsed.select(F.explode("clips").alias("c")).select("c.*", F.coalesce(text(F.col("c.clip_id")), F.lit("?")).alias("clip"))
    has = lambda s: F.coalesce(F.size(F.col(f"{s}.scenes")), F.lit(0)) > 0
    clip_rules = F.array_compact(
        F.array(
            F.when(F.col("clip_id").isNull() | F.col("title").isNull() | F.col("hook").isNull() | F.col("highlight").isNull(), F.lit("clip: missing field")),
            F.when(F.col("clip_id").isNotNull() & (kind(F.col("clip_id")) != "BIGINT"), F.lit("clip: id is no integer")),
            *[F.when(~has(s), F.lit(f"clip: no {s} scenes")) for s in ("hook", "highlight")],
        )
    )
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"{s}.scenes").alias("scenes")) for s in ("hook", "highlight")])
    scenes = clips.select("clip", F.explode(sections).alias("x")).select("clip", "x.section", F.posexplode("x.scenes").alias("scene_idx", "s"))
    scenes = scenes.select(
        F.concat_ws("/", "clip", "section", F.col("scene_idx").cast("string")).alias("key"), text(F.col("s.source_id")).alias("source_id"),
        *[f(F.col(f"s.{c}")).alias(n) for c in ("start", "end") for f, n in ((kind, f"_{c}_kind"), (number, c))],
    )
    no_start, no_end = F.col("_start_kind") == "VOID", F.col("_end_kind") == "VOID"
    unread = (~no_start & F.col("start").isNull()) | (~no_end & F.col("end").isNull())
    scene_rules = F.array_compact(
        F.array(
            F.when(F.coalesce("source_id", F.lit("")) == "", F.lit("scene: no source")),
            F.when(no_start != no_end, F.lit("scene: only one time")),
            F.when(unread, F.lit("scene: time is no number")),
            F.when(F.col("start") < 0, F.lit("scene: negative start")),
            F.when(F.col("end") <= F.col("start"), F.lit("scene: end before start")),
        )
    )
    registered = sources.select(F.col("source_id").cast("string").alias("source_id"))
    dangling = dangling_scene_sources(scenes.filter("source_id <> ''"), registered)
    out = _source_findings(sources)
    for part in (
        parsed.filter(F.coalesce(F.size("clips"), F.lit(0)) <= 0).select(F.lit("recipe: no clips").alias("rule"), F.lit("?").alias("key")),
        doubled.select(F.lit("clip: duplicate id").alias("rule"), "key"),
        clips.select(F.explode(clip_rules).alias("rule"), F.col("clip").alias("key")),
        scenes.select(F.explode(scene_rules).alias("rule"), "key"),
        dangling.select(F.lit("scene: unknown source").alias("rule"), "key"),
    ):
        out = out.unionByName(part)
    return out
