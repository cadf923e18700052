"""The engine's input tables, derived from the driver's Parquet files.

``Tables(spark, folder).<name>`` builds a DataFrame; ``TABLE_SQL[<name>]`` is the same
table for DuckDB. No table drops rows by id, modulo or prefix: filters only express the
meaning of a table (a video of type PROMO has no status row yet, an ``error`` event is a
missed face detection).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmart.functions.ordered import position_bucket, scan, spread
from clipmart.operators import transcript
from clipmart.session import tune
from clipmart.sources.files import scratch_path

LINE_ORDER = (
    "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()

STATUS_CASE = (
    "case p_size % 5 when 0 then 'used' when 1 then 'candidate' when 2 then 'skipped' else 'unused' end"
)

# Stand-in letters that turn Latin test words into another script.
LATIN_LETTERS = "abdegiklmnoprstuvz"
CYRILLIC_LETTERS = "абдегиклмнопрстувз"


#: Text of a partition whose words are exploded.
PART_BYTES = 2 << 20
#: Clips of a partition whose samples are exploded.
PART_CLIPS = 2048
#: Line numbers of an order's cell.
CELL_LINES = 256


def _minutes(base: str, n: str) -> Column:
    return F.expr(f"timestamp '{base}' + make_dt_interval(0, 0, {n}, 0)")


class Tables:
    """Lazily built input tables for one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            builder = getattr(type(self), f"_{name}", None)
            self._built[name] = builder(self) if builder else self.raw(name)
        return self._built[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- catalogue ---------------------------------------------------------
    def _channels(self):
        return self.supplier.selectExpr(
            "s_suppkey as channel_id",
            "s_name as name",
            "concat('https://tube.example/c/', s_suppkey) as url",
            "case when s_suppkey % 3 = 0 then concat('@c', s_suppkey) end as handle",
        )

    def _sources(self):
        nations = self.nation.selectExpr(
            "cast(n_nationkey as bigint) as source_id",
            "case n_regionkey % 3 when 0 then 'playlist' when 1 then 'manual' else 'channel' end as source_type",
            "n_name as title",
            "case when n_nationkey % 4 <> 3 then concat('https://tube.example/list/', n_nationkey) end as url",
        )
        regions = self.region.selectExpr(
            "cast(100 + r_regionkey as bigint) as source_id",
            "'manual' as source_type",
            "r_name as title",
            "cast(null as string) as url",
        )
        return nations.unionByName(regions)

    def _videos(self):
        return self.part.select(
            F.col("p_partkey").alias("video_id"),
            F.col("p_name").alias("title"),
            F.expr("concat('https://tube.example/v/', p_partkey)").alias("url"),
            (F.col("p_size") * 10).alias("duration_seconds"),
            F.col("p_size").cast("long").alias("channel_id"),
            F.col("p_brand").alias("channel_name"),
            F.expr("date_add(date '2020-01-01', cast(p_partkey % 700 as int))").alias("upload_date"),
            _minutes("2024-01-01 00:00:00", "p_partkey").alias("created_at"),
        )

    def _video_status(self):
        return self.part.filter("p_type <> 'PROMO'").select(
            F.col("p_partkey").alias("video_id"),
            F.expr(STATUS_CASE).alias("status"),
            F.when(F.expr("p_size % 5 = 0 and p_partkey % 2 = 0"), _minutes("2024-01-01 00:00:00", "p_partkey")).alias(
                "used_at"
            ),
            F.expr("case when p_size % 5 = 0 then upper(p_name) end").alias("clip_title"),
            F.col("p_type").alias("notes"),
            _minutes("2024-02-01 00:00:00", "p_partkey").alias("updated_at"),
        )

    def _pull_run_videos(self):
        lines = self.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
        orders = self.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        customers = self.customer.select("c_custkey", "c_nationkey")
        seen = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
            customers, F.col("o_custkey") == F.col("c_custkey")
        )
        month = F.expr("(year(o_orderdate) - 1990) * 12 + month(o_orderdate)")
        return (
            seen.select(
                F.col("c_nationkey").cast("long").alias("source_id"),
                month.cast("long").alias("pull_month"),
                F.col("l_partkey").alias("video_id"),
                F.col("l_linenumber").alias("position"),
            )
            .groupBy("source_id", "pull_month", "video_id")
            .agg(F.min("position").alias("position"))
            .withColumn("run_id", F.col("source_id") * 1000 + F.col("pull_month"))
        )

    def _pull_runs(self):
        return (
            self.pull_run_videos.groupBy("run_id", "source_id", "pull_month")
            .agg(F.count("*").alias("videos_found"))
            .withColumn(
                "status",
                F.expr("case run_id % 5 when 4 then 'running' when 3 then 'failed' else 'success' end"),
            )
            .withColumn("progress_total", F.col("videos_found") + F.col("run_id") % 7)
        )

    def _source_videos(self):
        links = self.pull_run_videos.groupBy("source_id", "video_id").agg(
            F.min("run_id").alias("first_seen_run"),
            F.max("run_id").alias("last_seen_run"),
            F.min("position").alias("position"),
        )
        latest = self.pull_run_videos.groupBy("source_id").agg(F.max("run_id").alias("latest_run"))
        return links.join(latest, "source_id").select(
            "source_id",
            "video_id",
            "position",
            "first_seen_run",
            "last_seen_run",
            (F.col("last_seen_run") == F.col("latest_run")).alias("is_present"),
        )

    def _incoming(self):
        """Entries of a new pull of every source: known, new and repeated videos."""
        return self.customer.select(
            F.col("c_nationkey").cast("long").alias("source_id"),
            F.col("c_custkey").alias("position"),
            F.expr("(c_custkey div 2) * 3").alias("video_id"),
            F.expr("case when c_custkey % 2 = 0 then c_name end").alias("title"),
            F.expr("case when c_custkey % 2 = 1 then c_custkey % 600 end").alias("duration_seconds"),
            F.expr("case when c_custkey % 5 <> 0 then c_custkey % 120 end").alias("channel_id"),
            F.expr("case when c_custkey % 5 <> 1 then c_mktsegment end").alias("channel_name"),
            F.expr("case when c_acctbal > 5000 then concat('@n', c_custkey) end").alias("handle"),
        )

    # ---- transcripts ---------------------------------------------------------
    def _texts(self):
        """Documents spread by id before they are taken apart.

        Windows over a video then need no shuffle of their own: the compact text travels once
        instead of every word row, and one large row group does not keep a single core busy. The words of a partition are many times as
        large as its texts, so partitions hold ``PART_BYTES`` of text, however much there is, and are sorted in memory.
        """
        return spread(self.documents, self._text_parts, ["doc_id"])

    @cached_property
    def _text_parts(self) -> int:
        size = self.spark.read.parquet(f"{self.folder}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
        return max(self.spark.sparkContext.defaultParallelism, -(-(size or 0) // PART_BYTES))

    def _doc_words(self):
        return self._words_of(self.texts)

    @staticmethod
    def _words_of(texts: DataFrame, *others: str) -> DataFrame:
        clean = F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " "))
        return texts.select(
            F.col("doc_id").alias("video_id"), *others, F.posexplode(F.split(clean, " ")).alias("ord", "word")
        ).filter("word <> ''")

    def _words(self):
        return self._timed(self.doc_words)

    @staticmethod
    def _timed(doc_words: DataFrame, *others: str) -> DataFrame:
        start = F.expr("400 * ord + 700 * (ord div 10)").cast("long")
        return doc_words.select(
            "video_id",
            F.col("ord").cast("long").alias("ord"),
            "word",
            *others,
            (start.cast("double") / 1000).alias("start_s"),
            ((start + 350).cast("double") / 1000).alias("end_s"),
        )

    def _raw_words(self):
        start = F.expr("400 * ord + 700 * (ord div 10)").cast("long")
        return self.doc_words.select(
            "video_id",
            F.col("ord").cast("long").alias("ord"),
            "word",
            (start.cast("double") / 1000).alias("start_s"),
            ((start + 100 + 60 * F.length("word")).cast("double") / 1000).alias("end_s"),
        )

    def _doc_clips(self):
        # As many clips as the document has room for: the last ones lie near its end.
        last = F.greatest(F.lit(4), F.expr("cast(length(text) div 255 as int)"))
        docs = self.documents.select("doc_id", last.alias("_last"))
        # Where the words of a video are, so that clips meet them without a further shuffle.
        near = spread(docs, self._text_parts, ["doc_id"])
        return self._clips_of(near.select(F.col("doc_id").alias("video_id"), "_last")).drop("_last")

    @staticmethod
    def _clips_of(videos: DataFrame) -> DataFrame:
        """Candidate clips 0 to ``_last`` of each video; other columns are kept."""
        k = videos.withColumn("ord", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        start = F.expr("ord * 20000 + (video_id * 137) % 9000").cast("long")
        length = F.expr("30000 + (video_id * 71 + ord * 4099) % 30000").cast("long")
        return k.withColumns(
            {
                "start_time": start.cast("double") / 1000,
                "end_time": (start + length).cast("double") / 1000,
                "viral_score": F.expr("50 + (video_id * 31 + ord * 17) % 50").cast("long"),
                "ord": F.col("ord").cast("long"),
            }
        )

    def _placed(self):
        return transcript.caption_positions(self.words)

    def _captions(self):
        return transcript.group_captions(self.words)

    def _script_words(self):
        """Words of French documents written in Cyrillic letters, the others unchanged."""
        # Each text meets its language whole; the words of both come from one place.
        known = spread(self.documents.select("doc_id", "lang"), self._text_parts, ["doc_id"])
        own = F.coalesce("doc_id", F.lit(0).cast(self.documents.schema["doc_id"].dataType))
        texts = self.texts.select("doc_id", "text", own.alias("_own")).join(known.withColumn("_own", own), ["_own", "doc_id"])
        native = F.translate("word", LATIN_LETTERS, CYRILLIC_LETTERS)
        return self._timed(self._words_of(texts, "lang"), "lang").withColumn(
            "word", F.when(F.col("lang") == "fr", native).otherwise(F.col("word"))
        )

    # ---- clips and manifests -------------------------------------------------
    def _clips(self):
        return self.lineitem.select(
            F.col("l_partkey").alias("video_id"),
            F.expr("l_orderkey * 10 + l_linenumber").alias("ord"),
            F.expr("cast(l_linenumber * 25 + l_orderkey % 40 as double)").alias("start_time"),
            F.expr("cast(l_linenumber * 25 + l_orderkey % 40 + 20 as double) + l_quantity * 1.5D").alias("end_time"),
            F.expr("cast(50 + l_quantity as bigint)").alias("viral_score"),
        )

    def _candidates(self):
        """Raw clip candidates: text from the documents, timing with gaps and fallbacks."""
        clips = self._clips_of(
            self.texts.select(F.col("doc_id").alias("video_id"), "text", "lang", "source", F.lit(4).alias("_last"))
        )
        span = "struct<start_time: double, end_time: double>"

        def spans(*pairs):
            inner = ", ".join(f"named_struct('start_time', {a}, 'end_time', {b})" for a, b in pairs)
            return f"cast(array({inner}) as array<{span}>)"

        three = spans(
            ("start_time - 5", "start_time + 12"), ("start_time + 10", "start_time + 20"), ("start_time + 22", "end_time + 9")
        )
        short = spans(("start_time", "start_time + 6"))
        return clips.selectExpr(
            "video_id",
            "ord",
            "case when ord = 0 then 0.0D else start_time end as start_time",
            "start_time as clip_start",
            "cast(null as double) as start",
            "end_time",
            "cast(null as double) as clip_end",
            "cast(null as double) as end",
            "case when ord = 3 then 'n/a' when ord < 3 then concat(viral_score, '.9') end as viral_score",
            "start_time - 2 + ord * 3 as hook_start_time",
            "case when ord < 4 then start_time - 3 + ord * 5 end as hook_end_time",
            "case when ord <> 2 then source end as hook_text",
            "concat('“', text, '\"') as on_screen_hook",
            "text as title",
            "lang as description_hook",
            "case when ord = 1 then 'From the whole talk' end as description_context",
            "case when ord <> 3 then regexp_replace(text, '[ \\\\t\\\\n\\\\r\\\\f]+', ' #') end as hashtags",
            "'#One #one #2024 #Two-Three' as hashtag",
            "case when ord <> 4 then split(text, '[.]') end as keyword_tags",
            f"case when ord in (1, 3) then {three} when ord = 4 then {short} end as keep_segments",
            "case when ord = 1 then concat('https://tube.example/v/', video_id) end as source_url",
        )

    def _snap_input(self):
        """Clips with a hook and two keep-segments each."""
        span = "struct<start_time: double, end_time: double>"
        return self.doc_clips.selectExpr(
            "video_id", "ord", "start_time", "end_time",
            "case when ord <> 1 then start_time + 1.03D end as hook_start_time",
            "case when ord <> 1 then start_time + 6.11D end as hook_end_time",
            f"""case when ord <> 2 then cast(array(named_struct('start_time', start_time, 'end_time', start_time + 12),
                named_struct('start_time', start_time + 14, 'end_time', end_time - 0.5D)) as array<{span}>) end as keep_segments""",
        )

    @cached_property
    def _ranked_lines(self) -> DataFrame:
        """Lines with their rank in the order, written out once: queries read the manifest several times, each with other columns."""
        # An order is one cell, or one for each CELL_LINES line numbers, so that cells are far fewer than rows. Lines without an order are no
        # order, however many there are: they are cut by line and part.
        loose = F.col("l_orderkey").isNull()
        line = F.when(loose, F.col("l_linenumber")).otherwise(F.floor(F.col("l_linenumber") / CELL_LINES))
        ranked = scan(
            self.lineitem,
            ["l_orderkey"],
            {"_line": line.cast("long"), "_part": F.when(loose, F.expr("l_partkey div 1000"))},
            LINE_ORDER[1:],
            ordinal="rank",
        )
        used = "l_orderkey l_linenumber l_partkey l_quantity l_discount l_returnflag l_linestatus l_shipdate rank".split()
        path = scratch_path(self.spark, "manifest")
        ranked.select(*used).write.parquet(path)
        return self.spark.read.parquet(path)

    def _manifest(self):
        ranked = self._ranked_lines
        return ranked.select(
            F.col("l_orderkey").alias("job_id"),
            "rank",
            F.expr("case when l_returnflag = 'R' then 'failed' else 'success' end").alias("status"),
            F.expr("case when l_linestatus = 'F' then 'uploaded' end").alias("youtube_upload_status"),
            F.expr("case when l_linestatus = 'F' then concat('yt', l_orderkey, '-', l_linenumber) end").alias(
                "youtube_video_id"
            ),
            F.expr("case when l_returnflag = 'A' then concat('ig', l_partkey) end").alias("ig_container_id"),
            F.expr("case when l_returnflag = 'A' and l_linestatus = 'F' then concat('m', l_partkey) end").alias(
                "ig_media_id"
            ),
            F.expr("case when l_returnflag = 'A' and l_linestatus = 'F' then cast(l_shipdate as timestamp) end").alias(
                "ig_published_at"
            ),
            F.expr("cast(50 + l_quantity as bigint)").alias("viral_score"),
            F.col("l_partkey").alias("video_id"),
            F.expr("concat('/out/', l_orderkey, '/clip_', rank, '.mp4')").alias("video_path"),
            F.expr("case when l_discount > 0.02D then concat('Clip of ', l_partkey) end").alias("title"),
            F.expr("case l_linenumber % 5 when 1 then concat('Final ', l_orderkey) when 2 then '' end").alias("youtube_title_final"),
            (F.col("l_quantity") * 1.5).alias("duration"),
        )

    def _files(self):
        """Rendered files: path and size; a zero size stands for an empty file."""
        return self.manifest.select(
            F.col("video_path").alias("path"), F.expr("(viral_score * 7919 + rank) % 23").alias("length")
        )

    def _jobs(self):
        return self.orders.select(
            F.col("o_orderkey").alias("job_id"),
            F.expr("case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'rendering' end").alias(
                "status"
            ),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.expr("concat('https://tube.example/v/', o_custkey)").alias("url"),
        )

    def _upload_queue(self):
        state = F.expr(
            "case job_id % 4 when 0 then 'queued' when 1 then 'uploading' when 2 then 'failed' else 'uploaded' end"
        )
        return self.manifest.filter("rank = 1").select(
            "job_id",
            "rank",
            state.alias("status"),
            F.when(
                F.expr("job_id % 50 <> 7"),
                F.date_format(_minutes("2024-01-01 00:00:00", "job_id % 1000"), "yyyy-MM-dd HH:mm:ss"),
            )
            .otherwise(F.lit("soon"))
            .alias("scheduled_at"),
        )

    def _history(self):
        return self.orders.filter("o_orderstatus = 'F'").select(
            F.col("o_orderkey").alias("video_id"),
            F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, cast(o_orderkey % 24 as int), 0, 0)").alias(
                "uploaded_at"
            ),
            F.col("o_orderpriority").alias("title"),
        )

    def _performance(self):
        return self.orders.select(
            F.col("o_orderkey").alias("video_id"),
            (F.col("o_custkey") % 10).alias("channel_id"),
            F.expr("case o_orderstatus when 'F' then 'public' when 'O' then 'private' else 'unlisted' end").alias(
                "privacy"
            ),
            F.col("o_orderdate").cast("timestamp").alias("published_at"),
            F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, cast(o_orderkey % 240 as int), 0, 0)").alias(
                "fetched_at"
            ),
            F.floor("o_totalprice").alias("views"),
            F.col("o_orderpriority").alias("title"),
        )

    def _scheduled(self):
        """Channel listing with publish times, one row per order."""
        return self.orders.select(
            F.col("o_orderkey").alias("video_id"),
            F.expr("case o_orderstatus when 'F' then 'public' else 'private' end").alias("privacy"),
            F.when(
                F.expr("o_orderpriority <> '5-LOW'"),
                F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"),
            )
            .otherwise(F.lit(""))
            .alias("publish_at"),
        )

    # ---- speakers ------------------------------------------------------------
    def _turns(self):
        said = scan(
            self.conversations.select("conv_id", F.col("turn").cast("long"), F.length("text").cast("long").alias("n")),
            ["conv_id"],
            position_bucket("turn"),
            ["turn"],
            run_sum={"said": F.col("n")},
        )
        start = F.expr("1000 * turn + 50 * (said - n)")
        end = F.expr("1000 * turn + 50 * said + case turn % 3 when 0 then 0 when 1 then 700 else 2500 end")
        return said.select(
            F.col("conv_id").alias("video_id"),
            F.col("turn").alias("ord"),
            F.expr("case when turn % 4 < 2 then 'SPEAKER_00' else 'SPEAKER_01' end").alias("speaker"),
            (start.cast("double") / 1000).alias("start_s"),
            (end.cast("double") / 1000).alias("end_s"),
        )

    def _conv_clips(self):
        # A clip every 30 seconds, to the last turn.
        spoken = (F.max("turn") * 1000 + F.coalesce(F.sum(F.length("text")), F.lit(0)) * 50) / 30000
        k = self.conversations.groupBy(F.col("conv_id").alias("video_id")).agg(F.greatest(F.lit(2), F.floor(spoken)).alias("_last"))
        k = k.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))))
        start = F.expr("ord * 30000 + (video_id * 137) % 9000")
        return k.select(
            "video_id",
            "ord",
            (start.cast("double") / 1000).alias("start_time"),
            ((start + 40000).cast("double") / 1000).alias("end_time"),
        )

    def _grid(self):
        """Half-second samples of every conversation clip; ``t`` is absolute, ``rel_t`` relative."""
        # Clips are dealt out before they are exploded: they are small, so Spark would put them all in one task.
        parts = max(self.spark.sparkContext.defaultParallelism, -(-self.conv_clips.count() // PART_CLIPS))
        clips = self.conv_clips.repartition(parts, "video_id", "ord")
        rows = clips.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(79))))
        return rows.select(
            "video_id", "ord", F.col("idx").cast("long").alias("idx"), (F.col("idx") * 0.5).alias("rel_t"),
            F.round(F.col("start_time") + F.col("idx") * 0.5, 3).alias("t"),
        )

    def _event_order(self):
        return scan(
            self.events.select("user_id", "ts", "event_id", "event_type", "value"),
            ["user_id"],
            {"_day": F.to_date("ts")},
            ["ts", "event_id"],
            ordinal="rn",
        )

    def _faces(self):
        return self.event_order.selectExpr(
            "user_id as clip_id",
            "rn as idx",
            "event_type as track",
            "cast(floor(value * 4) as bigint) as cx",
            "case when event_type <> 'error' then value / 4000.0D end as mouth",
        )

    def _frame_faces(self):
        """Two consecutive samples of a clip form one frame; ``error`` events are missed detections."""
        return self.event_order.filter("event_type <> 'error'").selectExpr(
            "user_id as clip_id",
            "(rn - 1) div 2 as idx",
            "rn as face_no",
            "event_type as track",
            "cast(floor(value * 4) as bigint) as cx",
            "concat('SPEAKER_0', event_id % 3) as speaker",
            "value / 4000.0D as mouth",
        )

    def _samples(self):
        """One row per sampled frame, with 0-2 faces."""
        return (
            self.event_order.groupBy(F.col("user_id").alias("clip_id"), F.expr("(rn - 1) div 2").alias("idx"))
            .agg(
                F.sum(F.expr("case when event_type <> 'error' then 1 else 0 end")).alias("faces"),
                F.max(F.expr("case when event_type <> 'error' then cast(floor(value * 4) as bigint) end")).alias("cx"),
                F.min(F.expr("date_trunc('day', ts)")).alias("day"),
            )
            .withColumn("scene", F.datediff("day", F.lit("2024-01-01")).cast("long"))
            .drop("day")
        )

    # ---- story, jobs, links --------------------------------------------------
    def _scenes(self):
        return self.lineitem.select(
            F.col("l_orderkey").alias("clip_id"),
            F.expr("case when l_linenumber % 2 = 0 then 'hook' else 'highlight' end").alias("section"),
            F.col("l_linenumber").cast("long").alias("scene_idx"),
            (F.col("l_suppkey") * 2).alias("source_id"),
            F.expr("case when l_quantity >= 5 then l_quantity end").alias("start_s"),
            F.expr("case when l_quantity between 3 and 48 then l_quantity + l_discount * 100 - 2 end").alias("end_s"),
        )

    def _story_sources(self):
        return self.supplier.selectExpr(
            "s_suppkey as source_id",
            "s_name as name",
            "case s_nationkey % 6 when 0 then 'youtube' when 1 then 'tiktok' when 2 then 'instagram' "
            "when 3 then 'gdrive' when 4 then 'local' else 'vimeo' end as platform",
            "case when s_acctbal > 500 then concat('https://tube.example/s/', s_suppkey) end as url",
            "case when s_acctbal > 2000 then concat('/media/', s_suppkey, '.mp4') end as local_path",
            "cast(floor(s_acctbal * 1000) as bigint) as bytes",
        )

    def _job_events(self):
        return self.events.selectExpr(
            "user_id as job_id",
            "cast(ts as timestamp) as ts",
            "event_id",
            "case event_type when 'signup' then 'queue' when 'view' then 'download' when 'click' then 'transcribe' "
            "when 'error' then 'analyze' else 'render' end as step",
            "case event_type when 'signup' then 'queued' when 'view' then 'downloading' when 'click' then "
            "'transcribing' when 'error' then 'failed' else 'completed' end as status",
            "value as percent",
        )

    def _links(self):
        return self.pages.select("page_id", "url")


TABLE_SQL = {
    "channels": """
        select s_suppkey as channel_id, s_name as name, concat('https://tube.example/c/', s_suppkey) as url,
               case when s_suppkey % 3 = 0 then concat('@c', s_suppkey) end as handle
        from supplier""",
    "sources": """
        select cast(n_nationkey as bigint) as source_id,
               case n_regionkey % 3 when 0 then 'playlist' when 1 then 'manual' else 'channel' end as source_type,
               n_name as title,
               case when n_nationkey % 4 <> 3 then concat('https://tube.example/list/', n_nationkey) end as url
        from nation
        union all
        select cast(100 + r_regionkey as bigint), 'manual', r_name, cast(null as varchar) from region""",
    "videos": """
        select p_partkey as video_id, p_name as title, concat('https://tube.example/v/', p_partkey) as url,
               p_size * 10 as duration_seconds, cast(p_size as bigint) as channel_id, p_brand as channel_name,
               date '2020-01-01' + cast(p_partkey % 700 as int) as upload_date,
               timestamp '2024-01-01' + p_partkey * interval '1' minute as created_at
        from part""",
    "video_status": f"""
        select p_partkey as video_id, {STATUS_CASE} as status,
               case when p_size % 5 = 0 and p_partkey % 2 = 0
                    then timestamp '2024-01-01' + p_partkey * interval '1' minute end as used_at,
               case when p_size % 5 = 0 then upper(p_name) end as clip_title, p_type as notes,
               timestamp '2024-02-01' + p_partkey * interval '1' minute as updated_at
        from part where p_type <> 'PROMO'""",
    "pull_run_videos": """
        select source_id, pull_month, video_id, min(position) as position, source_id * 1000 + pull_month as run_id
        from (select cast(c_nationkey as bigint) as source_id,
                     cast((year(o_orderdate) - 1990) * 12 + month(o_orderdate) as bigint) as pull_month,
                     l_partkey as video_id, l_linenumber as position
              from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)
        group by source_id, pull_month, video_id""",
    "pull_runs": """
        select run_id, source_id, pull_month, count(*) as videos_found,
               case run_id % 5 when 4 then 'running' when 3 then 'failed' else 'success' end as status,
               count(*) + run_id % 7 as progress_total
        from fx_pull_run_videos group by run_id, source_id, pull_month""",
    "source_videos": """
        select source_id, video_id, min(position) as position, min(run_id) as first_seen_run,
               max(run_id) as last_seen_run, max(run_id) = any_value(latest_run) as is_present
        from fx_pull_run_videos
        join (select source_id, max(run_id) as latest_run from fx_pull_run_videos group by source_id) using (source_id)
        group by source_id, video_id""",
    "incoming": """
        select cast(c_nationkey as bigint) as source_id, c_custkey as position, (c_custkey // 2) * 3 as video_id,
               case when c_custkey % 2 = 0 then c_name end as title,
               case when c_custkey % 2 = 1 then c_custkey % 600 end as duration_seconds,
               case when c_custkey % 5 <> 0 then c_custkey % 120 end as channel_id,
               case when c_custkey % 5 <> 1 then c_mktsegment end as channel_name,
               case when c_acctbal > 5000 then concat('@n', c_custkey) end as handle
        from customer""",
    "doc_words": r"""
        select * from (
          select doc_id as video_id, unnest(range(len(parts))) as ord, unnest(parts) as word
          from (select doc_id, string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' ') as parts
                from documents)) where word <> ''""",
    "words": """
        select video_id, ord, word, cast(400 * ord + 700 * (ord // 10) as double) / 1000 as start_s,
               cast(400 * ord + 700 * (ord // 10) + 350 as double) / 1000 as end_s from fx_doc_words""",
    "raw_words": """
        select video_id, ord, word, cast(400 * ord + 700 * (ord // 10) as double) / 1000 as start_s,
               cast(400 * ord + 700 * (ord // 10) + 100 + 60 * length(word) as double) / 1000 as end_s
        from fx_doc_words""",
    "placed": r"""
        with recursive a as (select *, lead(start_s) over (partition by video_id order by ord) as nxt,
            rtrim(word, '"''”’)]»') as bare from fx_words),
          f as (select *, nxt is null or (bare <> '' and instr('.?!…।؟。', right(bare, 1)) > 0) or nxt - end_s > 0.6 as hard,
                bare <> '' and instr(',;:，、', right(bare, 1)) > 0 as clause from a),
          i as (select *, coalesce(sum(case when hard then 1 else 0 end) over (partition by video_id order by ord
                rows between unbounded preceding and 1 preceding), 0) as isl from f),
          p as (select *, row_number() over (partition by video_id, isl order by ord) as pos from i),
          r as (select video_id, isl, pos, ord, word, start_s, end_s, ord as seg, hard as ends from p where pos = 1
            union all
            select p.video_id, p.isl, p.pos, p.ord, p.word, p.start_s, p.end_s,
              case when r.ends then p.ord else r.seg end,
              p.hard or p.ord - (case when r.ends then p.ord else r.seg end) + 1 >= 5
                or (p.clause and p.ord - (case when r.ends then p.ord else r.seg end) + 1 >= 2)
            from r join p on p.video_id = r.video_id and p.isl = r.isl and p.pos = r.pos + 1)
        select video_id, ord, word, start_s, end_s, seg from r""",
    "captions": """
        select video_id, seg, min(start_s) as start_s, max(end_s) as end_s, count(*) as n_words,
               string_agg(word, ' ' order by ord) as text from fx_placed group by video_id, seg""",
    "script_words": f"""
        select w.video_id, ord, start_s, end_s, lang,
               case when lang = 'fr' then translate(word, '{LATIN_LETTERS}', '{CYRILLIC_LETTERS}') else word end as word
        from fx_words w join documents on doc_id = w.video_id""",
    "doc_clips": """
        select video_id, ord, cast(s as double) / 1000 as start_time, cast(s + n as double) / 1000 as end_time,
               50 + (video_id * 31 + ord * 17) % 50 as viral_score
        from (select doc_id as video_id, ord, ord * 20000 + (doc_id * 137) % 9000 as s,
                     30000 + (doc_id * 71 + ord * 4099) % 30000 as n
              from (select doc_id, unnest(range(greatest(4, length(text) // 255) + 1)) as ord from documents))""",
    "clips": """
        select l_partkey as video_id, l_orderkey * 10 + l_linenumber as ord,
               cast(l_linenumber * 25 + l_orderkey % 40 as double) as start_time,
               cast(l_linenumber * 25 + l_orderkey % 40 + 20 as double) + l_quantity * 1.5 as end_time,
               cast(50 + l_quantity as bigint) as viral_score
        from lineitem""",
    "candidates": r"""
        select c.video_id, ord, case when ord = 0 then 0.0 else start_time end as start_time, start_time as clip_start,
               end_time, case when ord = 3 then 'n/a' when ord < 3 then concat(viral_score, '.9') end as viral_score,
               start_time - 2 + ord * 3 as hook_start_time, case when ord < 4 then start_time - 3 + ord * 5 end as hook_end_time,
               case when ord <> 2 then source end as hook_text, concat('“', text, '"') as on_screen_hook, text as title,
               lang as description_hook, case when ord = 1 then 'From the whole talk' end as description_context,
               case when ord <> 3 then regexp_replace(text, '[ \t\n\r\f]+', ' #', 'g') end as hashtags,
               '#One #one #2024 #Two-Three' as hashtag, case when ord <> 4 then string_split(text, '.') end as keyword_tags,
               case when ord = 1 then concat('https://tube.example/v/', c.video_id) end as source_url
        from fx_doc_clips c join documents on doc_id = c.video_id where ord < 5""",
    "manifest": f"""
        select l_orderkey as job_id, rank, case when l_returnflag = 'R' then 'failed' else 'success' end as status,
               case when l_linestatus = 'F' then 'uploaded' end as youtube_upload_status,
               case when l_linestatus = 'F' then concat('yt', l_orderkey, '-', l_linenumber) end as youtube_video_id,
               case when l_returnflag = 'A' then concat('ig', l_partkey) end as ig_container_id,
               case when l_returnflag = 'A' and l_linestatus = 'F' then concat('m', l_partkey) end as ig_media_id,
               case when l_returnflag = 'A' and l_linestatus = 'F' then l_shipdate end as ig_published_at,
               cast(50 + l_quantity as bigint) as viral_score, l_partkey as video_id,
               concat('/out/', l_orderkey, '/clip_', rank, '.mp4') as video_path,
               case when l_discount > 0.02 then concat('Clip of ', l_partkey) end as title,
               case l_linenumber % 5 when 1 then concat('Final ', l_orderkey) when 2 then '' end as youtube_title_final,
               l_quantity * 1.5 as duration
        from (select *, row_number() over (partition by l_orderkey order by {', '.join(LINE_ORDER[1:])}) as rank
              from lineitem)""",
    "files": "select video_path as path, (viral_score * 7919 + rank) % 23 as length from fx_manifest",
    "jobs": """
        select o_orderkey as job_id,
               case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'rendering' end as status,
               o_orderdate as created_at, concat('https://tube.example/v/', o_custkey) as url
        from orders""",
    "upload_queue": """
        select job_id, rank, case job_id % 4 when 0 then 'queued' when 1 then 'uploading' when 2 then 'failed'
               else 'uploaded' end as status,
               case when job_id % 50 <> 7
                    then strftime(timestamp '2024-01-01' + (job_id % 1000) * interval '1' minute, '%Y-%m-%d %H:%M:%S')
                    else 'soon' end as scheduled_at
        from fx_manifest where rank = 1""",
    "history": """
        select o_orderkey as video_id, o_orderdate + (o_orderkey % 24) * interval '1' hour as uploaded_at,
               o_orderpriority as title
        from orders where o_orderstatus = 'F'""",
    "performance": """
        select o_orderkey as video_id, o_custkey % 10 as channel_id,
               case o_orderstatus when 'F' then 'public' when 'O' then 'private' else 'unlisted' end as privacy,
               o_orderdate as published_at, o_orderdate + (o_orderkey % 240) * interval '1' hour as fetched_at,
               cast(floor(o_totalprice) as bigint) as views, o_orderpriority as title
        from orders""",
    "scheduled": """
        select o_orderkey as video_id, case o_orderstatus when 'F' then 'public' else 'private' end as privacy,
               case when o_orderpriority <> '5-LOW' then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') else '' end
                 as publish_at
        from orders""",
    "turns": """
        select conv_id as video_id, turn as ord,
               case when turn % 4 < 2 then 'SPEAKER_00' else 'SPEAKER_01' end as speaker,
               cast(1000 * turn + 50 * (said - n) as double) / 1000 as start_s,
               cast(1000 * turn + 50 * said + case turn % 3 when 0 then 0 when 1 then 700 else 2500 end as double)
                 / 1000 as end_s
        from (select conv_id, cast(turn as bigint) as turn, length(text) as n,
                     sum(length(text)) over (partition by conv_id order by turn) as said from conversations)""",
    "conv_clips": """
        select video_id, ord, cast(ord * 30000 + (video_id * 137) % 9000 as double) / 1000 as start_time,
               cast(ord * 30000 + (video_id * 137) % 9000 + 40000 as double) / 1000 as end_time
        from (select video_id, unnest(range(cast(greatest(2, floor(spoken)) as bigint) + 1)) as ord
              from (select conv_id as video_id, (max(turn) * 1000 + coalesce(sum(length(text)), 0) * 50) / 30000 as spoken
                    from conversations group by conv_id))""",
    "grid": """
        select video_id, ord, idx, idx * 0.5 :: double as rel_t, round(start_time + idx * 0.5 :: double, 3) as t
        from (select *, unnest(range(80)) as idx from fx_conv_clips)""",
    "event_order": """
        select user_id, ts, event_id, event_type, value,
               row_number() over (partition by user_id order by ts, event_id) as rn from events""",
    "faces": """
        select user_id as clip_id, rn as idx, event_type as track, cast(floor(value * 4) as bigint) as cx,
               case when event_type <> 'error' then value / 4000.0 end as mouth from fx_event_order""",
    "frame_faces": """
        select user_id as clip_id, (rn - 1) // 2 as idx, rn as face_no, event_type as track,
               cast(floor(value * 4) as bigint) as cx, concat('SPEAKER_0', event_id % 3) as speaker,
               value / 4000.0 as mouth
        from fx_event_order where event_type <> 'error'""",
    "samples": """
        select user_id as clip_id, (rn - 1) // 2 as idx,
               sum(case when event_type <> 'error' then 1 else 0 end) as faces,
               max(case when event_type <> 'error' then cast(floor(value * 4) as bigint) end) as cx,
               date_diff('day', date '2024-01-01', cast(min(ts) as date)) as scene
        from fx_event_order group by 1, 2""",
    "scenes": """
        select l_orderkey as clip_id, case when l_linenumber % 2 = 0 then 'hook' else 'highlight' end as section,
               cast(l_linenumber as bigint) as scene_idx, l_suppkey * 2 as source_id,
               case when l_quantity >= 5 then l_quantity end as start_s,
               case when l_quantity between 3 and 48 then l_quantity + l_discount * 100 - 2 end as end_s
        from lineitem""",
    "story_sources": """
        select s_suppkey as source_id, s_name as name,
               case s_nationkey % 6 when 0 then 'youtube' when 1 then 'tiktok' when 2 then 'instagram'
                 when 3 then 'gdrive' when 4 then 'local' else 'vimeo' end as platform,
               case when s_acctbal > 500 then concat('https://tube.example/s/', s_suppkey) end as url,
               case when s_acctbal > 2000 then concat('/media/', s_suppkey, '.mp4') end as local_path,
               cast(floor(s_acctbal * 1000) as bigint) as bytes
        from supplier""",
    "job_events": """
        select user_id as job_id, ts, event_id,
               case event_type when 'signup' then 'queue' when 'view' then 'download' when 'click' then 'transcribe'
                 when 'error' then 'analyze' else 'render' end as step,
               case event_type when 'signup' then 'queued' when 'view' then 'downloading' when 'click' then
                 'transcribing' when 'error' then 'failed' else 'completed' end as status,
               value as percent
        from events""",
    "links": "select page_id, url from pages",
}
