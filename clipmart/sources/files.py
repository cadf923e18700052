"""File readers and writers: JSON rows, Parquet tables, CSV and snapshot exports."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmart.functions.ordered import scan
from clipmart.operators import catalogue as cat
from clipmart.session import ensure_checkpoint_dir, kept
from clipmart.sources import ingest

def read_json_rows(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON array files as rows; a missing path or unreadable content gives no rows.

    With ``multi_line`` off, each line holds an object or an array of objects, and large
    files are split between tasks.
    """
    try:
        text = spark.read.text(path, wholetext=multi_line)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    rows = text.select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("r"))
    return rows.filter("r is not null").select("r.*")


def write_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a result table; the commit protocol publishes the files together."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_link_file(spark: SparkSession, path: str) -> DataFrame:
    """Links of one or more text files; the first link of a video by file path and line wins."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return ingest.read_links(spark.read.text(path).select("value", place.alias("line_no")))


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def split_payloads(spark: SparkSession, path: str, field: str = "clips") -> DataFrame:
    """(file_path, part, payload): JSON files cut into one payload for each object of the root's array *field*.

    A small file (``WHOLE_BYTES``) is cut by the task that reads it, and nothing but its payloads is handed on. A larger one is read by as many tasks
    as it has blocks: the text reader cuts it at closing braces, wherever they stand. Quotes
    are counted along a file, which tells strings from structure; brackets outside strings are, which gives the depth behind each brace;
    and braces that return to the depth of the array end its objects. The fragments of one object come together, and what stands before and
    behind the array is put around each. An object that is no valid JSON spoils its own payload only, as long as its brackets match. Files
    without such objects are one payload. Missing paths give no rows.
    """
    try:
        text, whole = spark.read.option("lineSep", "}").text(path), spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PAYLOAD)
    limit = min(WHOLE_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = F.col("_metadata.file_size")
    small = whole.filter(size <= limit).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").cast("binary").alias("value")).mapInArrow(_cut_whole(field), PAYLOAD)
    large = text.filter(size > limit)
    return small if large.isEmpty() else small.unionByName(_cut_in_blocks(large, field))


PAYLOAD = "file_path string, part bigint, payload string"
#: A file of at most so many bytes (and no more than a block) is cut by the task that reads it.
WHOLE_BYTES = 16 << 20


def cut_payloads(text: str, field: str) -> Iterator[str]:
    """One text cut into a payload for each object of the root's array *field*, in one pass over its strings and brackets."""
    depth, at, head, objects = 0, 0, None, []
    name, opening = f'"{field}"', re.compile(r"\s*:\s*\[(?=\s*\{)")
    for token in re.finditer(r'"[^"\\]*(?:\\.[^"\\]*)*"?|[{}\[\]]|\\.', text, re.S):
        c = text[token.start()]
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if head is None:
                continue
            if c == "}" and depth == 2:
                objects.append(text[at : token.start()].lstrip(" \t\n\r\f\v,"))
                at = token.end()
            elif depth == 1:
                break
        elif head is None and depth == 1 and token.group() == name and (found := opening.match(text, token.end())):
            at = found.end()
            head = text[:at]
    if not objects:
        yield text
    tail = text[at:] or "]}"
    for own in objects:
        yield f"{head}{own}}}{tail}"


def _cut_whole(field: str):
    """Batches of (file_path, value) → batches of payloads, each of some megabytes."""

    def cut(batches):
        import pyarrow as pa

        def batch_of(path, first, payloads):
            columns = [pa.array([path] * len(payloads), pa.string()), pa.array(range(first, first + len(payloads)), pa.int64()), pa.array(payloads, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["file_path", "part", "payload"])

        for batch in batches:
            for path, value in zip(batch.column(0), batch.column(1)):
                text, done, held, size = value.as_py().decode("utf-8", "replace"), 0, [], 0
                for payload in cut_payloads(text, field) if text else ():
                    held.append(payload)
                    size += len(payload)
                    if size > 1 << 22:
                        yield batch_of(path.as_py(), done, held)
                        done, held, size = done + len(held), [], 0
                if held:
                    yield batch_of(path.as_py(), done, held)

    return cut


def _cut_in_blocks(text: DataFrame, field: str) -> DataFrame:
    """Files that several tasks read, as (file_path, part, payload); *text* holds what stands before each closing brace."""
    keys, order = ["file_path"], ["block", "row"]
    placed = text.select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    bare = F.regexp_replace("value", r"\\(?s:.)", "")
    # The text is written out once each time, without what follows from it.
    counted = kept(placed.withColumn("quotes", F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))))
    bucket = {"_block": F.col("block"), "_rows": F.shiftright("row", 12)}
    quoted = scan(counted, keys, bucket, order, run_sum={"seen": F.col("quotes")})
    inside, closed = (F.col("seen") - F.col("quotes")) % 2 == 1, F.col("seen") % 2 == 0
    # Strings become empty ones, the field's opening becomes a mark and a bracket.
    opening = rf'"{field}"\s*:\s*\['
    marked = F.regexp_replace(bare, opening, f"{_MARK}[")
    code = F.regexp_replace(F.when(inside, F.regexp_replace(marked, '^[^"]*"?', "")).otherwise(marked), '"[^"]*(?:"|$)', '""')
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    net = lambda text: count(text, "{") + count(text, "[") - count(text, "]")
    coded = quoted.withColumns({"code": code, "closed": closed})
    deep = kept(scan(
        coded.withColumn("step", net(F.col("code")) - F.col("closed").cast("int")).drop("code", "closed"), keys, bucket, order,
        run_sum={"depth": F.col("step")},
    )).withColumns({"code": code, "closed": closed}).drop("quotes", "seen")
    before = F.col("depth") - F.col("step")
    # The depth at each mark: the array that is looked for lies in the root, and begins with an object.
    pieces = F.split("code", _MARK, -1)
    depths = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array(before.cast("int")), lambda d, t: F.array_append(d, F.element_at(d, -1) + net(t).cast("int"))
    )
    number = F.array_position(F.slice(depths, F.lit(2), F.size(depths)), 1).cast("int")
    fits = (number > 0) & F.get(pieces, number).rlike(r"^\[\s*\{")
    lengths = lambda found: F.aggregate(F.slice(found, F.lit(1), number), F.lit(0), lambda n, t: n + F.length(t))
    cut = lengths(F.split("value", opening, -1)) + lengths(F.regexp_extract_all("value", F.lit(opening), F.lit(0)))
    leaves = (before == 2) & F.col("code").rlike(r"^\s*\]")
    event = F.when(F.col("cut").isNotNull(), "in").when(leaves, "out")
    lasting = scan(
        deep.withColumn("cut", F.when(F.contains("code", F.lit(_MARK)), F.when(fits, cut))), keys, bucket, order,
        run_sum={"opened": F.col("cut").isNotNull().cast("int")}, run_last={"event": event},
    )
    ends = (F.col("opened") == 1) & (F.col("event") == "in") & F.col("closed") & (F.col("depth") == 2)
    numbered = scan(lasting.withColumn("ends", ends.cast("int")), keys, bucket, order, run_sum={"done": F.col("ends")})
    # The fragment of the opening belongs to both sides of it.
    whole, rest = F.struct(F.lit(0).alias("side"), F.col("value")), F.length("value")
    first = F.col("cut").isNotNull() & (F.col("opened") == 1)
    both = F.array(
        F.struct(F.lit(0).alias("side"), F.substring("value", F.lit(1), F.col("cut")).alias("value")),
        F.struct(F.lit(1).alias("side"), F.substring("value", F.col("cut") + 1, rest).alias("value")),
    )
    sided = numbered.select("*", F.explode(F.when(first, both).otherwise(F.array(whole))).alias("x"))
    outside = (F.col("opened") == 0) | (first & (F.col("x.side") == 0))
    parts = kept(
        sided.select("file_path", "block", "row", "depth", F.col("x.value").alias("value"), F.when(outside, -1).otherwise(F.col("done") - F.col("ends")).alias("part"), F.when(outside, 0).otherwise(F.col("ends")).alias("ends"))
        .groupBy("file_path", "part").agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("block", "row", "value")))["value"], "}").alias("text"), F.max("ends").alias("object"),
            F.max_by("depth", F.struct("block", "row")).alias("depth"),
        )
    )
    # The last brace of a file is no longer there; its depth tells whether there was one.
    finished = F.concat("text", F.when(F.col("depth") == 0, "}").otherwise(""))
    head = parts.filter("part = -1").select("file_path", F.col("text").alias("head"), finished.alias("whole"))
    tail = parts.filter("part >= 0 and object = 0").select("file_path", finished.alias("tail"))
    objects = parts.filter("object = 1").select("file_path", "part", F.regexp_replace("text", r"^[\s,]+", "").alias("own"))
    around = head.join(tail, "file_path", "left").select("file_path", "head", F.coalesce("tail", F.lit("]}")).alias("tail"))
    told = objects.join(around, "file_path").select("file_path", "part", F.concat("head", "own", F.lit("}"), "tail").alias("payload"))
    without = head.join(parts.filter("part >= 0"), "file_path", "left_anti").select("file_path", F.lit(0).cast("long").alias("part"), F.col("whole").alias("payload"))
    return told.unionByName(without)


#: Stands for the opening of the field's array in a text.
_MARK = "\x01"


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes as they are written, one file each (``payload``): rules that look at all clips of a recipe need it whole."""
    return _payloads(spark, path).select("payload")


def read_story_sources(spark: SparkSession, path: str) -> DataFrame:
    """Registered sources; a registry of any size is read by several tasks."""
    return ingest.story_sources(split_payloads(spark, path, "sources").select("payload"))


def read_story_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of recipes; a recipe of any size is read by several tasks, clip by clip."""
    return ingest.story_scenes(split_payloads(spark, path, "clips").select("payload"))


CSV_COLUMNS = (
    "video_id title url duration_seconds upload_date channel_name channel_url status used_at clip_title notes "
    "local_output_path published_url"
).split()


def videos_csv_rows(videos: DataFrame, status: DataFrame) -> DataFrame:
    """The thirteen columns of the video list, by title."""
    rows = cat.videos_with_status(videos, status)
    columns = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS]
    return rows.select(*columns).orderBy("title", "video_id")


def export_videos_csv(videos: DataFrame, status: DataFrame, path: str) -> None:
    videos_csv_rows(videos, status).write.mode("overwrite").option("header", True).csv(path)


def export_snapshot_json(
    sources: DataFrame, videos: DataFrame, channels: DataFrame, status: DataFrame, links: DataFrame, path: str
) -> None:
    """Statistics, sources and videos as three JSON datasets below *path*."""
    write_rows(cat.global_stats(sources, videos, channels, status), f"{path}/stats", "json")
    write_rows(cat.source_stats(sources, links, status), f"{path}/sources", "json")
    write_rows(cat.videos_with_status(videos, status).orderBy("title"), f"{path}/videos", "json")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")
