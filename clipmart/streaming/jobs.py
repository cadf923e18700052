"""Structured Streaming jobs. Every transformation also runs on a batch DataFrame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructType

from clipmart.functions.ordered import last_per_key, scan
from clipmart.operators.transcript import PAUSE_S

TERMINAL = ("completed", "failed", "cancelled")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int | None = 100) -> DataFrame:
    """Parquet files arriving in *folder*; the batch size bounds what one trigger has to hold (none: one trigger takes all files there are)."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return source.parquet(folder)


def _run(stream: DataFrame, path: str, mode: str, write, state_store: str | None = None) -> None:
    """Process everything available; ``state_store`` holds for this query only."""
    spark, option = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(option)
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    try:
        spark.conf.set(option, state_store or before)
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(option, before)
    query.awaitTermination()


def _batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the batches wrote, with their number."""
    return spark.read.schema(schema.add("batch", LongType())).option("basePath", f"{path}/data").parquet(f"{path}/data")


def _write(path: str, change=lambda batch: batch):
    """Each batch has a folder of its own that a replay of the batch replaces, so it counts once however often it runs."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    return write


def run_once(stream: DataFrame, path: str, state_store: str | None = None) -> DataFrame:
    """Append what a stream emits, and return all that was written so far."""
    _run(stream, path, "append", _write(path), state_store)
    return _batches(stream.sparkSession, path, stream.schema).drop("batch")


def run_latest(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The last event of each key by *order*, from a table that no trigger rewrites.

    A trigger appends the last events of its own rows. Readers take the last of these: it does not matter in which order files
    arrive or whether a batch is replayed, and the stream keeps no state.
    """
    _run(stream, path, "append", _write(path, lambda batch: last_per_key(batch, keys, list(order))))
    return last_per_key(_batches(stream.sparkSession, path, stream.schema).drop("batch"), keys, list(order))


def run_windows(stream: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Windowed aggregates in update mode: a trigger appends the windows that it changed, readers take each one's last value.

    The watermark evicts windows that can no longer change, so the state holds the open ones only; open windows are in the table with what
    they hold so far. Rows behind the watermark are dropped.
    """
    _run(stream, path, "update", _write(path))
    return last_per_key(_batches(stream.sparkSession, path, stream.schema), keys, ["batch"]).drop("batch")


def job_status(events: DataFrame) -> DataFrame:
    """Latest status and progress of each job."""
    latest = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(
        F.max_by("status", latest).alias("status"), F.max_by("percent", latest).alias("percent"), F.max("ts").alias("updated_at")
    )


def pull_progress(events: DataFrame) -> DataFrame:
    """Progress of each pull run from (run_id, ts, event_id, current, total)."""
    latest = F.struct("ts", "event_id")
    runs = events.groupBy("run_id").agg(
        F.max_by("current", latest).alias("current"), F.max_by("total", latest).alias("total")
    )
    share = F.floor(F.try_divide(F.col("current") * F.lit(100), F.col("total")))
    return runs.withColumn("percent", F.when(F.col("total") > 0, share).otherwise(F.lit(0)))


def publish_rate(events: DataFrame, cap: int = 50, lateness: str = "1 hour") -> DataFrame:
    """Publishes in every 24-hour window (hourly slide) against the cap."""
    timed = events.withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", "24 hours", "1 hour")).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "n", F.greatest(F.lit(cap) - F.col("n"), F.lit(0)).alias("remaining")
    )


def daily_uploads(events: DataFrame, tz: str, lateness: str = "1 day") -> DataFrame:
    """Uploads per local calendar day."""
    local = events.withColumn("local_ts", F.from_utc_timestamp("ts", tz)).withWatermark("local_ts", lateness)
    return local.groupBy(F.window("local_ts", "1 day")).agg(F.count("*").alias("uploads")).select(
        F.to_date("window.start").alias("day"), "uploads"
    )


def speech_sessions(words: DataFrame, lateness: str = "10 minutes", begins: Column | None = None) -> DataFrame:
    """Speech bursts by session window: a word keeps its session open until its end plus the pause.

    *begins* is the instant in which a word's video starts; without it, all videos are taken to start together.
    """
    instant = lambda s: F.timestamp_millis(F.round(s * 1000).cast("long"))
    spoken = F.col("start_s") if begins is None else F.col("start_s") + F.unix_millis(begins) / 1000
    millis = F.round((F.col("end_s") - F.col("start_s") + PAUSE_S) * 1000).cast("long").cast("string")
    timed = words.withColumn("ts", instant(spoken)).withWatermark("ts", lateness)
    session = F.session_window("ts", F.concat(millis, F.lit(" milliseconds")))
    return timed.groupBy("video_id", session).agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n_words")
    ).drop("session_window")


def run_sessions(stream: DataFrame, path: str) -> DataFrame:
    """Sessions of ``speech_sessions``, appended once the watermark has sealed them, and the ones still open, read from the state."""
    sealed = run_once(stream, path).withColumn("sealed", F.lit(True))
    state = stream.sparkSession.read.format("statestore").load(f"{path}/checkpoint")
    still_open = state.select("value.video_id", F.col("value.min").alias("start_s"), F.col("value.max").alias("end_s"), F.col("value.count").alias("n_words"))
    return sealed.unionByName(still_open.withColumn("sealed", F.lit(False)))


def performance_refresh(history: DataFrame, clips: DataFrame) -> DataFrame:
    """New upload-history rows with their clip's details (stream-static join)."""
    return history.join(clips, "video_id", "left")


# ---- changes ---------------------------------------------------------------------------
def _state_text() -> Column:
    return F.concat_ws("|", "status", F.col("percent").cast("string"))


def job_changes(events: DataFrame) -> DataFrame:
    """Events whose state differs from the previous one of the job, up to its first terminal state."""
    return _changed(events.withColumn("state", _state_text())).select("job_id", "event_id", "status", "percent")


def _changed(rows: DataFrame) -> DataFrame:
    bucket = {"_day": F.to_date("ts")}
    over = F.when(F.col("status").isin(*TERMINAL), F.lit(1))
    seen = scan(rows, ["job_id"], bucket, ["ts", "event_id"], lag=["state"], prior_last={"_over": over})
    return seen.filter("_over is null and (prev_state is null or prev_state <> state)")


class _Changes(StatefulProcessor):
    """Per job: the events that the watermark has not passed, the last state sent, and whether the job has ended.

    Events wait until the watermark passes them and are then judged in time order, whenever they arrived.
    """

    def __init__(self, held: StructType):
        self.shape = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.shape)
        self.sent = handle.getValueState("sent", "state string, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        if self.sent.exists() and self.sent.get()[1]:
            return iter(())
        fresh = [tuple(r) for batch in rows for r in batch[self.shape.names].astype(object).itertuples(index=False)]
        if fresh:
            self.held.appendList(fresh)
            self._wake(fresh)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(r) for r in self.held.get()), key=lambda r: (r[0], r[1]))
        ready = [r for r in waiting if self._millis(r) < watermark]
        later = waiting[len(ready) :]
        last, over = self.sent.get() if self.sent.exists() else (None, False)
        out = []
        for _, event_id, status, percent, state in ready:
            if not over and state != last:
                out.append((key[0], event_id, status, percent))
            last, over = (last, over) if over else (state, status in TERMINAL)
        if ready:
            self.sent.update((last, over))
        self.held.clear()
        if later and not over:
            self.held.put(later)
            self._wake(later)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "event_id", "status", "percent"])

    def _wake(self, rows) -> None:
        # One millisecond on: the watermark has then passed the event itself.
        self.handle.registerTimer(min(self._millis(r) for r in rows) + 1)

    @staticmethod
    def _millis(row) -> int:
        import pandas as pd

        return pd.Timestamp(row[0]).value // 1_000_000

    def close(self) -> None:
        pass


HELD = ("ts", "event_id", "status", "percent", "state")


def job_changes_stream(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """``job_changes`` as a stateful stream: run it with ``run_changes``.

    Files may arrive in any order, as long as an event is at most *lateness* behind the latest one seen; ids keep the type they have.
    """
    rows = events.select(
        "job_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status", F.col("percent").cast("double").alias("percent"),
        _state_text().alias("state"),
    )
    held = StructType([rows.schema[c] for c in HELD])
    out = StructType([rows.schema[c] for c in ("job_id", "event_id", "status", "percent")])
    return rows.withWatermark("ts", lateness).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Changes(held), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def run_changes(stream: DataFrame, path: str) -> DataFrame:
    """Changes that the watermark has passed, and those of events that still wait, judged from the state."""
    spark = stream.sparkSession
    passed = run_once(stream, path, ROCKSDB).withColumn("sealed", F.lit(True))

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(f"{path}/checkpoint")

    sent = state("sent").select(
        F.col("key.job_id").alias("job_id"), F.lit(None).cast("timestamp").alias("ts"), F.col("value.state").alias("state"),
        F.when(F.col("value.over"), TERMINAL[0]).alias("status"),
    )
    waiting = state("held").select("key.job_id", "list_element.*")
    # What was sent last stands before the waiting events.
    rows = waiting.unionByName(sent, allowMissingColumns=True)
    late = _changed(rows).filter("ts is not null").select("job_id", "event_id", "status", "percent")
    return passed.unionByName(late.withColumn("sealed", F.lit(False)))
