"""Streaming jobs over several files and triggers, in any order of arrival."""

import datetime as dt
import glob
import os
import random
import time

from pyspark.sql import functions as F

from clipmart.streaming import jobs

START = dt.datetime(2024, 1, 1)


def arrive(spark, folder, parts, shape):
    """One file for each part, in this order (the file source goes by modification time)."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(folder))
        for path in glob.glob(f"{folder}/*.parquet"):
            if os.path.getmtime(path) > time.time() - 3600 * 24 * 300:
                stamp = time.time() - 3600 * 24 * 365 + i
                os.utime(path, (stamp, stamp))


def events(n, jobs_=7, text_ids=False):
    dealt = random.Random(n)
    states = ["queued", "downloading", "transcribing", "transcribing", "completed", "failed"]
    key = (lambda k: f"job-{k}") if text_ids else (lambda k: k)
    return [
        (key(dealt.randrange(jobs_)), START + dt.timedelta(minutes=dealt.randrange(n)), i, states[min(dealt.randrange(40) // 8, 5)], float(dealt.randrange(3)))
        for i in range(n)
    ]


SHAPE = "job_id long, ts timestamp, event_id long, status string, percent double"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_latest_over_triggers_files_and_replays(spark, tmp_path):
    given = events(300)
    stream = lambda: jobs.read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    arrive(spark, tmp_path / "in", [given[200:], given[:100]], SHAPE)
    first = jobs.job_status(jobs.run_latest(stream(), str(tmp_path / "out"), ["job_id"]))
    assert rows_of(first) == rows_of(jobs.job_status(spark.createDataFrame(given[200:] + given[:100], SHAPE)))
    written = {p: os.path.getmtime(p) for p in glob.glob(f"{tmp_path}/out/data/*/*.parquet")}
    arrive(spark, tmp_path / "in", [given[100:200]], SHAPE)
    table = jobs.run_latest(stream(), str(tmp_path / "out"), ["job_id"])
    assert rows_of(jobs.job_status(table)) == rows_of(jobs.job_status(spark.createDataFrame(given, SHAPE)))
    # Three triggers, each with its own folder; the later ones left the earlier alone. A replayed batch changes nothing.
    assert len(glob.glob(f"{tmp_path}/out/data/batch=*")) == 3
    assert all(os.path.getmtime(p) == at for p, at in written.items())
    jobs._write(f"{tmp_path}/out")(table.limit(3), 99)
    again = jobs.last_per_key(jobs._batches(spark, f"{tmp_path}/out", table.schema).drop("batch"), ["job_id"], ["ts", "event_id"])
    assert rows_of(again) == rows_of(table)


def test_windows_are_sealed_and_evicted(spark, tmp_path):
    def at(hour):
        return (START + dt.timedelta(hours=hour),)

    parts = [[at(h) for h in range(0, 60)], [at(h) for h in range(58, 200)] + [at(59)], [at(199), at(3), at(150)]]
    arrive(spark, tmp_path / "in", parts, "ts timestamp")
    stream = jobs.read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    out = jobs.run_windows(jobs.publish_rate(stream, cap=20), str(tmp_path / "out"), ["start"])
    # Rows are late by the watermark that the trigger before last has left (hour 58): hour 3 is dropped, hour 150 is not.
    kept = parts[0] + parts[1] + [at(199), at(150)]
    want = {}
    for (ts,) in kept:
        for back in range(24):
            start = ts - dt.timedelta(hours=back)
            want[start] = want.get(start, 0) + 1
    got = {r.start: (r.n, r.remaining) for r in out.collect()}
    assert got == {s: (n, max(20 - n, 0)) for s, n in want.items()}
    state = spark.read.format("statestore").load(f"{tmp_path}/out/checkpoint")
    assert state.count() <= 25 < len(want)


def test_sessions_are_sealed_or_open(spark, tmp_path):
    shape = "video_id long, ord long, word string, start_s double, end_s double"
    def burst(v, first, n):
        return [(v, i, "w", first + i, first + i + 0.7) for i in range(n)]

    parts = [burst(1, 0.0, 5) + burst(2, 3.0, 2), burst(1, 4000.0, 4), burst(1, 4004.0, 2), burst(2, 4.0, 1)]
    arrive(spark, tmp_path / "in", parts, shape)
    stream = jobs.read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    out = jobs.run_sessions(jobs.speech_sessions(stream), str(tmp_path / "out"))
    # The late word of video 2 is dropped; the second burst of video 1 goes on in the third file and is still open.
    got = sorted((r.video_id, r.start_s, r.end_s, r.n_words, r.sealed) for r in out.collect())
    assert got == [(1, 0.0, 4.7, 5, True), (1, 4000.0, 4005.7, 6, False), (2, 3.0, 4.7, 2, True)]


def test_changes_do_not_depend_on_arrival(spark, tmp_path):
    given = sorted(events(240, text_ids=True), key=lambda e: e[1])
    dealt = random.Random(8)
    shape = SHAPE.replace("job_id long", "job_id string")
    want = rows_of(jobs.job_changes(spark.createDataFrame(given, shape)))
    # Events are dealt into files that overlap by less than the lateness, and each file is shuffled.
    parts = [[], [], [], []]
    for e in given:
        minute = (e[1] - START).total_seconds() / 60
        parts[min(3, max(0, int((minute + dealt.uniform(-25, 25)) // 60)))].append(e)
    for p in parts:
        dealt.shuffle(p)
    arrive(spark, tmp_path / "in", parts, shape)
    stream = jobs.read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    out = jobs.run_changes(jobs.job_changes_stream(stream, "1 hour"), str(tmp_path / "out"))
    assert rows_of(out.drop("sealed")) == want
    assert out.filter(F.col("sealed")).count() > 0 and dict(out.dtypes)["job_id"] == "string"


def test_streamed_tables_are_a_file_or_a_folder_of_files(spark, tmp_path):
    from clipmart.workload import registered

    texts = [(i, "One two. Three four five. " * (i + 1), "en", "s", 0) for i in range(4)]
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    arrive(spark, tmp_path / "folder" / "documents.parquet", [texts[:1], texts[1:3], texts[3:]], shape)
    arrive(spark, tmp_path / "parts", [texts], shape)
    os.makedirs(tmp_path / "file")
    os.rename(glob.glob(f"{tmp_path}/parts/*.parquet")[0], tmp_path / "file" / "documents.parquet")
    queries = registered()[0]
    for place in ("folder", "file"):
        found = queries["speech_sessions_stream"](spark, str(tmp_path / place))
        assert rows_of(found) == rows_of(queries["speech_sessions"](spark, str(tmp_path / place)).select(found.columns))
