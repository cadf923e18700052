"""Hand-made cases; expected values follow from the documented rules."""

from datetime import datetime

from pyspark.sql import functions as F

from clipmart.operators import catalogue as cat
from clipmart.operators import clips as cl
from clipmart.operators import maintenance as mt
from clipmart.operators import publishing as pub
from clipmart.operators import romanise as ro
from clipmart.operators import speakers as sp
from clipmart.operators import transcript as tr
from clipmart.sources import files, ingest


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_score_and_start_fallbacks(spark):
    df = spark.createDataFrame([(1, "87.9"), (2, "n/a"), (3, None), (4, "60")], "id int, viral_score string")
    assert rows(df.select(cl.clip_score("viral_score"))) == [(87,), (0,), (0,), (60,)]
    cands = spark.createDataFrame(
        [(1, 0, 0.0, 5.0, None, 45.0)], "video_id int, ord int, start_time double, clip_start double, start double, end_time double"
    ).withColumns({"clip_end": F.lit(None).cast("double"), "end": F.lit(None).cast("double")})
    assert rows(cl._timed(cands, 30, 80).select("start_time", "end_time")) == [(5.0, 45.0)]


def test_source_without_links_counts_one_unused(spark):
    sources = spark.createDataFrame([(1, "playlist", "A")], "source_id int, source_type string, title string")
    links = spark.createDataFrame([], "source_id int, video_id int")
    status = spark.createDataFrame([], "video_id int, status string")
    got = cat.source_stats(sources, links, status).select("total_videos", "unused_count").collect()[0]
    assert tuple(got) == (0, 1)
    assert cat.source_stats(sources, links, status, strict=True).first()["unused_count"] == 0


def perf(spark, n, age_h=72):
    published = datetime(2024, 1, 1)
    data = [(i, 1, "public", published, datetime(2024, 1, 1 + age_h // 24, age_h % 24), 100 * i) for i in range(n)]
    return spark.createDataFrame(data, "video_id int, channel_id int, privacy string, published_at timestamp, fetched_at timestamp, views int")


def test_best_and_worst_needs_six(spark):
    assert pub.best_and_worst(perf(spark, 5), "2024-02-01").count() == 0
    assert pub.best_and_worst(perf(spark, 6), "2024-02-01").groupBy("side").count().orderBy("side").collect()[0]["count"] == 3
    assert {r["count"] for r in pub.best_and_worst(perf(spark, 9), "2024-02-01").groupBy("side").count().collect()} == {4}
    assert pub.best_and_worst(perf(spark, 9, 48), "2024-02-01").count() == 8
    assert pub.best_and_worst(perf(spark, 9, 24), "2024-02-01").count() == 0


def timed(spark, words, step=0.4, length=0.35, gaps=()):
    data, t = [], 0.0
    for i, w in enumerate(words):
        t += dict(gaps).get(i, 0.0)
        data.append((1, i, w, round(t, 3), round(t + length, 3)))
        t += step
    return spark.createDataFrame(data, "video_id int, ord long, word string, start_s double, end_s double")


def texts(df, order="seg"):
    return [r["text"] for r in df.orderBy(order).collect()]


def test_caption_breaks(spark):
    words = timed(spark, ["Well,", "now", "then,", "she", 'said."', "a", "b", "c", "d", "e", "f"])
    assert texts(tr.group_captions(words)) == ["Well, now then,", 'she said."', "a b c d e", "f"]
    # A pause of up to 0.6 s does not break, a longer one does.
    pause = timed(spark, ["a", "b", "c"], step=0.5, length=0.5, gaps=[(1, 0.59), (2, 0.61)])
    assert texts(tr.group_captions(pause)) == ["a b", "c"]


def test_small_buckets_give_the_same_result(spark, monkeypatch):
    """Results do not depend on where keys and islands are cut."""
    from clipmart.functions import folds, ordered

    words = ["w%d%s" % (i, {3: ",", 5: ",", 11: "."}.get(i % 13, "")) for i in range(150)] + ["x" * (i % 4 + 1) for i in range(120)]
    data = timed(spark, words, gaps=[(i, 0.9) for i in range(40, 140, 17)])
    clips = spark.createDataFrame(
        [(1, i, 2.0 + 9 * i, 34.3 + 9.7 * i, 3.1 + 9 * i, 7.7 + 9 * i) for i in range(6)],
        "video_id int, ord int, start_time double, end_time double, hook_start_time double, hook_end_time double",
    ).withColumn("keep_segments", F.expr("array(named_struct('start_time', start_time, 'end_time', start_time + 12), named_struct('start_time', start_time + 14, 'end_time', end_time))"))
    turns = spark.createDataFrame(
        [(1, i, f"S{i // 2 % 2}", i * 2.0, i * 2.0 + 1.4 + (i % 3) * 0.3) for i in range(60)],
        "video_id int, ord long, speaker string, start_s double, end_s double",
    )
    series = spark.createDataFrame([(1, i, (i * i) % 7 // 3) for i in range(90)], "clip_id int, idx long, value int")

    def everything():
        return [
            rows(tr.group_captions(data), "seg"),
            rows(tr.transcript_lines(data), "line"),
            rows(tr.speech_sessions(data), "burst"),
            rows(tr.chunk_words(data), "chunk"),
            rows(tr.clamp_word_overlaps(data).select("ord", "end_s"), "ord"),
            rows(cl.snap_clips_to_words(clips, data), "ord"),
            rows(cl.merge_segments(clips), "start_time"),
            rows(sp.merge_turns(turns), "turn"),
            rows(sp.confirmed_runs(series, 3), "idx"),
        ]

    whole = everything()
    monkeypatch.setattr(ordered.position_bucket, "__defaults__", (7,))
    monkeypatch.setattr(ordered.time_bucket, "__defaults__", (5.0,))
    monkeypatch.setattr(folds, "PIECE", 4)
    assert everything() == whole


def test_scan_equals_plain_windows(spark):
    """Null keys, null order values, ties in the key, one large key: as one window over each key gives it."""
    import random

    from pyspark.sql import Window

    from clipmart.functions.ordered import position_bucket, scan

    dealt = random.Random(1)
    data = [(dealt.choice([None, 1, 2, 3]), dealt.choice([None, *range(40)]), i, dealt.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(data, "k long, o long, id long, v long").union(spark.range(20000).selectExpr("9L", "id div 3", "id", "if(id % 7 = 0, id, null)"))
    w = Window.partitionBy("k").orderBy("o", "id")
    upto, earlier, onward = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, 9)
    own = {
        "prev_v": F.lag("v").over(w), "next_v": F.lead("v").over(w), "a": F.last("v", True).over(upto), "b": F.last("v", True).over(earlier),
        "c": F.max("v").over(earlier), "s": F.coalesce(F.sum("v").over(upto), F.lit(0)), "n": F.row_number().over(w).cast("long"),
    }
    want = df.select("*", *[c.alias(n) for n, c in own.items()], F.first("v", True).over(onward).alias("f10"))
    v = F.col("v")
    got = scan(
        df, ["k"], position_bucket("o", 7), ["o", "id"], lag=["v"], lead=["v"], run_last={"a": v}, prior_last={"b": v}, prior_max={"c": v},
        run_sum={"s": v}, next_first={"f": v}, ordinal="n",
    )
    assert got.select(want.columns[:-1]).exceptAll(want.drop("f10")).count() == 0 and got.count() == want.count()
    both = got.join(want.select("id", "k", "f10"), ["id", "k"])
    assert both.filter("f10 is not null and f10 <> f").count() == 0


def test_captions_partition_the_words(spark):
    words = timed(spark, ["a,", "b", "c;", "d."] * 40)
    assert " ".join(texts(tr.group_captions(words))) == " ".join(r["word"] for r in words.orderBy("ord").collect())


def test_words_know_what_comes_behind(spark, monkeypatch):
    from clipmart.functions import folds

    monkeypatch.setattr(folds, "PIECE", 6)
    words = timed(spark, ["w%d%s" % (i, {3: ",", 8: "."}.get(i % 9, "")) for i in range(60)], gaps=[(20, 0.9), (41, 0.4)])
    clips = spark.createDataFrame([(1, 0, 3.0, 20.0), (1, 1, 15.0, 90.0)], "video_id int, ord int, start_time double, end_time double")
    placed = tr.caption_positions(words)
    looked_up = tr.word_cues(placed.drop("next_start_s", "next_seg"), clips)
    told = tr.word_cues(placed, clips).select(*looked_up.columns)
    assert told.exceptAll(looked_up).count() == 0 and told.count() == looked_up.count() > 0


def clip_table(spark, data):
    return spark.createDataFrame(data, "video_id int, ord int, start_time double, end_time double, viral_score int")


def test_overlap_selection(spark):
    three = clip_table(spark, [(1, 0, 0.0, 40.0, 80), (1, 1, 5.0, 45.0, 80), (1, 2, 10.0, 50.0, 80)])
    assert [r["ord"] for r in cl.drop_overlapping_clips(three).collect()] == [0]
    edge = clip_table(spark, [(1, 0, 0.0, 40.0, 90), (1, 1, 30.0, 70.0, 80), (1, 2, 60.0, 60.0, 70)])
    assert sorted(r["ord"] for r in cl.drop_overlapping_clips(edge).collect()) == [0, 1, 2]


def test_overlap_selection_equals_one_greedy_pass(spark):
    data = [(1, i, float((i * 37) % 4000), float((i * 37) % 4000 + 20 + i % 30), (i * 13) % 50) for i in range(300)]
    data += [(2, i, float(i * 10), float(i * 10 + 25), i) for i in range(20)] + [(3, 0, 5.0, 5.0, 9), (3, 1, 7.0, 3.0, 9), (3, 2, 1.0, 9.0, 9), (None, 0, 1.0, 9.0, 1)]
    kept = set()
    for video in (1, 2, 3, None):
        own = []
        for _, i, s, e, v in sorted((r for r in data if r[0] == video), key=lambda r: (-r[4], r[1], r[2], r[3])):
            share = [(min(e, b) - max(s, a)) / min(e - s, b - a) if min(e, b) > max(s, a) and min(e - s, b - a) > 0 else 0 for a, b in own]
            if not any(x > 0.25 for x in share):
                own.append((s, e))
                kept.add((video, i))
    got = cl.drop_overlapping_clips(clip_table(spark, data)).collect()
    assert {(r["video_id"], r["ord"]) for r in got} == kept and len(got) == len(kept)


def test_merge_segments_touching_and_contained(spark):
    segs = clip_table(spark, [(1, 0, 5.0, 9.0, 0), (1, 1, 0.0, 5.0, 0), (1, 2, 6.0, 7.0, 0), (1, 3, 9.5, 10.0, 0)])
    assert rows(cl.merge_segments(segs), "start_time") == [(1, 0.0, 9.0), (1, 9.5, 10.0)]


def test_metadata_text(spark):
    df = spark.createDataFrame(
        [("#Joe-Rogan #2024 #joerogan " + " ".join(f"#t{i}" for i in range(20)), "“Big #x news”", ["A b", "a  B", "c"])],
        "hashtags string, on_screen_hook string, keyword_tags array<string>",
    ).withColumns({c: F.lit("") for c in ("hashtag", "hook_text", "title", "description_hook", "description_context", "source_url")})
    out = cl.clip_metadata_text(df).first()
    assert out["hashtags"].startswith("#JoeRogan #t0") and out["n_hashtags"] == 15
    assert out["on_screen_hook"] == "Big news" and out["keyword_tags"] == ["A b", "c"]


def test_snapping_edges(spark):
    words = timed(spark, ["One", "two", "three."], step=1.0, length=0.5)
    words = words.withColumns({"start_s": F.col("start_s") + 2, "end_s": F.col("end_s") + 2})
    clips = spark.createDataFrame(
        [(1, 0, 0.5, 4.3), (1, 1, 3.2, 99.0), (9, 0, 1.0, 2.0)], "video_id int, ord int, start_time double, end_time double"
    ).withColumns({"hook_start_time": F.lit(None).cast("double"), "hook_end_time": F.lit(None).cast("double"), "keep_segments": F.lit(None).cast("array<struct<start_time: double, end_time: double>>")})
    got = {(r["video_id"], r["ord"]): (r["start_time"], r["end_time"]) for r in cl.snap_clips_to_words(clips, words).collect()}
    # Before the first word: its start less the lead-in. After the last: its end plus the tail.
    assert got == {(1, 0): (1.88, 4.85), (1, 1): (2.88, 4.85), (9, 0): (1.0, 2.0)}


def test_overlapping_words_are_looked_up_exactly(spark):
    data = [(1, 0, "a.", 1.0, 1.6), (1, 1, "b", 1.2, 1.7), (1, 2, "c", 3.0, 3.3)]
    words = spark.createDataFrame(data, "video_id int, ord long, word string, start_s double, end_s double")
    clips = spark.createDataFrame([(1, 0, 0.0, 2.0)], "video_id int, ord int, start_time double, end_time double")
    # End 2.0 is after "b"; the sentence end "a." (1.6) is found through the word at 1.55, which is "b".
    assert cl.finish_sentence(clips, words, min_s=0.5).first()["end_time"] == 2.05


def test_queue_slots(spark):
    queue = spark.createDataFrame(
        [(1, 1, "queued", "2024-01-01 10:00:00"), (2, 1, "failed", "soon")], "job_id int, rank int, status string, scheduled_at string"
    )
    manifest = spark.createDataFrame(
        [(1, 1, "success", "a", "/a"), (2, 1, "success", None, "/b"), (3, 1, "failed", "c", "/c")],
        "job_id int, rank int, status string, title string, video_path string",
    )
    named = manifest.withColumn("youtube_title_final", F.when(F.col("job_id") == 1, "Edited"))
    assert pub._display_title(named) is not None and named.select(pub._display_title(named)).first()[0] == "Edited"
    refs = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 2), (2, 1, 3)], "job_id int, rank int, ord int")
    out = pub.enqueue_slots(queue, refs, manifest, "2024-01-01 09:00:00", 30).orderBy("ord").collect()
    assert [(r["job_id"], r["scheduled_at"].strftime("%H:%M"), r["title"]) for r in out] == [(2, "10:00", "Clip 1"), (2, "10:30", "Clip 1")]
    empty = pub.enqueue_slots(queue.filter("false"), refs, manifest, "2024-01-01 09:00:00", 30).orderBy("ord").first()
    assert empty["scheduled_at"].strftime("%H:%M") == "09:00"


def test_global_order_of_any_key(spark):
    data = [("b", 1), (None, 2), ("a", 5), ("a", None), ("c", 0)] * 50
    df = spark.createDataFrame(data, "job_id string, rank int")
    out = pub.in_order(df, ["job_id", "rank"]).orderBy("i").collect()
    assert [r["i"] for r in out] == list(range(1, 251))
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)
    assert [(r["job_id"], r["rank"]) for r in out] == sorted(data, key=key)


def test_tables_keep_their_columns(spark):
    sources = spark.createDataFrame([("k", 7, "playlist", "Old")], "source_key string, source_id long, source_type string, title string")
    sources = sources.withColumns({"last_pulled_at": F.lit("x"), "created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})
    out = mt.upsert_sources(sources, spark.createDataFrame([("k", "New", 0)], "source_key string, title string, ord int"), "2024-01-01").first()
    assert (out["source_id"], out["last_pulled_at"], out["title"]) == (7, "x", "New")


def test_snapshot_job_writes_all_tables(spark):
    from clipmart.plans.snapshot import apply_playlist_pull

    stamps = {"created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")}
    make = spark.createDataFrame
    tables = {
        "channels": make([(1, "One", None, None)], "channel_id long, name string, url string, handle string").withColumns(stamps),
        "videos": make([(10, "Old")], "video_id long, title string").withColumns(stamps),
        "video_status": make([(10, "used")], "video_id long, status string").withColumn("updated_at", F.lit(None).cast("timestamp")),
        "pull_run_videos": make([], "run_id long, source_id long, video_id long, position int"),
        "source_videos": make([(7, 10, 0, 1, 1, True, None, None, None, "manual"), (7, 99, 1, 1, 1, True, None, None, None, "manual")],
            "source_id long, video_id long, position int, first_seen_run long, last_seen_run long, is_present boolean, missing_since timestamp, last_seen_at timestamp, added_at timestamp, metadata_source string"),
        "pull_runs": make([(1, 7, "success")], "run_id long, source_id long, status string"),
        "sources": make([("k7", 7, "playlist", "Seven", None)], "source_key string, source_id long, source_type string, title string, url string").withColumns(stamps),
    }
    entries = make([(7, 0, 10, "Old", 1, "One", None, 2), (7, 1, 11, "New", 2, "Two", "@two", 2)],
        "source_id long, position int, video_id long, title string, channel_id long, channel_name string, handle string, run_id long")
    headers = make([("k7", "Seven again", "u", "3", "Owner", "o")], "source_key string, title string, url string, owner_channel_id string, owner_channel_name string, owner_channel_url string")
    out = apply_playlist_pull(tables, entries, "2024-06-01 00:00:00", headers)
    assert [(r["channel_id"], r["name"]) for r in out["channels"].orderBy("channel_id").collect()] == [(1, "One"), (2, "Two"), (3, "Owner")]
    assert [(r["video_id"], r["was_new"]) for r in out["videos"].orderBy("video_id").collect()] == [(10, False), (11, True)]
    assert [(r["video_id"], r["status"]) for r in out["video_status"].orderBy("video_id").collect()] == [(10, "used"), (11, "unused")]
    assert out["pull_run_videos"].count() == 2
    linked = {r["video_id"]: r for r in out["source_videos"].collect()}
    assert {v: r["is_present"] for v, r in linked.items()} == {10: True, 11: True, 99: False}
    assert {v: r["metadata_source"] for v, r in linked.items()} == {10: "playlist_pull", 11: "playlist_pull", 99: "manual"}
    runs = {r["run_id"]: r for r in out["pull_runs"].collect()}
    assert (runs[2]["status"], runs[2]["videos_found"], runs[2]["videos_added"], runs[2]["videos_missing"]) == ("success", 2, 1, 1)
    source = out["sources"].first()
    assert (source["source_id"], source["title"], source["last_pulled_at"] is not None) == (7, "Seven again", True)
    assert out["stats"].first()["videos_already_exists"] == 1


def test_tag_budget_skips_but_goes_on(spark):
    df = spark.createDataFrame([(["x" * 480, "y" * 40, "ab c", "ABC"], "#z")], "keyword_tags array<string>, hashtags string")
    out = pub.budgeted_tags(df).first()
    assert out["upload_tags"][1:] == ["ab c", "z"] and out["upload_tag_chars"] == 480 + 7 + 2


def test_non_latin(spark):
    df = spark.createDataFrame([(w,) for w in ["café", "नमस्ते", "مرحبا", "привет", "2024!"]], "word string")
    assert [r["word"] for r in ro.non_latin_words(df).collect()] == ["नमस्ते", "مرحبا", "привет"]


def test_turns_gap(spark):
    turns = spark.createDataFrame(
        [(1, 0, "A", 0.0, 2.0), (1, 1, "A", 2.5, 3.0), (1, 2, "A", 3.1, 2.9), (1, 3, "B", 3.0, 4.0)],
        "video_id int, ord long, speaker string, start_s double, end_s double",
    )
    assert rows(sp.merge_turns(turns).select("turn", "end_s"), "turn") == [(0, 2.0), (1, 2.9), (3, 4.0)]


def test_upsert_folds_a_batch(spark):
    current = spark.createDataFrame([(1, "Old", 10, datetime(2024, 1, 1), datetime(2024, 1, 1))], "video_id int, title string, duration_seconds int, created_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame([(1, None, 20, 0), (1, "New", None, 1), (2, None, None, 2)], "video_id int, title string, duration_seconds int, ord int")
    out = rows(mt.upsert_videos(current, batch, "2024-06-01").select("video_id", "title", "duration_seconds", "was_new"), "video_id")
    assert out == [(1, "New", 20, False), (2, "Untitled", None, True)]


def test_files(spark, tmp_path):
    shape = "a bigint, b string"
    assert files.read_json_rows(spark, str(tmp_path / "none.json"), shape).count() == 0
    (tmp_path / "bad.json").write_text("{ not json")
    assert files.read_json_rows(spark, str(tmp_path / "bad.json"), shape).count() == 0
    (tmp_path / "ok.json").write_text('[\n {"a": 1, "b": "x"},\n {"a": 2}\n]')
    assert rows(files.read_json_rows(spark, str(tmp_path / "ok.json"), shape), "a") == [(1, "x"), (2, None)]
    (tmp_path / "links.txt").write_text("# no\nhttps://youtu.be/abcdefghijk, https://x.example/1\nhttps://youtu.be/abcdefghijk?t=3\n")
    assert files.read_link_file(spark, str(tmp_path / "links.txt")).count() == 2


def test_candidate_shapes(spark):
    bodies = ['[{"title": "a"}, 7]', '{"highlights": [{"metadata": {"title": "b"}}]}', '{"title": "c"}', "sorry"]
    raw = spark.createDataFrame(list(enumerate(bodies)), "video_id int, payload string")
    got = rows(ingest.ingest_clip_candidates(raw).select("video_id", "title").filter("title is not null"), "video_id")
    assert got == [(0, "a"), (1, "b"), (2, "c")]


def test_candidates_from_answer_to_preview(spark):
    body = """[{"no": 3, "title": "A", "start_time": 1, "end_time": 50, "viral_score": "88", "account_classification": {"account_type": "tech"},
        "typography_plan": [{"word": "w", "style": "bold", "scale_level": "2"}]}, {"rank": 1, "title": "B", "start_time": 100, "end_time": 150}]"""
    cands = ingest.ingest_clip_candidates(spark.createDataFrame([(1, body)], "video_id int, payload string"))
    assert rows(cands.select("rank", "typography_plan.word"), "rank") == [("1", None), ("3", ["w"])]
    preview = cl.clip_preview(cl.normalize_clips(cands)).collect()
    assert [(r["rank"], r["title"], r["account"]) for r in preview] == [(1, "A", "tech")]


def test_link_files_in_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("https://youtu.be/aaaaaaaaaaa?t=1\n")
    (tmp_path / "b.txt").write_text("# longer, so it is read first\n" * 200 + "https://youtu.be/aaaaaaaaaaa?t=2\nhttps://youtu.be/bbbbbbbbbbb\n")
    links = files.read_link_file(spark, str(tmp_path)).collect()
    assert sorted(r["url"] for r in links) == ["https://youtu.be/aaaaaaaaaaa?t=1", "https://youtu.be/bbbbbbbbbbb"]


def test_recipe_rules_that_exploded_scenes_lose(spark):
    import json

    from clipmart.operators.story import recipe_validation

    scene = {"source_id": "a", "start": 1, "end": 2.5}
    clips = [
        {"clip_id": 1, "title": "t", "hook": {"scenes": []}, "highlight": {"scenes": []}},
        {"clip_id": 2, "title": "t", "hook": {"scenes": [scene]}, "highlight": {"scenes": [scene | {"start": "x"}]}},
        {"clip_id": 2, "title": "t", "hook": {"scenes": [scene]}, "highlight": {"scenes": [scene | {"start": None, "end": None}]}},
        {"clip_id": "3", "title": "t", "hook": {"scenes": [scene]}, "highlight": {"scenes": [scene | {"start": None}, {"start": 1, "end": 2}]}},
        {"clip_id": 4, "hook": {"scenes": [scene | {"start": -1}]}, "highlight": {"scenes": [scene | {"end": 1}, scene | {"source_id": "b"}]}},
    ]
    recipes = spark.createDataFrame([(json.dumps({"clips": clips}),), ('{"clips": []}',)], "payload string")
    sources = spark.createDataFrame([("a", "n", "youtube", "u", None)], "source_id string, name string, platform string, url string, local_path string")
    got = sorted(tuple(r) for r in recipe_validation(sources, recipes).collect())
    assert got == sorted([
        ("recipe: no clips", "?"), ("clip: no hook scenes", "1"), ("clip: no highlight scenes", "1"), ("clip: duplicate id", "2"),
        ("scene: time is no number", "2/highlight/0"), ("clip: id is no integer", "3"), ("scene: only one time", "3/highlight/0"),
        ("scene: no source", "3/highlight/1"), ("clip: missing field", "4"),
        ("scene: negative start", "4/hook/0"), ("scene: end before start", "4/highlight/0"), ("scene: unknown source", "4/highlight/1"),
    ])


def test_metadata_of_long_texts_equals_that_of_the_whole(spark):
    """First words are enough where they fill the limits; where they do not, the whole text counts."""
    import re

    texts = [
        "", "  one  ", "\u2003" * 300 + "late", "a " * 400, "x" * 500, " ".join(f"w{i}" for i in range(300)), "#a " * 200 + "tail of it " * 30,
        " ".join(["Same", "same"] * 200 + [f"n{i}" for i in range(40)]), "12 34 " * 100 + "five six", '"" ' * 60 + '“quoted” #x ' + "word " * 50,
        "\"'“" * 60 + " said, " + "then-some " * 40 + "”", "é\t\n— " * 120 + "ends,;",
    ]
    items = [[], ["a"] * 50 + ["B", "b", " c "], [f"k{i}" for i in range(60)], ["", " "] * 40 + [f"k{i % 9}" for i in range(20)], None]
    rows = [(i, t, items[i % len(items)]) for i, t in enumerate(texts)]
    shape = "i int, t string, keyword_tags array<string>"
    extra = {c: F.lit(None).cast("string") for c in ("hook_text", "description_hook", "description_context", "hashtag", "source_url")}
    df = spark.createDataFrame(rows, shape).withColumns({"title": F.col("t"), "on_screen_hook": F.col("t"), "hashtags": F.col("t"), **extra})
    blank = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    squash = lambda v: re.sub(blank, " ", v).strip(" ")

    def firsts(values, limit):
        seen = {}
        for v in values:
            seen.setdefault(v.lower(), v)
        return list(seen.values())[:limit]

    for r in cl.clip_metadata_text(df).collect():
        t = squash(r.t)
        head = t[:100]
        assert r.title == (t if len(t) <= 100 else (head.rpartition(" ")[0] if " " in head else head).strip(" ")), r.t
        hook = " ".join(w for w in squash(t.strip("\"'“”‘’")).split(" ") if not w.startswith("#"))
        head = hook[:42]
        cut = (head.rpartition(" ")[0] if " " in head else head).rstrip(",;:-–— ")
        assert r.on_screen_hook == (hook if len(hook) <= 42 else cut or head), r.t
        bodies = ["".join(c for c in w if c.isalnum() or c == "_") for w in t.split(" ")]
        tags = firsts([b for b in bodies if b and not b.isdecimal()], 15)
        assert r.hashtags == " ".join("#" + b for b in tags) and r.n_hashtags == len(tags), r.t
        assert r.keyword_tags == firsts([squash(k) for k in items[r.i % len(items)] or [] if squash(k)], 8)


def test_first_words_are_whole(spark):
    from clipmart.functions import text as tx

    cases = {" a bb  ccc d": " a bb  ", "one": "", "a b": "a ", "\u3000x\u2028y z": "\u3000x\u2028y ", "": "", None: ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.f for r in df.select("t", tx.first_words("t", 2).alias("f")).collect()} == cases


def test_caption_segments_are_cleaned_in_order(spark):
    import json

    from clipmart.sources import ingest

    said = ["- hi", " - ", "\u200b-\n x", "- <i></i>", ">♪> a", ">> - b", "[Music] c\u3000\u2003d", "<b>[x</b>]", "e ", None]
    events = [{"tStartMs": 1000 * i, "dDurationMs": 900, "segs": [{"utf8": u, "tOffsetMs": 0}]} for i, u in enumerate(said)] + [{"tStartMs": 5}]
    df = spark.createDataFrame([("v", json.dumps({"events": events})), ("none", "{}")], "video_id string, payload string")
    rows = sorted(ingest.words_from_json3(df).collect(), key=lambda r: r.ord)
    assert [r.word for r in rows] == ["hi", "-", "x", ">>", "a", "b", "c", "d", "e"]
    assert [r.ord for r in rows] == list(range(9)) and [r.start_s for r in rows] == [0.0, 1.0, 2.0, 4.0, 4.45, 5.0, 6.0, 6.45, 8.0]
