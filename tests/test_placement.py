"""Words stay where their text was put."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clipmart.workload import registered
from clipmart.workload.tables import CYRILLIC_LETTERS, LATIN_LETTERS, Tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts of 1 to 700 words, one without id, one id twice, one without text."""
    path = str(tmp_path_factory.mktemp("texts"))
    texts = [(i, " ".join(f"w{k}{'.' if k % 17 == 16 else ''}" for k in range(1 + i * 70)), "fr" if i % 2 else "en") for i in range(11)]
    rows = [*texts, (None, "no id here.", "fr"), (3, "once more, twice.", "en"), (20, None, "fr")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns(
        {"source": F.lit("s"), "n_chars": F.length("text").cast("long")}
    ).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def moved(df) -> list[str]:
    """Shuffles that the plan adds, apart from that of the texts and of single summaries."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ENSURE_REQUIREMENTS" in line]


@pytest.mark.parametrize(
    "name",
    ["group_captions", "caption_hold", "transcript_lines", "chunk_words", "speech_sessions", "clamp_word_overlaps", "speech_coverage"],
)
def test_words_are_not_shuffled(spark, folder, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = moved(registered()[0][name](spark, folder))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Entry states of captions come from a written table, videos of a coverage from the documents: both are small.
    words = [line for line in plan if "ord" in line or "_cell_b" in line or "line" in line or "chunk" in line or "burst" in line]
    assert words == [], words


@pytest.mark.parametrize(
    "name", ["caption_cues", "choose_window_transcript", "interval_overlap_join", "clip_text", "non_latin_words"]
)
def test_captions_meet_clips_and_windows_where_their_words_are(spark, folder, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = moved(registered()[0][name](spark, folder))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Rows that would move by more than the video's stand-in carry words, pieces or captions.
    rows = [line for line in plan if any(c in line for c in ("_level", "window_no", "ord#", "seg#", "_cell_b"))]
    assert rows == [], rows


def test_texts_lie_in_partitions_of_bounded_size(spark, folder, monkeypatch):
    from clipmart.workload import tables

    monkeypatch.setattr(tables, "PART_BYTES", 256)
    t = Tables(spark, folder)
    size = t.raw("documents").agg(F.sum(F.octet_length("text"))).first()[0]
    assert t.texts.rdd.getNumPartitions() == -(-size // 256)


def test_languages_meet_words_as_in_a_join(spark, folder):
    t = Tables(spark, folder)
    lang = t.documents.select(F.col("doc_id").alias("video_id"), "lang")
    plain = t.words.join(lang, "video_id").withColumn(
        "word", F.when(F.col("lang") == "fr", F.translate("word", LATIN_LETTERS, CYRILLIC_LETTERS)).otherwise(F.col("word"))
    )
    columns = ["video_id", "ord", "word", "start_s", "end_s", "lang"]
    assert sorted(t.script_words.select(columns).collect()) == sorted(plain.select(columns).collect())


def test_exploded_sides_are_not_broadcast(spark, tmp_path, monkeypatch):
    from clipmart.functions.ranges import overlap_join
    from clipmart.workload import tables

    # A few clips that become many samples: Spark would take the samples to be as small as the clips.
    clips = spark.range(3).selectExpr("id as video_id", "explode(sequence(0, 79)) as idx").selectExpr("video_id", "idx * 0.5D as t")
    said = spark.range(3).selectExpr("id as video_id", "id * 1.0D as start_s", "id + 2.5D as end_s")
    pairs = overlap_join(clips, said, "video_id", ("t", "t"), ("start_s", "end_s"), closed=True)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert pairs.count() == 18

    turns = [(1, i, "user", "x" * 900) for i in range(20)] + [(None, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(tables, "PART_CLIPS", 4)
    t = Tables(spark, str(tmp_path))
    n = t.conv_clips.count()
    assert t.grid.rdd.getNumPartitions() == -(-n // 4) > 4 and t.grid.count() == 80 * n


def test_manifest_ranks_once_in_few_cells(spark, tmp_path):
    from pyspark.sql import Window

    from clipmart.workload.tables import LINE_ORDER

    # Orders of some lines, one of very many, one with repeated line numbers, and lines without an order or a number.
    keys = [(o, n) for o in range(5) for n in range(1, 8)] + [(7, n) for n in range(700)] + [(8, 1)] * 3 + [(None, n % 7) for n in range(30)] + [(9, None), (9, 2)]
    rows = [(o, n, i * 997 % 5000, i % 3, i % 7 * 1.0, 0.5, 0.0, 0.0, "ARN"[i % 3], "FO"[i % 2]) for i, (o, n) in enumerate(keys)]
    shape = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, shape).withColumn("l_shipdate", F.lit("2024-01-01").cast("date")).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    plain = t.raw("lineitem").withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER[1:])))
    found = t.manifest.select("job_id", "rank", "video_id")
    assert sorted(found.collect(), key=str) == sorted(plain.select("l_orderkey", "rank", "l_partkey").collect(), key=str)
    # The other tables that are made of it read the same files.
    for table in (t.manifest, t.files, t.upload_queue):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_entry_states_are_merged(spark):
    from clipmart.functions import folds

    # Broadcast, the small tables would lie by the group alone, in more partitions than the pieces, which would then be moved to them.
    tables = spark.createDataFrame([(1, p, [1, 0]) for p in range(600)] + [(2, 0, [1, 1])], "g bigint, _piece bigint, _exit array<int>")
    states = folds.entry_states(tables, ["g"], 2)
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {(r.g, r._piece): r._entry for r in states.collect()} == {**{(1, p + 1): (p + 1) % 2 for p in range(600)}, (2, 1): 1}


def test_an_adaptive_plan_tells_where_rows_lie(spark):
    from clipmart.functions.ordered import bare_keys, lies_by, own_keys, scan, spread, stacked, with_cells

    rows = spark.createDataFrame([(i % 3 if i % 4 else None, i) for i in range(20)], "g bigint, n bigint")
    near = spread(rows, 4, ["g"])
    own = [*own_keys(with_cells(near, ["g"], {})), "_cell_km"]
    assert lies_by(with_cells(near, ["g"], {}), own) and not lies_by(with_cells(rows, ["g"], {}), own)
    # Rows that lie by key are read once; the union of two such frames lies by key as well, and gives the keys back.
    both = stacked([near, spread(rows.withColumn("n", F.col("n") + 100), 4, ["g"])], ["g"], F.col("n") % 2)
    seen = bare_keys(scan(both, ["g"], F.col("n") % 2, ["n"], ordinal="i"), ["g"])
    assert moved(seen) == [] and seen._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 2
    assert sorted((r.g is None, r.g, r.i) for r in seen.filter("g is not null").collect()) == sorted(
        (False, g, i + 1) for g in range(3) for i in range(2 * sum(k % 4 != 0 and k % 3 == g for k in range(20)))
    )


def test_captions_are_worked_out_once(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {n: registered()[0][n](spark, folder)._jdf.queryExecution().executedPlan().toString() for n in ("caption_hold", "choose_window_transcript", "aligned_lines")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Words of the primary and captions of the other; lines and answers.
    assert {n: p.count("posexplode(split") for n, p in plans.items()} == {"caption_hold": 1, "choose_window_transcript": 2, "aligned_lines": 2}
    line_moves = [x for x in plans["aligned_lines"].splitlines() if "ENSURE_REQUIREMENTS" in x and ("line_id" in x or "_cell_k1" in x)]
    assert line_moves == [], line_moves


@pytest.mark.parametrize("spans", [1, 2])
def test_words_and_probes_meet_where_the_words_are(spark, folder, spans):
    from clipmart.operators import clips as cl

    t = Tables(spark, folder)
    words = cl._sentence_words(cl._clean_words(t.words))
    at = F.explode(F.array(*[F.col("end_time") - k for k in range(spans)])).alias("t")
    found = cl._lookup(words, t.doc_clips.select("video_id", "ord", at).select("video_id", "t", F.struct("ord").alias("payload")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert moved(found) == [] and plan.count("posexplode(split") == 1
    # The same without any placement.
    loose = cl._lookup(spark.createDataFrame(words.collect(), words.schema), spark.createDataFrame(t.doc_clips.select("video_id", "ord", at).collect()).select("video_id", "t", F.struct("ord").alias("payload")))
    columns = ["video_id", "payload.ord", "at.start_s", "at.last_sentence.end_s", "at.next_sentence.end_s"]
    assert sorted(found.select(columns).collect(), key=str) == sorted(loose.select(columns).collect(), key=str)


def test_candidates_keep_their_texts_where_they_are(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clips = registered()[0]["normalize_clips"](spark, folder)
        plan = clips._jdf.queryExecution().executedPlan().initialPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Above the texts' own exchange there is none: only the ranks come to them.
    left = plan[plan.index("SortMergeJoin"):]
    texts = left[:left.index("Scan parquet")].splitlines()
    assert sum("Exchange" in x for x in texts) == 1 and "REPARTITION_BY_NUM" in "".join(texts)
