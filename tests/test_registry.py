"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "source_stats", "channel_detail", "global_stats", "duplicate_videos", "pull_run_stats", "apply_playlist_pull",
    "update_status", "link_source_videos", "catalogue_constraints", "group_captions", "transcript_lines", "clip_text",
    "snap_clips_to_words", "normalize_clips", "drop_overlapping_clips", "merge_previous_results", "publish_plan",
    "enqueue_slots", "best_and_worst", "active_speakers_at", "speaker_switch_timeline", "layout_timeline", "confirmed_runs",
    "words_from_json3", "story_validation", "romanisation_lines", "job_changes_stream", "export_videos_csv",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def test_every_query_has_a_twin():
    from clipmart.workload import registered

    queries, oracles = registered()
    assert set(queries) == set(oracles)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    import __spark_entry__ as entry
    from tools.check import rows_of

    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
