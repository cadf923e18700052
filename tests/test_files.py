"""Large JSON files, cut at object boundaries."""

import json

import pytest

from clipmart.sources import files


def recipe(n, text="a \\ \"b\" {x} [y] }{"):
    scene = {"source_id": "s1", "start": 1, "end": 2.5, "label": text}
    return {
        "note": text, "default_settings": {"min_duration": 20, "tags": [{"clips": [{"a": 1}]}]},
        "clips": [{"clip_id": i, "title": text, "hook": {"scenes": [scene]}, "highlight": {"scenes": [scene, scene]}} for i in range(n)],
        "after": [{"b": text}], "last": {"c": 1},
    }


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("block", [97, 1 << 20])
def test_objects_of_any_file_are_found(spark, tmp_path, indent, block):
    given = {"a": recipe(7), "b": recipe(1), "c": {"clips": []}, "d": {"x": [1]}, "e": recipe(3, "")}
    for name, r in given.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(r, indent=indent) + ("\n" if name in "ac" else ""))
    (tmp_path / "f.json").write_text('{"clips": [{"clip_id": 1, "title": "t"}, {"clip_id": 2 "title": "no comma"}, {"clip_id": 3}]}')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = files.split_payloads(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in sorted(rows, key=lambda r: (r.file_path, r.part)):
        got.setdefault(r.file_path.rsplit("/", 1)[1][0], []).append(r.payload)
    for name, r in given.items():
        read = [json.loads(p) for p in got[name]]
        if r.get("clips"):
            assert [p["clips"] for p in read] == [[c] for c in r["clips"]]
            assert all({k: v for k, v in p.items() if k != "clips"} == {k: v for k, v in r.items() if k != "clips"} for p in read)
        else:
            assert read == [r]
    # The broken clip is its own payload; the others are read.
    assert [json.loads(p)["clips"][0]["clip_id"] for p in got["f"] if "no comma" not in p] == [1, 3] and len(got["f"]) == 3


def test_one_large_recipe_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps({"project_name": "p"} | recipe(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 4
        scenes = files.read_story_scenes(spark, str(tmp_path))
        counts = scenes.groupBy("section").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["section"]: r["count"] for r in counts} == {"hook": 20_000, "highlight": 40_000}
    assert files.read_story_scenes(spark, str(tmp_path / "none")).count() == 0


def test_small_files_are_cut_where_they_are_read(spark, tmp_path):
    given = {"a": recipe(7), "b": recipe(2), "c": {"clips": []}}
    for name, r in given.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(r))
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_bytes(b'{"clips": [{"clip_id": 1, "title": "\xff"}, 5], "after": [{"b": 1}]}')
    (tmp_path / "f.json").write_text('{"clips": [{"clip_id": 1}')
    found = files.split_payloads(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Nothing is shuffled or written out.
    assert "Exchange" not in plan and "ExistingRDD" not in plan
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.file_path, r.part)):
        got.setdefault(r.file_path.rsplit("/", 1)[1][0], []).append(json.loads(r.payload))
    assert [p["clips"] for p in got["a"]] == [[c] for c in given["a"]["clips"]] and len(got["b"]) == 2 and got["c"] == [{"clips": []}]
    assert "d" not in got and got["e"][0]["clips"][0]["clip_id"] == 1 and got["f"] == [{"clips": [{"clip_id": 1}]}]


def test_small_and_large_files_give_the_same_payloads(spark, tmp_path, monkeypatch):
    for name, r in {"a": recipe(5), "b": recipe(40, "long \\\" text {" * 9), "c": {"x": 1}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(r, indent=2 if name == "a" else None))
    read = lambda: sorted((r.file_path, r.part, r.payload) for r in files.split_payloads(spark, str(tmp_path)).collect())
    small = read()
    monkeypatch.setattr(files, "WHOLE_BYTES", 0)
    large = read()
    monkeypatch.setattr(files, "WHOLE_BYTES", 5000)
    assert [x[:2] for x in small] == [x[:2] for x in large] and [json.loads(x[2]) for x in small] == [json.loads(x[2]) for x in large]
    assert read() != [] and [json.loads(x[2]) for x in read()] == [json.loads(x[2]) for x in large]
