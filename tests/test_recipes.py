"""Rules of recipes with many clips."""

from __future__ import annotations

import time

from clipmart.operators import story as st


def test_repeated_ids_of_a_large_recipe(spark):
    n = 20_000
    clip = '{"clip_id": %s, "title": "t", "hook": {"scenes": []}, "highlight": {"scenes": []}}'
    whole = '{"clips": [' + ", ".join(clip % (i if i != 7 else 6) for i in range(n)) + "]}"
    # The same id in two recipes is no repetition, one without id neither.
    other = '{"clips": [' + ", ".join([clip % 1, clip % "null", clip % "null"]) + "]}"
    recipes = spark.createDataFrame([(whole,), (other,)], "payload string")
    sources = spark.createDataFrame([], "source_id string, name string, platform string, url string, local_path string")
    start = time.monotonic()
    found = st.recipe_validation(sources, recipes).filter("rule = 'clip: duplicate id'").collect()
    assert [(r.rule, r.key) for r in found] == [("clip: duplicate id", "6")]
    assert time.monotonic() - start < 60
