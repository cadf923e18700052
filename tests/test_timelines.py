"""Long series against plain walks: timelines by links, overlapping clips by rounds, range joins on levels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmart.functions import links
from clipmart.functions.ranges import overlap_join
from clipmart.operators import clips as cl
from clipmart.operators import speakers as sp

SHAPE = "video_id long, ord long, idx long, t double, speakers array<string>"


def walked_switches(samples, solo, hold):
    now, last, out = None, 0.0, []
    for idx, t, said in samples:
        n, first = len(said), said[0] if said else None
        shared = n >= 2 and not set(said) & solo
        blur = shared or (n == 0 and now is None)
        if (n >= 2 and not shared and (now is None or now not in said)) or (n == 1 and (now is None or (first != now and t >= last + hold))):
            now, last = first, t
        out.append((idx, "blur" if blur else "crop", now))
    return out


def walked_layouts(samples, hold):
    layout, now, last, out = "split", None, -hold, []
    for idx, t, said in samples:
        n, first = len(said), said[0] if said else None
        wanted = "full" if n == 1 else "split" if n else layout
        if t >= last + hold:
            if wanted != layout:
                layout, now, last = wanted, first, t
            elif layout == "full" and n == 1 and first != now:
                now, last = first, t
        out.append((idx, layout, now))
    return out


def clip(seed, n):
    dealt, said, out, t = random.Random(seed), [], [], 0.0
    for idx in range(n):
        if dealt.random() < 0.2:
            said = dealt.sample("ABCD", dealt.choice([0, 1, 1, 1, 2, 3]))
        out.append((idx, t, list(said)))
        t += dealt.choice([0.25, 0.25, 0.5, 0.0])
    return out


@pytest.mark.parametrize("cell", [4, 256])
def test_links_equal_a_walk(spark, monkeypatch, cell):
    monkeypatch.setattr(sp, "FOLDED", 40)
    monkeypatch.setattr(links, "CELL_NODES", cell)
    clips = {(v, o): clip(10 * (v or 0) + o, n) for v, o, n in [(1, 0, 400), (1, 1, 30), (2, 0, 700), (None, 0, 300), (3, 0, 1), (4, 0, 90)]}
    solo = {1: {"A"}, 2: {"B", "C"}}
    samples = spark.createDataFrame([(v, o, *s) for (v, o), own in clips.items() for s in own], SHAPE)
    alone = spark.createDataFrame([(v, s) for v, own in solo.items() for s in own], "video_id long, speaker string")
    for hold in (2.0, 0.25):
        got = sorted((str(r.video_id), r.ord, r.idx, r.layout, r.speaker or "") for r in sp.speaker_switch_timeline(samples, alone, hold).collect())
        want = [(str(v), o, i, lay, s or "") for (v, o), own in clips.items() for i, lay, s in walked_switches(own, solo.get(v, set()), hold)]
        assert got == sorted(want)
        got = sorted((str(r.video_id), r.ord, r.idx, r.layout, r.speaker or "") for r in sp.layout_timeline(samples, hold).collect())
        assert got == sorted((str(v), o, i, lay, s or "") for (v, o), own in clips.items() for i, lay, s in walked_layouts(own, hold))


def test_a_very_long_clip(spark):
    n = 200_000
    rng = np.random.default_rng(1)
    turns = np.repeat(rng.integers(0, 6, n // 8 + 1), 8)[:n]
    kinds = [[], ["A"], ["B"], ["C"], ["A", "B"], ["B", "C"]]
    own = [(i, i * 0.25, kinds[k]) for i, k in enumerate(turns)]
    said = F.element_at(F.array(*[F.array(*[F.lit(s) for s in k]).cast("array<string>") for k in kinds]), F.col("kind").cast("int") + 1)
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "kind": turns}))
    samples = rows.select(F.lit(1).cast("long").alias("video_id"), F.lit(0).cast("long").alias("ord"), "idx", (F.col("idx") * 0.25).alias("t"), said.alias("speakers"))
    solo = spark.createDataFrame([(1, "A")], "video_id long, speaker string")
    got = sp.speaker_switch_timeline(samples, solo).toPandas().sort_values("idx")
    want = walked_switches(own, {"A"}, 2.0)
    assert got["layout"].tolist() == [w[1] for w in want] and got["speaker"].fillna("").tolist() == [w[2] or "" for w in want]


# --- overlapping clips ------------------------------------------------------------------------
def greedy(own, limit=0.25):
    """Kept clips of (ord, start, end, score), best first; only the kept ones near a clip are looked at."""
    near, out = {}, set()
    for o, s, e, v in sorted(own, key=lambda r: (-r[3], r[0], r[1], r[2])):
        cells = range(int(s // 100), int(e // 100) + 1)
        others = {k for c in cells for k in near.get(c, ())}
        if all(min(e, y) - max(s, x) <= limit * min(e - s, y - x) for x, y in others):
            out.add((o, s, e, v))
            for c in cells:
                near.setdefault(c, set()).add((s, e))
    return out


def test_long_runs_of_overlapping_clips(spark, monkeypatch):
    dealt = random.Random(3)
    own = {1: [(i, 20.0 * i, 20.0 * i + dealt.choice([30.0, 45.0, 60.0]), dealt.randrange(100)) for i in range(100_000)]}
    monkeypatch.setattr(cl, "RUN_CLIPS", 10)
    # Copies, one clip over everything, a run that falls along time, a video without id, and short runs.
    own[2] = [(i, 7.0 * (i // 3), 7.0 * (i // 3) + 25, dealt.randrange(4)) for i in range(90)] + [(500, 0.0, 900.0, 2)]
    own[3] = [(i, 10.0 * i, 10.0 * i + 25, 50) for i in range(16)]
    own[None] = [(i, 3.0 * i, 3.0 * i + 9, dealt.randrange(9)) for i in range(40)]
    own[4] = [(i, 100.0 * i, 100.0 * i + 30, 7) for i in range(30)]
    rows = [(v, *r) for v, r in own.items() for r in r]
    clips = spark.createDataFrame(rows, "video_id long, ord long, start_time double, end_time double, viral_score int").repartition(8)
    got = {tuple(r) for r in cl.drop_overlapping_clips(clips).collect()}
    assert got == {(v, *r) for v, o in own.items() for r in greedy(o)}


# --- range joins ------------------------------------------------------------------------------
@pytest.mark.parametrize("look", [("left", "right"), ("left",), ()])
@pytest.mark.parametrize("closed", [False, True])
def test_spans_of_any_length_meet(spark, look, closed):
    dealt = random.Random(4)
    lengths = [0.0, 1.0, 29.0, 30.0, 500.0, 9000.0, 1e6, 1e12, -5.0]

    def spans(n):
        return [(dealt.randrange(3), i, s, s + dealt.choice(lengths)) for i in range(n) for s in [float(dealt.randrange(4000))]] + [(1, n, -50.0, 1e12)]

    a, b = spans(60), spans(60)
    left = spark.createDataFrame(a, "k long, i long, s double, e double")
    right = spark.createDataFrame(b, "k long, j long, x double, y double")
    got = sorted((r.i, r.j) for r in overlap_join(left, right, "k", ("s", "e"), ("x", "y"), closed=closed, look=look).collect())
    hit = (lambda s, e, x, y: y >= s and x <= e) if closed else (lambda s, e, x, y: y > s and x < e)
    assert got == sorted((i, j) for k, i, s, e in a for n, j, x, y in b if k == n and hit(s, e, x, y))
