"""Operators that look at all transcripts together."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipmart.llm import jaccard_join, language_model, line_dedup, mixing, neighbours, sharding
from clipmart.llm.components import components
from tests.llm.data import ROWS, prose, table


def tokens(text):
    return (text or "").encode().lower().split()


def by_group(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b), key=str)] = min(find(a), find(b), key=str)
    return find


# --- components --------------------------------------------------------------------------------
def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing ------------------------------------------------------------------------------------
def wanted_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(repeats * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if target[s] > repeats * sizes[s] + 1e-9]
        if not over:
            return target | {s: repeats * sizes[s] for s in full}
        full |= set(over)


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets(spark, seed):
    dealt = random.Random(seed)
    rows = [(i, prose(i, dealt.randrange(1, 80)), dealt.choice(["a", "b", "b", "b", "c", "é", "", None]), None) for i in range(300)] + ROWS
    got = mixing.mix_sources(table(spark, rows)).collect()
    again = mixing.mix_sources(table(spark, rows[::-1])).collect()
    key = lambda r: (str(r.video_id), str(r.source_key), r.n_words, r.taken_words)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(tokens(r[1]))
    want = wanted_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken_words <= 2 * r.n_words and r.source_words == sizes[r.source_key]
        assert r.target_words == pytest.approx(want[r.source_key])
        taken[r.source_key] += r.taken_words
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    # The mix is one sequence: readings begin one after the other.
    starts = sorted(r.mix_start for r in got if r.mix_start is not None)
    assert starts[0] == 0 and len(set(starts)) == len(starts) and starts[-1] < sum(taken.values())


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(table(spark).limit(0)).count() == 0
    got = mixing.mix_sources(table(spark, [(1, None, "a", None), (2, "", None, None)])).collect()
    assert [(r.taken_words, r.target_words) for r in got] == [(0, 0.0), (0, 0.0)]


# --- sharding ----------------------------------------------------------------------------------
def smallest_capacity(sizes, shards):
    def fits(limit):
        used, load = 1, 0
        for s in sizes:
            if s > limit:
                return False
            if load + s > limit:
                used, load = used + 1, 0
            load += s
        return used <= shards

    return next(c for c in itertools.count(max(sizes)) if fits(c))


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_are_minimax(spark, shards):
    dealt = random.Random(shards)
    rows = [(i, prose(dealt.randrange(90), dealt.randrange(1, 30)) if i % 5 else "same text", None, None) for i in range(200)] + ROWS
    df = table(spark, rows)
    got = sharding.shard_transcripts(df, shards).collect()
    assert len(got) == len(rows) and all(0 <= r.shard < shards for r in got)
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    where = defaultdict(set)
    load = Counter()
    for r in got:
        where[r.text_crc32].add(r.shard)
        load[r.shard] += r.n_bytes
    assert all(len(s) == 1 for s in where.values())
    text = F.col("transcript")
    sizes = [r.b for r in df.groupBy(sharding.group_of(text).alias("g")).agg(F.sum(sharding.row_bytes(text)).alias("b")).orderBy("g").collect()]
    capacity = sharding.shard_ends(df, shards).first()["capacity"]
    assert capacity == smallest_capacity(sizes, shards) and max(load.values()) <= capacity
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.video_id and (x[1] is None) == (r.text_crc32 is None) and (x[1] is None or zlib.crc32(x[1].encode()) == r.text_crc32))
        assert r.n_bytes == len((text or "").encode()) + 8


def test_shards_of_nothing(spark):
    assert sharding.shard_transcripts(table(spark).limit(0)).count() == 0


# --- language model ----------------------------------------------------------------------------
def test_base_scores_and_model(spark):
    rows = [(i, prose(i % 40, 20 + i % 9).replace("clip", "Clip"), None, None) for i in range(120)] + ROWS
    df = table(spark, rows).withColumn("learn", F.when(F.col("video_id") == 8, F.lit(None)).otherwise(F.coalesce(F.col("video_id") % 5 != 0, F.lit(True))))
    learn = lambda i: i is None or (i != 8 and i % 5 != 0)
    counts = Counter(t for r in rows if learn(r[0]) for t in [*tokens(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    got = language_model.score_transcripts(df, chunk_bytes=20_000).collect()
    want = sorted((str(r[0]), len(tokens(r[1])) + 1, sum(counts[t] > 0 for t in [*tokens(r[1]), None])) for r in rows)
    assert sorted((str(r.video_id), r.n_tokens, r.n_known) for r in got) == want
    base = Counter(round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in [*tokens(r[1]), None]), 6) for r in rows)
    assert Counter(round(r.base_score, 6) for r in got) == base and all(r.train_tokens == n for r in got)
    # The model is a distribution that beats the base on repeated prose.
    assert all(r.score <= 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_model_probabilities_sum_to_one_and_em_finds_the_mixture():
    import pandas as pd

    dealt = np.random.default_rng(1)
    cells = pd.DataFrame({"bucket": [3] * 400, "p2": dealt.integers(-1, 30, 400), "p1": dealt.integers(8, 40, 400), "n": dealt.integers(1, 50, 400)})
    w = language_model.mixture_weights(cells, 1e-4)
    assert w.sum(axis=1) == pytest.approx(np.ones(len(w))) and (w[3] > 0).all() and w[0].tolist() == [0, 0, 1]

    def likelihood(x):
        p = np.where(cells.p2 < 0, 0, 2.0 ** (-(cells.p2 + 0.5) / 2)) * x[0] + 2.0 ** -(cells.p1 + 0.5) * x[1] + 1e-4 * x[2]
        return float((cells.n * np.log(p)).sum())

    near = [likelihood(np.abs(w[3] + d) / np.abs(w[3] + d).sum()) for d in dealt.normal(0, 0.02, (50, 3))]
    assert likelihood(w[3]) >= max(near) - 3


def test_packing_round_trip():
    for values in ([], [0], [-5, 3, 1 << 60, 0, 7]):
        a = np.array(values, dtype=np.int64)
        assert language_model.unpacked(language_model.packed(a), len(a)).tolist() == values


def test_model_without_training(spark):
    got = language_model.score_transcripts(table(spark).withColumn("learn", F.lit(False))).collect()
    assert len(got) == len(ROWS) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in got)
    assert language_model.score_transcripts(table(spark).limit(0).withColumn("learn", F.lit(True))).count() == 0


# --- nearest vectors ---------------------------------------------------------------------------
def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)
    dealt = np.random.default_rng(5)
    x = dealt.standard_normal((900, 16)) + 2 * dealt.standard_normal((9, 16)).repeat(100, axis=0)
    rows = [(i, x[i].tolist()) for i in range(900)] + [(i, x[3].tolist()) for i in range(900, 920)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0] * 15 + [float("inf")]), (1005, [1.0] * 15 + [None]), (1006, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = neighbours.nearest(df, df.filter("vec_id % 30 = 0")).collect()
    vectors = dict(rows)
    score = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    hits = total = 0
    for q in {r.query_id for r in got}:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in own}
        assert all(r.score == pytest.approx(score(vectors[q], vectors[r.vec_id]), abs=1e-12) for r in own)
        best = sorted((i for i in vectors if i != q), key=lambda i: (-round(score(vectors[q], vectors[i]), 12), i))[:5]
        hits, total = hits + len(set(best) & {r.vec_id for r in own}), total + 5
    assert total == 155 and hits >= 0.9 * total


def test_nearest_of_extreme_numbers(spark):
    base = [[3.0, 4.0, 0.5], [4.0, 3.0, 0.25], [-1.0, 2.0, 8.0], [5.0, 5.0, 5.0]]
    rows = [(i, [x * s for x in v]) for i, (v, s) in enumerate(zip(base, (1e200, 1e-200, 1.0, 1e300), strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df).collect()
    for r in got:
        a, b = np.array(base[r.query_id]), np.array(base[r.vec_id])
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert len(got) == 12 and all(a.score >= b.score for a, b in zip(got, got[1:], strict=False) if a.query_id == b.query_id and a.rank < b.rank)


def test_nearest_ties_few_and_none(spark):
    rows = [(i, [1.0, 1.0]) for i in (9, 3, 5)] + [(50, [1.0, 1.0]), (100, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(50, 3), (50, 5), (50, 9), (50, 100), (100, 3), (100, 5), (100, 9), (100, 50)]
    assert neighbours.nearest(df.limit(0), df).count() == neighbours.nearest(df, df.limit(0)).count() == 0


# --- near duplicates ---------------------------------------------------------------------------
def edited(text, seed, edits):
    dealt, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[dealt.randrange(len(words))] = f"edit{dealt.randrange(10**6)}"
    return " ".join(words)


def sets_of(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block, hubs", [(1024, 2), (6, 1)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, hubs):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HUBS", hubs)
    base, boiler = [prose(s, n) for s, n in ((1, 60), (2, 300), (3, 90))], prose(77, 25)
    rows = [(i, edited(base[i % 3], i, i % 5), None, None) for i in range(120)]
    rows += [(200 + i, prose(300 + i, 80) + " " + boiler, None, None) for i in range(40)]
    rows += [(300 + i, " ".join(base[1].split()[: 300 - 5 * i]), None, None) for i in range(20)] + ROWS
    got = jaccard_join.near_duplicates(table(spark, rows)).collect()
    sets = [sets_of(r[1]) for r in rows]
    links = [
        (i, j) for i, j in itertools.combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    find = by_group(links)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None and (least[find(i)] is None or r[0] < least[find(i)]):
            least[find(i)] = r[0]
    want = sorted((str(r[0]), len(sets[i]), str(least[find(i)] if sets[i] else r[0])) for i, r in enumerate(rows))
    assert sorted((str(r.video_id), r.n_shingles, str(r.component_id)) for r in got) == want
    stay = [r for r in got if r.stays and r.n_shingles]
    assert len({(r.component_id, r.text_hash) for r in stay}) == len({find(i) for i in range(len(rows)) if sets[i]})


def test_tree_join_keeps_all_similar_pairs():
    dealt = random.Random(4)
    sets = []
    for i in range(150):
        own = set(dealt.sample(range(1, 10**9), 100)) if i % 3 == 0 else set(sets[-1])
        for _ in range(dealt.randrange(14)):
            own.pop()
        sets.append(own)
    hashed = [np.sort(jaccard_join.mixed(np.array(sorted(s), dtype=np.uint64))) for s in sets]
    words = min(len(jaccard_join.bitmap(h)) for h in hashed) // 8
    bits = np.concatenate([jaccard_join._folded(np.frombuffer(jaccard_join.bitmap(h), dtype=np.uint64)[None, :], words) for h in hashed])
    sizes = np.array([len(s) for s in sets])
    tree = jaccard_join.Tree(sizes, jaccard_join._folded(bits, max(1, words // jaccard_join.COARSE)))
    i, j = tree.join(tree)
    near = jaccard_join._near(sizes, bits, sizes, bits, i, j)
    got = set(zip(i[near].tolist(), j[near].tolist(), strict=True))
    similar = {(i, j) for i in range(150) for j in range(150) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert similar <= got and len(got) < 150 * 150 / 4


def test_near_duplicates_of_nothing(spark):
    assert jaccard_join.near_duplicates(table(spark).limit(0)).count() == 0


# --- line de-duplication -----------------------------------------------------------------------
def distance(a, b):
    up = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, up[j + 1] + 1, up[j] + (x != y)))
        up = row
    return up[-1]


def changed(line, seed, edits):
    dealt, chars = random.Random(seed), list(line)
    for _ in range(edits):
        at = dealt.randrange(len(chars))
        what = dealt.randrange(3)
        chars[at : at + (what != 0)] = [] if what == 2 else [dealt.choice("abcé☃ ")]
    return "".join(chars)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_links_equal_brute_force(spark, edits):
    lines = sorted({changed(prose(i % 6, 5), 100 * i + edits, i % 5) for i in range(90)} | {"x" * 40, "x" * 41, "x" * 43, "y" + "x" * 39})
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    got = {tuple(sorted(r)) for r in line_dedup.similar_lines(df.union(df), edits).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if distance(lines[i], lines[j]) <= edits}
    assert got == want and want


def test_first_line_of_a_class_stays(spark):
    a, b, c = prose(1, 6), prose(2, 6), prose(3, 6)
    rows = [(3, f"{a}\nshort\n{b}", None, None), (1, f"{a}x\n\nshort\n{a}xy", None, None), (2, f"{c}\n{b}\n{c}", None, None), (2, f"{c}\n{b}\n{c}", None, None), (4, None, None, None), (5, "", None, None), (None, c, None, None)]
    got = sorted((str(r.video_id), r.n_lines, r.n_dropped, r.transcript) for r in line_dedup.dedup_lines(table(spark, rows)).collect())
    assert got == sorted([
        ("3", 3, 2, "short"), ("1", 4, 1, f"{a}x\n\nshort"), ("2", 3, 2, b), ("2", 3, 2, b), ("4", 0, 0, None), ("5", 1, 0, ""), ("None", 1, 0, c),
    ], key=str)
    assert line_dedup.dedup_lines(table(spark).limit(0)).count() == 0 and line_dedup.dedup_lines(table(spark)).count() == len(ROWS)


def test_repeated_lines_of_a_long_text_are_dropped_in_one_walk(spark):
    text = "\n".join(["x" * 30, "", prose(1, 6)] * 20000)
    got = line_dedup.dedup_lines(table(spark, [(1, text, None, None)])).first()
    assert (got.n_lines, got.n_dropped, got.transcript) == (60000, 39998, "x" * 30 + "\n\n" + prose(1, 6) + "\n" * 19999)


def test_lines_that_meet_are_paired_only_where_their_letters_are_near(spark):
    dealt = random.Random(5)
    # One beginning for all, so all meet under one key; every tenth has a copy with three errors.
    ends = ["".join(dealt.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40)) for _ in range(200)]
    texts = ["the same beginning " + e for e in ends] + ["the same beginning " + e[:9] + "zz" + e[11:-1] for e in ends[::10]]
    shared = spark.createDataFrame([(1, i, 0) for i in range(len(texts))], "_key long, _h long, _role int")
    lines = spark.createDataFrame(list(enumerate(texts)), "_h long, line string")
    marks = lines.select("_h", line_dedup._counts(F.col("line")).alias("_c"), F.length("line").alias("_n"))
    met = {tuple(r) for r in line_dedup._meeting(shared, marks, 3).collect()}
    assert {(10 * i, 200 + i) for i in range(20)} <= met and len(met) < 60

    # Counts past the circle's end, letters that are not counted, and texts without any.
    pairs = [
        ("e" * 31, "e" * 34, True), ("e" * 31, "e" * 35, False), ("я" * 20, "ю" * 20, True), ("", "eta", True), ("ww7", "eea", True), ("aaaa", "eeee", False),
        ("etu" + "9" * 30, "9" * 33, True), ("7777 in all", "in all", False), ("in all", "7777 in all", False),
    ]
    at = spark.createDataFrame(pairs, "a string, b string, near boolean")
    told = at.select("near", line_dedup._counts_near(line_dedup._counts(F.col("a")), line_dedup._counts(F.col("b")), 3).alias("got"))
    assert [r.got for r in told.collect()] == [r.near for r in told.collect()]


def test_registered_line_dedup_drops_lines_with_three_errors(spark, tmp_path):
    from clipmart.llm.queries import QUERIES

    base = prose(1, 6)
    near = [changed(base, 7 * i, 3) for i in range(1, 6)]
    far = base[:10] + "????" + base[14:]
    rows = [(i, line, "en", "a") for i, line in enumerate([base, *near, far])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_dropped for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, **{i: 1 for i in range(1, 6)}, 6: 0}


def test_registered_line_dedup_drops_repeated_short_lines(spark, tmp_path):
    from clipmart.llm.queries import QUERIES

    texts = ["Les.\n\nAnd ornd.", "Les.\n\nLes!", "And ornb.\nOf, edti oner. It then.", "Of, edti oner. It then.x\nLes.", "\n"]
    rows = [(i, text, "en", "a") for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: (3, 0), 1: (3, 1), 2: (2, 1), 3: (2, 2), 4: (2, 0)}
