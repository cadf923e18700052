"""The pipeline's stages on a small corpus with planted cases, each held against brute force on its own input."""

import random
import subprocess
import sys
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from clipmart.llm import toxicity
from clipmart.llm.queries import QUERIES, as_transcripts, toxic_labels
from tests.llm.data import prose
from tests.llm.test_corpuswide import edited, sets_of, tokens, wanted_targets
from tests.llm.test_rowwise import brute_hits

ITEMS = [(1, prose(900, 40)), (2, prose(901, 20))]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, exact and near copies, toxic and contaminated ones, nulls, empties, repeated rows and ids."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    dealt = random.Random(3)
    docs = [(i, prose(i, dealt.randrange(30, 90))) for i in range(120)]
    docs += [(200 + i, docs[i][1]) for i in range(10)] + [(220 + i, edited(docs[20][1] + " " + docs[21][1], i, 1)) for i in range(6)]
    docs += [(240 + i, prose(700 + i, 60) + " you stupid moron, " + prose(800 + i, 5)) for i in range(12)]
    docs += [(260 + i, prose(600 + i, 20) + " " + ITEMS[i % 2][1] + " " + prose(650 + i, 20)) for i in range(6)]
    docs += [(300, None), (301, ""), (302, "  "), (None, prose(500, 40)), (303, prose(501, 40)), (303, prose(501, 40)), (303, prose(502, 40))]
    rows = [(i, t, "en", f"src{(i or 0) % 4}" if i != 301 else None, len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(240 <= i < 252)) for i, _ in docs if i is not None and i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_equal_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumns({"_text": F.lit(1), "shard": F.lit("x"), "transcript": F.lit(None).cast("string")})
    columns, stages = docs.columns, dict(cp.STAGES)
    where = columns.index("text"), columns.index("doc_id"), columns.index("source")

    after = stages["toxicity"](spark, docs, corpus)
    assert after.columns == columns
    model = toxicity.train_toxicity(as_transcripts(docs), toxic_labels(spark, corpus))
    reader = toxicity.Reader(model)
    want = Counter({r: n for r, n in rows_of(docs).items() if reader.score(reader.matches(r[where[0]] or "")) < toxicity.THRESHOLD})
    assert rows_of(after) == want and not any(r[where[1]] in range(240, 252) for r in want)

    before, after = rows_of(after), stages["near_duplicates"](spark, after, corpus)
    kept = rows_of(after)
    assert after.columns == columns and not kept - before
    texts = {r: sets_of(r[where[0]]) for r in before}
    like = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    for row, n in before.items():
        # Wordless rows all stay; every other row is like a kept one of its group, reached over links.
        assert kept[row] == n if not texts[row] else kept[row] <= 1
    groups = []
    for row in (r for r in before if texts[r]):
        near = [g for g in groups if any(like(texts[row], texts[x]) for x in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [row])]
    for g in groups:
        ids = [r[where[1]] for r in g if r[where[1]] is not None]
        stays = [r for r in g if kept[r]]
        assert len(stays) == 1 and stays[0][where[1]] == (min(ids) if ids else None)

    before, after = kept, stages["decontamination"](spark, after, corpus)
    kept = rows_of(after)
    assert after.columns == columns and kept == Counter({r: n for r, n in before.items() if not brute_hits(r[where[0]], ITEMS)[3]})
    assert len(kept) < len(before)

    before, after = kept, stages["mixing"](spark, after, corpus)
    kept = rows_of(after)
    assert after.columns == columns and set(kept) <= set(before)
    size = lambda r: len(tokens(r[where[0]]))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r, n in before.items():
        sizes[r[where[2]]] += size(r) * n
        largest[r[where[2]]] = max(largest[r[where[2]]], size(r))
    for r, n in kept.items():
        assert n == (1 if size(r) == 0 else min(n, 2))
        taken[r[where[2]]] += size(r) * n
    for source, target in wanted_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1

    before, after = kept, stages["sharding"](spark, after, corpus)
    assert after.columns == [c for c in columns if c != "shard"] + ["shard"]
    out = after.collect()
    assert len(out) == sum(before.values()) and {type(r["shard"]) for r in out} == {int} and all(0 <= r["shard"] < 24 for r in out)
    assert max(Counter(t for t, _ in {(r["text"], r["shard"]) for r in out}).values()) == 1


def test_run_applies_all_stages(spark, corpus):
    out = cp.run(spark, corpus)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"] and out.count() > 100
    assert rows_of(out) == rows_of(cp.run(spark, corpus))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_empty_documents_pass(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, corpus)
        assert docs.count() == 0


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES} and "pipeline" in names and set(QUERIES) <= set(names)


def test_the_rest_works_without_the_subpackage():
    code = """
    import importlib.abc, sys
    class Gone(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name.startswith("clipmart.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)
    sys.meta_path.insert(0, Gone())
    import __spark_entry__ as entry
    assert len(entry.queries()) > 160 and not any(n.startswith("op1") for n in entry.queries()) and "pipeline" not in entry.oracle_sql()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, timeout=120)
