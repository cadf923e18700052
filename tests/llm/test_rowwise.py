"""Operators that judge each transcript for itself."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from clipmart.llm import decontaminate, language, private_data, toxicity
from tests.llm.data import LONG, ROWS, prose, table


# --- benchmark decontamination -----------------------------------------------------------------
def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(text, items):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[i : i + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
    return len(own), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(own)


ITEMS = [(1, prose(1, 60)[50:300]), (2, "Two"), (3, None), (4, "..."), (5, prose(5, 20)), (6, prose(5, 20)), (7, "one-two one"), (8, prose(3, 14) + " x")]


@pytest.mark.parametrize("pass_bytes", [1 << 20, 150])
def test_contamination_equals_brute_force(spark, pass_bytes):
    rows = [r for r in ROWS if r[1] != LONG] + [
        (20, "x y " + prose(5, 20).upper() + " z", "a", "en"), (21, "one two one two one", "a", "en"), (22, prose(6, 900) + " " + prose(5, 13), "a", "en"),
    ]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_hit", F.lit(1))
    got = decontaminate.contamination(table(spark, rows), bench, pass_bytes=pass_bytes).collect()
    want = sorted((str(r[0]), *brute_hits(r[1], ITEMS)) for r in rows)
    assert sorted((str(r.video_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == want


def test_contamination_of_long_and_empty(spark):
    bench = spark.createDataFrame([(1, " ".join(LONG.split()[-13:]))], "item_id long, text string")
    got = {r.video_id: r for r in decontaminate.contamination(table(spark), bench).collect()}
    assert got[6].n_hit == 13 and not got[6].contaminated and got[3].n_words == 0
    assert decontaminate.contamination(table(spark), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(table(spark).limit(0), bench).count() == 0
    digest = spark.createDataFrame([(["10", "2"],), ([],)], "i array<string>").select(decontaminate.items_digest(F.col("i")).alias("d"))
    assert [r.d for r in digest.collect()] == [hashlib.sha256(x).hexdigest() for x in (b"10,2", b"")]


# --- personal data -----------------------------------------------------------------------------
def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}
TRICKY = [
    "a@b.c@d.e f@g h@i.j. @k.l m@@n.op %+-@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 01.02.003.4 1..2.3.4 256.1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  111111111111 1234567890123456 4111111111111111222", "+1 (555) 010-9999 +12 +1234567890123456 ++49 30 1234567 +1-2-3-4-5-6-7-8.",
    "é4111111111111111é ☃ a@b.co ☃ +44 20 7946 0958 10.0.0.1", "mail a.b@c-d.ef, see https://x.example/a?b=1. IBAN DE89 3704 0044 0532 0130 00, account no: 12345678",
    "9" * 3000 + " " + "1." * 500 + "@" * 300 + "+" * 300 + "a" * 3000, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1((((((((((((((((", None, "",
]


def test_base_spans_equal_the_patterns(spark):
    rows = [(i, t, "a", "en") for i, t in enumerate(TRICKY)] + ROWS
    got = private_data.private_spans(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.video_id is not None and row.video_id < len(TRICKY) and row.video_id not in {r[0] for r in ROWS}:
            text = TRICKY[row.video_id] or ""
            want = [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text) if ok(m.group())]
            assert [tuple(s) for s in row.spans if s.kind in BASE] == want
    tree = private_data.anchors()
    for text in TRICKY:
        found = private_data.find_spans(text or "", tree)
        for kind, (pattern, ok) in BASE.items():
            assert found[kind] == [m.span() for m in re.finditer(pattern, text or "") if ok(m.group())], (kind, text)


def test_added_spans_and_empty_table(spark):
    text = TRICKY[5]
    found = private_data.find_spans(text, private_data.anchors())
    assert [text[s:e] for s, e in found["url"]] == ["https://x.example/a?b=1"]
    assert [text[s:e] for s, e in found["account"]] == ["DE89 3704 0044 0532 0130 00", "12345678"]
    assert private_data.private_spans(table(spark).limit(0)).count() == 0


# --- language ----------------------------------------------------------------------------------
SPOKEN = {"en": "the of and this that with from have they would ing tion", "de": "der die und nicht ein ich sch ung keit über für auf", "fr": "les des une est dans pour que avec sur été où ça"}


def spoken(language, seed, n=25):
    import random

    dealt = random.Random(seed)
    return " ".join(dealt.choice(SPOKEN[language].split()) for _ in range(n))


def test_languages_are_told_apart(spark):
    train = [(100 + i, spoken(x, i), "a", x) for x in SPOKEN for i in range(20)] + [(1, None, None, "en"), (2, "no label", None, None)]
    codes = language.train_languages(table(spark, train))
    assert codes.languages == ["de", "en", "fr"]
    asked = [(i, spoken(x, 500 + i), "a", None) for i, x in enumerate(SPOKEN)] + [(10, None, None, "en"), (11, "", None, "en"), (12, "12 !? ☃", None, "en"), (13, "the", None, "de")]
    got = {r.video_id: r for r in language.identify_language(table(spark, asked), codes).collect()}
    assert [got[i].language_pred for i in range(3)] == list(SPOKEN) and got[13].language_pred == "en"
    assert all(got[i].language_pred == "und" and got[i].score == 0 for i in (10, 11, 12))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_rows_and_without_training(spark):
    for train in (table(spark).limit(0), table(spark, [(1, "only one", None, "en")])):
        codes = language.train_languages(train)
        got = language.identify_language(table(spark), codes).collect()
        assert len(got) == len(ROWS)
        assert {r.language_pred for r in got} <= {"und", "en"}
        assert language.identify_language(table(spark).limit(0), codes).count() == 0


def test_letters_of_all_planes():
    text = "aB1 \u00c4\u4e2d\U00020000\U00020001\U0001F600\U000E0041"
    assert [chr(p) for p in language.letters_of(text)] == [c if c.isalpha() else " " for c in text.lower()]


def test_items_without_id(spark):
    bench = spark.createDataFrame([(None, "one two"), (3, "one two"), (None, None)], "item_id long, text string")
    docs = table(spark, [(1, "x one two", "a", "en")])
    row = decontaminate.contamination(docs, bench).first()
    assert (row["items"], row.n_hit) == (["", "3"], 2)


@pytest.mark.parametrize("n", [2, 3, 5, 6, 9, 30])
def test_codewords_differ(n):
    codes = language._codewords(n)
    assert len({tuple(r) for r in codes.tolist()}) == n and all(set(c) == {-1, 1} for c in codes.T.tolist())


# --- toxicity ----------------------------------------------------------------------------------
def test_clauses_and_surroundings():
    reader = toxicity.Reader(toxicity.ToxicModel())
    patterns = lambda text: [i for i, v in enumerate(reader.matches(text)) if v]
    assert patterns("What a moron.") == [0] and patterns("You are a moron.") == [1]
    assert patterns("This is not a moron") == [2] and patterns('"a moron" it was') == [4] and patterns("He says moron.") == [5]
    assert patterns("You. A moron.") == [0] and patterns("We kill you") == [8] and patterns("We kill. You") == []
    assert reader.score(reader.matches("You moron")) > 0.3 > reader.score(reader.matches(""))
    assert reader.matches("moron. moron.")[0] == 2 * reader.matches("moron moron.")[0]


def test_lexicon_is_learned_whatever_the_copies(spark):
    bad = ["grumpf%d" % i for i in range(40)]
    texts = [(i, prose(i, 40) + (f" {bad[i % 40]} " + prose(1000 + i, 20) if i % 4 == 0 else ""), "a", "en") for i in range(600)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 4 == 0)) for r in texts if r[0] % 3], "video_id long, toxic int").withColumn("score", F.lit(9))
    labels = labels.union(spark.createDataFrame([(None, 1, 9), (1, None, 9), (2, 7, 9)], "video_id long, toxic int, score int"))
    model = toxicity.train_toxicity(table(spark, texts), labels)
    assert model.lexicon.get("grum*", 0) > 1
    got = {r.video_id: r for r in toxicity.toxicity(table(spark, texts), model).collect()}
    wrong = [i for i in got if i % 3 == 0 and got[i].toxic != (i % 4 == 0)]
    assert len(wrong) <= 2


def test_toxicity_of_odd_rows(spark):
    none = spark.createDataFrame([], "video_id long, toxic int")
    model = toxicity.train_toxicity(table(spark), none)
    got = toxicity.toxicity(table(spark), model).collect()
    assert len(got) == len(ROWS) and not any(r.toxic for r in got) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(table(spark).limit(0), model).count() == 0
    assert toxicity.train_toxicity(table(spark).limit(0), none).lexicon == toxicity.ToxicModel().lexicon
