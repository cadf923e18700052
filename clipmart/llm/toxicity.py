"""Toxicity by a weighted grammar of clauses.

Five small transducers read a transcript's tokens side by side: insult, threat, target,
negation and reported speech. Their composition writes a pattern (what was matched and in which
surroundings) with a weight for each matched clause part; a text's score comes from its clauses.
Which words are insults, and what each pattern weighs, is learned from labelled transcripts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmart.llm.common import kept, shingle_hashes, small_batches, word_hashes

THRESHOLD = 0.3
#: Labelled transcripts that a fit reads at most: so many toxic ones, and so many others.
TOXIC_SAMPLE, OTHER_SAMPLE = 2000, 6000
#: Letters of the word beginnings and endings that may carry an insult.
HEADS, TAILS = (4, 5, 6), (4, 5)

# Words that the grammar knows before it has seen any label.
INSULTS = "idiot moron stupid scum loser trash worthless pathetic disgusting clown dumbass imbecile idiota imbécil estúpido idiote imbécile crétin dummkopf vollidiot".split()
THREATS = "kill hurt destroy beat shoot stab burn murder töten schlagen umbringen matar golpear tuer frapper".split()
TARGETS = "you your yours u yourself du dich dir dein ihr euch tu te toi vous votre usted ustedes ti tú they them he she".split()
NEGATIONS = "not no never isn't aren't don't won't nobody nicht kein keine nie pas ne jamais aucun nunca jamás ni".split()
REPORTS = "said says say told wrote writes called claims quoted sagte schrieb nannte dit écrit dijo escribió llamó".split()

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n]+|[\"“”«»]")

WORD, END, QUOTE, TARGET, NEGATION, REPORT, THREAT, INSULT = range(8)


class Transducer:
    """A deterministic machine: ``arcs[state][symbol]`` is (next state, what it writes)."""

    def __init__(self, arcs: list[list[tuple[int, int]]]):
        self.arcs = arcs


def countdown(trigger: int, reach: int) -> Transducer:
    """Writes 1 for *reach* symbols after *trigger*, until a clause ends."""
    arcs = []
    for left in range(reach + 1):
        arcs.append([(0 if s == END else reach if s == trigger else max(0, left - 1), int(left > 0)) for s in range(8)])
    return Transducer(arcs)


def reported() -> Transducer:
    """Writes 1 between quotation marks, and after a verb of saying until the clause ends."""
    plain, saying, quoted = 0, 1, 2
    return Transducer(
        [
            [({QUOTE: quoted, REPORT: saying}.get(s, plain), 0) for s in range(8)],
            [({QUOTE: quoted, END: plain}.get(s, saying), 1) for s in range(8)],
            [(plain if s == QUOTE else quoted, 1) for s in range(8)],
        ]
    )


def threat() -> Transducer:
    """Writes 1 for a target that follows a verb of harm within three symbols of a clause."""
    arcs = []
    for left in range(4):
        arcs.append([(0 if s == END else 3 if s == THREAT else max(0, left - 1), int(left > 0 and s == TARGET)) for s in range(8)])
    return Transducer(arcs)


def insult() -> Transducer:
    """Writes 1 for an insult."""
    return Transducer([[(0, int(s == INSULT)) for s in range(8)]])


class Grammar:
    """The composition of all transducers; states of the product are made when first reached.

    Patterns 0 to 7: an insult, plus 1 with a target, 2 negated, 4 reported. 8 to 11: a threat,
    plus 1 negated, 2 reported.
    """

    patterns = 12

    def __init__(self):
        self.parts = [insult(), threat(), countdown(TARGET, 4), countdown(NEGATION, 3), reported()]
        self.states: dict[tuple[int, ...], int] = {(0,) * 5: 0}
        self.arcs: list[list[tuple[int, int] | None]] = [[None] * 8]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and pattern (-1: none)."""
        arc = self.arcs[state][symbol]
        if arc is None:
            arc = self.arcs[state][symbol] = self._made(state, symbol)
        return arc

    def _made(self, state: int, symbol: int) -> tuple[int, int]:
        here = next(k for k, v in self.states.items() if v == state)
        moves = [part.arcs[s][symbol] for part, s in zip(self.parts, here, strict=True)]
        after = tuple(m[0] for m in moves)
        if after not in self.states:
            self.states[after] = len(self.arcs)
            self.arcs.append([None] * 8)
        insulted, threatened, target, negated, said = (m[1] for m in moves)
        pattern = target + 2 * negated + 4 * said if insulted else 8 + negated + 2 * said if threatened else -1
        return self.states[after], pattern


def parts_of(word: str) -> list[str]:
    """A word, its beginnings and its endings, as the lexicon names them."""
    out = [word]
    out += [word[:n] + "*" for n in HEADS if len(word) > n]
    out += ["*" + word[-n:] for n in TAILS if len(word) > n]
    return out


@dataclass
class ToxicModel:
    """Weights of insults (whole words and ``head*`` / ``*tail``), of patterns, and the bias."""

    lexicon: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 4.0))
    pattern_weights: list[float] = field(default_factory=lambda: [1.0, 1.2, 0.5, 0.6, 0.4, 0.5, 0.2, 0.3, 1.0, 0.4, 0.4, 0.2])
    bias: float = -2.5


class Reader:
    """Applies a model; remembers what each word means to it."""

    class Symbols(dict):
        def __init__(self, lexicon: dict[str, float]):
            self.lexicon = lexicon
            self.update(dict.fromkeys(TARGETS, (TARGET, 0.0)) | dict.fromkeys(NEGATIONS, (NEGATION, 0.0)))
            self.update(dict.fromkeys(REPORTS, (REPORT, 0.0)) | dict.fromkeys(THREATS, (THREAT, 1.0)))
            self.known = dict(self)

        def __missing__(self, token: str) -> tuple[int, float]:
            if len(self) > 500_000:
                self.clear()
                self.update(self.known)
            first = token[0]
            if first in ".!?;:\n":
                value = (END, 0.0)
            elif first in "\"“”«»":
                value = (QUOTE, 0.0)
            else:
                weight = max((self.lexicon.get(p, 0.0) for p in parts_of(token)), default=0.0)
                value = (INSULT, weight) if weight > 0 else (WORD, 0.0)
            self[token] = value
            return value

    def __init__(self, model: ToxicModel):
        self.model, self.grammar, self.symbols = model, Grammar(), self.Symbols(model.lexicon)

    def matches(self, text: str) -> np.ndarray:
        """Weight of the matched clauses by pattern; a clause counts its strongest match of each."""
        out = np.zeros(Grammar.patterns)
        read = list(map(self.symbols.__getitem__, _TOKEN.findall(text.lower())))
        if not any(s >= THREAT for s, _ in read):
            return out
        clause: dict[int, float] = {}
        state, step = 0, self.grammar.step
        for symbol, weight in read:
            state, pattern = step(state, symbol)
            if pattern >= 0:
                clause[pattern] = max(clause.get(pattern, 0.0), weight or 1.0)
            if symbol == END and clause:
                for p, w in clause.items():
                    out[p] += w
                clause = {}
        for p, w in clause.items():
            out[p] += w
        return out

    def score(self, matches: np.ndarray) -> float:
        total = self.model.bias + float(np.minimum(matches, 12.0) @ self.model.pattern_weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def train_toxicity(transcripts: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, other_sample: int = OTHER_SAMPLE) -> ToxicModel:
    """Learn the lexicon and the pattern weights from labelled transcripts.

    ``transcripts``: ``video_id``, ``transcript``. ``labels``: ``video_id``, ``toxic`` (1 or 0; others are
    ignored). At most ``toxic_sample`` toxic and ``other_sample`` other labelled rows are read,
    the first by a hash of the id; the rest of the labels is not used. Near copies count once in the
    lexicon. Without labels of both kinds the built-in words and weights stand.
    """
    spark = transcripts.sparkSession
    small_batches(spark)
    marked = labels.select("video_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and video_id is not null")
    marked = marked.withColumn("_deal", F.xxhash64(F.col("video_id").cast("string")))
    chosen = [
        marked.filter(F.col("toxic") == t).orderBy("_deal", "video_id").limit(n) for t, n in ((1, toxic_sample), (0, other_sample))
    ]
    # Never more than the two samples' rows, which is what the size of this broadcast is bounded by.
    ids = chosen[0].unionByName(chosen[1]).groupBy("video_id").agg(F.max("toxic").alias("toxic"))
    texts = transcripts.select("video_id", F.col("transcript").cast("string").alias("transcript")).filter("transcript is not null")
    sample = kept(texts.join(F.broadcast(ids), "video_id").select("toxic", "transcript").repartition(32))

    shape = "part string, copy long"

    def toxic_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _parts(batches, None)

    in_toxic = sample.filter("toxic = 1").select("transcript").mapInArrow(toxic_parts, shape)
    often = in_toxic.distinct().groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4").toPandas()
    wanted = dict(zip(often["part"], often["n"].astype(float), strict=True))
    shared = spark.sparkContext.broadcast(frozenset(wanted))

    def other_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _parts(batches, shared.value)

    in_other = sample.filter("toxic = 0").select("transcript").mapInArrow(other_parts, shape)
    seldom = in_other.distinct().groupBy("part").agg(F.count(F.lit(1)).alias("n")).toPandas()
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return ToxicModel()
    model = ToxicModel(lexicon=_lexicon(wanted, dict(zip(seldom["part"], seldom["n"].astype(float), strict=True)), totals[1], totals[0]))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            rows = [reader.matches(t).tolist() for t in batch.column("transcript").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.mapInArrow(measured, "toxic int, x array<double>").toPandas()
    return _weighted(model, np.array(rows["x"].tolist()), rows["toxic"].to_numpy(dtype=float))


def _parts(batches: Iterator[pa.RecordBatch], wanted: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Distinct (word part, copy class) of the batch; near copies mostly share the class."""
    for batch in batches:
        out: set[tuple[str, int]] = set()
        for text in batch.column("transcript").to_pylist():
            words = set(t for t in _TOKEN.findall(text.lower()) if t[0].isalnum())
            run = shingle_hashes(word_hashes([text.encode()])[0])
            copy = int(run.min()) >> 1 if len(run) else 0
            parts = {p for w in words for p in parts_of(w)}
            out.update((p, copy) for p in (parts if wanted is None else parts & wanted))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in out], pa.string()), pa.array([c for _, c in out], pa.int64())], ["part", "copy"]
        )


def _lexicon(toxic: dict[str, float], other: dict[str, float], n_toxic: int, n_other: int) -> dict[str, float]:
    """Parts that toxic transcripts hold far more often than chance among all tried parts explains."""
    share = n_toxic / (n_toxic + n_other)
    needed = math.log(max(100, len(toxic)))
    out = dict.fromkeys(INSULTS, 4.0)
    for part, t in toxic.items():
        c = other.get(part, 0.0)
        rate = t / (t + c)
        surprise = t * math.log(rate / share) + (c * math.log((1 - rate) / (1 - share)) if c else 0.0)
        odds = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_other + 1))
        if rate >= 0.85 and surprise >= needed:
            out[part] = min(6.0, max(1.0, odds))
        elif part in out and surprise < 1 and t + c >= 10:
            out[part] = 0.5
    # A beginning or ending that one word explains says nothing about other words.
    for word in [w for w in out if "*" not in w]:
        for part in parts_of(word)[1:]:
            if part in out and toxic.get(word, 0.0) >= 0.7 * toxic[part]:
                del out[part]
    return out


def _weighted(model: ToxicModel, x: np.ndarray, y: np.ndarray) -> ToxicModel:
    """Logistic regression on the pattern weights, drawn towards the built-in ones."""
    x = np.minimum(x, 12.0)
    prior = np.array([-2.5, *ToxicModel().pattern_weights])
    design = np.column_stack([np.ones(len(x)), x])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        pull = np.array([1e-3, *[0.5] * Grammar.patterns])
        gradient = design.T @ (p - y) + pull * (w - prior)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(pull)
        move = np.linalg.solve(hessian, gradient)
        w -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return ToxicModel(model.lexicon, np.maximum(w[1:], 0.0).tolist(), float(min(w[0], -1.5)))


def with_toxicity(transcripts: DataFrame, model: ToxicModel) -> DataFrame:
    """*transcripts* with a double ``_score`` for each row."""
    small_batches(transcripts.sparkSession)
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value)
        for batch in texts:
            yield pd.Series([reader.score(reader.matches(t or "")) for t in batch], dtype="float64")

    return transcripts.withColumn("_score", scored(F.col("transcript").cast("string")))


def toxicity(transcripts: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """How toxic each whole transcript is, from its text alone.

    ``transcripts``: ``video_id``, ``transcript``; other columns are ignored. Returns ``video_id``, ``score``
    (0 to 1) and ``toxic`` (score at or over ``threshold``), one row per input row. A null or empty
    transcript matches nothing and gets the score of a text without any matched clause. Repeated rows get equal scores.
    """
    scored = with_toxicity(transcripts.select("video_id", "transcript"), model)
    return scored.select("video_id", F.col("_score").alias("score"), (F.col("_score") >= threshold).alias("toxic"))
