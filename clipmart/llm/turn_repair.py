"""Repair of a dialogue's turn structure by iterative-deepening A*.

A video's turns become a string of one symbol per run of equal turns (who speaks, and what is wrong with the turn). Edits
lead through that string and through a four-state pattern of speakers; the cheapest edits are searched depth first under
growing cost bounds. Dialogues of any length are searched in chunks whose costs to go are known at their borders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from clipmart.functions.ordered import position_bucket, scan
from clipmart.llm.common import kept

#: Costs of the edits; a truncated turn that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Speakers whose initials make the pattern ``(s?(ua)+)?``: an opening one, then two in turn.
SPEAKERS = ("system", "user", "assistant")
#: Runs of a chunk (one search) and bits of a piece (one string of chunks).
CHUNK, PIECE_BITS = 32, 12
BLANKS, SENTENCE_ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Characters by which turns of one place and speaker are ordered before their digest decides.
HEAD_CHARS = 64

# Pattern states: 0 nothing yet, 1 after the opening speaker, 2 after the first, 3 after the second.
_NEXT = (2, 2, 3, 2)  # the state after the one speaker that may be put in
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_END = (0, 6, 3, 0)  # cost of closing the dialogue by insertions
_FAR = 1 << 40


class Repair(NamedTuple):
    """``videos``: one row for each dialogue; ``turns``: the repaired turns."""

    videos: DataFrame
    turns: DataFrame


# ---- one string ----------------------------------------------------------------------------
def _steps(symbol: str, state: int) -> list[tuple[str, int, int, int]]:
    """(mark, cost, runs taken, next state) of the edits of a run, in the order of their initials D, I, K, R.

    Marks: ``D`` delete, ``f``/``s`` insert the first/second speaker, ``K`` keep, ``F``/``S`` give the turn to one of them.
    """
    after = _NEXT[state]
    speaker = "f" if after == 2 else "s"
    steps = [("D", DELETE, 1, state), (speaker, INSERT, 0, after)]
    if symbol != "d":
        more = TRUNCATED if symbol.isupper() else 0
        to = _KEPT.get(symbol.lower(), {}).get(state)
        if to is not None:
            steps.append(("K", more, 1, to))
        steps.append((speaker.upper(), REROLE + more, 1, after))
    return steps


def costs_to_go(symbols: str, end: tuple[int, ...], every: int = 0) -> list[tuple[int, ...]]:
    """Least costs from each state before the symbols (and before each *every*-th one), *end* being those after them."""
    costs, out = list(end), []
    for i in range(len(symbols) - 1, -1, -1):
        taken = [min(c + costs[to] for _, c, n, to in _steps(symbols[i], q) if n) for q in range(4)]
        for _ in range(2):  # two insertions lead through all states
            taken = [min(t, INSERT + taken[_NEXT[q]]) for q, t in enumerate(taken)]
        costs = taken
        if every and i % every == 0:
            out.append(tuple(costs))
    return out[::-1] if every else [tuple(costs)]


@lru_cache(maxsize=1 << 16)
def search(symbols: str, end: tuple[int, ...], state: int) -> tuple[str, int]:
    """Marks of the cheapest edits of a chunk from *state*, first in the order of their initials, and the state they lead to.

    Depth-first search under a cost bound that grows to the least cost seen beyond it. The transposition table
    holds, for each failed state, the cost that it needs at least, and outlives the bounds.
    """
    n = len(symbols)
    floor = [min(end)] * (n + 1)
    for i in range(n - 1, -1, -1):
        least = DELETE if symbols[i] == "d" else TRUNCATED if symbols[i].isupper() else 0
        floor[i] = floor[i + 1] + least
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def needs(i: int, q: int) -> int:
        return failed.get((i, q), floor[i])

    def descend(i: int, q: int, left: int) -> int | None:
        """The state reached at the end, or None when *left* does not suffice."""
        if i == n:
            if end[q] <= left:
                return q
            failed[i, q] = end[q]
            return None
        least = _FAR
        for mark, cost, taken, to in _steps(symbols[i], q):
            if cost + needs(i + taken, to) <= left:
                path.append(mark)
                found = descend(i + taken, to, left - cost)
                if found is not None:
                    return found
                path.pop()
            least = min(least, cost + needs(i + taken, to))
        failed[i, q] = max(least, needs(i, q))
        return None

    while (found := descend(0, state, needs(0, state))) is None:
        pass
    return "".join(path), found


def walk(symbols: str, end: tuple[int, ...], state: int) -> tuple[str, int]:
    """``search`` over a string of any length, chunk by chunk."""
    if len(symbols) <= CHUNK:
        return search(symbols, end, state)
    borders = [*costs_to_go(symbols, end, CHUNK)[1:], end]
    marks = []
    for i, after in enumerate(borders):
        part, state = search(symbols[i * CHUNK : (i + 1) * CHUNK], after, state)
        marks.append(part)
    return "".join(marks), state


@F.udf(ArrayType(StructType().add("marks", StringType()).add("exit", IntegerType())), useArrow=True)
def _walked(symbols, end, entries):
    return [walk(symbols, tuple(int(x) for x in end), q) for q in range(entries)]


@F.udf(ArrayType(LongType()), useArrow=True)
def _piece_costs(symbols):
    """Least costs of a piece from each state (by four) to each."""
    ways = [costs_to_go(symbols, tuple(0 if q == r else _FAR for q in range(4)))[0] for r in range(4)]
    return [min(ways[r][q], _FAR) for q in range(4) for r in range(4)]


@F.udf(ArrayType(ArrayType(LongType())), useArrow=True)
def _piece_ends(costs):
    """Costs to go after each of the pieces that follow each other."""
    ends = [_END]
    for c in reversed(costs):
        ends.append(tuple(min(int(c[4 * q + r]) + ends[-1][r] for r in range(4)) for q in range(4)))
    return [list(e) for e in ends[:-1][::-1]]


@F.udf(ArrayType(IntegerType()), useArrow=True)
def _piece_entries(exits):
    """The state in which each of the pieces that follow each other is entered."""
    out, state = [], 0
    for e in exits:
        out.append(state)
        state = int(e[state])
    return out


# ---- tables --------------------------------------------------------------------------------
def _ordered_runs(rows: DataFrame) -> DataFrame:
    """Runs of equal turns with ``at``, their place in the order of all dialogues."""
    bare = F.rtrim("text", F.lit(BLANKS))
    runs = rows.select(
        "video_id", "ord", "speaker", F.substring("text", 1, HEAD_CHARS).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"),
        (bare == "").alias("is_blank"), (~F.right(bare, F.lit(1)).isin(*SENTENCE_ENDS)).alias("is_truncated"),
    ).groupBy("video_id", "ord", "speaker", "head", "digest", "is_blank", "is_truncated").agg(F.count(F.lit(1)).alias("copies"))
    along = [F.asc_nulls_first(c) for c in ("video_id", "ord", "speaker", "head", "digest")]
    # The ranges are drawn from a sample, so the places are written out once.
    return kept(runs.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("at", F.monotonically_increasing_id()).drop("head"))


def _symbol(speakers: tuple[str, str, str]) -> Column:
    cls = F.lit("x")
    for letter, label in zip("aus", speakers[::-1], strict=True):
        cls = F.when(F.col("initial") == label[:1], letter).otherwise(cls)
    return F.when(F.col("is_blank") | F.col("repeats"), "d").when(F.col("is_truncated"), F.upper(cls)).otherwise(cls)


def _judged_runs(rows: DataFrame, speakers: tuple[str, str, str]) -> DataFrame:
    placed = _ordered_runs(rows)
    # The first of all turns with one speaker and text; joined by place, so that a text of many turns is no hot key.
    firsts = placed.filter("not is_blank").groupBy("video_id", "speaker", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    judged = placed.join(firsts, "at", "left").withColumns(
        {"repeats": ~F.col("is_blank") & F.col("first").isNull(), "initial": F.substring("speaker", 1, 1)}
    ).drop("first")
    seen = scan(judged, ["video_id"], position_bucket("at"), ["at"], lag=["initial"], lead=["initial"])
    return seen.withColumn("symbol", _symbol(speakers))


def _pieces(runs: DataFrame) -> DataFrame:
    """Strings of at most ``2 ** PIECE_BITS`` runs of a dialogue; ``head``/``tail``: its first/last one."""
    entry = F.struct("at", "symbol", "copies", "speaker", "digest")
    return runs.groupBy("video_id", F.shiftright("at", PIECE_BITS).alias("_piece")).agg(
        F.sort_array(F.collect_list(entry)).alias("runs"),
        F.max(F.col("prev_initial").isNull()).alias("head"), F.max(F.col("next_initial").isNull()).alias("tail"),
    ).select("video_id", F.col("runs")[0]["at"].alias("first_at"), "runs", F.array_join("runs.symbol", "").alias("symbols"), "head", "tail")


def _chained(parts: DataFrame, value: str, fold, name: str) -> DataFrame:
    """(first_at, *name*): *fold* of the values of a dialogue's pieces, in their order."""
    every = parts.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("first_at", value))).alias("_all"))
    zipped = F.arrays_zip(F.col("_all.first_at").alias("at"), fold(F.col(f"_all.{value}")).alias("value"))
    return every.select(F.explode(zipped).alias("_p")).select(F.col("_p.at").alias("first_at"), F.col("_p.value").alias(name))


def _solved(pieces: DataFrame) -> DataFrame:
    """Pieces with ``marks`` of their edits, closing insertions included."""
    closed = F.array(*[F.lit(c).cast("bigint") for c in _END])
    alone = F.col("head") & F.col("tail")
    whole = pieces.filter(alone).withColumn("_way", _walked("symbols", closed, F.lit(1))[0])
    # Pieces of longer dialogues: costs to go at their ends, the edits from each state, then the states that are met.
    parts = pieces.filter(~alone)
    ends = _chained(parts.withColumn("costs", _piece_costs("symbols")), "costs", _piece_ends, "end")
    tried = kept(parts.join(ends, "first_at").withColumn("_ways", _walked("symbols", "end", F.lit(4))).drop("end"))
    entries = _chained(tried.withColumn("exits", F.col("_ways.exit")), "exits", _piece_entries, "entry")
    met = tried.join(entries, "first_at").withColumn("_way", F.get("_ways", F.col("entry"))).select(*whole.columns)
    closing = F.when(F.col("tail") & (F.col("_way.exit") == 1), "fs").when(F.col("tail") & (F.col("_way.exit") == 2), "s").otherwise("")
    return whole.unionByName(met).select("video_id", "first_at", "runs", F.col("_way.marks").alias("marks"), closing.alias("closing"))


def repair_turns(turns: DataFrame, speakers: tuple[str, str, str] = SPEAKERS) -> Repair:
    """Repair each video's dialogue with the cheapest edits.

    ``turns``: ``video_id``, ``ord``, ``speaker``, ``text``; other columns are ignored. A dialogue's turns go by ``ord`` (nulls first), then
    ``speaker``, then text (by its first 64 characters, then its SHA-256). Null speakers and texts are one space. Turns are judged by
    their first fault: *blank* (nothing but space and 0x09-0x0D), *duplicate* (speaker and text seen earlier in
    the dialogue), *truncated* (the last other character is none of ``.!?``). Speakers count by their first character, an
    empty speaker fits nowhere.

    Edits: Keep (0), Rerole to the second or third of *speakers* (3), Delete (4, the only one for blank and duplicate turns), Insert
    an empty turn of one of these two (3); a truncated turn that is not deleted costs 3 more. What remains reads
    ``(s?(ua)+)?`` in the initials of *speakers*. Of the cheapest edits, those whose initials come first in ASCII order are taken.

    ``videos`` has one row for each ``video_id`` (null is one): ``gaps`` (places missing between the least and greatest ``ord``), ``blank``,
    ``duplicate``, ``truncated``, ``illegal`` (neighbours other than su, ua, au), ``cost``, ``audit`` (initials of the edits in order). ``turns``
    has the repaired turns in the order of ``video_id``, ``place``, ``step``: ``edit`` (K, R or I), ``speaker``, ``text``. Repeated rows are
    duplicates; an empty table gives empty tables.

    A dialogue of any length is spread over tasks: its turns are placed by ranges, equal turns are counted before they
    move, and pieces of 4,096 runs are searched on their own; a row of 16 costs for each is all that is chained.
    """
    rows = turns.select(
        "video_id", F.col("ord").cast("long").alias("ord"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("speaker", "text")],
    )
    runs = _judged_runs(rows, speakers)
    s, u, a = (x[:1] for x in speakers)
    pair = F.concat("prev_initial", "initial")
    repeated, once = F.col("copies") - 1, F.col("copies")
    marked = {
        "blank": F.when(F.col("is_blank"), once).otherwise(0),
        "duplicate": F.when(F.col("is_blank"), 0).when(F.col("repeats"), once).otherwise(repeated),
        "truncated": (~F.col("is_blank") & ~F.col("repeats") & F.col("is_truncated")).cast("long"),
        "illegal": repeated + F.when(F.col("prev_initial").isNotNull() & ~pair.isin(s + u, u + a, a + u), 1).otherwise(0),
    }
    faults = runs.groupBy("video_id").agg(
        F.coalesce(F.max("ord") - F.min("ord") + 1 - F.countDistinct("ord"), F.lit(0).cast("long")).alias("gaps"),
        *[F.sum(c).alias(n) for n, c in marked.items()],
    )
    solved = kept(_solved(_pieces(runs)))

    tokens = F.regexp_extract_all("marks", F.lit("([fs]*[DKFS])"), F.lit(1))
    edits = F.concat(F.array_join(F.zip_with(tokens, "runs", lambda t, r: F.concat(t, F.repeat(F.lit("D"), (r["copies"] - 1).cast("int")))), ""), "closing")
    priced = solved.withColumn("_text", F.translate(edits, "fsFS", "IIRR")).withColumn(
        "_stays", F.aggregate(
            F.zip_with(tokens, "runs", lambda t, r: F.when(r["symbol"].rlike("[A-Z]") & ~t.endswith("D"), TRUNCATED).otherwise(0)), F.lit(0), lambda x, y: x + y
        )
    )
    letter = lambda x: F.length("_text") - F.length(F.replace("_text", F.lit(x), F.lit("")))
    cost = letter("D") * DELETE + letter("I") * INSERT + letter("R") * REROLE + F.col("_stays")
    audits = priced.groupBy("video_id").agg(
        F.sum(cost.cast("long")).alias("cost"), F.sort_array(F.collect_list(F.struct("first_at", "_text"))).alias("_all")
    ).select(F.col("video_id").alias("_video"), "cost", F.array_join("_all._text", "").alias("audit"))
    videos = faults.join(audits, F.col("video_id").eqNullSafe(F.col("_video")), "left").drop("_video")
    return Repair(videos, _repaired(rows, solved, tokens, speakers))


def _repaired(rows: DataFrame, solved: DataFrame, tokens: Column, speakers: tuple[str, str, str]) -> DataFrame:
    own = solved.select("video_id", F.explode(F.arrays_zip(tokens.alias("t"), F.col("runs").alias("r"))).alias("_e"))
    own = own.select("video_id", F.col("_e.r").alias("r"), F.posexplode(F.split("_e.t", "")).alias("step", "mark"))
    # Closing insertions stand behind the last run.
    closing = solved.filter("closing <> ''").select("video_id", F.element_at("runs", -1).alias("r"), F.posexplode(F.split("closing", "")).alias("step", "mark"))
    each = own.unionByName(closing.withColumn("step", F.col("step") + 10)).filter("mark not in ('D', '')").select(
        "video_id", F.col("r.at").alias("place"), "step", "mark", F.translate("mark", "fsFS", "IIRR").alias("edit"),
        F.col("r.speaker").alias("_speaker"), F.col("r.digest").alias("_digest"),
    )
    named = F.when(F.lower("mark") == "f", speakers[1]).when(F.lower("mark") == "s", speakers[2]).otherwise(F.col("_speaker"))
    each = each.withColumn("speaker", named)
    order = ["video_id", "place", "step", "edit", "speaker"]
    texts = rows.select(F.col("video_id").alias("_v"), F.col("speaker").alias("_s"), F.unhex(F.sha2("text", 256)).alias("_d"), "text")
    texts = texts.groupBy("_v", "_s", "_d").agg(F.first("text").alias("text"))
    same = F.col("video_id").eqNullSafe(F.col("_v")) & (F.col("_speaker") == F.col("_s")) & (F.col("_digest") == F.col("_d"))
    told = each.filter("edit <> 'I'").join(texts, same).select(*order, "text")
    return told.unionByName(each.filter("edit = 'I'").select(*order, F.lit("").alias("text")))


# ---- digest --------------------------------------------------------------------------------
def turns_digest(repaired: DataFrame) -> DataFrame:
    """(video_id, repaired_sha256): SHA-256 of each dialogue's ``speaker:text``, joined by newlines.

    A digest is read in order, so a dialogue is read by one task; it passes through as a stream, one batch at a time.
    """
    lines = repaired.select("video_id", "place", "step", F.concat_ws(":", "speaker", "text").cast("binary").alias("line"))
    kind = dict(lines.dtypes)["video_id"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for video, line in zip(batch.column("video_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or video != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = video, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            yield out(done, batch.schema.field("video_id").type)
            shape = batch.schema.field("video_id").type
        if state is not None:
            yield out([(now, state.hexdigest())], shape)

    def out(rows: list[tuple], shape: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], shape), pa.array([d for _, d in rows], pa.string())], ["video_id", "repaired_sha256"])

    along = [F.asc_nulls_first("video_id"), "place", "step"]
    return lines.repartition("video_id").sortWithinPartitions(*along).mapInArrow(digests, f"video_id {kind}, repaired_sha256 string")
