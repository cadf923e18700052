"""Line de-duplication by a segment-partition edit join, on DataFrame functions only.

Two lines within *edits* edits share one of *edits + 1* segments at nearly the same place.
Segments of every distinct line are indexed by (size, segment, hash); a line probes the
indexes of its own and the next smaller segment size. Lines that meet there are paired where the counts
of their letters are near enough, and pairs are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmart.llm.common import kept, released
from clipmart.llm.components import components

EDITS = 3
#: Shorter lines (bullets, headings, single words) are left as they are, unless a caller asks for them.
MIN_CHARS = 24
#: One edit for each so many characters of the shorter line: lines of fewer are classed by equality, those of up
#: to ``NEAR_CHARS`` with one edit, and from there on with ``EDITS``.
SHORT_CHARS, NEAR_CHARS = 8, 24
#: Line ids that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Characters that are counted in lines which meet another one, ten to a number. Any characters give the same result.
COUNTED = ("etaoinsrlu", "dcmhgpfybw", "0123456789")
#: Each count is kept modulo 32 in the low bits of six.
_ONES = sum(1 << 6 * i for i in range(10))
_COUNTS, _GUARDS = _ONES * 31, _ONES * 32


def _size(length: Column, edits: int) -> Column:
    """Size of the segments of a line: an even share, cut to its four leading bits so that near lengths agree."""
    even = F.floor(length / (edits + 1)).cast("int")
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(even)) - 4, F.lit(0)))
    return F.floor(even / step).cast("int") * step


def _keys(line: Column, length: Column, size: Column, edits: int) -> tuple[list[Column], list[Column]]:
    """Keys of a line for segments of *size* characters: at their own places (a line is found and looks up under
    these), and at the places to which edits outside of a segment can have moved it (it only looks up).

    The first half of the segments is laid from the beginning, the others from the end. Of the segments from one
    side, either one without an edit has at most as many edits before it as segments, or each has cost
    one edit at least; both sides together would then have cost *edits + 1*.
    """
    own, moved = [], []
    for i in range(edits + 1):
        near = min(i, edits - i)
        head = i <= edits - i
        for move in range(-near, near + 1):
            at = size * near + move if head else length - size * (near + 1) + move
            key = F.xxhash64(size, F.lit(i), F.substring(line, at + 1, size))
            if move:
                moved.append(F.when((at >= 0) & (at + size <= length), key))
            else:
                own.append(key)
    return own, moved


def _common(a: Column, b: Column, room: Column, head: bool) -> Column:
    """Length of the common beginning (or end) of two texts, by halving steps; at most *room*."""

    def same(n: Column) -> Column:
        if head:
            return F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)
        return F.right(a, n) == F.right(b, n)

    steps = F.array(*[F.lit(1 << i) for i in range(24, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= room) & same(at + step), at + step).otherwise(at))


def _counts(line: Column) -> Column:
    """How often each of ``COUNTED`` is in a line, modulo 32: an array of numbers."""

    def packed(letters: str) -> Column:
        own = [F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in letters]
        return sum([F.shiftleft(n.bitwiseAND(F.lit(31)).cast("long"), 6 * i) for i, n in enumerate(own)], F.lit(0).cast("long"))

    return F.array(*[packed(letters) for letters in COUNTED])


def _more(a: Column, b: Column) -> Column:
    """By how much the counts of *a* are above those of *b*, in all; modulo 63, and differences of 16 and more may be left out."""
    ones, counts, guards = (F.lit(x).cast("long") for x in (_ONES, _COUNTS, _GUARDS))
    # All counts at once: the guard above each count is lent to it, and differences from 16 on (below zero) are masked out.
    apart = (a.bitwiseOR(guards) - b).bitwiseAND(counts)
    below = F.shiftright(apart, 4).bitwiseAND(ones) * 31
    return apart.bitwiseAND(F.bitwise_not(below)) % 63


def _counts_near(a: Column, b: Column, edits: int) -> Column:
    """Whether lines with these counts can be within *edits* edits: an edit adds one letter at most, and takes one away at most.

    Of lines that are within fewer than 16 edits, all differences are seen as they are.
    """
    ways = [sum([_more(x[i], y[i]) for i in range(1, len(COUNTED))], _more(x[0], y[0])) for x, y in ((a, b), (b, a))]
    return (ways[0] <= edits) & (ways[1] <= edits) if edits < 16 else F.lit(True)


def _meeting(shared: DataFrame, marks: DataFrame, edits: int) -> DataFrame:
    """Distinct pairs (``_ha``, ``_hb``) that meet under a key and whose lengths and letters let them be similar.

    ``shared``: ``_key``, ``_h``, ``_role``; ``marks``: ``_h``, ``_c`` (``_counts``), ``_n`` (length).
    """
    marked = shared.join(marks, "_h")
    a = marked.filter("_role = 0").select(F.col("_h").alias("_ha"), "_key", F.col("_c").alias("_ca"), F.col("_n").alias("_na"))
    b = marked.select(F.col("_h").alias("_hb"), "_key", "_role", F.col("_c").alias("_cb"), F.col("_n").alias("_nb"))
    # Of two lines with segments of one size, one direction is enough.
    once = (F.col("_ha") < F.col("_hb")) | ((F.col("_role") == 2) & (F.col("_ha") != F.col("_hb")))
    near = (F.abs(F.col("_na") - F.col("_nb")) <= edits) & _counts_near(F.col("_ca"), F.col("_cb"), edits)
    return a.join(b, "_key").filter(once & near).select("_ha", "_hb").distinct()


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """*df* with *columns* worked out once: a generator keeps them from being copied into later lambdas."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", one.alias("_one")).select(*df.columns, "_one.*")


def _lines(transcripts: DataFrame, min_chars: int) -> DataFrame:
    """Lines long enough to be compared, with the key of their row."""
    text = F.col("transcript").cast("string")
    rows = transcripts.select("_id", "_text", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.filter(F.length("line") >= min_chars).withColumn("line_id", F.unhex(F.md5("line")))


def similar_lines(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Pairs ``a``, ``b`` of ids of different lines within *edits* edits (``line_id``, ``line`` in).

    Lines are made distinct first, so a line that is everywhere is indexed and probed once.
    """
    lines = lines.withColumn("_h", F.xxhash64("line"))
    line, length = F.col("line"), F.length("line")
    sized = lines.withColumns({"_size": _size(length, edits), "_less": _size(F.greatest(length - edits, F.lit(0)), edits)})
    own, moved = _keys(line, length, F.col("_size"), edits)
    # A line looks for those of its segment size and, where a slightly shorter line has smaller segments, of that.
    below = [F.when(F.col("_less") < F.col("_size"), k) for ks in _keys(line, length, F.col("_less"), edits) for k in ks]
    # A line travels as its keys; texts are fetched for lines that meet another one.
    named = {f"_k{i}": k for i, k in enumerate([*own, *moved, *below])}
    distinct = sized.groupBy("_h").agg(*[F.first(k).alias(n) for n, k in named.items()])
    keys = distinct.select("_h", F.posexplode(F.array(*named)).alias("_at", "_key")).filter("_key is not null").select(
        "_key", "_h", F.when(F.col("_at") < len(own), 0).when(F.col("_at") < len(own) + len(moved), 1).otherwise(2).cast("byte").alias("_role")
    )
    group = Window.partitionBy("_key")
    alone = F.min("_h").over(group) == F.max("_h").over(group)
    shared = kept(keys.withColumn("_alone", alone | (F.min("_role").over(group) > 0)).filter("not _alone").select("_key", "_h", "_role"))
    named = shared.select("_h").distinct()
    few = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # Read several times: written out, lines are cut and hashed once.
    texts = kept(lines.join(F.broadcast(named) if few else named, "_h").dropDuplicates(["line_id"]).select("_h", "line_id", "line"))
    marks = texts.select("_h", _counts(F.col("line")).alias("_c"), F.length("line").alias("_n"))
    met = kept(_meeting(shared, F.broadcast(marks) if few else marks, edits))
    released(lines.sparkSession)
    paired = met.join(texts.toDF("_ha", "a", "_ta"), "_ha").join(texts.toDF("_hb", "b", "_tb"), "_hb")
    ta, tb = F.col("_ta"), F.col("_tb")
    paired = _settled(paired, _head=_common(ta, tb, F.length(ta), True))
    paired = _settled(paired, _tail=_common(ta, tb, F.length(ta) - F.col("_head"), False))
    core = [F.substring(t, F.col("_head") + 1, F.length(t) - F.col("_head") - F.col("_tail")) for t in (ta, tb)]
    return paired.filter(F.levenshtein(core[0], core[1], edits) >= 0).select("a", "b")


def dedup_lines(transcripts: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Transcripts without the lines that repeat an earlier line up to *edits* edits (short lines: one or none).

    ``transcripts``: ``video_id``, ``transcript``; other columns are ignored, whatever their names. Lines of at
    least ``min_chars`` characters that are linked by a chain of lines, each within ``edits`` edits of the next,
    are one class; the first of a class by (``video_id``, line number) stays, the others go. A null id comes first.
    Where ``min_chars`` lets in lines under ``NEAR_CHARS`` characters, those of ``SHORT_CHARS`` or more are linked by one
    edit (to lines up to one character longer as well) and still shorter ones are in one class if equal. Empty lines stay.

    Returns one row per input row: ``video_id``, ``n_lines``, ``n_dropped``, ``transcript`` (the lines that stay). A null transcript
    has no lines and stays null, an empty one has one empty line. Rows equal in id and text are one transcript
    and keep the same lines. An empty table gives an empty result.

    Occurrences travel as ids, never in groups: the first of a class is an aggregate that combines map-side,
    and a class that fills a third of all lines is joined back by parts.
    """
    rows = transcripts.select("video_id", F.col("transcript").cast("string").alias("transcript")).withColumns(
        {"_id": F.coalesce(F.col("video_id").cast("string"), F.lit("")), "_text": F.xxhash64("transcript")}
    )
    min_chars = max(1, min_chars)
    lines = _lines(rows, min_chars).select("line_id", "line")
    links = similar_lines(lines.filter(F.length("line") >= max(NEAR_CHARS, min_chars)), edits)
    if min_chars < NEAR_CHARS and edits:
        short = lines.filter(F.length("line").between(SHORT_CHARS, NEAR_CHARS))
        links = links.union(similar_lines(short, 1))
    links = kept(links)
    classes = components(links)

    seen = rows.select("video_id", "_id", "_text", F.posexplode(F.split("transcript", "\n")).alias("line_no", "line"))
    seen = seen.filter(F.length("line") >= min_chars).select(
        F.unhex(F.md5("line")).alias("line_id"), F.struct("video_id", "_text", "line_no").alias("_at"), "_id", "_text", "line_no"
    )
    seen = seen.join(classes.toDF("line_id", "_class"), "line_id", "left").withColumn("_class", F.coalesce("_class", "line_id"))
    first = seen.groupBy("_class").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    dropped = seen.join(first, "_class").filter(F.col("_at") != F.col("_first")).select("_id", "_text", "line_no")
    dropped = dropped.distinct().groupBy("_id", "_text").agg(F.array_sort(F.collect_list("line_no")).alias("_gone"))

    out = rows.join(dropped, ["_id", "_text"], "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    # What lies between two dropped lines stays: the gaps are walked once.
    out = _settled(out, _lines=F.split("transcript", "\n"))
    after, upto = F.concat(F.array(F.lit(-1)), "_gone"), F.concat("_gone", F.array(F.size("_lines")))
    out = _settled(out, _gaps=F.arrays_zip(after.alias("after"), upto.alias("upto")))
    stay = F.flatten(F.transform("_gaps", lambda gap: F.slice("_lines", gap["after"] + 2, gap["upto"] - gap["after"] - 1)))
    return out.select(
        "video_id", F.coalesce(F.when(F.col("_lines").isNotNull(), F.size("_lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_dropped"), F.array_join(stay, "\n").alias("transcript"),
    )
