"""Range joins as equi joins on time cells of several widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmart.functions.ordered import own_keys, with_cells, without_cells

#: Cells of a level are this many times as wide as those of the level below; the last level is one cell that holds everything.
GROWTH, LEVELS = 16, 9


def _level(start: Column, end: Column, width: float) -> Column:
    """The lowest level on which a span touches at most ``GROWTH + 1`` cells."""
    length = end - start
    above = [F.when(length > width * GROWTH ** (i + 1), 1).otherwise(0) for i in range(LEVELS)]
    return sum(above[1:], above[0])


def _cell(at: Column, level: Column, width: float) -> Column:
    wide = F.lit(float(width)) * F.pow(F.lit(float(GROWTH)), level)
    return F.when(level >= LEVELS, F.lit(0).cast("long")).otherwise(F.floor(at / wide).cast("long"))


def _levels(df: DataFrame, span: tuple[str, str], width: float) -> Column:
    """The levels on which spans of *df* are, found before the join starts; points are all on the lowest."""
    if span[0] == span[1]:
        return F.array(F.lit(0))
    start, end = (F.col(c) for c in span)
    return df.select(_level(start, end, width).alias("_l")).agg(F.sort_array(F.collect_set("_l")).alias("_l")).scalar()


def _placed(df: DataFrame, start: Column, end: Column, width: float, others: Column | None) -> DataFrame:
    """Rows on the cells of their level, and on those that they touch on each higher one of *others*."""
    own = _level(start, end, width)
    every = F.sequence(F.lit(0), F.lit(LEVELS)) if others is None else others
    levelled = df.withColumns({"_own": own, "_every": every})
    levels = F.concat(F.array("_own"), F.filter("_every", lambda x: x > F.col("_own")))
    seen = levelled.withColumn("_level", F.explode(levels))
    first, last = _cell(start, F.col("_level"), width), _cell(end, F.col("_level"), width)
    return seen.withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, last)))).drop("_every")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    width: float = 30.0,
    closed: bool = False,
    look: tuple[str, ...] = ("left", "right"),
) -> DataFrame:
    """Pairs on ``key`` whose time spans overlap.

    Half-open by default (touching spans do not pair); ``closed`` includes touching ends. A span lies on the level
    whose cells it touches at most ``GROWTH + 1`` of, so a span of any length is copied a bounded number of times. It also visits the higher levels
    on which the other side has spans: these are looked up by a scalar subquery for the sides in ``look`` (leave out a side
    that is costly to compute), and are all levels otherwise. A pair is emitted on the higher of its two levels, in the cell
    that holds the later of the two starts, so no de-duplication shuffle is needed.
    Column names other than ``key`` must differ between the sides.
    """
    ls, le = (F.col(c) for c in left_span)
    rs, re = (F.col(c) for c in right_span)
    seen_left = _levels(left, left_span, width) if "left" in look else None
    seen_right = _levels(right, right_span, width) if "right" in look else None
    a = _placed(left, ls, le, width, seen_right).withColumnRenamed("_own", "_own_a")
    b = _placed(right, rs, re, width, seen_left).withColumnRenamed("_own", "_own_b")
    hit = ((re >= ls) & (rs <= le)) if closed else ((re > ls) & (rs < le))
    owner = (F.col("_level") == F.greatest("_own_a", "_own_b")) & (_cell(F.greatest(ls, rs), F.col("_level"), width) == F.col("_cell"))
    # The stand-ins are joined as well as the key, so sides that lie by key already stay where they are. Null keys still meet nobody.
    a, b = (with_cells(x, [key], {}).drop("_cell_m", "_cell_km") for x in (a, b))
    # Never broadcast: a side is measured by what it was exploded from, which may be a small part of it.
    pairs = a.join(b.hint("merge"), [*own_keys(a), key, "_level", "_cell"]).filter(hit & owner)
    return without_cells(pairs).drop("_level", "_cell", "_own_a", "_own_b")
