"""Ordered-series helpers that survive hot keys.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here each key is cut
into *buckets* (columns that never decrease along the order, for example ``ord div 4096``):
windows run inside a cell, that is one bucket of one key, and one small summary row per
cell carries the state across bucket edges. There is one plan for keys of any size, and nothing
is looked up while it is built. Null keys and null order values are groups like any other.

Where the plan says that a key's rows lie in one partition already (``lies_by``), cells would lie there as well: they would run on
the same task, and the summaries would work out all rows once more. Windows then run along the whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 4096


def position_bucket(ordinal: str | Column, rows: int = ROWS_PER_BUCKET) -> Column:
    """Bucket for a dense per-key position: at most *rows* rows each."""
    col = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(col / F.lit(rows)).cast("long")


def time_bucket(seconds: str | Column, width: float = 600.0) -> Column:
    """Bucket for a time axis in seconds."""
    col = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.floor(col / F.lit(float(width))).cast("long")


CELL = "_cell"


def _stand_in(column: Column, kind: str) -> Column:
    """*column* with a value of its type for null."""
    if kind == "string":
        return F.coalesce(column, F.lit(""))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.coalesce(column, F.lit("1970-01-01").cast(kind))
    if kind == "boolean":
        return F.coalesce(column, F.lit(False))
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.coalesce(column, F.lit(0).cast(kind))
    return F.coalesce(F.to_json(F.struct(column.alias("x"))), F.lit(""))


def with_cells(df: DataFrame, keys: Sequence[str], bucket: Mapping[str, Column] | Column) -> DataFrame:
    """*df* with the columns that name each row's cell.

    They are never null (a mask column tells nulls apart from their stand-ins), so rows and
    summaries join by plain equality on the partitioning that the windows already have. Scans that follow
    each other on one frame share cells, and with them one shuffle; ``without_cells`` removes them.
    """
    buckets = {"0": bucket} if isinstance(bucket, Column) else dict(bucket)
    if buckets:
        df = df.withColumns({f"{CELL}_at_{n}": c for n, c in buckets.items()})
    named = [*keys, *(f"{CELL}_at_{n}" for n in buckets)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    mask = sum([F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(named)], F.lit(0))
    key_mask = sum([F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(keys)], F.lit(0))
    stand_ins = {f"{CELL}_{'k' if i < len(keys) else 'b'}{i}": _stand_in(F.col(c), kinds[c]) for i, c in enumerate(named)}
    return df.withColumns({**stand_ins, f"{CELL}_m": mask, f"{CELL}_km": key_mask})


def spread(df: DataFrame, parts: int, keys: Sequence[str]) -> DataFrame:
    """*df* in *parts* partitions by *keys*, on the stand-ins of ``with_cells``: cells, and all that is grouped or joined by them, need no further shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.repartition(parts, *[_stand_in(F.col(k), kinds[k]) for k in keys])


def own_keys(df: DataFrame) -> list[str]:
    """The columns that stand for the keys of a frame with cells. Grouped or joined by as well, they keep rows where a scan has put them."""
    return [c for c in df.columns if c.startswith(f"{CELL}_k") and c != f"{CELL}_km"]


def grouped(df: DataFrame, keys: Sequence[str], *others: str | Column) -> GroupedData:
    """*df* grouped by *keys* and *others* without moving rows that lie by key; ``without_cells`` removes the stand-ins."""
    celled = with_cells(df, keys, {})
    return celled.groupBy(*own_keys(celled), *keys, *others)


def stacked(frames: Sequence[DataFrame], keys: Sequence[str], bucket: Mapping[str, Column] | Column) -> DataFrame:
    """The rows of all *frames* with their cells, left where they lie; ``bare_keys`` brings the keys back.

    A union tells where its rows lie only if all its sides say the same about it. A key next to its stand-in would say it twice, so until then
    keys are wrapped in arrays, which nothing looks through.
    """
    wrapped = [with_cells(x, keys, bucket).withColumns({k: F.array(k) for k in keys}) for x in frames]
    out = wrapped[0]
    for more in wrapped[1:]:
        out = out.unionByName(more)
    return out


def bare_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """*df* with the keys that ``stacked`` has wrapped."""
    return df.withColumns({k: F.element_at(k, 1) for k in keys})


def lies_by(df: DataFrame, columns: Sequence[str]) -> bool:
    """The rows of *df* with equal *columns* lie in one partition of a hash of these. Told by the plan: nothing is run.

    One partition of everything does not count, nor do files that were written by a key: those rows can still be dealt out.
    """
    plan = df.select(*columns)._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        # The node around an adaptive plan does not tell how that one partitions its rows.
        plan = plan.initialPlan()
    # A hash of other columns does not get through the selection.
    return "hashpartitioning(" in plan.outputPartitioning().toString()


def without_cells(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(f"{CELL}_")])


def scan(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Mapping[str, Column] | Column,
    order: Sequence[str],
    *,
    lag: Sequence[str] = (),
    lead: Sequence[str] = (),
    run_last: Mapping[str, Column] | None = None,
    prior_last: Mapping[str, Column] | None = None,
    prior_max: Mapping[str, Column] | None = None,
    run_sum: Mapping[str, Column] | None = None,
    next_first: Mapping[str, Column] | None = None,
    later_first: Mapping[str, Column] | None = None,
    ordinal: str | None = None,
) -> DataFrame:
    """Add neighbour and running columns along ``order`` within ``keys``.

    ``lag``/``lead`` name columns; results are ``prev_<c>`` / ``next_<c>``. ``run_last`` is the
    last non-null value up to the current row, ``prior_last`` and ``prior_max`` look at earlier
    rows only, ``next_first`` is the first non-null value from the current row on, ``later_first`` that of later
    rows only, ``ordinal`` is a 1-based row number. Where ``df`` already has cells (``with_cells``) they are used and kept.

    The summaries are the last rows of the windowed cells, so both uses of the rows
    share one shuffle, and the join back is a broadcast whenever the summaries are small.
    """
    run_last, prior_last, prior_max = dict(run_last or {}), dict(prior_last or {}), dict(prior_max or {})
    run_sum, next_first, later_first = dict(run_sum or {}), dict(next_first or {}), dict(later_first or {})
    if ordinal:
        run_sum[ordinal] = F.lit(1).cast("long")
    order = list(order)
    given = any(c.startswith(f"{CELL}_") for c in df.columns)
    celled = df if given else with_cells(df, keys, bucket)
    places = [c for c in celled.columns if c.startswith(f"{CELL}_at_")]
    cell = [c for c in celled.columns if c.startswith(f"{CELL}_") and c not in places and c != f"{CELL}_km"]
    key = [c for c in cell if c.startswith(f"{CELL}_k")] + [f"{CELL}_km"]
    places_up, places_down = [F.asc_nulls_first(b) for b in places], [F.desc_nulls_last(b) for b in places]

    if lies_by(celled, key):
        along = Window.partitionBy(*key).orderBy(*places_up, *order)
        back = Window.partitionBy(*key).orderBy(*places_down, *[F.desc(c) for c in order])
        upto, earlier = (along.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))
        onward, later = (back.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))
        found = {
            **{f"prev_{c}": F.lag(c).over(along) for c in lag},
            **{f"next_{c}": F.lead(c).over(along) for c in lead},
            **{n: F.last(c, ignorenulls=True).over(upto) for n, c in run_last.items()},
            **{n: F.last(c, ignorenulls=True).over(earlier) for n, c in prior_last.items()},
            **{n: F.max(c).over(earlier) for n, c in prior_max.items()},
            **{n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in run_sum.items()},
            **{n: F.last(c, ignorenulls=True).over(onward) for n, c in next_first.items()},
            **{n: F.last(c, ignorenulls=True).over(later) for n, c in later_first.items()},
        }
        kept = [c for c in (celled if given else df).columns if c not in found]
        return celled.select(*kept, *[c.alias(n) for n, c in found.items()])

    inside = Window.partitionBy(*cell).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    # "All later rows" as "all earlier rows of the reversed order": a frame that ends at
    # unboundedFollowing is re-aggregated for every row, a growing frame is not.
    reverse = Window.partitionBy(*cell).orderBy(*[F.desc(c) for c in order])
    onward, later = (reverse.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))

    local: dict[str, Column] = {"_tail": F.lead(F.lit(1)).over(inside).isNull()}
    total: dict[str, Column] = {}
    if lag:
        local["_lag"] = F.lag(F.struct(*lag)).over(inside)
        total["_end_row"] = F.struct(*lag)
    if lead:
        local["_lead"] = F.lead(F.struct(*lead)).over(inside)
        local["_head"] = F.first(F.struct(*lead)).over(upto)
        total["_head"] = F.col("_head")
    for n, c in run_last.items():
        local[f"_in_{n}"] = F.last(c, ignorenulls=True).over(upto)
        total[f"_all_{n}"] = F.col(f"_in_{n}")
    for n, c in prior_last.items():
        local[f"_in_{n}"] = F.last(c, ignorenulls=True).over(earlier)
        total[f"_all_{n}"] = F.coalesce(c, F.col(f"_in_{n}"))
    for n, c in prior_max.items():
        local[f"_in_{n}"] = F.max(c).over(earlier)
        total[f"_all_{n}"] = F.greatest(c, F.col(f"_in_{n}"))
    for n, c in run_sum.items():
        local[f"_in_{n}"] = F.sum(c).over(upto)
        total[f"_all_{n}"] = F.col(f"_in_{n}")
    for n, c in [*next_first.items(), *later_first.items()]:
        local[f"_in_{n}"] = F.last(c, ignorenulls=True).over(onward if n in next_first else later)
        local[f"_any_{n}"] = F.first(c, ignorenulls=True).over(upto)
        total[f"_all_{n}"] = F.col(f"_any_{n}")
    rows = celled.withColumns(local)

    along = Window.partitionBy(*key).orderBy(*places_up)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*key).orderBy(*places_down)
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    carried: dict[str, Column] = {}
    if lag:
        carried["_carry_lag"] = F.lag("_end_row").over(along)
    if lead:
        carried["_carry_lead"] = F.lead("_head").over(along)
    for n in [*run_last, *prior_last]:
        carried[f"_carry_{n}"] = F.last(f"_all_{n}", ignorenulls=True).over(before)
    for n in prior_max:
        carried[f"_carry_{n}"] = F.max(f"_all_{n}").over(before)
    for n in run_sum:
        carried[f"_carry_{n}"] = F.sum(f"_all_{n}").over(before)
    for n in [*next_first, *later_first]:
        carried[f"_carry_{n}"] = F.last(f"_all_{n}", ignorenulls=True).over(after)
    summary = rows.filter("_tail").select(*cell, f"{CELL}_km", *places, *[c.alias(n) for n, c in total.items()])
    carry = summary.select(*cell, *[c.alias(n) for n, c in carried.items()])

    joined = rows.join(carry, cell, "left")
    final: dict[str, Column] = {}
    if lag:
        whole = F.coalesce("_lag", "_carry_lag")
        final.update({f"prev_{c}": whole[c] for c in lag})
    if lead:
        whole = F.coalesce("_lead", "_carry_lead")
        final.update({f"next_{c}": whole[c] for c in lead})
    for n in [*run_last, *prior_last, *next_first, *later_first]:
        final[n] = F.coalesce(f"_in_{n}", f"_carry_{n}")
    for n in prior_max:
        final[n] = F.greatest(f"_in_{n}", f"_carry_{n}")
    for n in run_sum:
        final[n] = F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_carry_{n}", F.lit(0))
    taken = set(final)
    kept = [c for c in (celled if given else df).columns if c not in taken]
    return joined.select(*kept, *[c.alias(n) for n, c in final.items()])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; aggregated map-side, so a hot key needs no sort."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key; aggregated map-side."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def haloed(
    df: DataFrame, keys: Sequence[str], position: str, before: int, after: int, columns: Mapping[str, Callable], rows: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Windows that look a bounded distance around ``position``, in one shuffle whatever the key size.

    Each key is cut into runs of ``rows`` positions; rows near an edge are copied to the
    neighbouring run, so every window finds its whole neighbourhood locally. ``columns``
    maps a name to a function of the window (ordered by position).
    """
    at = F.col(position)
    home = F.floor(at / rows)
    spread = df.withColumn(
        "_run", F.explode(F.sequence(F.floor((at - after) / rows), F.floor((at + before) / rows)))
    )
    window = Window.partitionBy(*keys, "_run").orderBy(position)
    added = {n: make(window) for n, make in columns.items()}
    return spread.withColumns(added).filter(F.col("_run") == home).drop("_run")
