"""Folds over ordered rows with a small state, without holding a long series in one array."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmart.functions.ordered import CELL, with_cells

PIECE = 256


def _states(tables: Column, start: Column) -> Column:
    """The states before the first of the sorted exit tables and after each of them."""
    return F.aggregate(tables, F.array(start.cast("int")), lambda acc, t: F.array_append(acc, F.get(t["_exit"], F.element_at(acc, -1))))


def _entries(tables: Column, at: str, start: Column) -> Column:
    """(at, state) for each exit table: the state in which it is entered when the first is entered in *start*."""
    states = F.slice(_states(tables, start), F.lit(1), F.size(tables))
    return F.zip_with(F.transform(tables, lambda t: t[at]), states, lambda a, s: F.struct(a.alias("at"), s.alias("state")))


def _exits(tables: Column, at: str, start: Column) -> Column:
    """(at, state) for each exit table: the state in which it is left."""
    states = F.slice(_states(tables, start), F.lit(2), F.size(tables))
    return F.zip_with(F.transform(tables, lambda t: t[at]), states, lambda a, s: F.struct(a.alias("at"), s.alias("state")))


def entry_states(tables: DataFrame, group: Sequence[str], n_states: int) -> DataFrame:
    """``_entry`` of every piece that follows one of *tables* (``_piece``, ``_exit``: exit state by entry state).

    The first piece of a group is entered in state 0. Two levels, the pieces of a span and the spans of a
    group, so no array holds all pieces of a long series.
    """
    zero, group = F.lit(0), list(group)
    spans = tables.withColumn("_span", F.floor(F.col("_piece") / PIECE)).groupBy(*group, "_span")
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("_piece", "_exit"))).alias("_tables"))
    whole = spans.withColumn(
        "_exit", F.aggregate("_tables", F.sequence(zero, F.lit(n_states - 1)), lambda acc, t: F.transform(acc, lambda s: F.get(t["_exit"], s)))
    )
    heads = whole.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_span", "_exit"))).alias("_all"))
    into_span = heads.select(*group, F.explode(_entries(F.col("_all"), "_span", zero)).alias("_e")).select(
        *group, F.col("_e.at").alias("_span"), F.col("_e.state").alias("_from")
    )
    # Merged, never broadcast: small tables on a broadcast's other side would lie by the group alone, and the rows that the states are joined to
    # would be moved to them.
    into_next = spans.join(into_span.hint("merge"), [*group, "_span"]).select(
        *group, F.explode(_exits(F.col("_tables"), "_piece", F.col("_from"))).alias("_e")
    )
    return into_next.select(*group, (F.col("_e.at") + 1).alias("_piece"), F.col("_e.state").alias("_entry"))


def states_before(
    rows: DataFrame, keys: Sequence[str], island: str, position: str, fields: Sequence[str],
    step: Callable[[Column, Column], Column], n_states: int,
) -> DataFrame:
    """Each row with ``before``: the fold's state (0 .. n_states-1) when the row is reached.

    Within an island the fold starts at 0 and goes along ``position``, which is consecutive from ``island`` on. Islands of
    any length are folded in pieces of ``PIECE`` positions. A piece that has a successor (it is full) is summarised as a
    map *entry state -> exit state*; entry states follow by composing those maps along the island's pieces.
    """
    keys, zero = list(keys), F.lit(0)
    # Keys without nulls, so that pieces meet their entry states on the partitioning they already have.
    celled = with_cells(rows, keys, {})
    own = [c for c in celled.columns if c.startswith(f"{CELL}_k")]
    group = [*own, island]
    celled = celled.withColumn("_piece", F.floor((F.col(position) - F.col(island)) / PIECE))

    def pieces(*columns: str) -> DataFrame:
        return celled.groupBy(*group, "_piece").agg(F.sort_array(F.collect_list(F.struct(position, *columns))).alias("_rows"), *[F.first(k).alias(k) for k in keys])

    full = pieces(*fields).filter(F.element_at("_rows", -1)[position] - F.col(island) == F.col("_piece") * PIECE + PIECE - 1)
    tables = full.select(
        *group, "_piece",
        F.transform(F.sequence(zero, F.lit(n_states - 1)), lambda s: F.aggregate("_rows", s, step)).alias("_exit"),
    )
    entries = entry_states(tables, group, n_states)

    placed = pieces(*fields).join(entries, [*group, "_piece"], "left")
    first = F.struct(F.coalesce("_entry", zero).alias("state"), F.array().cast("array<int>").alias("before"))
    walked = F.aggregate(
        "_rows",
        first,
        lambda acc, r: F.struct(
            step(acc["state"], r).alias("state"), F.array_append(acc["before"], acc["state"]).alias("before")
        ),
        lambda acc: acc["before"],
    )
    out = placed.select(*keys, island, F.explode(F.arrays_zip("_rows", walked.alias("_before"))).alias("_r"))
    return out.select(*keys, island, "_r._rows.*", F.col("_r._before").alias("before"))
