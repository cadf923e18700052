"""Paths along links that lead onward in an ordered series, without walking the series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmart.functions.ordered import CELL, with_cells
from clipmart.session import kept

#: Nodes of a cell: what one array holds.
CELL_NODES = 256


def _cell(no: str | Column) -> Column:
    return F.floor(((F.col(no) if isinstance(no, str) else no) - 1) / CELL_NODES)


def on_path(nodes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, columns) of the nodes that are met when links are followed from each key's first node.

    ``nodes``: keys, ``no`` (1, 2, ... per key), ``link`` (a greater number, or null) and *columns*.

    Cells of ``CELL_NODES`` nodes are walked for themselves. A cell's links are first shortened to where they leave it, so a path enters a
    cell at most once. The entries of keys with several cells are found by pointer jumping: in every round the marked
    entries mark those their links lead to, and links are doubled, so a path through n cells takes about log2(n) rounds.
    """
    keys = list(keys)
    celled = with_cells(nodes, keys, {})
    own = [c for c in celled.columns if c.startswith(f"{CELL}_k")]
    slots = celled.groupBy(*own, _cell("no").alias("_at")).agg(
        F.sort_array(F.collect_list(F.struct("no", "link", *columns))).alias("_slots"), *[F.first(k).alias(k) for k in keys]
    )
    slots = kept(slots)

    def shorten(later: Column, s: Column) -> Column:
        inside = F.get(later, (s["link"] - s["no"] - 1).cast("int"))["to"]
        to = F.when(_cell(s["link"]) == F.col("_at"), inside).otherwise(s["link"])
        return F.concat(F.array(F.struct(s["no"].alias("no"), to.alias("to"))), later)

    leaving = slots.filter(F.exists("_slots", lambda s: F.coalesce(_cell(s["link"]) > F.col("_at"), F.lit(False))))
    none = F.array().cast("array<struct<no: bigint, to: bigint>>")
    jumps = leaving.select(*own, F.explode(F.aggregate(F.reverse("_slots"), none, shorten)).alias("_j")).select(*own, "_j.*").filter("to is not null")
    first = slots.filter("_at = 0").withColumn("_entry", F.lit(1).cast("long"))
    entered = first
    jumps = kept(jumps)
    if not jumps.isEmpty():
        marked = jumps.filter("no = 1").select(*own, "no")
        while not jumps.isEmpty():
            led = marked.join(jumps, [*own, "no"]).select(*own, F.col("to").alias("no"))
            onward = jumps.select(*own, F.col("no").alias("to"), F.col("to").alias("_next"))
            marked, jumps = kept(marked.unionByName(led)), kept(jumps.join(onward, [*own, "to"]).select(*own, "no", F.col("_next").alias("to")))
        entries = marked.filter("no > 1").select(*own, _cell("no").alias("_at"), F.col("no").alias("_entry"))
        entered = first.unionByName(slots.join(entries, [*own, "_at"]).select(*first.columns))

    def step(acc: Column, s: Column) -> Column:
        here = acc["now"] == s["no"]
        return F.struct(
            F.when(here, s["link"]).otherwise(acc["now"]).alias("now"), F.when(here, F.array_append(acc["met"], s)).otherwise(acc["met"]).alias("met")
        )

    start = F.struct(F.col("_entry").alias("now"), F.slice(F.col("_slots"), 1, 0).alias("met"))
    met = F.aggregate("_slots", start, step, lambda acc: acc["met"])
    return entered.select(*keys, F.explode(met).alias("_s")).select(*keys, *[f"_s.{c}" for c in columns])
