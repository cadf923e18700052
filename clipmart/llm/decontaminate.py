"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The alphabet is words, a block is two consecutive words. For all patterns of one length
the shift table tells how far the window may jump given the block at its end; where the
shift is nothing, the bucket of that block holds the patterns to compare in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmart.llm.common import small_batches

WINDOW = 13
#: Benchmark bytes that one pass holds in memory; a larger benchmark is searched in several passes.
PASS_BYTES = 16 << 20

# Lower-case A-Z and turn every ASCII byte that is no letter or digit into a blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class WordSearch:
    """Wu-Manber tables over the windows of benchmark items."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            length = min(window, len(words))
            for i in range(len(words) - length + 1 if words else 0):
                by_length.setdefault(length, {}).setdefault(tuple(words[i : i + length]), set()).add(item)
        self.tables = [(length, *self._tables(length, found)) for length, found in sorted(by_length.items())]

    @staticmethod
    def _tables(length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        block = min(2, length)
        shift: dict[bytes, int] = {}
        bucket: dict[bytes, dict[tuple[bytes, ...], set[str]]] = {}
        for words, items in patterns.items():
            for end in range(block, length + 1):
                key = b" ".join(words[end - block : end])
                shift[key] = min(length - end, shift.get(key, length))
            bucket.setdefault(b" ".join(words[-block:]), {})[words] = items
        return block, shift, bucket

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for length, block, shift, bucket in self.tables:
            far = length - block + 1
            at, n = length, len(words)
            while at <= n:
                key = words[at - 2] + b" " + words[at - 1] if block == 2 else words[at - 1]
                jump = shift.get(key, far)
                if jump:
                    at += jump
                    continue
                start = at - length
                found = bucket[key].get(tuple(words[start:at]))
                if found:
                    items |= found
                    spans.append((start, at))
                at += 1
        return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _search_udf(search: WordSearch):
    @F.pandas_udf("n_words long, spans array<struct<s: long, e: long>>, items array<string>")
    def searched(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                words = words_of(text.encode()) if text else []
                spans, items = search.search(words)
                rows.append((len(words), [{"s": s, "e": e} for s, e in spans], sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return searched


def _passes(benchmark: DataFrame, pass_bytes: int) -> list[DataFrame]:
    """The items with words, in parts of about *pass_bytes* by hash of the id."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).filter(
        "text is not null"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // pass_bytes
    if parts == 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) for i in range(parts)]


def _merge_runs(runs: Column) -> Column:
    """Sorted, merged spans of a flattened array of spans."""
    start = F.array().cast("array<struct<s: bigint, e: bigint>>")

    def add(acc: Column, run: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], run["e"]).alias("e")))
        )
        return F.when((F.size(acc) > 0) & (run["s"] <= F.try_element_at(acc, F.lit(-1))["e"]), joined).otherwise(
            F.concat(acc, F.array(run))
        )

    return F.aggregate(F.array_sort(runs), start, add)


def with_contamination(transcripts: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """*transcripts* with a struct ``_found`` of ``n_words``, ``n_hit``, ``items`` and ``contaminated`` for each row."""
    small_batches(transcripts.sparkSession)
    out, columns = transcripts, transcripts.columns
    parts = []
    for i, items in enumerate(_passes(benchmark, pass_bytes)):
        rows = [(r["item_id"], r["text"].encode()) for r in items.toLocalIterator()]
        out = out.withColumn(f"_part{i}", _search_udf(WordSearch(rows, window))(F.col("transcript").cast("string")))
        parts.append(f"_part{i}")
    runs, items = F.col(f"{parts[0]}.spans"), F.col(f"{parts[0]}.items")
    if len(parts) > 1:
        runs = _merge_runs(F.flatten(F.array(*[F.col(f"{p}.spans") for p in parts])))
        items = F.array_distinct(F.flatten(F.array(*[F.col(f"{p}.items") for p in parts])))
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r["e"] - r["s"])
    out = out.select(
        *columns, F.col(f"{parts[0]}.n_words").alias("_n"), n_hit.alias("_hit"), items.alias("_items")
    )
    found = F.struct(
        F.col("_n").alias("n_words"), F.col("_hit").alias("n_hit"), F.array_sort("_items").alias("items"),
        ((F.col("_hit") > 0) & (F.col("_hit") * 20 >= F.col("_n"))).alias("contaminated"),
    )
    return out.select(*columns, found.alias("_found"))


def contamination(transcripts: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Words of each transcript that lie in a window of a benchmark item.

    ``transcripts``: ``video_id``, ``transcript``. ``benchmark``: ``item_id``, ``text`` (the project
    keeps no test sets, so these are general). Other columns are ignored, whatever their names.
    A window is ``window`` consecutive words of an item; an item with fewer words is one window,
    one without words none. Returns ``video_id``, ``n_words``, ``n_hit``, ``items`` (sorted ids)
    and ``contaminated`` (hit words are 5 % or more), one row per input row. An item without id is listed as ''. A null or empty
    transcript has no words and is clean; an item without id is listed as an empty one. Repeated rows are judged each for itself; items with
    equal texts all count; an empty benchmark finds nothing.

    Only the benchmark is held by the tasks, ``pass_bytes`` of it at a time: a larger one is
    searched in several passes over the same rows, whose spans are merged.
    """
    found = with_contamination(transcripts.select("video_id", "transcript"), benchmark, window, pass_bytes)
    return found.select("video_id", "_found.*")


def items_digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items).cast("binary"), 256)


def sha256_of(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
