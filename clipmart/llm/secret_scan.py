"""Secrets in versions of texts, by an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. A ledger says which (blob, rule version) pairs have been
scanned and what was found there; only unseen pairs are scanned, and findings are joined back to all paths that hold the blob.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A secret is a match of ``pattern`` (leftmost, non-overlapping) whose ``group`` has at least ``least`` characters.

    A match that is too short is dropped and its text is not searched again. A new ``version`` has every blob scanned again.
    """

    pattern: str
    least: int
    group: int = 0
    version: int = 1


# The forms of secrets, in the order in which spans with one start are listed.
RULES: dict[str, Rule] = {
    "assign": Rule(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    "access": Rule(r"AKIA[A-Z0-9]+", 18),
    # Shorter runs of hex digits are no secrets; as runs are maximal, asking for 16 at once finds the same.
    "hex": Rule(r"[0-9a-f]{16,}", 16),
    "private_key": Rule(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0),
    "web_token": Rule(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0),
    "login_url": Rule(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,64}@", 0),
}

SPAN = "array<struct<rule: string, start: bigint, end: bigint>>"
LEDGER = f"blob_id string, pairs array<string>, spans {SPAN}"


class Scan(NamedTuple):
    """``paths``: the given rows with ``blob_id`` and ``spans``; ``scanned``: new rows for the ledger."""

    paths: DataFrame
    scanned: DataFrame


def blob_id(text: str | Column) -> Column:
    """The address of a text; null is the empty text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(column, F.lit("")), 256)


def _pair(name: str, rule: Rule) -> str:
    return f"{name}@{rule.version}"


def _unseen(versions: DataFrame, ledger: DataFrame | None, rules: Mapping[str, Rule]) -> DataFrame:
    """(blob_id, text, due): each blob once, with the pairs that no ledger row covers."""
    blobs = versions.select(blob_id("transcript").alias("blob_id"), F.coalesce("transcript", F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob_id").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(_pair(n, r)) for n, r in rules.items()])
    if ledger is None:
        return blobs.withColumn("due", every)
    seen = ledger.groupBy("blob_id").agg(F.flatten(F.collect_set("pairs")).alias("_seen"))
    due = F.array_except(every, F.coalesce("_seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob_id", "left").withColumn("due", due).drop("_seen").filter(F.size("due") > 0)


def _matches(blobs: DataFrame, name: str, rule: Rule) -> Column:
    """Lengths of the text before each match, of the match and of its group; null where the rule is not due or finds nothing.

    Splitting and extracting use one matcher, so pieces and matches alternate.
    """
    text, pattern = F.col("text"), F.lit(rule.pattern)
    before = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    part = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else whole
    hits = F.arrays_zip(F.slice(before, F.lit(1), F.size(whole)).alias("gap"), whole.alias("length"), part.alias("part"))
    due = F.array_contains("due", _pair(name, rule)) & text.rlike(rule.pattern)
    return F.when(due, F.struct(F.lit(name).alias("rule"), F.lit(rule.least).alias("least"), hits.alias("hits")))


def scan_blobs(blobs: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Ledger rows of (blob_id, text, due): the pairs scanned and the spans found, by start and rule."""
    order = F.create_map(*[x for i, n in enumerate(rules) for x in (F.lit(n), F.lit(i))])
    told = blobs.select("blob_id", "due", F.array_compact(F.array(*[_matches(blobs, n, r) for n, r in rules.items()])).alias("_found"))
    # Places are running sums over a blob's matches: rows and a window, as an array would be copied for every match.
    each = told.select("blob_id", "due", F.explode_outer("_found").alias("_f"))
    each = each.select("blob_id", "due", "_f.rule", "_f.least", F.posexplode_outer("_f.hits").alias("_i", "_h"))
    along = Window.partitionBy("blob_id", "rule").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("_h.gap") + F.col("_h.length")).over(along)
    placed = each.withColumns({"end": end, "start": end - F.col("_h.length")})
    span = F.struct("start", F.element_at(order, F.col("rule")).alias("nr"), "rule", "end")
    good = F.col("_h.part") >= F.col("least")
    found = placed.groupBy("blob_id").agg(F.first("due").alias("pairs"), F.sort_array(F.collect_list(F.when(good, span))).alias("_spans"))
    spans = F.transform("_spans", lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("blob_id", "pairs", spans.cast(SPAN).alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: Mapping[str, Rule] = RULES) -> Scan:
    """Find secrets in every historical version of the videos' texts.

    ``versions``: ``transcript`` and whatever names its path (``video_id``, a pull run, a field); these columns are kept, but for
    ``blob_id`` and ``spans``, which are set. A null transcript is empty; copies are one blob, scanned once however many paths hold
    it; an empty table gives empty tables. ``ledger``: rows of earlier scans (``blob_id``, ``pairs``, ``spans``), None at
    first. ``pairs`` are ``rule@version``: a blob is scanned for the rules that no row of its has at their present version.

    ``paths`` has one row for each given one, with ``spans`` (``rule``, ``start``, ``end``: code points, end exclusive) of the present rule
    versions, sorted by start, then in the order of *rules*. ``scanned`` are the rows to append to the ledger: append them
    once, and a next call scans none of their pairs. Texts are scanned whole. ``scanned`` is not stored here: write it before ``paths`` is
    used with a ledger, or ``paths`` scans what is unseen for itself.
    """
    scanned = scan_blobs(_unseen(versions, ledger, rules), rules)
    rows = scanned if ledger is None else ledger.select("blob_id", "pairs", "spans").unionByName(scanned)
    return Scan(findings_by_path(versions, rows, rules), scanned)


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """The given rows with the spans that the ledger knows of their blobs for the present *rules*; a scan of blobs is not made here."""
    current = F.create_map(*[x for n, r in rules.items() for x in (F.lit(n), F.lit(_pair(n, r)))])
    order = F.create_map(*[x for i, n in enumerate(rules) for x in (F.lit(n), F.lit(i))])
    kept = F.filter("spans", lambda s: F.coalesce(F.array_contains("pairs", F.try_element_at(current, s["rule"])), F.lit(False)))
    # Only blobs with findings move; a finding of a retried append counts once.
    found = ledger.select("blob_id", kept.alias("spans")).filter(F.size("spans") > 0).groupBy("blob_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    keyed = F.transform(F.array_distinct("spans"), lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["rule"]).alias("nr"), s["rule"].alias("rule"), s["end"].alias("end")))
    spans = F.transform(F.sort_array(keyed), lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
    paths = versions.drop("blob_id", "spans").withColumn("blob_id", blob_id("transcript"))
    none = F.array().cast(SPAN)
    return paths.join(found.select(F.col("blob_id").alias("_blob"), spans.alias("spans")), F.col("blob_id") == F.col("_blob"), "left").drop(
        "_blob"
    ).withColumn("spans", F.coalesce(F.col("spans").cast(SPAN), none))


def count_of(spans: Column, rule: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rule"] == rule)).cast("long")


def joined(spans: Column) -> Column:
    """``rule:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
