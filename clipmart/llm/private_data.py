"""Personal data: Aho-Corasick finds anchors, local parsers expand and check each of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmart.llm.common import small_batches

#: Kinds in the order of the result; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
# Schemes of addresses and words that announce an account number.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "routing", "passport", "ssn", "swift", "konto", "cuenta", "compte")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`|]*[^\s<>\"'`|.,;:!?)\]}]")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:number|no|nr|num|id|code)\b)?[ \t.:#=-]*(?=[A-Z0-9]*[0-9])([A-Z]{0,4}[0-9](?:[ -]?[A-Z0-9]){3,32})(?![A-Za-z0-9])")
_DIGITS = "0123456789"


def anchors() -> ahocorasick.Automaton:
    """One automaton for all anchors; the value is (parser, length)."""
    tree = ahocorasick.Automaton()
    tree.add_word("@", ("email", 1))
    tree.add_word("+", ("phone", 1))
    for digit in _DIGITS:
        tree.add_word(digit, ("digit", 1))
    for scheme in SCHEMES:
        for form in {scheme, scheme.upper(), scheme.capitalize()}:
            tree.add_word(form, ("url", len(form)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            tree.add_word(form, ("account", len(form)))
    tree.make_automaton()
    return tree


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find_spans(text: str, tree: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind as code points (end exclusive), in order and without overlap within a kind.

    ``free`` is, for each kind, where the next match may begin: behind the last match of its
    pattern, kept or dropped. Anchors come in the order of their ends, so each is expanded once.
    """
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys((*KINDS, "digit"), 0)
    for last, (what, length) in tree.iter(text):
        at = last - length + 1
        if what == "digit":
            if at < free["digit"]:
                continue
            # Once for each run of digits: a match begins at the start of a run.
            free["digit"] = at + 1
            while free["digit"] < len(text) and text[free["digit"]] in _DIGITS:
                free["digit"] += 1
            if at >= free["ip"] and (m := _ip_at(text, at, free["digit"])):
                free["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                    spans["ip"].append(m.span())
            if at >= free["card"] and (m := _CARD.match(text, at)):
                free["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append(m.span())
        elif what == "email":
            start = at
            while start > free["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                free["email"] = m.end()
                spans["email"].append((start, m.end()))
        elif what == "phone":
            if at >= free["phone"] and (m := _PHONE.match(text, at)):
                free["phone"] = m.end()
                if 8 <= sum(c in _DIGITS for c in m.group()) <= 15:
                    spans["phone"].append(m.span())
        elif what == "url":
            if at >= free["url"] and (m := _URL.match(text, last + 1)):
                free["url"] = m.end()
                spans["url"].append((at, m.end()))
        elif at >= free["account"] and not (at and text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
            free["account"] = m.end()
            spans["account"].append(m.span(1))
    return spans


def _ip_at(text: str, at: int, end: int) -> re.Match | None:
    """The address at the start of the digit run *at* .. *end*; a run that no dot follows is none."""
    return _IP.match(text, at) if end < len(text) and text[end] == "." else None


def _spans_udf():
    @F.pandas_udf("array<struct<kind: string, span_start: long, span_end: long>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = anchors()
        for batch in texts:
            out = []
            for text in batch:
                found = find_spans(text, tree) if text else {}
                out.append([{"kind": k, "span_start": s, "span_end": e} for k in KINDS for s, e in found.get(k, ())])
            yield pd.Series(out)

    return spans


def private_spans(transcripts: DataFrame) -> DataFrame:
    """Personal data in each transcript: ``video_id`` and ``spans`` (kind, span_start, span_end).

    ``transcripts``: ``video_id``, ``transcript``; other columns are ignored, whatever their names.
    Spans are code points, end exclusive, sorted by kind (``KINDS``) and start. ``email``, ``ip``,
    ``card`` and ``phone`` are the leftmost non-overlapping matches of their patterns without
    those that fail the check (parts over 255, Luhn, number of digits); ``url`` and ``account``
    are added by scheme and cue. One row per input row, repeated rows included; a null or empty
    transcript has no spans, an empty table gives none. Work is linear in a text's length but for runs
    of digits and dots, of which each is read four times at most.
    """
    small_batches(transcripts.sparkSession)
    return transcripts.select("video_id", _spans_udf()(F.col("transcript").cast("string")).alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["span_start"], s["span_end"])))


def base_digest(spans: Column) -> Column:
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:4]))
    return F.sha2(joined(base).cast("binary"), 256)
