"""Text expressions shared by the operators (all built-in functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that close a sentence or a clause, and marks stripped before the test.
CAPTION_SENTENCE_END = ".?!…।؟。"
CAPTION_CLAUSE_END = ",;:，、"
CAPTION_CLOSERS = "\"'”’)]»"
# All characters that \s means in a pattern with (?U).
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CUT_SENTENCE_END = ".?!…।॥؟。！？"
CUT_CLOSERS = "\"'”’»)]"


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def squash(value: str | Column) -> Column:
    """All whitespace runs become one space; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(value), F.lit("")), r"(?U)\s+", " "))


def first_words(value: str | Column, n: int) -> Column:
    """The text up to its *n*-th word, whole words only: each has whitespace behind it, so the last word of all is left out."""
    return F.regexp_extract(F.coalesce(col(value), F.lit("")), rf"(?U)^\s*+(?:\S++\s++){{0,{n}}}", 0)


def strip_end(value: str | Column, chars: str) -> Column:
    return F.rtrim(col(value), F.lit(chars))


def ends_with_any(value: Column, chars: str) -> Column:
    """The last character is one of *chars* (false for an empty string)."""
    return (F.length(value) > 0) & (F.instr(F.lit(chars), F.right(value, F.lit(1))) > 0)


def ends_caption_sentence(word: str | Column) -> Column:
    return ends_with_any(strip_end(word, CAPTION_CLOSERS), CAPTION_SENTENCE_END)


def ends_clause(word: str | Column) -> Column:
    return ends_with_any(strip_end(word, CAPTION_CLOSERS), CAPTION_CLAUSE_END)


def ends_line(word: str | Column) -> Column:
    return ends_with_any(strip_end(word, "\"'"), ".?!")


def ends_cut_sentence(word: str | Column) -> Column:
    return ends_with_any(strip_end(squash(word), CUT_CLOSERS), CUT_SENTENCE_END)


def first_distinct(items: str, keys: str, limit: int) -> Column:
    """First *limit* items of an array column with distinct keys, in order.

    ``items`` and ``keys`` are aligned, finished columns (not expressions), so that looking an
    item up does not recompute them.
    """
    wanted = F.slice(F.array_distinct(F.col(keys)), 1, limit)
    return F.transform(wanted, lambda k: F.element_at(F.col(items), F.array_position(F.col(keys), k).cast("int")))


def non_latin(value: str | Column) -> Column:
    """The text holds a letter of a non-Latin script."""
    return col(value).rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def bare_word(value: str | Column) -> Column:
    """Lower-case word without surrounding punctuation (native marks included)."""
    lowered = F.lower(squash(value))
    return F.regexp_replace(lowered, r"^[\p{P}$+<=>^`|~]+|[\p{P}$+<=>^`|~]+$", "")


def bare_ascii_word(value: str | Column) -> Column:
    """Lower-case word without surrounding ASCII punctuation."""
    return F.trim(F.lower(col(value)), F.lit("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
