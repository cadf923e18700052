"""Helpers shared by the training-data operators.

Transcripts are rows of ``video_id``, ``transcript`` and, where an operator needs them,
``source_key`` and ``language``. Word rules work on UTF-8 bytes: ``bytes.split`` cuts at
space and 0x09-0x0D exactly, and ``bytes.lower`` changes A-Z only.
"""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmart.session import ensure_checkpoint_dir

#: Rows per Arrow batch. Transcripts may be long, so a batch stays at some megabytes.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Python tasks see few transcripts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def kept(df: DataFrame) -> DataFrame:
    """*df* written to the shared checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints that nothing refers to any more.

    They go when the driver's JVM collects its garbage, which may be long after a phase of many shuffles has ended.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(key: str, parts: int, part: int = 2):
    """The remainder of crc32 of the id's decimal text is *part*; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def bytes_of(column) -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


#: Bytes that are hashed at once.
PIECE_BYTES = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PRIME_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(length: int) -> list[np.ndarray]:
    if len(_powers[0]) < length:
        for i, base in enumerate((_PRIME, _PRIME_INVERSE)):
            _powers[i] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(length, base, dtype=np.uint64))))
    return _powers


def _pieces(text: bytes) -> list[bytes]:
    """A text in pieces of about ``PIECE_BYTES`` that end at a blank."""
    out, at = [], 0
    while len(text) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order.

    A word's hash is a difference of running polynomial sums over all bytes, moved to a common place: all
    words of many texts are hashed in a few passes, and equal words are equal wherever they stand.
    """
    parts = [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    first = 0
    while first < len(parts):
        last, size = first, 0
        while last < len(parts) and (last == first or size + len(parts[last][1]) <= PIECE_BYTES):
            size += len(parts[last][1]) + 1
            last += 1
        joined = np.frombuffer(b"\n".join(p for _, p in parts[first:last]) + b"\n", dtype=np.uint8)
        blank = _BLANK[joined]
        edge = np.diff(blank.view(np.int8), prepend=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _power_tables(len(joined) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE_VALUES[joined] * power[: len(joined)], dtype=np.uint64)))
        hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        bounds = np.cumsum([len(p) + 1 for _, p in parts[first:last]])
        for (i, _), own in zip(parts[first:last], np.split(hashes, np.searchsorted(starts, bounds)[:-1]), strict=True):
            found[i].append(own)
        first = last
    return [f[0] if len(f) == 1 else np.concatenate(f) for f in found]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a finaliser of shifts and odd multipliers)."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """One hash for each run of *width* words; a shorter, not empty sequence is one run."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - width + 1 + i]
    return mixed(out)
