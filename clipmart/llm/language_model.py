"""Language-model scores by deleted interpolation of word bigrams, words and a uniform floor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmart.llm.common import bytes_of, kept, mixed, small_batches, word_hashes

#: Text bytes of a chunk. A chunk's distinct words and pairs are what one task holds.
CHUNK_BYTES = 16 << 20
#: Context-frequency buckets: unseen, then one for each octave of the count, the last open.
BUCKETS = 42
#: Cells for an octave of the pair's and of the word's probability, in which held-out events are counted.
PER_OCTAVE = (2, 1)
EM_ROUNDS = 60

START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
_ZSTD = pa.Codec("zstd", compression_level=1)


def token_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The words of each text with A-Z lower-cased, then one end."""
    return [np.append(words, END) for words in word_hashes([t.lower() for t in texts])]


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """One key for each token and the one before it."""
    before = np.concatenate(([START], tokens[:-1]))
    return mixed(mixed(before + np.uint64(1)) + tokens)


class Chunk:
    """The distinct keys of a chunk's texts, in a fixed order, and which of them each token has."""

    def __init__(self, texts: list[bytes], parts: int):
        tokens = token_hashes(texts)
        self.lengths = [len(t) for t in tokens]
        self.size = sum(self.lengths)
        contexts = np.full(len(texts), START, dtype=np.uint64)
        every = np.concatenate([*tokens, *map(pair_keys, tokens), contexts])
        del tokens
        self.keys, inverse = np.unique(every, return_inverse=True)
        del every
        self.inverse = inverse.astype(np.int32 if len(self.keys) < 1 << 31 else np.int64)
        self.part = (self.keys % np.uint64(parts)).astype(np.int32)
        # Keys stay ascending within a part, as both passes over the chunk need the same order.
        self.order = np.argsort(self.part, kind="stable")

    def counts(self, learn: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts to learn from."""
        weight = np.repeat(learn, self.lengths)
        return np.bincount(self.inverse, weights=np.concatenate([weight, weight, learn]), minlength=len(self.keys)).astype(np.int64)

    def by_part(self) -> Iterator[tuple[int, np.ndarray]]:
        part = self.part[self.order]
        edges = np.flatnonzero(np.diff(part)) + 1
        for rows in np.split(self.order, edges):
            yield int(self.part[rows[0]]), rows


def packed(values: np.ndarray) -> bytes:
    """Integers with their equal bytes next to each other, so that compression finds the zeros."""
    return _ZSTD.compress(np.ascontiguousarray(values.astype(np.int64)).view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def unpacked(data: bytes, count: int) -> np.ndarray:
    raw = _ZSTD.decompress(data, decompressed_size=8 * count, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, count).T).view(np.int64).ravel()


def _ascending(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def _keys(data: bytes, count: int) -> np.ndarray:
    return np.cumsum(unpacked(data, count).view(np.uint64), dtype=np.uint64)


def _asked(parts: int):
    """Each chunk asks every part of the key space for the totals of its keys there."""

    def ask(table: pa.Table) -> pa.Table:
        chunk = Chunk(bytes_of(table.column("transcript")), parts)
        learn = np.array(table.column("learn").to_pylist(), dtype=np.float64)
        counts, name = chunk.counts(learn), table.column("_chunk")[0].as_py()
        rows = [(p, name, len(i), _ascending(chunk.keys[i]), packed(counts[i])) for p, i in chunk.by_part()]
        return pa.Table.from_arrays(
            [pa.array(c) for c in zip(*rows, strict=True)], names=["_part", "_chunk", "n", "keys", "counts"]
        )

    return ask


def _answered(table: pa.Table) -> pa.Table:
    """The totals over all chunks, for each request in the order of its keys."""
    sizes = table.column("n").to_pylist()
    keys = np.concatenate([_keys(k, n) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
    counts = np.concatenate([unpacked(c, n) for c, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
    distinct, inverse = np.unique(keys, return_inverse=True)
    totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)[inverse]
    answers = np.split(totals, np.cumsum(sizes)[:-1])
    return pa.Table.from_arrays(
        [table.column("_chunk"), table.column("_part"), pa.array(sizes, pa.int64()), pa.array([packed(a) for a in answers])],
        names=["_chunk", "_part", "n", "totals"],
    )


def _told(parts: int):
    """For each transcript the counts of its pairs, contexts and words."""

    def tell(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows:
            chunk = Chunk(bytes_of(rows.column("transcript")), parts)
            got = dict(zip(answers.column("_part").to_pylist(), zip(answers.column("n").to_pylist(), answers.column("totals").to_pylist(), strict=True), strict=True))
            totals = np.empty(len(chunk.keys), dtype=np.int64)
            for part, i in chunk.by_part():
                totals[i] = unpacked(got[part][1], got[part][0])
            all_words = totals[chunk.inverse[: chunk.size]]
            all_pairs = totals[chunk.inverse[chunk.size : 2 * chunk.size]]
            starts = totals[chunk.inverse[2 * chunk.size :]]
            at = 0
            for i, n in enumerate(chunk.lengths):
                words, pairs = all_words[at : at + n], all_pairs[at : at + n]
                contexts = np.concatenate((starts[i : i + 1], words[:-1]))
                out.append((n, int((words > 0).sum()), packed(np.concatenate((pairs, contexts, words)))))
                at += n
        n, known, events = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_arrays(
            [rows.column("video_id"), rows.column("learn"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(events, pa.binary())],
            names=["video_id", "learn", "n_tokens", "n_known", "events"],
        )

    return tell


def bucket_of(contexts: np.ndarray) -> np.ndarray:
    """Bucket of a context's count."""
    return np.where(contexts > 0, np.minimum(1 + np.floor(np.log2(np.maximum(contexts, 1))).astype(np.int64), BUCKETS - 1), 0)


def _cell(p: np.ndarray, per_octave: int) -> np.ndarray:
    """Cell of a probability; -1 for none."""
    return np.where(p > 0, np.floor(-np.log2(np.where(p > 0, p, 1.0)) * per_octave).astype(np.int64), -1)


def _held_out_cells(train_tokens: int):
    """Every token to learn from as an event of the model without that token, counted by bucket and cells.

    Bucket -1 has the sum of 1 / count over all tokens: each distinct token adds one to it.
    """
    span = 1 << 12  # more than any cell

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        distinct = 0.0
        for batch in batches:
            codes = []
            for n, events in zip(batch.column("n_tokens").to_pylist(), batch.column("events").to_pylist(), strict=True):
                pairs, contexts, words = unpacked(events, 3 * n).reshape(3, n)
                distinct += float((1.0 / words).sum())
                p2 = _cell((pairs - 1) / np.maximum(contexts - 1, 1), PER_OCTAVE[0])
                p1 = _cell((words - 1) / max(train_tokens - 1, 1), PER_OCTAVE[1])
                codes.append((bucket_of(contexts - 1) * span + p2 + 1) * span + p1 + 1)
            found, times = np.unique(np.concatenate(codes), return_counts=True) if codes else ([], [])
            for code, t in zip(np.asarray(found).tolist(), np.asarray(times).tolist(), strict=True):
                total[code] = total.get(code, 0) + t
        code = np.array(list(total), dtype=np.int64)
        columns = [code // span // span, code // span % span - 1, code % span - 1, np.array(list(total.values()), dtype=np.float64)]
        for values, extra in zip(columns, (-1, 0, 0, distinct), strict=True):
            values.resize(len(code) + 1, refcheck=False)
            values[-1] = extra
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "p2", "p1", "n"])

    return count


def mixture_weights(cells: pd.DataFrame, floor: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights of pair, word and floor for each bucket, by expectation-maximisation on counted events.

    One event is added to each part, so no weight is nothing; a bucket without events stays at the floor.
    """
    weights = np.tile(np.array([0.0, 0.0, 1.0]), (BUCKETS, 1))
    for bucket, own in cells.groupby("bucket"):
        p = np.column_stack(
            [
                *(np.where(own[c] < 0, 0.0, 2.0 ** (-(own[c] + 0.5) / n)) for c, n in zip(("p2", "p1"), PER_OCTAVE, strict=True)),
                np.full(len(own), floor),
            ]
        )
        n = own["n"].to_numpy(dtype=float)
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = n @ share + 1.0
            w /= w.sum()
        weights[int(bucket)] = w
    return weights


def _scored(weights: np.ndarray, train_tokens: int, vocabulary: int):
    floor, whole = 1 / (vocabulary + 1), max(train_tokens, 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, model = [], []
            for n, events in zip(batch.column("n_tokens").to_pylist(), batch.column("events").to_pylist(), strict=True):
                pairs, contexts, words = unpacked(events, 3 * n).reshape(3, n)
                w = weights[bucket_of(contexts)]
                p = w[:, 0] * (pairs / np.maximum(contexts, 1)) + w[:, 1] * (words / whole) + w[:, 2] * floor
                model.append(float(np.log10(p).sum()))
                base.append(float(np.log10((words + 1) / (train_tokens + vocabulary + 1)).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("video_id", "learn", "n_tokens", "n_known")), pa.array([train_tokens] * len(base), pa.int64()),
                 pa.array(base, pa.float64()), pa.array(model, pa.float64())],
                names=["video_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return score


def score_transcripts(transcripts: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Log10 probability of each transcript under a model learned from those marked ``learn``.

    ``transcripts``: ``video_id``, ``transcript``, ``learn`` (boolean; null is false); other columns are ignored.
    Tokens are the words (A-Z lower-cased) and one end; the model mixes the maximum-likelihood estimates of
    a word after the word before it, of the word alone, and 1 / (distinct tokens + 1). The mixture depends on
    how often the word before was seen; its weights are learned on all tokens to learn from, each
    held out of the counts in turn.

    Returns one row per input row: ``video_id``, ``learn``, ``n_tokens``, ``n_known`` (tokens that were learned), ``train_tokens``,
    ``base_score`` (add-one words) and ``score``. A null or empty transcript is one end. Repeated rows get equal scores
    (and count as often when learned from). With nothing to learn from every token has probability 1. An empty table gives an empty result.

    Texts are put in chunks by hash. A chunk asks for the totals of its distinct words and pairs, the key space answers in
    parts, and chunks meet their answers again: only distinct keys move, no word's occurrences meet in one
    task, and nothing of the vocabulary is sent to the driver or to all tasks.
    """
    spark = transcripts.sparkSession
    small_batches(spark)
    rows = transcripts.select(
        "video_id", F.col("transcript").cast("string").alias("transcript"), F.coalesce(F.col("learn").cast("boolean"), F.lit(False)).alias("learn")
    )
    id_type = rows.schema["video_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("transcript"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("video_id", "transcript"), F.lit(parts))).repartition(parts, "_chunk")

    asked = rows.groupBy("_chunk").applyInArrow(_asked(parts), "_part long, _chunk long, n long, keys binary, counts binary")
    answers = asked.groupBy("_part").applyInArrow(_answered, "_chunk long, _part long, n long, totals binary")
    told = rows.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(
        _told(parts), f"video_id {id_type}, learn boolean, n_tokens long, n_known long, events binary"
    )
    told = kept(told)
    learned = told.filter("learn")
    train_tokens = learned.agg(F.sum("n_tokens")).first()[0] or 0

    narrow = learned.select("n_tokens", "events")
    cells = narrow.mapInArrow(_held_out_cells(train_tokens), "bucket long, p2 long, p1 long, n double")
    cells = cells.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).toPandas()
    vocabulary = round(cells.loc[cells["bucket"] < 0, "n"].sum())
    cells = cells[cells["bucket"] >= 0]
    weights = mixture_weights(cells, 1 / (vocabulary + 1))
    return told.mapInArrow(
        _scored(weights, train_tokens, vocabulary),
        f"video_id {id_type}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
