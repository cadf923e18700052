"""Language identification by error-correcting output codes.

Every language has a codeword. One binary n-gram classifier per bit tells the languages with
that bit set from the others; a text gets the language whose codeword loses least against
the classifiers' margins, bits that separate well weighing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmart.llm.common import mixed, small_batches

#: Hash cells for letter trigrams.
CELLS = 1 << 14
UNKNOWN = "und"
#: Trigrams of one text lean on each other: their log odds count by this share.
EVIDENCE = 0.25
#: Two codewords whose losses differ by less are a tie to report.
AMBIGUOUS = 1.0

_LETTERS: np.ndarray | None = None


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text with 32 for everything that is no letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(_LETTERS[points], points, np.uint32(32))


def trigram_cells(letters: np.ndarray) -> np.ndarray:
    """Cells of all runs of three that hold a letter, with one blank before and after the text."""
    points = np.concatenate(([32], letters, [32])).astype(np.uint64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    # A blank in the middle, or two blanks, say nothing about the language.
    use = (b != 32) & ((a != 32) | (c != 32))
    return (mixed((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c)[use] % np.uint64(CELLS)).astype(np.int64)


@dataclass
class LanguageCodes:
    """Codewords (languages x bits of -1 and 1), classifier weights (cells x bits) and bit weights."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    @classmethod
    def fitted(cls, languages: list[str], counts: np.ndarray) -> LanguageCodes:
        """From the trigram counts of each language (languages x cells)."""
        n = len(languages)
        if n == 1:
            return cls(languages, np.ones((1, 1)), np.zeros((counts.shape[1], 1), dtype=np.float32), np.ones(1))
        codes = _codewords(n)
        smooth = counts + 0.05
        rate = smooth / smooth.sum(axis=1, keepdims=True)
        on, off = (codes > 0).astype(float), (codes < 0).astype(float)
        above = (on.T / on.sum(axis=0)[:, None]) @ rate
        below = (off.T / off.sum(axis=0)[:, None]) @ rate
        weights = np.log(above / below).T
        # What a language's own text is expected to give: the weakest language tells a bit's worth.
        gap = np.maximum(((rate @ weights) * codes).min(axis=0), 1e-3)
        return cls(languages, codes, weights.astype(np.float32), gap / gap.sum() * len(gap))

    def decode(self, cells: np.ndarray) -> tuple[str, float, bool]:
        """Language, share of the soft-minimum loss, and whether the runner-up is close."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        used, times = np.unique(cells, return_counts=True)
        margin = np.clip(EVIDENCE * (times @ self.weights[used].astype(np.float64)), -30, 30)
        loss = np.logaddexp(0, -self.codes * margin) @ self.trust
        best = int(np.argmin(loss))
        share = np.exp(loss[best] - loss)
        near = np.partition(loss, 1)[1] - loss[best] < AMBIGUOUS
        return self.languages[best], float(1 / share.sum()), bool(near)


def _codewords(n: int) -> np.ndarray:
    """All splits of up to six languages, else balanced splits dealt by a fixed seed."""
    if n <= 6:
        rows = [[1 if (j >> i) & 1 else -1 for j in range(1, max(2, 2 ** (n - 1)))] for i in range(n - 1)]
        return np.array([*rows, [-1] * len(rows[0])] if rows else [[1]])
    dealt, bits = np.random.default_rng(7), 8 * int(np.ceil(np.log2(n))) + 8
    half = np.where(np.arange(n) < n // 2, 1, -1)
    return np.array([dealt.permutation(half) for _ in range(bits)]).T


def train_languages(transcripts: DataFrame) -> LanguageCodes:
    """Fit on every row of *transcripts* that has a ``language``.

    Tasks add up trigram counts per language; only those sums (languages x ``CELLS``) reach the driver.
    """
    small_batches(transcripts.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column("language").to_pylist(), batch.column("transcript").to_pylist(), strict=True):
                cells = trigram_cells(letters_of(text))
                if len(cells):
                    own = sums.setdefault(language, np.zeros(CELLS, dtype=np.int64))
                    own += np.bincount(cells, minlength=CELLS)
        for language, own in sums.items():
            cells = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(cells), pa.string()), pa.array(cells), pa.array(own[cells])], ["language", "cell", "n"]
            )

    known = transcripts.select(F.col("language").cast("string").alias("language"), F.col("transcript").cast("string").alias("transcript"))
    known = known.filter("language is not null and transcript is not null")
    sums = known.mapInArrow(counted, "language string, cell long, n long").groupBy("language", "cell").agg(F.sum("n").alias("n"))
    rows = sums.toPandas()
    languages = sorted(rows["language"].unique())
    counts = np.zeros((len(languages), CELLS))
    place = {x: i for i, x in enumerate(languages)}
    counts[rows["language"].map(place).to_numpy(dtype=int), rows["cell"].to_numpy(dtype=int)] = rows["n"]
    return LanguageCodes.fitted(languages, counts) if languages else LanguageCodes([], *[np.zeros((0, 0))] * 3)


def identify_language(transcripts: DataFrame, codes: LanguageCodes) -> DataFrame:
    """The language of each whole transcript, from its text alone.

    ``transcripts``: ``video_id``, ``transcript``; other columns (``language`` included) are
    ignored. Returns ``video_id``, ``language_pred`` (a learned language), ``score`` (0 to 1) and
    ``ambiguous`` (two codewords are about as near), one row per input row. A null, empty or letterless
    transcript is ``und`` with score 0, as is every transcript when nothing was learned; of equally near
    codewords the first language by name wins. Repeated rows get equal results.
    """
    small_batches(transcripts.sparkSession)
    shared = transcripts.sparkSession.sparkContext.broadcast(codes)

    @F.pandas_udf("language_pred string, score double, ambiguous boolean")
    def told(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in texts:
            rows = []
            for text in batch:
                letters = letters_of(text) if text else np.array([], dtype=np.uint32)
                if not model.languages or not (letters != 32).any():
                    rows.append((UNKNOWN, 0.0, False))
                else:
                    rows.append(model.decode(trigram_cells(letters)))
            yield pd.DataFrame(rows, columns=["language_pred", "score", "ambiguous"])

    return transcripts.select("video_id", told(F.col("transcript").cast("string")).alias("_told")).select("video_id", "_told.*")
