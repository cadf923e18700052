"""Nearest vectors by collision-counting hashing.

Every projection sorts a block's vectors along one random direction. A query's window on each
of these arrays is centred on the query and grows by virtual rehashing (wider each round, over
the same sorted array). Vectors that fall into enough windows are verified on the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Random directions, and the share of their windows that a vector must fall into to be verified.
PROJECTIONS, THRESHOLD = 64, 0.58
#: Vectors of a block, and queries of a block: what one task holds.
BLOCK, QUERY_BLOCK = 4096, 256
#: First half width of a window on unit vectors, its growth in a round, and the rounds before windows hold everything.
WIDTH, GROWTH, ROUNDS = 0.2, 2**0.5, 8
#: Windows are counted once vectors fall, on average, into this share of the windows needed.
SPARSE = 0.5
SEED = 11


def directions(dimension: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((projections, dimension))


def is_usable(vector: Column) -> Column:
    """Not null, no component null or not finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


class Block:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lengths = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.ways = directions(vectors.shape[1], projections)
        along = (self.vectors / self.lengths[:, None]) @ self.ways.T
        rank = np.argsort(along, axis=0, kind="stable")
        self.sorted = np.take_along_axis(along, rank, axis=0).T.copy()
        # Where each vector stands in each sorted array: it is in a window when its place is between the window's ends.
        small = np.int16 if len(ids) < 1 << 15 else np.int32
        self.place = np.empty(rank.shape[::-1], dtype=small)
        np.put_along_axis(self.place, rank.T, np.arange(len(ids), dtype=small)[None, :], axis=1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and cosines of the *k* nearest found in this block, ties by smaller id."""
        lengths = np.sqrt((queries * queries).sum(axis=1))
        centres = (queries / lengths[:, None]) @ self.ways.T
        needed, n = int(np.ceil(threshold * len(self.ways))), len(self.ids)
        out: list = [None] * len(queries)
        open_ones, width = np.arange(len(queries)), WIDTH
        for level in range(ROUNDS + 1):
            low = np.zeros((len(open_ones), len(self.ways)), dtype=self.place.dtype)
            high = np.full_like(low, n)
            if level < ROUNDS:
                for j, line in enumerate(self.sorted):
                    low[:, j] = np.searchsorted(line, centres[open_ones, j] - width, "left")
                    high[:, j] = np.searchsorted(line, centres[open_ones, j] + width, "right")
            unsigned = np.dtype(f"u{self.place.itemsize}")
            spans = (high - low).view(unsigned)
            # While windows are so narrow that hardly any vector can fall into enough of them, they only grow.
            wide = spans.sum(axis=1) >= SPARSE * needed * n
            left = [q for q, w in zip(open_ones, wide, strict=True) if not w and level < ROUNDS]
            for i, q in enumerate(open_ones):
                if not wide[i] and level < ROUNDS:
                    continue
                inside = (self.place - low[i][:, None]).view(unsigned) < spans[i][:, None]
                hits = np.add.reduce(inside, axis=0, dtype=np.uint8)
                found = np.flatnonzero((hits >= needed) & (self.ids != query_ids[q]))
                if level == ROUNDS or len(found) >= k:
                    score = (self.vectors[found] * queries[q]).sum(axis=1) / (self.lengths[found] * lengths[q])
                    best = np.lexsort((self.ids[found], -score))[:k]
                    # Vectors that collide this often are near; go on only while the k-th may still be far outside.
                    if level == ROUNDS or self._settled(score[best[-1]], width):
                        out[q] = (self.ids[found][best], score[best])
                        continue
                left.append(q)
            open_ones, width = np.array(left, dtype=np.int64), width * GROWTH
            if not left:
                break
        return out

    @staticmethod
    def _settled(cosine: float, width: float) -> bool:
        """A vector at the k-th distance d strays by about d along a direction: windows of d suffice."""
        return width >= np.sqrt(max(0.0, 2 - 2 * cosine))


def _searched(k: int, threshold: float):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            block = Block(*_arrays(left, "vec_id", "vector"))
            names, queries = _arrays(right, "query_id", "query")
            for name, (ids, scores) in zip(names, block.search(names, queries, k, threshold), strict=True):
                out += [(int(name), int(i), float(s)) for i, s in zip(ids, scores, strict=True)]
        columns = zip(*out, strict=True) if out else ((), (), ())
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "vec_id", "score"])

    return search


def _arrays(table: pa.Table, name: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    flat = table.column(vector).combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return table.column(name).to_numpy(), _scaled(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest components near 1: cosines keep every bit, squares stay finite."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """The *k* nearest vectors found for each query, by cosine in double precision.

    The project keeps no vectors, so the tables are general. ``vectors`` and ``queries``: ``vec_id``,
    ``embedding`` (array of numbers); other columns are ignored. A query's own ``vec_id`` is no candidate. Vectors that are
    null, empty, zero or hold a null or non-finite component take no part; vectors only meet vectors of their dimension.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: nearest first, ties by smaller id, fewer rows where there are fewer
    candidates. Repeated ids in ``vectors`` are separate candidates; repeated queries give one answer. Empty tables give no rows.

    Vectors and queries are dealt into blocks of bounded size; each block of queries meets each block of
    vectors once (a stated query set against all rows), and only the best *k* of a block leave it.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    use = [
        d.select(F.col("vec_id").cast("long").alias(i), F.col("embedding").cast("array<double>").alias(v))
        .filter(F.col(i).isNotNull() & (F.size(v) > 0) & is_usable(F.col(v)))
        for d, i, v in ((vectors, "vec_id", "vector"), (queries, "query_id", "query"))
    ]
    use[1] = use[1].dropDuplicates(["query_id"])
    n_vectors, n_queries = (d.count() for d in use)
    blocks, query_blocks = max(1, -(-n_vectors // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    left = use[0].withColumns(
        {"_block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), "_size": F.size("vector")}
    ).withColumn("_query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = use[1].withColumns(
        {"_query_block": F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"), "_size": F.size("query")}
    ).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["_size", "_block", "_query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searched(k, threshold), "query_id long, vec_id long, score double")
    # The row-number limit also holds before the shuffle: a task passes on its best k of a query.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
