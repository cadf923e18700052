"""Hard negatives by cover trees over norm-augmented vectors.

One more component brings all vectors of a block to one length, so that the inner product with a query depends on an angle alone. A
cover tree holds a centre and a covering angle for each node: the angle between query and centre, plus or minus that, bounds every inner
product below the node. Nodes outside all of a query's score windows are skipped, the others are descended best first.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmart.llm.common import kept

#: Vectors of a tree, and anchors that visit it together: what one task holds.
BLOCK, ANCHOR_BLOCK = 2048, 1024
#: Vectors of a node that is not split further.
LEAF = 16
#: Slack of the bounds, as a share of the largest product; scores themselves are exact integers.
SLACK = 1e-9
#: Distances on the unit sphere below this are rounding.
ROUNDING = 1e-6
#: Integers below this are exact in double precision.
_EXACT = 1 << 53


class CoverTree:
    """Nodes of a block, by levels: the children of a node stand side by side, and a node's centre is one of its vectors.

    Radii halve from level to level: a node's vectors lie within its level's radius of the centre, and
    centres of one node are further apart than that. Nodes of at most ``LEAF`` vectors and nodes of equal vectors are leaves. Vectors
    are kept in the order of the leaves, so those of a node's leaf children are one slice.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        real = vectors.astype(np.float64)
        squares = (real * real).sum(axis=1)
        self.length = float(np.sqrt(squares.max()))
        unit = np.concatenate([real, np.sqrt(np.maximum(0.0, squares.max() - squares))[:, None]], axis=1)
        self._unit = unit / (self.length or 1.0)
        self._cosines = self._unit @ self._unit.T
        #: For each inner node: its children's centres, cosines and sines of their covering angles, numbers (-1: a leaf), and the leaves' slices.
        self.nodes: list[tuple[np.ndarray, ...]] = []
        order: list[np.ndarray] = []
        self._placed = 0
        self._grow(np.arange(len(ids)), order)
        place = np.concatenate(order)
        self.ids, self.labels, self.vectors = ids[place], labels[place], vectors[place]
        del self._unit, self._cosines

    def _grow(self, everything: np.ndarray, order: list[np.ndarray]) -> None:
        """Nodes from the top; the top node has one child, which covers all."""
        open_nodes = [[(0, everything, self._spread(0, everything))]]
        numbered = 1
        while open_nodes:
            parts = open_nodes.pop(0)
            angles, numbers, ends = [], [], [self._placed]
            for centre, own, away in parts:
                radius = float(away.max())
                # The covering angle of a chord, widened by rounding.
                angles.append(min(np.pi, 2 * np.arcsin(min(1.0, radius / 2)) + 2 * ROUNDING))
                if len(own) <= LEAF or radius <= ROUNDING:
                    numbers.append(-1)
                    order.append(own)
                    self._placed += len(own)
                else:
                    numbers.append(numbered)
                    numbered += 1
                    open_nodes.append(self._cover(centre, own, away, radius / 2))
                ends.append(self._placed)
            centres, wide = self._unit[[c for c, _, _ in parts]], np.array(angles)
            self.nodes.append((centres, np.cos(wide), np.sin(wide), np.array(numbers), np.array(ends)))

    def _spread(self, centre: int, own: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * self._cosines[centre, own]))

    def _cover(self, centre: int, own: np.ndarray, away: np.ndarray, radius: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Centres further than *radius* apart, the node's own first, each with the vectors that it is the first to cover."""
        parts = []
        while len(own):
            near = away <= radius
            parts.append((centre, own[near], away[near]))
            own = own[~near]
            if len(own):
                centre = int(own[0])
                away = self._spread(centre, own)
        return parts

    def search(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, usable: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each window the *k* first (score, id) of the *usable* vectors with ``low <= 100 * score <= high``."""
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum())) * self.length
        slack = SLACK * length + ROUNDING
        toward = np.append(query.astype(np.float64), 0.0) / ((length / self.length) if length else 1.0)
        floor = low.astype(np.float64) / 100
        top = high.astype(np.float64) / 100
        best: list[list[tuple[int, int]]] = [[] for _ in low]
        heap = [(-length, 0, length, -length)]
        while heap:
            _, node, upper, lower = heapq.heappop(heap)
            if not ((upper >= floor - slack) & (lower <= top + slack)).any():
                continue
            centres, cosines, sines, numbers, ends = self.nodes[node]
            # Cosines of the angle to the centre minus and plus the covering angle, inside 0 and pi.
            near = np.clip(centres @ toward, -1.0, 1.0)
            both, apart = near * cosines, np.sqrt(1 - near * near) * sines
            uppers = length * np.where(near >= cosines, 1.0, both + apart)
            lowers = length * np.where(near <= -cosines, -1.0, both - apart)
            met = ((uppers[:, None] >= floor - slack) & (lowers[:, None] <= top + slack)).any(axis=1)
            for i in np.flatnonzero(met & (numbers >= 0)):
                heapq.heappush(heap, (-uppers[i], int(numbers[i]), uppers[i], lowers[i]))
            if ends[-1] > ends[0]:
                reached = np.arange(ends[0], ends[-1])[np.repeat(met, np.diff(ends))]
                whole = len(reached) == ends[-1] - ends[0]
                self._verify(slice(ends[0], ends[-1]) if whole else reached, reached, query, low, high, k, usable, best, floor)
        return best

    def _verify(self, place, members, query, low, high, k, usable, best, floor) -> None:
        """Exact scores of leaves; a window's floor rises to its *k*-th score."""
        scores = self.vectors[place] @ query
        hundred, fit = scores * 100, usable[place]
        for j in range(len(low)):
            inside = np.flatnonzero(fit & (hundred >= low[j]) & (hundred <= high[j]) & (scores >= floor[j] - 1))
            if not len(inside):
                continue
            if len(inside) > 4 * k:  # ties at the k-th score stay
                inside = inside[scores[inside] >= np.partition(scores[inside], len(inside) - k)[len(inside) - k]]
            found = best[j] + [(int(scores[i]), int(self.ids[members[i]])) for i in inside]
            best[j] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
            if len(best[j]) == k:
                floor[j] = max(floor[j], best[j][-1][0])


def is_usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    """Integer vectors as doubles where their products are exact, else as Python's integers."""
    flat = pa.concat_arrays(table.column(name).chunks).flatten().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)
    whole = flat.reshape(table.num_rows, -1)
    largest = int(np.abs(flat).max()) if len(flat) else 0
    exact = 100 * whole.shape[1] * largest * largest < _EXACT
    return whole.astype(np.float64) if exact else whole.astype(object)


def _visit(k: int, same: bool):
    """A block's tree, visited by a block of anchors; *same*: for vectors of the anchor's label, else for those of others."""

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("vec_id"), right.sort_by("anchor_id")
            vectors, queries = _matrix(left, "vector"), _matrix(right, "anchor")
            if object in (vectors.dtype, queries.dtype):
                vectors, queries = vectors.astype(object), queries.astype(object)
            tree = CoverTree(left["vec_id"].to_numpy(), left["label"].to_numpy(), vectors)
            windows = right["windows"].to_pylist()
            for i, (anchor, label) in enumerate(zip(right["anchor_id"].to_pylist(), right["anchor_label"].to_pylist(), strict=True)):
                usable = (tree.labels == label) & (tree.ids != anchor) if same else tree.labels != label
                low = np.array([w["low"] for w in windows[i]], dtype=object if vectors.dtype == object else np.float64)
                high = np.array([w["high"] for w in windows[i]], dtype=low.dtype)
                for w, found in zip(windows[i], tree.search(queries[i], low, high, k, usable), strict=True):
                    out += [(anchor, w["place"], v, s) for s, v in found]
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "place", "vec_id", "score"])

    return visit


def _meet(vectors: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int, k: int, same: bool) -> DataFrame:
    """Each block of anchors meets each block of vectors once; the best *k* of a block and window leave it."""
    left = vectors.withColumn("_anchors", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(anchor_blocks - 1).cast("long"))))
    right = anchors.withColumn("_anchors", F.pmod(F.xxhash64("anchor_id"), F.lit(anchor_blocks))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    keys = ["_size", "_block", "_anchors"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _visit(k, same), "anchor_id long, place long, vec_id long, score long"
    )
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: int = 80, scale: float = 256.0) -> DataFrame:
    """Vectors of other labels that score nearly as high as an anchor's positives.

    The project keeps no vectors, so the tables are general. ``vectors`` and ``anchors``: ``vec_id``, ``embedding`` (array of numbers), ``label``;
    other columns are ignored. Rows with a null id, label or vector or a null or non-finite component take no part; vectors only meet those
    of their dimension. Components count as ``floor(scale * x)`` in double precision, scores are integer inner
    products, a hundred times of which must fit a long.

    An anchor's positives are the first *positives* other ids of its label, by falling score, then smaller id. For each of them
    the first *negatives* vectors of other labels with ``share * positive <= 100 * negative <= 100 * positive`` are
    returned: ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``. Fewer candidates
    give fewer rows, empty tables none. Repeated rows are separate candidates; repeated anchors are one (the least of their rows).

    Blocks of bounded size hold the trees; each block of anchors visits each tree twice (a stated query set against all
    rows): once for positives, once for the windows these define.
    """
    size, number = F.size("vector"), F.col("embedding").cast("array<double>")
    use = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), number.alias("_x"))
    asked = anchors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), number.alias("_x"))
    floored = F.transform("_x", lambda x: F.floor(F.lit(float(scale)) * x)).alias("vector")
    use, asked = (
        d.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_usable(F.col("_x")) & (F.size("_x") > 0)).select("vec_id", "label", floored)
        for d in (use, asked)
    )
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("_a")).select(
        F.col("vec_id").alias("anchor_id"), F.col("_a.label").alias("anchor_label"), F.col("_a.vector").alias("anchor"), F.size("_a.vector").alias("_size")
    )
    blocks, anchor_blocks = max(1, -(-use.count() // BLOCK)), max(1, -(-asked.count() // ANCHOR_BLOCK))
    # A second hash spreads rows that repeat one id.
    use = use.withColumns({"_size": size, "_block": F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks))})
    far = 1 << 62
    open_window = F.array(F.struct(F.lit(1).cast("long").alias("place"), F.lit(-far).alias("low"), F.lit(far).alias("high")))
    first = kept(_meet(use, asked.withColumn("windows", open_window), blocks, anchor_blocks, positives, True).select(
        "anchor_id", F.col("rank").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    # Below zero a window is empty.
    window = F.struct("place", (F.col("positive_score") * share).alias("low"), (F.col("positive_score") * 100).alias("high"))
    windows = first.filter("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    hard = _meet(use, asked.join(windows, "anchor_id"), blocks, anchor_blocks, negatives, False)
    return hard.join(first, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
