"""Near-duplicate transcripts: an exact n-gram Jaccard join with signature trees.

Every set of shingles has a bitmap. A signature tree's leaves hold bitmaps of sets, its nodes the OR of
what is below and the range of sizes. Two trees are walked together; a pair of nodes goes no further when the
most that any two of their sets can share is too little. Trees are built for sets that share a
shingle of their prefixes (which similar sets must), and what survives is verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmart.llm.common import bytes_of, kept, mixed, released, shingle_hashes, small_batches, word_hashes
from clipmart.llm.components import components

WORDS = 5
#: Similarity in per cent.
PERCENT = 80
#: Sets of a tree, and of a leaf.
BLOCK, LEAF = 1024, 8
#: Bits of a bitmap for each shingle; trees work on bitmaps folded to a ``COARSE``-th of that.
BITS, COARSE = 4, 4
#: Sets that are compared with all others of a group before the group is searched.
HUBS = 2
#: Transcripts from which frequent shingles are learned, which go last in prefixes. Any order gives the same result.
ORDER_SAMPLE = 8000
FREQUENT_SHARE = 0.001
#: Rows of set ids that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    return [np.unique(shingle_hashes(words, WORDS)) for words in word_hashes([t.lower() for t in texts])]


def set_name(own: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(own):
        return 0
    name = mixed(np.array([mixed(own ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(own))], dtype=np.uint64))
    return int(name.view(np.int64)[0])


def prefix(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles in the common order (frequent ones last) of which a similar set must have one."""
    if not len(own):
        return own
    length = len(own) - (PERCENT * len(own) + 99) // 100 + 1
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
        own = np.concatenate((own[~often], own[often]))
    return own[:length]


def bitmap(own: np.ndarray) -> bytes:
    """A bitmap of the power of two from ``BITS`` bits for each shingle: few shingles share a bit."""
    size = max(64, 1 << int(BITS * len(own) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(own >> np.uint64(32)) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) ORed down to *words* words."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles that sets of *a* and *b* shingles must share to be similar."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


class Tree:
    """A signature tree over sets of like size: levels of OR-combined bitmaps, size and slack ranges.

    ``slack`` is the number of shingles that share a bit with another one of their set: two sets share at most
    their common bits plus the smaller slack.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        slack = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        # Sets that look alike become neighbours, so that their OR stays thin.
        self.order = np.lexsort((sizes, *(bits[:, i] for i in range(min(3, bits.shape[1])))))
        level = (bits[self.order], sizes[self.order], sizes[self.order], slack[self.order])
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), LEAF)
            level = (
                np.bitwise_or.reduceat(level[0], at, axis=0), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at),
                np.maximum.reduceat(level[3], at),
            )
            self.levels.append(level)

    def join(self, other: Tree) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that may be similar, by walking both trees from their roots."""
        up, down = len(self.levels) - 1, len(other.levels) - 1
        a, b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        while True:
            keep = [self._may(self.levels[up], other.levels[down], a[i : i + 65536], b[i : i + 65536]) for i in range(0, len(a), 65536)]
            keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
            a, b = a[keep], b[keep]
            if not len(a) or up == down == 0:
                return self.order[a] if len(a) else a, other.order[b] if len(b) else b
            if up >= down:
                a, b = self._children(a, b, len(self.levels[up - 1][0]))
                up -= 1
            else:
                b, a = self._children(b, a, len(other.levels[down - 1][0]))
                down -= 1

    @staticmethod
    def _children(nodes: np.ndarray, others: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        below = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        real = below < count
        return below[real], np.repeat(others, LEAF)[real]

    @staticmethod
    def _may(left, right, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low_a, high_a, low_b, high_b = left[1][a], left[2][a], right[1][b], right[2][b]
        fits = (100 * high_b >= PERCENT * low_a) & (100 * high_a >= PERCENT * low_b)
        common = np.bitwise_count(left[0][a] & right[0][b]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(high_a, high_b), common + np.minimum(left[3][a], right[3][b]))
        # The smallest sets of both nodes ask for the least.
        return fits & (most >= least_shared(low_a, low_b))


def _sketched(frequent: np.ndarray):
    """Size, name, bitmap and prefix of each transcript's set; a set's prefix once in a task."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sizes, names, bitmaps, ends, tokens = [], [], [], [0], []
            for own in shingles(bytes_of(batch.column("transcript"))):
                name = set_name(own)
                sizes.append(len(own))
                names.append(name if len(own) else None)
                first = len(own) > 0 and name not in seen
                bitmaps.append(bitmap(own) if first else None)
                if first:
                    seen.add(name)
                    tokens.append(prefix(own, frequent))
                ends.append(ends[-1] + (len(tokens[-1]) if first else 0))
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("video_id"), batch.column("_text"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()),
                 pa.array(bitmaps, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["video_id", "_text", "n_shingles", "set_id", "bits", "prefix"],
            )

    return sketch


def _frequent(rows: DataFrame) -> np.ndarray:
    """Shingles in at least ``FREQUENT_SHARE`` of a sample of about ``ORDER_SAMPLE`` texts."""
    total = rows.count()
    sample = rows.filter(F.pmod(F.xxhash64("_text"), F.lit(max(1, total // ORDER_SAMPLE))) == 0).select("transcript")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sets = []
            for own in shingles(bytes_of(batch.column("transcript"))):
                if (name := set_name(own)) not in seen:
                    seen.add(name)
                    sets.append(own)
            found, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["token", "n"])

    counts = sample.mapInArrow(tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = counts.filter(F.col("n") >= max(8, int(FREQUENT_SHARE * min(total, ORDER_SAMPLE)))).orderBy(F.desc("n"), "token").limit(BROADCAST_ROWS)
    return np.sort(often.toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64))


def _met(rows: pa.Table, known: pa.Table) -> pa.Table:
    """Pairs of a probe and a member of one cell that may be similar and are not yet in one component.

    ``rows`` place sets in cells, ``known`` has each set of the bin once. A pair that meets in several cells of the
    bin leaves it once.
    """
    names = known.column("set_id").to_numpy()
    by_name = np.argsort(names)
    names = names[by_name]
    sizes, components = (known.column(c).to_numpy()[by_name] for c in ("n_shingles", "component"))
    raw = known.column("bits").combine_chunks().take(pa.array(by_name))
    bits = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in raw]
    at = np.searchsorted(names, rows.column("set_id").to_numpy())
    probe = np.array(rows.column("probe").to_pylist(), dtype=bool)
    token, cell = rows.column("token").to_numpy(), rows.column("cell").to_numpy()
    order = np.lexsort((cell, token))
    edges = np.flatnonzero((np.diff(token[order]) != 0) | (np.diff(cell[order]) != 0)) + 1
    codes: list[np.ndarray] = []
    for group in np.split(order, edges):
        left, right = at[group[probe[group]]], at[group[~probe[group]]]
        if not len(left) or not len(right):
            continue
        for a, b in _by_width(left, right, sizes):
            # Bitmaps of one width: wide ones fold onto the narrowest of the part.
            words = min(len(bits[i]) for i in (*a, *b))
            fine = [np.concatenate([_folded(bits[i][None, :], words) for i in x]) for x in (a, b)]
            thin = max(1, words // COARSE)
            i, j = Tree(sizes[a], _folded(fine[0], thin)).join(Tree(sizes[b], _folded(fine[1], thin)))
            new = components[a[i]] != components[b[j]]
            i, j = i[new], j[new]
            near = _near(sizes[a], fine[0], sizes[b], fine[1], i, j)
            x, y = a[i[near]], b[j[near]]
            codes.append(np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y)))
    found = np.unique(np.concatenate(codes)) if codes else np.zeros(0, dtype=np.int64)
    ends = (names[found // len(names)], names[found % len(names)]) if len(found) else (found, found)
    return pa.Table.from_arrays([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])


def _near(sizes_a: np.ndarray, bits_a: np.ndarray, sizes_b: np.ndarray, bits_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether full bitmaps leave room for enough common shingles, for pairs (i, j) in blocks."""
    slack = [n - np.bitwise_count(b).sum(axis=1, dtype=np.int64) for n, b in ((sizes_a, bits_a), (sizes_b, bits_b))]
    out = []
    step = max(1, (1 << 21) // max(1, bits_a.shape[1]))
    for k in range(0, len(i), step):
        x, y = i[k : k + step], j[k : k + step]
        common = np.bitwise_count(bits_a[x] & bits_b[y]).sum(axis=1, dtype=np.int64)
        out.append(common + np.minimum(slack[0][x], slack[1][y]) >= least_shared(sizes_a[x], sizes_b[y]))
    return np.concatenate(out) if out else np.zeros(0, dtype=bool)


def _by_width(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of both sides by octave of size; similar sets are in one octave or in neighbours."""
    octave = lambda rows: np.floor(np.log2(sizes[rows])).astype(int)
    of_left, of_right = octave(left), octave(right)
    for o in np.unique(of_left):
        for p in (o - 1, o, o + 1):
            if (of_right == p).any():
                yield left[of_left == o], right[of_right == p]


def _cells(members: DataFrame, probes: DataFrame, known: DataFrame, parts: int) -> DataFrame:
    """Pairs from cells of at most about ``BLOCK`` members and ``BLOCK`` probes of one shingle.

    Both carry ``token``, ``cnt`` (members of the shingle), ``probes`` (its probes), ``home`` and ``set_id``; ``known`` has ``set_id``,
    ``n_shingles``, ``component`` and ``bits``. Shingles with one home (mostly the same sets) share bins, to which a set travels once.
    """
    blocks = F.ceil(F.col("cnt") / BLOCK).cast("long")
    chunks = F.ceil(F.col("probes") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("set_id"), blocks)
    mine = F.pmod(F.xxhash64("set_id", F.lit(1)), chunks)
    zero = F.lit(0).cast("long")
    spread = [
        members.withColumn("cell", F.explode(F.transform(F.sequence(zero, chunks - 1), lambda c: c * blocks + own))),
        probes.withColumn("cell", F.explode(F.transform(F.sequence(zero, blocks - 1), lambda b: mine * blocks + b))),
    ]
    bin_of = F.pmod(F.xxhash64("home", "cell"), F.lit(parts)).alias("_bin")
    rows = [d.select(bin_of, "token", "cell", "set_id", F.lit(i == 1).alias("probe")) for i, d in enumerate(spread)]
    rows = rows[0].unionByName(rows[1])
    wide = rows.select("_bin", "set_id").distinct().join(known, "set_id").select("_bin", "set_id", "n_shingles", "component", "bits")
    wide = wide.toDF("_wide_bin", *wide.columns[1:])
    return rows.groupBy("_bin").cogroup(wide.groupBy("_wide_bin")).applyInArrow(lambda r, k: _met(r, k), "a long, b long").distinct()


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are similar, from the texts of one transcript for each of their sets."""
    named = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    wanted = kept(sets.join(named, "set_id").select("set_id", F.col("first.video_id").alias("_id"), F.col("first._text").alias("_t")))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, rows["_text"].eqNullSafe(F.col("_t")) & rows["video_id"].eqNullSafe(F.col("_id"))).select("set_id", "transcript")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            names, ends, parts = [], [0], []
            for name, own in zip(batch.column("set_id").to_pylist(), shingles(bytes_of(batch.column("transcript"))), strict=True):
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    parts.append(own)
                    ends.append(ends[-1] + len(parts[-1]))
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["set_id", "own"]
            )

    # Dealt by set once: both joins read the same shuffle.
    own = texts.mapInArrow(arrays, "set_id long, own array<long>").dropDuplicates(["set_id"])
    joined = pairs.join(own.toDF("a", "_a"), "a").join(own.toDF("b", "_b"), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    similar = shared * 100 >= (F.size("_a") + F.size("_b") - shared) * PERCENT
    return joined.filter(similar).select("a", "b")


def near_duplicates(transcripts: DataFrame) -> DataFrame:
    """Groups of transcripts that are linked by similar sets of five-word shingles.

    ``transcripts``: ``video_id``, ``transcript``; other columns are ignored. A set holds the distinct runs of
    ``WORDS`` words (A-Z lower-cased); a shorter, not empty text is one run. Two transcripts link
    when their sets share at least ``PERCENT`` per cent of their union. Returns one row per input row: ``video_id``, ``n_shingles``,
    ``component_id`` (the smallest ``video_id`` that links reach, itself included), ``text_hash`` (xxhash64 of the transcript) and ``stays``
    (the row, or a row equal to the row, that stands for its component; wordless rows always). A null or wordless transcript has
    no set and links with nothing: its component is its own id. Equal sets are one node of the search; repeated rows and equal
    ids get the smallest id of their set's component. A null id is never the smallest unless there is no other. An empty table
    gives an empty result.

    Shingles and sets are compared by 64-bit hashes. Groups of sets behind one shingle are of any size: hubs
    join most of a group in linear work, and what is left of it is searched in cells of bounded size.
    """
    spark = transcripts.sparkSession
    small_batches(spark)
    id_type = transcripts.schema["video_id"].dataType.simpleString()
    text = F.col("transcript").cast("string")
    rows = transcripts.select("video_id", text.alias("transcript"), F.xxhash64(text).alias("_text"))
    shape = f"video_id {id_type}, _text long, n_shingles long, set_id long, bits binary, prefix array<long>"
    sketch = kept(rows.mapInArrow(_sketched(_frequent(rows)), shape))
    sets = sketch.filter("set_id is not null").groupBy("set_id").agg(
        F.min(F.struct(F.col("video_id").isNull().alias("none"), "video_id", "_text")).alias("first")
    )

    # One shuffle by shingle serves the distinct sets of a shingle, the counts and the join of both.
    tokens = sketch.select(F.explode("prefix").alias("token"), "set_id").repartition("token").dropDuplicates(["token", "set_id"])
    groups = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"), F.bit_xor(F.xxhash64("set_id")).alias("_who"), F.min("set_id").alias("home")).filter("cnt > 1")
    # Shingles of the same sets say the same: one of them is enough.
    groups = groups.groupBy("cnt", "_who").agg(F.min(F.struct("token", "home")).alias("_t")).select("_t.token", "_t.home", "cnt")
    shared = kept(tokens.join(groups, "token"))
    marked = sketch.filter("bits is not null").select("set_id", "n_shingles", "bits").join(shared.select("set_id").distinct(), "set_id")
    marked = kept(marked.dropDuplicates(["set_id"]))
    del tokens, groups
    released(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shared.count() // 100_000))

    # Round one: a few hubs of each group against all of it.
    hubs = shared.groupBy("token").agg(*[F.min_by("set_id", F.xxhash64("set_id", F.lit(i))).alias(f"_h{i}") for i in range(HUBS)])
    hubs = hubs.select("token", F.explode(F.array_distinct(F.array(*[f"_h{i}" for i in range(HUBS)]))).alias("set_id"))
    members = shared.withColumn("probes", F.lit(HUBS).cast("long"))
    probes = members.join(hubs, ["token", "set_id"], "left_semi")
    known = marked.withColumn("component", F.col("set_id"))
    links = kept(_verified(kept(_cells(members, probes, known, parts)), rows, sets))
    del hubs, members, probes, known
    released(spark)

    # Round two: in groups of several components, all sets outside the largest one against the whole group.
    reached = components(links).toDF("set_id", "_c")
    placed = shared.join(reached, "set_id", "left").withColumn("component", F.coalesce("_c", "set_id")).drop("_c")
    share = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("_n"), F.first("cnt").alias("cnt"))
    largest = share.groupBy("token").agg(F.max(F.struct("_n", "component")).alias("_top"), F.first("cnt").alias("cnt"))
    largest = largest.filter(F.col("_top._n") < F.col("cnt")).select(
        "token", F.col("_top.component").alias("_main"), (F.col("cnt") - F.col("_top._n")).alias("probes")
    )
    members = placed.join(largest, "token")
    known = marked.join(reached, "set_id", "left").withColumn("component", F.coalesce("_c", "set_id")).drop("_c")
    more = kept(_verified(kept(_cells(members, members.filter("component <> _main"), known, parts)), rows, sets))
    del members, known, placed, share, largest, reached
    released(spark)

    reached = components(links.union(more)).toDF("set_id", "_c")
    smallest = sets.join(reached, "set_id").groupBy("_c").agg(F.min("first").alias("_least"))
    reached = reached.join(smallest, "_c").select("set_id", "_least")
    named = sets.join(reached, "set_id", "left").select("set_id", F.coalesce("_least", "first").alias("_least"))
    out = sketch.select("video_id", "n_shingles", "set_id", "_text").join(named, "set_id", "left")
    wordless, least = F.col("set_id").isNull(), F.col("_least")
    stays = F.col("video_id").eqNullSafe(least["video_id"]) & F.col("_text").eqNullSafe(least["_text"])
    return out.select(
        "video_id", "n_shingles", F.when(wordless, F.col("video_id")).otherwise(least["video_id"]).alias("component_id"),
        F.col("_text").alias("text_hash"), (wordless | stays).alias("stays"),
    )
