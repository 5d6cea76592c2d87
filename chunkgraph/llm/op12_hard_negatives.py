"""Hard negatives by blocked dense products.

Vectors become integers, floor(256 x), and are multiplied in float64, which is exact while no sum of products can
reach 2^53; blocks beyond that are multiplied in Python integers. The anchors are cut into blocks of at most
``BLOCK`` rows, each of which is broadcast; the other side is the whole table, which stays where it is scanned and
passes in blocks of ``BATCH`` rows. There are two passes for each block of anchors:

1. products of equal labels only; a task keeps the best ``positives`` rows of each anchor. Such lists merge, so
   tasks send theirs packed, a row for each ``GROUP`` anchors, and each group is merged where it arrives, list by list.
2. each positive's score gives a window of scores, known by now. A task keeps the best ``negatives`` rows of another
   label in each window, and those lists merge the same way.

No row of the table is shuffled; what is sent is a few numbers for each anchor and task. A task holds one product of
at most ``CELLS`` numbers, and the driver one block of anchors with their positives. Each block's result is written to
the shared folder.

Defined cases: rows with a null vec_id or label, a null vector, or a null or non-finite component take no part; repeated
anchors (equal in all columns) count once, repeated rows as often as they stand there; rows with the anchor's vec_id are
never its positives or negatives; ties go to the smaller vec_id; vectors of different lengths don't meet; an anchor
without positives, or a positive without negatives in its window, has no row. A score outside of 64 bits is an error.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import pack, unpack
from .storage import Scratch, partitions

SCALE = 256
#: Anchors of a broadcast block at most, and its bytes.
BLOCK, BLOCK_BYTES = 8192, 32 << 20
BATCH = 2048
CELLS = 1 << 20
GROUP = 1024
EXACT = 1 << 53
NONE = np.iinfo(np.int64).min


def vectors(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, v): the rows that take part, components as integral doubles."""
    label = F.col("label").cast("long") if label is None else label
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # the floor of a double, as one; F.floor would give a long
    return rows.filter(finite).select("vec_id", "label", F.transform("v", lambda x: F.rint(x * SCALE) - F.when(F.rint(x * SCALE) > x * SCALE, 1.0).otherwise(0.0)).alias("v"))


def by_length(ids: np.ndarray, labels: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, labels, matrix) of the vectors of each length."""
    sizes = np.asarray(column.value_lengths())
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        flat = np.asarray(column.take(pa.array(rows)).flatten(), np.float64)
        yield rows, ids[rows], labels[rows], flat.reshape(len(rows), size)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of integral rows, as int64."""
    largest = float(np.abs(a).sum(axis=1).max(initial=0)) * float(np.abs(b).max(initial=0))
    if largest < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = [[int(x) for x in r] for r in a.tolist()], [[int(x) for x in r] for r in b.tolist()]
    return np.array([[sum(x * y for x, y in zip(r, c)) for c in exact[1]] for r in exact[0]], np.int64).reshape(len(a), len(b))


class Best:
    """The first k (score, id) of each key, higher scores first, then smaller ids; lists merge in any order."""

    def __init__(self, keys: int, k: int):
        self.k, self.least = k, np.full(keys, NONE)
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def put(self, key: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Adds rows; those below the k-th best so far are left out."""
        good = score >= self.least[key]
        if good.any():
            self.held.append((key[good], score[good], id_[good]))
            self.size += int(good.sum())
            if self.size > max(1 << 16, 4 * len(self.key)):
                self.fold()

    def fold(self) -> Best:
        key, score, id_ = (np.concatenate(c) for c in zip((self.key, self.score, self.id), *self.held))
        by = np.lexsort((id_, -score, key))
        key, score, id_ = key[by], score[by], id_[by]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(key)))
        rank = np.arange(len(key)) - np.repeat(head, size)
        keep = rank < self.k
        self.key, self.score, self.id, self.held, self.size = key[keep], score[keep], id_[keep], [], 0
        full = head[size >= self.k] + self.k - 1
        self.least[key[full]] = score[full]
        return self


def tops(score: np.ndarray, good: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the good scores stand that are among the k best of their row, ties included."""
    if score.shape[1] > 4 * k:
        rows = np.flatnonzero(good.sum(axis=1) > k)
        s = np.where(good[rows], score[rows], NONE)
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if len(rows) else np.zeros(0, np.int64)
        good[rows] &= score[rows] >= kth[:, None]
    return np.nonzero(good)


class Block:
    """A block of anchors: ids, and (rows, ids, labels, matrix) of each length of vectors."""

    def __init__(self, table: pa.Table):
        ids, labels = np.asarray(table["vec_id"]).astype(np.int64), np.asarray(table["label"]).astype(np.int64)
        self.ids, self.parts = ids, {}
        if len(ids):
            for rows, own, label, m in by_length(ids, labels, table["v"].combine_chunks()):
                self.parts[m.shape[1]] = (rows, own, label, m)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, len(batch), BATCH):
            part = batch.slice(a, BATCH)
            for _, ids, labels, m in by_length(np.asarray(part.column(0)), np.asarray(part.column(1)), part.column(2)):
                yield ids, labels, m


def _packed(best: Best, slots: int) -> Iterator[pa.RecordBatch]:
    """A row (bucket, blob) for each ``GROUP`` anchors with a list; ``slots`` keys belong to an anchor."""
    best.fold()
    bucket = best.key // (GROUP * slots)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([pack(best.key[a:b], best.score[a:b], best.id[a:b])], pa.binary())], names=["bucket", "blob"])


def _positives(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        best = Best(len(block.ids), k)
        for ids, labels, m in _blocks(batches):
            if m.shape[1] not in block.parts:
                continue
            rows, own, label, x = block.parts[m.shape[1]]
            for value in np.intersect1d(label, labels).tolist():
                mine, theirs = np.flatnonzero(label == value), np.flatnonzero(labels == value)
                step = max(1, CELLS // len(theirs))
                for a in range(0, len(mine), step):
                    at = mine[a : a + step]
                    s = product(x[at], m[theirs])
                    i, j = tops(s, (own[at, None] != ids[theirs][None, :]) & (s >= best.least[rows[at]][:, None]), k)
                    best.put(rows[at[i]], s[i, j], ids[theirs[j]])
        yield from _packed(best, 1)

    return run


def _negatives(sent, slots: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, high = sent.value  # windows by anchor and slot; one without a positive is empty
        best = Best(len(block.ids) * slots, k)
        for ids, labels, m in _blocks(batches):
            if m.shape[1] not in block.parts:
                continue
            rows, own, label, x = block.parts[m.shape[1]]
            step = max(1, CELLS // len(ids))
            for a in range(0, len(rows), step):
                at = rows[a : a + step]
                s = product(x[a : a + step], m)
                other = (label[a : a + step, None] != labels[None, :]) & (own[a : a + step, None] != ids[None, :])
                for slot in range(slots):
                    least = np.maximum(low[at, slot], best.least[at * slots + slot])
                    i, j = tops(s, other & (s <= high[at, slot][:, None]) & (s >= least[:, None]), k)
                    best.put(at[i] * slots + slot, s[i, j], ids[j])
        yield from _packed(best, slots)

    return run


def _merge(keys: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(keys, k)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                best.put(*unpack(blob))
        best.fold()
        rank = np.arange(len(best.key)) - np.searchsorted(best.key, best.key)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (best.key, rank, best.score, best.id)], names=["key", "rank", "score", "vec_id"])

    return run


def merged(packed: DataFrame, keys: int, slots: int, k: int) -> DataFrame:
    """(key, rank from 0, score, vec_id) of the lists of all tasks."""
    groups = -(-keys // (GROUP * slots))
    tasks = max(1, min(groups, partitions(packed.sparkSession)))
    placed = packed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)))
    return placed.mapInArrow(_merge(keys, k), "key long, rank long, score long, vec_id long")


def mine(embeddings: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of each anchor the best ``positives`` rows of its label, and for each of them the best ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` hundredths of the positive's. ``anchor`` is a condition on vec_id."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = vectors(embeddings, label)
    anchors = rows.filter(anchor).distinct()
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("components")).first()
    blocks = -(-size.n // max(1, min(block, BLOCK_BYTES // (8 * max(1, size.components or 0)))))
    spec = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not blocks:
        return spark.createDataFrame([], spec)
    # a hash of the whole row deals the anchors evenly to the blocks
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)).cast("int"))
    (dealt.repartition("block") if blocks > 1 else dealt).write.partitionBy("block").parquet(f"{scratch.path}/anchors")
    chosen = scratch.read("anchors", "vec_id long, label long, v array<double>, block int")
    for b in range(blocks):
        own = Block(chosen.filter(F.col("block") == b).orderBy("label", "vec_id").select("vec_id", "label", "v").toArrow())
        n = len(own.ids)
        sent = spark.sparkContext.broadcast(own)
        found = merged(rows.mapInArrow(_positives(sent, positives), "bucket int, blob binary"), n, 1, positives).toArrow()
        sent.unpersist()
        key, rank, score, ids = (np.asarray(found[c]).astype(np.int64) for c in ("key", "rank", "score", "vec_id"))
        lows, highs = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)  # empty windows
        lows[key, rank] = [-(-low * s // 100) for s in score.tolist()]
        highs[key, rank] = [high * s // 100 for s in score.tolist()]
        sent = spark.sparkContext.broadcast((own, lows, highs))
        best = merged(rows.mapInArrow(_negatives(sent, positives, negatives), "bucket int, blob binary"), n * positives, positives, negatives)
        # one row for each anchor of the block and positive
        pairs = spark.createDataFrame(pa.table({"key": key * positives + rank, "anchor_id": own.ids[key], "positive_id": ids, "positive_score": score}))
        told = best.join(F.broadcast(pairs), "key")
        shown = told.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        shown.write.mode("append").parquet(f"{scratch.path}/found")
        sent.unpersist()
    return scratch.read("found", spec)
