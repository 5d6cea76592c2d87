"""Vector expressions, the blocked similarity kernel and an offline embedder."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Rows of the left side that a task holds, where both sides are large.
BLOCK = 8192
#: Rows and bytes of a side that is small: every task holds it.
HELD, HELD_BYTES = 8192, 128 << 20
#: Products are rounded, as their last bits depend on how rows are put together; what differs by less is a tie.
DIGITS, TIE = 12, 1e-11
#: Bytes of vectors in a block of a grid's left side, and in what is sent as one row.
BLOCK_BYTES, BLOB_BYTES = 32 << 20, 1 << 20
#: The share of cells reached below which cells around pivots are worth while.
CELLS_SHARE = 0.1
#: Codes of the right side in a tile of pairs, and pairs in it: what the cache of a core holds.
CODE_COLUMNS, CODE_PAIRS = 8192, 1 << 17
#: Pivots around which the left side is cut at most.
PIVOTS = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """The vector at length 1; null for a zero vector, which has no direction."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # an expression inside a lambda would be taken anew for each component
    return F.when(length > 0, F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, y: x / y))


def cosine(a: Column, b: Column) -> Column:
    return dot(normalise(a), normalise(b))


def parse_embedding(text: Column) -> Column:
    """A vector stored as JSON text; null if it can't be read or holds a null."""
    v = F.from_json(text, "array<double>")
    return F.when(F.forall(v, lambda x: x.isNotNull()), v)


def nodes_of(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", text: Column | None = None) -> DataFrame:
    """(node_id, text, emb): unit vectors as doubles; rows without a direction are left out."""
    body = text if text is not None else F.concat(F.lit("vec_"), F.col(id_col))
    rows = embeddings.select(F.col(id_col).cast("long").alias("node_id"), body.alias("text"), normalise(F.col(vector_col).cast("array<double>")).alias("emb"))
    return rows.filter("node_id is not null and emb is not null")


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of vectors; of binary codes, each bit is 1 or -1."""
    if pa.types.is_binary(column.type):
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.uint8)
        return np.unpackbits(raw, axis=1).astype(np.float32) * 2 - 1
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rows_of(column: pa.Array) -> np.ndarray:
    """The rows of a column of vectors; of binary codes their bytes, which stay packed."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.uint8)
    return matrix(column)


def _best(row: np.ndarray, dst: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of (row, dst, weight) the k best of each row, ties to the lesser dst, with their ranks from 1."""
    by = np.lexsort((dst, -weight, row))
    row, dst, weight = row[by], dst[by], weight[by]
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row)))) + 1
    keep = rank <= k
    return row[keep], dst[keep], weight[keep], rank[keep]


def _pairs(own: np.ndarray, x: np.ndarray, other: np.ndarray, m: np.ndarray, threshold: float, inclusive: bool, k: int | None, distinct: bool, low: np.ndarray | None = None, last: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of x, id in other, product) of the pairs that reach the threshold, with k only those that may be the best of a row.

    Single precision tells which pairs can reach it, or what a row's k best have reached (``low``); its error is bounded
    by the lengths. Those pairs' products are then taken in double precision. Codes are compared by their bits."""
    if x.dtype == np.uint8:
        yield from _code_pairs(own, x, other, m, threshold, inclusive, k, distinct, low, last)
        return
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    most = np.nan_to_num(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))).max(initial=0.0)
    slack = np.nan_to_num(lengths) * most * (x.shape[1] + 8) * 2.0**-23 + 1e-30
    fine = np.float32 if slack.max(initial=0.0) < 1e30 and lengths.max(initial=0.0) < 1e18 and most < 1e18 else np.float64
    x4, m4 = x.astype(fine, copy=False), m.astype(fine, copy=False).T
    step = max(1, (1 << 18) // max(1, len(other)))  # what a core holds near
    for a in range(0, len(own), step):
        s = x4[a : a + step] @ m4
        near = slack[a : a + step]
        floor = threshold if low is None else np.maximum(low[a : a + step], threshold)
        good = s >= (floor - near - TIE)[:, None].astype(fine)
        if k is not None and s.shape[1] > k and np.count_nonzero(good) > 4 * k * len(s):
            if distinct:
                good &= own[a : a + step, None] != other[None, :]
            kth = np.partition(np.where(good, s, -np.inf), s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            good &= s >= (kth - 2 * near - TIE)[:, None].astype(fine)
        at = np.flatnonzero(good)
        if not len(at):
            continue
        i, j = np.divmod(at, s.shape[1])
        if 16 * len(at) > s.size:
            v = (x[a : a + step] @ m.T).reshape(-1)[at].astype(np.float64)
        else:
            v = np.concatenate([np.einsum("ij,ij->i", x[a + i[c : c + 16384]], m[j[c : c + 16384]]) for c in range(0, len(at), 16384)]).astype(np.float64)
        keep = v >= threshold if inclusive else v > threshold
        if distinct:
            keep &= own[a + i] != other[j]
        yield a + i[keep], other[j[keep]], np.round(v[keep], DIGITS)


def _words(codes: np.ndarray) -> np.ndarray:
    """Packed codes as rows of 64 bits each, one row for each word of a code; what fills the last one up is zero."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64).T)


def _code_pairs(own: np.ndarray, x: np.ndarray, other: np.ndarray, m: np.ndarray, threshold: float, inclusive: bool, k: int | None, distinct: bool, low: np.ndarray | None = None, last: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """As ``_pairs`` for packed codes, whose product is the number of bits less twice that of different ones.

    A tile of pairs is as large as a core's cache; in it bits are counted, and only pairs that count leave it."""
    bits = 8 * x.shape[1]
    most = (bits - min(max(threshold, -bits - 2), bits + 2)) / 2
    most = min(bits, math.floor(most) if inclusive else math.ceil(most) - 1)
    if most < 0 or not len(own) or not len(other):
        return
    kind = np.uint8 if bits < 256 else np.uint16 if bits < 65536 else np.uint32
    left, right = _words(x), _words(m)
    for b in range(0, len(other), CODE_COLUMNS):
        ids, here = other[b : b + CODE_COLUMNS], np.ascontiguousarray(right[:, b : b + CODE_COLUMNS])
        step = max(1, CODE_PAIRS // len(ids))
        shape = (min(step, len(own)), len(ids))
        words, count, apart, good = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape, kind), np.zeros(-(-shape[0] * shape[1] // 8) * 8, bool)
        for a in range(0, len(own), step):
            n = min(step, len(own) - a)
            w, c, d = words[:n], count[:n], apart[:n]
            g = good[: n * len(ids)].reshape(n, len(ids))
            good[n * len(ids) :] = False
            for i in range(len(left)):
                np.bitwise_xor(left[i, a : a + n, None], here[i], out=w)
                if i:
                    np.add(d, np.bitwise_count(w, out=c), out=d)
                else:
                    d[:] = np.bitwise_count(w, out=c)
            floor = np.full(n, most) if low is None else np.minimum((bits - np.maximum(low[a : a + n], -bits)) // 2, most)
            np.less_equal(d, floor.astype(kind)[:, None], out=g)
            at = np.flatnonzero(good.view(np.uint64))  # most hold nothing
            if not len(at):
                continue
            if k is not None and len(ids) > k + 1 and 2 * len(at) > (k + 1) * n:
                # one more than k, as a row may meet itself
                g &= d <= np.partition(d, k, axis=1)[:, k : k + 1]
                at = np.flatnonzero(good.view(np.uint64))
            at = (8 * at[:, None] + np.arange(8)).reshape(-1)
            i, j = np.divmod(at[good[at]], len(ids))
            far = d[i, j]
            keep = own[a + i] != ids[j] if distinct else np.ones(len(i), bool)
            if last is not None:  # a tie with the last of a row's k best
                keep &= (far < floor[i]) | (ids[j] < last[a + i])
            if keep.any():
                yield a + i[keep], ids[j[keep]], bits - 2.0 * far[keep]


class _Found:
    """Pairs of the rows of one side; with k the best of each of ``rows`` so far, in ``low`` what its k best reach and in
    ``last`` the id of the last of them."""

    def __init__(self, k: int | None, rows: int = 0):
        self.k, self.held, self.size, self.kept = k, [], 0, 1 << 16
        self.low = None if k is None else np.full(rows, -np.inf)
        self.last = None if k is None else np.full(rows, np.iinfo(np.int64).max)

    def put(self, row: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> None:
        self.held.append((row, dst, weight))
        self.size += len(row)
        if self.size > self.kept:
            best = self.best()
            self.held, self.size = [best[:3]], len(best[0])
            self.kept = max(self.kept, 3 * self.size)
            full = best[3] == self.k
            self.low[best[0][full]], self.last[best[0][full]] = best[2][full], best[1][full]

    def best(self) -> tuple[np.ndarray, ...]:
        return _best(*(np.concatenate(c) for c in zip(*self.held)), self.k)


PAIRS = "src long, dst long, weight double, nbr_rank int"


def _batch_of(src, dst, weight, rank=None) -> pa.RecordBatch:
    rank = np.zeros(len(src), np.int32) if rank is None else rank.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(weight), pa.array(rank)], names=["src", "dst", "weight", "nbr_rank"])


def _kernel(threshold: float, inclusive: bool, k: int | None, distinct: bool):
    """Pairs from rows (group, block, side, node_id, emb): side 0 of a group and block comes before side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, found = None, [], [], _Found(k)

        def done() -> Iterator[pa.RecordBatch]:
            if found.held:
                row, dst, weight, rank = found.best()
                yield _batch_of(ids[0][row], dst, weight, rank)

        for batch in batches:
            group, block, side, node = (np.asarray(batch.column(i)) for i in range(4))
            cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1]), [True]])) if len(batch) else []
            for a, b in zip(cut[:-1], cut[1:]):
                if (here := (int(group[a]), int(block[a]))) != key:
                    yield from done()
                    key, ids, vectors, found = here, [], [], _Found(k)
                m = rows_of(batch.column(4).slice(a, b - a))
                if side[a] == 0:
                    ids.append(node[a:b])
                    vectors.append(m)
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                if not found.held:
                    found = _Found(k, len(ids[0]))
                for row, dst, weight in _pairs(ids[0], vectors[0], node[a:b], m, threshold, inclusive, k, distinct, found.low, found.last):
                    if k is None:
                        yield _batch_of(ids[0][row], dst, weight)
                    else:
                        found.put(row, dst, weight)
        yield from done()

    return run


@dataclass
class Side:
    """The rows of a side that each task holds, by group."""

    ids: np.ndarray
    vectors: np.ndarray
    rows: dict[int, np.ndarray]

    @classmethod
    def of(cls, table: pa.Table) -> Side:
        group = np.asarray(table["group"])
        return cls(np.asarray(table["node_id"]), rows_of(table["emb"].combine_chunks()), {int(g): np.flatnonzero(group == g) for g in np.unique(group)})


def small(rows: DataFrame) -> pa.Table | None:
    """All rows, if they are few enough for each task to hold them; else none.

    Rows are counted on ids alone, and no further than the limit, before any vector is read."""
    if len(rows.select("node_id").take(HELD + 1)) > HELD:
        return None
    found = rows.toArrow()
    return found if found.nbytes <= HELD_BYTES else None


def _against(sent, of_left: bool, threshold: float, inclusive: bool, k: int | None, distinct: bool):
    """Pairs of rows (group, node_id, emb) with the side that each task holds, which is the left or the right one.

    With k and the left side held, what a task gives are the best among its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = sent.value
        found = _Found(k, len(side.ids) if of_left else 0)
        for batch in batches:
            group = np.asarray(batch.column(0))
            for g in np.unique(group).tolist():
                held, at = side.rows.get(g), np.flatnonzero(group == g)
                if held is None:
                    continue
                here = batch.take(pa.array(at)) if len(at) < len(batch) else batch
                ids, x = np.asarray(here.column(1)), rows_of(here.column(2))
                if of_left:
                    for row, dst, weight in _pairs(side.ids[held], side.vectors[held], ids, x, threshold, inclusive, k, distinct, *((None, None) if k is None else (found.low[held], found.last[held]))):
                        if k is None:
                            yield _batch_of(side.ids[held[row]], dst, weight)
                        else:
                            found.put(held[row], dst, weight)
                    continue
                for row, dst, weight in _pairs(ids, x, side.ids[held], side.vectors[held], threshold, inclusive, k, distinct):
                    if k is None:
                        yield _batch_of(ids[row], dst, weight)
                    else:
                        row, dst, weight, rank = _best(row, dst, weight, k)
                        yield _batch_of(ids[row], dst, weight, rank)
        if found.held:
            row, dst, weight, rank = found.best()
            yield _batch_of(side.ids[row], dst, weight, rank)

    return run


def _first(pairs: DataFrame, k: int) -> DataFrame:
    """Of the best of each task the best of all: k rows for each src and task are what is sent."""
    order = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    return pairs.withColumn("nbr_rank", F.row_number().over(order)).filter(F.col("nbr_rank") <= k)


def _nearest_cell(sent):
    """Adds to (node_id, emb) the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            cell = np.argmax(2 * (x @ pivots.T) - (pivots**2).sum(axis=1), axis=1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)).astype(np.float64)  # codes are float32
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["node_id", "emb", "cell", "far"])

    return run


def _reached_blocks(sent, threshold: float):
    """Adds to (node_id, emb) the blocks in which a row may have a partner.

    For x in a cell of pivot p and radius R, x y = p y + (x - p) y is at most p y + R |y|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, base, size = sent.value
        for batch in batches:
            y = matrix(batch.column(1))
            if not len(y):
                continue
            length = np.sqrt((y**2).sum(axis=1))[:, None]
            able = y @ pivots.T + radius[None, :] * length >= threshold - 1e-9 * (1 + length)
            able &= size > 0
            i, cell = np.nonzero(able)
            blocks = np.repeat(base[cell], size[cell]) + np.arange(size[cell].sum()) - np.repeat(np.cumsum(size[cell]) - size[cell], size[cell])
            count = np.bincount(i, size[cell], len(y)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(blocks.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["node_id", "emb", "blocks"])

    return run


def pivot_blocks(left: DataFrame, right: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    """(block, node_id, emb) of both sides of a join above a threshold, and the number of blocks.

    The left side is cut into cells around pivots of its own, a cell into blocks of about ``BLOCK`` rows. A right row
    goes to those cells alone whose radius lets a product reach the threshold."""
    spark, scratch, kind = left.sparkSession, Scratch(left.sparkSession, "cells"), left.schema["emb"].dataType.simpleString()
    n = left.count()
    pivots = matrix(left.orderBy(F.xxhash64("node_id"), "node_id").limit(min(PIVOTS, max(8, 2 * -(-n // BLOCK)))).select("emb").toArrow()["emb"].combine_chunks())
    sent = spark.sparkContext.broadcast(pivots)
    placed = scratch.write(left.select("node_id", "emb").mapInArrow(_nearest_cell(sent), f"node_id long, emb {kind}, cell int, far double"), "left")
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row for each pivot
        radius[r.cell], size[r.cell] = r.far, -(-r.n // BLOCK)
    base = np.cumsum(size) - size
    cells = pa.table({"cell": pa.array(np.arange(len(pivots)), pa.int32()), "base": pa.array(base, pa.int32()), "blocks": pa.array(np.maximum(size, 1), pa.int32())})
    own = placed.join(F.broadcast(spark.createDataFrame(cells)), "cell").select((F.col("base") + F.pmod(F.xxhash64("node_id"), F.col("blocks"))).cast("int").alias("block"), "node_id", "emb")
    reached = right.select("node_id", "emb").mapInArrow(_reached_blocks(spark.sparkContext.broadcast((pivots, radius, base, size)), threshold), f"node_id long, emb {kind}, blocks array<int>")
    return own, reached.select(F.explode("blocks").alias("block"), "node_id", "emb"), int(size.sum())


def _packed(side: int, blocks: int):
    """Rows (node_id, emb) as (block, side, ids, vectors), some thousand rows in one; blocks go by a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(blocks)]
        size, total = np.zeros(blocks, np.int64), 0

        def blob(which) -> pa.RecordBatch:
            rows = [(b, side, b"".join(i for i, _ in held[b]), b"".join(v for _, v in held[b])) for b in which]
            for b in which:
                held[b], size[b] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "side", "ids", "vectors"])

        for batch in batches:
            if not len(batch):
                continue
            node = np.asarray(batch.column(0))
            raw = rows_of(batch.column(1))
            to = ((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % blocks
            by = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[by], np.arange(blocks + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                part = by[cut[b] : cut[b + 1]]
                held[b].append((node[part].tobytes(), raw[part].tobytes()))
                size[b] += raw[part].nbytes
                total += raw[part].nbytes
            if len(full := np.flatnonzero(size >= BLOB_BYTES).tolist()) or total > 64 << 20:
                full = full if total <= 64 << 20 else np.flatnonzero(size).tolist()
                total -= int(size[full].sum())
                yield blob(full)
        if len(rest := np.flatnonzero(size).tolist()):
            yield blob(rest)

    return run


def _grid_kernel(codes: bool, threshold: float, inclusive: bool, k: int | None, distinct: bool):
    """Pairs of one block of the left side with one of the right: rows (part, side, ids, vectors), the left ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, vectors, found = None, [], [], _Found(k)

        def done() -> Iterator[pa.RecordBatch]:
            if found.held:
                row, dst, weight, rank = found.best()
                yield _batch_of(ids[0][row], dst, weight, rank)

        for batch in batches:
            for n in range(len(batch)):
                here, side, raw, packed = (batch.column(c)[n] for c in range(4))
                if here.as_py() != part:
                    yield from done()
                    part, ids, vectors, found = here.as_py(), [], [], _Found(k)
                node = np.frombuffer(raw.as_buffer(), np.int64)
                m = np.frombuffer(packed.as_buffer(), np.uint8 if codes else np.float64).reshape(len(node), -1)
                if side.as_py() == 0:
                    ids.append(node)
                    vectors.append(m)
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                if not found.held:
                    found = _Found(k, len(ids[0]))
                for row, dst, weight in _pairs(ids[0], vectors[0], node, m, threshold, inclusive, k, distinct, found.low, found.last):
                    if k is None:
                        yield _batch_of(ids[0][row], dst, weight)
                    else:
                        found.put(row, dst, weight)
        yield from done()

    return run


def _grid_join(left: DataFrame, right: DataFrame, threshold: float, inclusive: bool, k: int | None, distinct: bool) -> DataFrame:
    """All pairs of two large sides, block by block: a task has one block of each side.

    With k the left side alone is cut, two blocks a core or as many as tasks can hold, so that a row's best are found in
    one task. Without, both sides are cut, so that few copies of them are sent."""
    codes = left.schema["emb"].dataType.simpleString() == "binary"
    first = left.select("emb").head()
    size = max(1, len(first.emb) * (8 if codes else 1))
    rows = left.count()
    high, tasks = max(1, -(-rows // max(BLOCK, BLOCK_BYTES // (8 * size)))), 2 * left.sparkSession.sparkContext.defaultParallelism
    if k is not None:
        high, wide = max(high, tasks), 1
    else:
        high = max(high, math.isqrt(tasks))
        wide = max(1, -(-tasks // high))
    shape = "block int, side int, ids binary, vectors binary"
    own = left.select("node_id", "emb").mapInArrow(_packed(0, high), shape)
    others = right.select("node_id", "emb").mapInArrow(_packed(1, wide), shape)
    own = own.withColumn("part", F.explode(F.sequence(F.col("block") * wide, F.col("block") * wide + wide - 1)))
    others = others.withColumn("part", F.explode(F.sequence(F.col("block"), F.col("block") + (high - 1) * wide, F.lit(wide))))
    both = own.union(others).select(F.col("part").cast("int").alias("part"), "side", "ids", "vectors")
    placed = both.repartitionById(high * wide, F.col("part")).sortWithinPartitions("part", "side")
    found = placed.mapInArrow(_grid_kernel(codes, threshold, inclusive, k, distinct), PAIRS)
    return found.drop("nbr_rank") if k is None else found


def cells_help(left: DataFrame, threshold: float) -> bool:
    """Whether cells around pivots leave most pairs out, by a sample of the left side; the result is the same either way."""
    if not np.isfinite(threshold) or left.schema["emb"].dataType.simpleString() == "binary":
        return False
    sample = matrix(left.orderBy(F.xxhash64("node_id"), "node_id").limit(4096).select("emb").toArrow()["emb"].combine_chunks())
    pivots, sample = sample[:64], sample[64:]
    if not len(sample):
        return False
    cell = np.argmax(2 * (sample @ pivots.T) - (pivots**2).sum(axis=1), axis=1)
    radius = np.zeros(len(pivots))
    np.maximum.at(radius, cell, np.sqrt(((sample - pivots[cell]) ** 2).sum(axis=1)))
    reached = sample @ pivots.T + radius[None, :] * np.sqrt((sample**2).sum(axis=1))[:, None] >= threshold
    return bool(reached.mean() < CELLS_SHARE)


def similarity_join(left: DataFrame, right: DataFrame, threshold: float, inclusive: bool, k: int | None = None, distinct: bool = True, group: str | None = None) -> DataFrame:
    """(src, dst, weight) of pairs of ids whose inner product reaches the threshold; per src the k best, with nbr_rank.

    left, right: (node_id, emb), where emb may be a binary code whose bits count as 1 and -1; and a column to join on if ``group`` names one. A side of at most ``HELD`` rows is held
    by each task while the other side is scanned where it is; with k, each task of a scanned right side gives its k
    best, which are merged. Two larger sides are cut into blocks: a task holds a block of the left side and takes the
    right side's rows in batches, each one matrix product, so that neither side is ever in one place and the square of
    pairs is never a table. Without groups, and where a sample tells that it leaves out most pairs, the blocks are cells
    around pivots, and a right row is sent only where the threshold can be reached; else both sides are cut into a grid
    of large blocks. In a group a right row is sent to each block of the group. ``distinct`` leaves out pairs of equal ids.
    """
    spark = left.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = "binary" if left.schema["emb"].dataType.simpleString() == "binary" else "array<double>"
    key = F.lit(0).cast("long") if group is None else F.col(group).cast("long")
    own, others = (df.select(key.alias("group"), F.col("node_id").cast("long").alias("node_id"), F.col("emb").cast(kind).alias("emb")) for df in (left, right))
    for rows, scanned, of_left in ((own, others, True), (others, own, False)):
        if (of_left and left is right) or (held := small(rows)) is None:
            continue
        if not held.num_rows:
            found = spark.createDataFrame([], PAIRS)
            return found if k is not None else found.drop("nbr_rank")
        if left is right:  # as few rows
            scanned = scanned.repartition(tasks, "node_id")
        found = scanned.mapInArrow(_against(spark.sparkContext.broadcast(Side.of(held)), of_left, threshold, inclusive, k, distinct), PAIRS)
        return found.drop("nbr_rank") if k is None else _first(found, k) if of_left else found
    if group is None and not cells_help(own, threshold):
        return _grid_join(own, others, threshold, inclusive, k, distinct)
    if group is None:
        own, others, blocks = pivot_blocks(own, others, threshold)
        own, others, tasks = own.withColumn("group", F.lit(0).cast("long")), others.withColumn("group", F.lit(0).cast("long")), max(tasks, blocks)
    else:
        sizes = own.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        own, others = own.join(sizes, "group"), others.join(sizes, "group")
        own = own.withColumn("block", F.pmod(F.xxhash64("node_id"), F.col("blocks")).cast("int"))
        others = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = own.select("group", "block", F.lit(0).alias("side"), "node_id", "emb").union(others.select("group", "block", F.lit(1).alias("side"), "node_id", "emb"))
    both = both.withColumn("part", F.pmod(F.col("block") + F.when(F.col("group") == 0, 0).otherwise(F.xxhash64("group")), tasks).cast("int"))
    placed = both.repartitionById(tasks, F.col("part")).drop("part").sortWithinPartitions("group", "block", "side")
    found = placed.mapInArrow(_kernel(threshold, inclusive, k, distinct), PAIRS)
    return found if k is not None else found.drop("nbr_rank")


def _weighed(columns: int, threshold: float):
    """Rows (node_id, sums) of pairs of blobs (ids, vectors, other, values), whose values follow the vectors of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, x, total = None, None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own), *[pa.array(total[:, i]) for i in range(columns)]], names=["node_id", *[f"v{i}" for i in range(columns)]])

        for batch in batches:
            for n in range(len(batch)):
                ids, vectors, others, values = (batch.column(c)[n] for c in range(4))
                if (here := ids.as_py()) != key:
                    if key is not None:
                        yield done()
                    key, own = here, np.frombuffer(here, np.int64)
                    x = np.frombuffer(vectors.as_py(), np.float64).reshape(len(own), -1)
                    total = np.zeros((len(own), columns))
                other = np.frombuffer(others.as_buffer(), np.int64)
                m = np.frombuffer(values.as_buffer(), np.float64).reshape(len(other), -1)
                y, v = np.ascontiguousarray(m[:, :-columns].T), np.ascontiguousarray(m[:, -columns:])
                both = np.isin(own, other)
                step = max(1, (1 << 18) // len(other))  # what a core holds near
                for a in range(0, len(own), step):
                    s = x[a : a + step] @ y
                    s[s < threshold] = 0
                    for i in np.flatnonzero(both[a : a + step]):
                        s[i, other == own[a + i]] = 0
                    total[a : a + step] += s @ v
        if key is not None:
            yield done()

    return run


class Similarities:
    """The products of pairs of different ids of (node_id, emb) that reach a threshold above zero, all of them.

    They are quadratic in the nodes and never a table: ``times`` takes them tile by tile, ``pairs`` gives their rows.
    Nodes are packed in blobs, and each blob meets each in some task, read where it was written and without a shuffle."""

    def __init__(self, nodes: DataFrame, threshold: float = 1e-9):
        self.threshold, self.scratch, self.products = threshold, Scratch(nodes.sparkSession, "similarities"), 0
        self.degree = None
        rows = nodes.select(F.col("node_id").cast("long").alias("node_id"), F.col("emb").cast("array<double>").alias("emb"))
        self.nodes = self.scratch.write(rows.repartition(2 * nodes.sparkSession.sparkContext.defaultParallelism, "node_id"), "nodes")
        self.blobs = self.scratch.write(self._blobs(self.nodes, "ids", "vectors"), "blobs")

    @staticmethod
    def _blobs(rows: DataFrame, ids: str, vectors: str) -> DataFrame:
        packed = rows.select("node_id", "emb").mapInArrow(_packed(0, 1), "block int, side int, ids binary, vectors binary")
        return packed.select(F.col("ids").alias(ids), F.col("vectors").alias(vectors))

    def pairs(self) -> DataFrame:
        return similarity_join(self.nodes, self.nodes, self.threshold, inclusive=True).select("src", "dst", "weight")

    def collect(self) -> list:
        """The rows of ``pairs``, for a few nodes."""
        return self.pairs().collect()

    def times(self, rows: DataFrame, columns: int) -> DataFrame:
        """For each node the sums of the values v0, v1, ... of (node_id, v0, v1, ...) over all others, times their products;
        to be written before the next call."""
        names = [f"v{i}" for i in range(columns)]
        self.products += 1
        valued = self.nodes.join(rows.select("node_id", *names), "node_id").select("node_id", F.concat("emb", F.array(*names)).alias("emb"))
        others = self.scratch.write(self._blobs(valued, "other", "values"), f"values-{self.products}")
        self.scratch.drop(f"values-{self.products - 1}")
        parts = self.blobs.hint("shuffle_replicate_nl").crossJoin(others).mapInArrow(_weighed(columns, self.threshold), ", ".join(["node_id long", *[f"{n} double" for n in names]]))
        return parts.groupBy("node_id").agg(*[F.sum(n).alias(n) for n in names])

    def degrees(self) -> DataFrame:
        """(node_id, degree): the sum of a node's similarities, of nodes that have any."""
        if self.degree is None:
            ones = self.times(self.nodes.select("node_id", F.lit(1.0).alias("v0")), 1)
            self.degree = self.scratch.write(ones.filter("v0 > 0").select("node_id", F.col("v0").alias("degree")), "degrees")
        return self.degree


def hashing_embedder(size: int = 384):
    """An Arrow UDF that stands in for a text model: signed token hashes, at unit length; null for no tokens."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hashlib

        for batch in texts:
            out = []
            for t in batch:
                v = np.zeros(size)
                for token in (t or "").lower().split():
                    h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                    v[h % size] += 1.0 if h >> 63 else -1.0
                length = np.linalg.norm(v)
                out.append((v / length).astype(np.float32) if length else None)
            yield pd.Series(out)

    return embed
