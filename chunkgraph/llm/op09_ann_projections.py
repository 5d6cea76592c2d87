"""Approximate nearest neighbours by low-dimensional stable projections.

Largest inner products become nearest points: with M the greatest length, x gains the component sqrt(M^2 - |x|^2)
and a query is scaled to length M. Points are projected on ``DIMENSIONS`` Gaussian directions, and each shard keeps
a kd-tree over its projections. A query visits leaves by their distance in the projected space and verifies their
points on the original vectors. A projected squared distance over the true one follows a chi-square distribution,
so a search stops once the nearest unvisited leaf lies beyond the ``QUANTILE`` of that distribution times the
distance of the k-th neighbour so far: a true neighbour beyond it is that unlikely.

The index is built once and written to the shared folder: shards of about ``SHARD`` vectors are boxes of projected
space, cut at the medians of a bounded sample (``SAMPLE`` vectors, by hash); every vector is indexed. A query first
searches the shard that it lies in, which gives a first k-th neighbour. Then it goes to the other shards whose boxes
the same chi-square test doesn't exclude, takes that neighbour's distance along, and brings back only what is nearer.

Skew: a box with many vectors, such as equal ones, is dealt by id to several shards; queries whose nearest boxes are
equal are dealt among them. Queries reach a shard in packed blocks, one block in memory at a time.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
another length than a query's are no candidates; rows with a null id take no part; rows that share an id count
once, with the least vector; ties go to the smaller id; fewer than k candidates give all; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blobs
from .storage import Scratch, partitions
from .textops import mix

K = 20
EVERY = 20  # queries are the rows whose id this divides
DIMENSIONS, QUANTILE, SEED = 12, 0.97, 11
SHARD, BLOCK, LEAF = 16_384, 2048, 128
SAMPLE = 16_384


def chi_square_quantile(p: float, m: int) -> float:
    """The quantile of a chi-square distribution of an even number m of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))
        low, high = (x, high) if below < p else (low, x)
    return high


def directions(size: int) -> np.ndarray:
    """Gaussian directions for vectors of a size, the same everywhere."""
    return np.random.default_rng([SEED, size]).standard_normal((size + 1, DIMENSIONS))


class Tree:
    """A kd-tree over projections: points in leaf order, and the box of each leaf."""

    def __init__(self, points: np.ndarray):
        order, bounds, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                bounds.append((a, b))
                continue
            part = points[order[a:b]]
            axis = int((part.max(0) - part.min(0)).argmax())
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        bounds.sort()
        self.order = order
        self.begin = np.array([a for a, _ in bounds], np.int64)
        self.size = np.array([b - a for a, b in bounds], np.int64)
        self.points = points[order]
        self.low = np.minimum.reduceat(self.points, self.begin)
        self.high = np.maximum.reduceat(self.points, self.begin)

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of queries from the boxes of all leaves."""
        out = np.zeros((len(q), len(self.begin)))
        for d in range(q.shape[1]):
            x = q[:, d, None]
            out += np.maximum(np.maximum(self.low[:, d] - x, x - self.high[:, d]), 0) ** 2
        return out


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k greatest scores, ties to smaller ids."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


class Index:
    """A shard's vectors of one size."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float):
        self.most = most
        self.directions = directions(vectors.shape[1])
        self.tree = Tree(projected(vectors, most))
        self.ids, self.vectors = ids[self.tree.order], vectors[self.tree.order]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, ids, scores) of the k best here, of those at least as good as the score ``known`` of each;
        ``self.verified`` counts inner products."""
        stretch = chi_square_quantile(QUANTILE, DIMENSIONS)
        length = np.sqrt((queries**2).sum(1))
        points = project_queries(queries, self.most)
        leaf = self.tree.leaf_distances(points)
        order = np.argsort(leaf, axis=1)
        self.verified = 0
        slack = 1e-9 * self.most**2
        for q in range(len(queries)):
            found = np.zeros(0, np.int64)
            score = np.zeros(0)
            least = -np.inf if known is None else known[q]
            reach = lambda s: stretch * max(0.0, 2 * self.most**2 - 2 * s * self.most / length[q]) + slack  # noqa: E731, B023
            radius, at, step = (reach(least) if np.isfinite(least) else np.inf), 0, 4
            near, by = leaf[q], order[q]
            while at < len(by) and near[by[at]] <= radius:
                some = by[at : at + step]
                some = some[near[some] <= radius]
                at += step
                step *= 2
                rows = np.concatenate([np.arange(self.tree.begin[x], self.tree.begin[x] + self.tree.size[x]) for x in some.tolist()])
                if np.isfinite(radius):
                    rows = rows[((self.tree.points[rows] - points[q]) ** 2).sum(1) <= radius]
                rows = rows[self.ids[rows] != query_ids[q]]
                self.verified += len(rows)
                new = self.vectors[rows] @ queries[q]
                good = new >= least
                found, score = np.concatenate([found, rows[good]]), np.concatenate([score, new[good]])
                best = top(self.ids[found], score, k)
                found, score = found[best], score[best]
                if len(found) == k:
                    radius = reach(score[-1])
            if len(found):
                yield q, self.ids[found], score


def projected(vectors: np.ndarray, most: float) -> np.ndarray:
    """Projections of vectors, lifted to the length ``most``."""
    lift = np.sqrt(np.maximum(most**2 - (vectors**2).sum(1), 0))
    return np.concatenate([vectors, lift[:, None]], 1) @ directions(vectors.shape[1])


def project_queries(queries: np.ndarray, most: float) -> np.ndarray:
    """Projections of queries, scaled to the length ``most``."""
    return (queries * (most / np.sqrt((queries**2).sum(1)))[:, None]) @ directions(queries.shape[1])[:-1]


@dataclass
class Cuts:
    """A binary tree over projected space: (axis, place) of each inner node in the order of a heap."""

    depth: int
    axis: np.ndarray
    place: np.ndarray

    def box(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.place[node])
        return node - ((1 << self.depth) - 1)


def cut_space(points: np.ndarray, boxes: int) -> Cuts:
    """Cuts a sample's widest axes at their medians until there are about as many boxes as asked for."""
    depth = max(0, int(boxes - 1).bit_length()) if len(points) else 0
    axis, place = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    parts = {0: np.arange(len(points))}
    for node in range(len(axis)):
        rows = parts.pop(node)
        if len(rows):
            own = points[rows]
            axis[node] = int((own.max(0) - own.min(0)).argmax())
            place[node] = float(np.median(own[:, axis[node]]))
        right = points[rows, axis[node]] > place[node]
        parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]
    return Cuts(depth, axis, place)


def _sized(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows of each vector size."""
    ids, vectors = np.asarray(batch.column(0)), batch.column(1)
    sizes = np.diff(np.asarray(vectors.offsets))
    for size in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == size)
        yield ids[some], np.asarray(vectors.take(pa.array(some)).flatten(), np.float64).reshape(-1, size)


PLACED = "vec_id long, embedding array<double>, size int, box long"


def _placer(cuts, most: float):
    """Adds a vector's size and its box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _sized(batch):
                size = x.shape[1]
                box = cuts.value[size].box(projected(x, most))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists, pa.array(np.full(len(ids), size, np.int32)), pa.array(box)], names=["vec_id", "embedding", "size", "box"])

    return run


INDEX = "shard int, size int, low array<double>, high array<double>, rows binary"


def _builder(most: float):
    """One row for each shard, whose vectors come together: its box as it is, ids and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            shard = np.asarray(batch.column(2))
            for s in np.unique(shard).tolist():
                part = batch.filter(pa.array(shard == s))
                held.setdefault(s, []).extend(_sized(part))
        for s in sorted(held):
            ids, x = (np.concatenate(c) for c in zip(*held.pop(s)))
            by = np.argsort(ids)
            ids, x = ids[by], x[by]
            p = projected(x, most)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()]), pa.array([blobs.pack(ids, x.reshape(-1))], pa.binary())], names=[c.split()[0] for c in INDEX.split(", ")])

    return run


@dataclass
class Shards:
    """The boxes of all shards, a row of ``2 * DIMENSIONS`` numbers each, by vector size."""

    number: dict[int, np.ndarray]
    low: dict[int, np.ndarray]
    high: dict[int, np.ndarray]
    most: float

    def distances(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the shards, squared distances of queries from their boxes)."""
        size = queries.shape[1]
        if size not in self.number:
            return np.zeros(0, np.int64), np.zeros((len(queries), 0))
        p = project_queries(queries, self.most)
        out = np.zeros((len(queries), len(self.number[size])))
        for d in range(DIMENSIONS):
            out += np.maximum(np.maximum(self.low[size][:, d] - p[:, d, None], p[:, d, None] - self.high[size][:, d]), 0) ** 2
        return self.number[size], out

    def home(self, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The shard whose box is nearest, dealt by id among equally near ones; -1 if there is none."""
        number, far = self.distances(queries)
        if not len(number):
            return np.full(len(ids), -1)
        near = far <= far.min(1, keepdims=True)
        pick = (mix(ids.view(np.uint64)) % near.sum(1).astype(np.uint64)).astype(np.int64)
        return number[(near.cumsum(1) > pick[:, None]).argmax(1)]


FLOW = "shard int, size int, rows binary, queries binary"


def _sent(shard: np.ndarray, ids: np.ndarray, x: np.ndarray, known: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of queries for each shard."""
    for s, (i, v, k, h) in blobs.split(shard.astype(np.int32), ids, x, known, home):
        for a in range(0, len(i), BLOCK):
            own = slice(a, a + BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.nulls(1, pa.binary()), pa.array([blobs.pack(i[own], v[own].reshape(-1), k[own], h[own])], pa.binary())], names=[c.split()[0] for c in FLOW.split(", ")])


def _asker(shards):
    """Sends each query to the shard that it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _sized(batch):
                home = shards.value.home(ids, x)
                some = home >= 0
                yield from _sent(home[some], ids[some], x[some], np.full(int(some.sum()), -np.inf), home[some])

    return run


def _farther(shards, k: int):
    """Sends each query, with its k-th score so far, to the other shards that may hold a better one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = chi_square_quantile(QUANTILE, DIMENSIONS)
        for batch in batches:
            home_of, count, kth = (np.asarray(batch.column(i)) for i in (2, 3, 4))
            ids_of = np.asarray(batch.column(0))
            by = {i: j for j, i in enumerate(ids_of.tolist())}
            for ids, x in _sized(batch):
                j = np.array([by[i] for i in ids.tolist()], np.int64)
                known = np.where(count[j] >= k, kth[j], -np.inf)
                number, far = shards.value.distances(x)
                most = shards.value.most
                radius = stretch * np.maximum(0, 2 * most**2 - 2 * known * most / np.sqrt((x**2).sum(1))) + 1e-9 * most**2
                q, s = np.nonzero((far <= radius[:, None]) & (number[None, :] != home_of[j][:, None]))
                yield from _sent(number[s], ids[q], x[q], known[q], home_of[j][q])

    return run


RESULT = "query_id long, vec_id long, score double"


def _searcher(most: float, k: int):
    """Answers of the shards, each of whose rows comes before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shard = None
        for batch in batches:
            for s, size, rows, asked in zip(*(c.to_pylist() for c in batch.columns)):
                if rows is not None:
                    ids, x = blobs.unpack(rows)
                    index, shard = Index(ids, x.reshape(-1, size), most), s
                    continue
                if s != shard:
                    raise ValueError("queries came without their shard")
                ids, x, known, _ = blobs.unpack(asked)
                out = [(np.full(len(found), ids[q]), found, score) for q, found, score in index.search(ids, x.reshape(-1, size), k, known)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as floats or doubles) of the vectors that take part; of those that share an id the least."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & F.exists("embedding", lambda x: x != 0))
    again = rows.groupBy("vec_id").agg(F.count("*").alias("k")).filter("k > 1").select("vec_id")
    if again.isEmpty():
        return rows
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.join(again, "vec_id", "left_anti").unionByName(least)


def build(rows: DataFrame, scratch: Scratch, count: int, most: float) -> tuple[DataFrame, Shards]:
    """The written index, and the boxes of its shards (one row for each, of a fixed size)."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    by_size: dict[int, np.ndarray] = {}
    sizes = np.diff(np.asarray(sample.offsets))
    present = [r.n for r in rows.select(F.size("embedding").alias("n")).distinct().collect()]
    for size in present:
        some = np.flatnonzero(sizes == size)
        x = np.asarray(sample.take(pa.array(some)).flatten(), np.float64).reshape(-1, size)
        share = max(1, round(count / SHARD * len(some) / max(1, len(sizes))))
        by_size[size] = cut_space(projected(x, most) if len(some) else np.zeros((0, DIMENSIONS)), share)
    placed = scratch.write(rows.mapInArrow(_placer(spark.sparkContext.broadcast(by_size), most), PLACED), "placed")
    found = placed.groupBy("size", "box").agg(F.count("*").alias("n")).orderBy("size", "box").collect()  # one row for each box
    numbers, base = [], 0
    for r in found:
        ways = -(-r.n // SHARD)
        numbers.append((r["size"], r.box, base, ways))
        base += ways
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*numbers), (pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names=["size", "box", "base", "ways"])
    dealt = placed.join(F.broadcast(spark.createDataFrame(table)), ["size", "box"]).select("vec_id", "embedding", (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("ways"))).cast("int").alias("shard"))
    index = scratch.write(dealt.repartitionById(max(1, base), F.col("shard")).mapInArrow(_builder(most), INDEX), "index")
    scratch.drop("placed")
    boxes = index.select("shard", "size", "low", "high").orderBy("shard").collect()
    own = lambda size, f: np.array([f(r) for r in boxes if r["size"] == size])
    known = sorted({r["size"] for r in boxes})
    return index, Shards({s: own(s, lambda r: r.shard) for s in known}, {s: own(s, lambda r: r.low) for s in known}, {s: own(s, lambda r: r.high) for s in known}, most)


def neighbours(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = scratch.write(usable(embeddings), "vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, most = rows.agg(F.count("*"), F.max(F.sqrt(square))).first()
    if not count:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).filter("false")
    index, shards = build(rows, scratch, count, float(most))
    sent, n = spark.sparkContext.broadcast(shards), sum(len(x) for x in shards.number.values())
    queries = rows.filter(F.col("vec_id") % every == 0)

    def answers(asked: DataFrame, label: str) -> DataFrame:
        both = index.select("shard", "size", "rows", F.lit(None).cast("binary").alias("queries")).union(asked)
        held = both.join(F.broadcast(asked.select("shard").distinct()), "shard", "left_semi") if n <= 1 << 16 else both
        together = held.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("rows").isNull())
        return scratch.write(together.mapInArrow(_searcher(float(most), k), RESULT), label)

    asked = scratch.write(queries.mapInArrow(_asker(sent), FLOW), "asked")
    first = answers(asked, "first")
    so_far = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    homes = asked.mapInArrow(_homes, "query_id long, home int")
    going = queries.withColumnRenamed("vec_id", "query_id").join(homes, "query_id").join(so_far, "query_id", "left")
    going = going.select("query_id", "embedding", "home", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kth", F.lit(0.0)).alias("kth"))
    more = answers(scratch.write(going.repartition(partitions(spark), "query_id").mapInArrow(_farther(sent, k), FLOW), "farther"), "more")
    scratch.drop("asked", "farther", "index")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return first.union(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, the shard that it was first sent to)."""
    for batch in batches:
        for raw in batch.column(3).to_pylist():
            ids, _, _, home = blobs.unpack(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(home.astype(np.int32))], names=["query_id", "home"])
