"""Similarity graphs: one builder for each strategy, from (node_id, emb) to (src, dst, weight, nbr_rank, method)."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.vectors import Similarities, dot, matrix, normalise, similarity_join
from ..scratch import Scratch


def ranked(edges: DataFrame, method: str, by_weight: bool = True) -> DataFrame:
    """Adds nbr_rank, the order in which a path search follows a node's edges, and the method's name."""
    order = [F.col("weight").desc(), F.col("dst")] if by_weight else [F.col("dst")]
    rank = F.row_number().over(Window.partitionBy("src").orderBy(*order))
    return edges.select("src", "dst", "weight", rank.alias("nbr_rank"), F.lit(method).alias("method"))


def brute_force(nodes: DataFrame, c: EngineConfig) -> DataFrame:
    """Both directions of every pair above the threshold."""
    return ranked(similarity_join(nodes, nodes, c.sim_threshold, inclusive=False), "brute_force", by_weight=False)


def knn(nodes: DataFrame, c: EngineConfig) -> DataFrame:
    """The k nearest of each node at or above the threshold, from the node to them."""
    found = similarity_join(nodes, nodes, c.sim_threshold, inclusive=True, k=c.k)
    return found.select("src", "dst", "weight", "nbr_rank", F.lit("knn").alias("method"))


def intra_cluster(clustered: DataFrame, c: EngineConfig, small: int | None = None, k: int | None = None, method: str = "intra") -> DataFrame:
    """Edges within clusters of (node_id, emb, cluster).

    A cluster of at most ``small`` members links every pair above the threshold from the lower id; a larger one links
    each member to its k nearest above it. Large clusters go in blocks, so no task compares a whole one with itself."""
    small = max(c.k, 20) if small is None else small
    k = c.intra_k if k is None else k
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("members"))
    rows = clustered.join(sizes, "cluster").select("cluster", "members", "node_id", "emb")
    few, many = rows.filter(F.col("members") <= small), rows.filter(F.col("members") > small)
    pairs = similarity_join(few, few, c.sim_threshold, inclusive=False, group="cluster").filter("src < dst")
    near = similarity_join(many, many, c.sim_threshold, inclusive=False, k=k, group="cluster").select("src", "dst", "weight")
    return ranked(pairs.unionByName(near), method)


def inter_cluster(clustered: DataFrame, c: EngineConfig) -> DataFrame:
    """Edges between the first members of a cluster and those of its nearest clusters.

    Centroids are one row for each cluster (n_clusters at most), so their pairs are few."""
    parts = clustered.select("cluster", F.posexplode("emb").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("v"))
    centroid = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centroid"))
    a, b = centroid.toDF("ca", "va"), centroid.toDF("cb", "vb")
    near = a.join(b, F.col("ca") != F.col("cb")).select("ca", "cb", dot(F.col("va"), F.col("vb")).alias("s"))
    best = Window.partitionBy("ca").orderBy(F.col("s").desc(), "cb")
    near = near.withColumn("r", F.row_number().over(best)).filter((F.col("r") <= c.inter_k) & (F.col("s") >= c.inter_centroid))
    first = Window.partitionBy("cluster").orderBy("node_id")
    heads = clustered.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= c.inter_members)
    x = heads.select(F.col("cluster").alias("ca"), F.col("node_id").alias("src"), F.col("emb").alias("x"))
    y = heads.select(F.col("cluster").alias("cb"), F.col("node_id").alias("dst"), F.col("emb").alias("y"))
    scored = near.select("ca", "cb").join(x, "ca").join(y, "cb").select("src", "dst", dot(F.col("x"), F.col("y")).alias("weight"))
    return ranked(scored.filter(F.col("weight") > c.inter_chunk), "inter")


def clusters(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """(node_id, emb, cluster) by k-means; k is at most the number of nodes."""
    n = nodes.count()
    if n < 2 or min(k, n) < 2:
        return nodes.select("node_id", "emb", F.lit(0).alias("cluster"))
    rows = nodes.select("node_id", "emb", array_to_vector("emb").alias("features"))
    model = KMeans(k=min(k, n), seed=seed, maxIter=20).fit(rows)
    return model.transform(rows).select("node_id", "emb", F.col("prediction").alias("cluster"))


def hierarchical(nodes: DataFrame, c: EngineConfig, clustered: DataFrame | None = None) -> DataFrame:
    """Edges within and between the clusters."""
    clustered = clusters(nodes, c.n_clusters, c.seed) if clustered is None else clustered
    both = intra_cluster(clustered, c).unionByName(inter_cluster(clustered, c))
    return ranked(both.select("src", "dst", "weight").dropDuplicates(["src", "dst"]), "hierarchical")


def multi_level(nodes: DataFrame, c: EngineConfig, clustered: DataFrame | None = None) -> DataFrame:
    """Coarse clusters; all pairs of those with at most 50 members, else k nearest; brute force for few nodes."""
    if clustered is None:
        n = nodes.count()
        coarse = min(c.n_clusters, n // 100, n)
        if coarse < 2:
            return brute_force(nodes, c).withColumn("method", F.lit("multi_level"))
        clustered = clusters(nodes, coarse, c.seed)
    return intra_cluster(clustered, c, small=50, k=c.k, method="multi_level")


def approximate(nodes: DataFrame, c: EngineConfig) -> DataFrame:
    """The k best of a sample of other nodes, above the threshold.

    Node number i samples the m numbers that follow a start spread by multiplication, so the same sample comes
    again, none comes twice, and the join is on the number alone."""
    n = nodes.count()
    m = min(int(n * c.sample_ratio), 3 * c.k, n - 1)
    if m < 1:
        return ranked(nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("weight")).filter("false"), "approximate")
    numbered = numbers(nodes)
    offset = (F.col("i") * 7919 + F.col("j")) % (n - 1) + 1
    asked = numbered.select(F.col("node_id").alias("src"), F.col("emb").alias("x"), "i", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    asked = asked.select("src", "x", ((F.col("i") + offset) % n).alias("i"))
    pairs = asked.join(numbered.select(F.col("node_id").alias("dst"), F.col("emb").alias("y"), "i"), "i")
    scored = pairs.select("src", "dst", dot(F.col("x"), F.col("y")).alias("weight"))
    best = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    kept = scored.withColumn("r", F.row_number().over(best)).filter((F.col("r") <= c.k) & (F.col("weight") > c.sim_threshold))
    return ranked(kept.select("src", "dst", "weight"), "approximate")


def numbers(nodes: DataFrame) -> DataFrame:
    """Adds i, the rank of node_id from 0, without gathering the nodes in one partition.

    Ranges of ids are written to the shared folder, and get the number of nodes before them from one count each."""
    scratch = Scratch(nodes.sparkSession, "numbers")
    spread = scratch.write(nodes.repartitionByRange("node_id").sortWithinPartitions("node_id").withColumn("part_", F.spark_partition_id()), "ranges")
    counts = sorted((r.part_, r["count"]) for r in spread.groupBy("part_").count().collect())  # one row for each partition
    bases = pa.table({"part_": pa.array([p for p, _ in counts], pa.int32()), "base_": pa.array(np.cumsum([0, *(k for _, k in counts)])[: len(counts)], pa.int64())})
    inside = F.row_number().over(Window.partitionBy("part_").orderBy("node_id")) - 1
    numbered = spread.withColumn("inside_", inside).join(F.broadcast(nodes.sparkSession.createDataFrame(bases)), "part_")
    return numbered.withColumn("i", F.col("base_") + F.col("inside_")).drop("part_", "base_", "inside_")


#: The modulus and the steps by which plane signs are drawn; SQL can draw the same ones.
PRIME, STEP_I, STEP_J, STEP_SEED = 2147483647, 7919, 104729, 15485863


def plane_signs(size: int, planes: int, seed: int) -> np.ndarray:
    """For each component and hyperplane 1 or -1, drawn by squaring twice modulo a prime; the same everywhere."""
    x = ((np.arange(1, size + 1)[:, None] * STEP_I) + np.arange(1, planes + 1)[None, :] * STEP_J + seed * STEP_SEED) % PRIME
    for _ in range(3):
        x = (x * x + 12345) % PRIME
    return np.where((x >> 16) % 2 == 1, 1.0, -1.0)


def hyperplane_codes(nodes: DataFrame, planes: int, seed: int) -> DataFrame:
    """(node_id, emb): a bit for each of the seeded hyperplanes, the side on which a vector lies."""
    if planes < 8 or planes % 8:
        raise ValueError("the number of hyperplanes must be a multiple of 8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            side = np.packbits(x @ plane_signs(x.shape[1], planes, seed) >= 0, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in side], pa.binary())], names=["node_id", "emb"])

    return nodes.select(F.col("node_id").cast("long").alias("node_id"), F.col("emb").cast("array<double>").alias("emb")).mapInArrow(run, "node_id long, emb binary")


def lsh(nodes: DataFrame, c: EngineConfig) -> DataFrame:
    """The k nearest of all nodes by Hamming distance of hyperplane codes, kept above the threshold.

    A code is a bit for each plane. The inner product of two codes, their bits taken for 1 and -1, is the number of
    planes less twice the distance, so the similarity join ranks; only the pairs that it finds meet their vectors.
    Codes are written once, as the join reads them several times."""
    codes = Scratch(nodes.sparkSession, "codes").write(hyperplane_codes(nodes, c.lsh_planes, c.seed), "codes")
    near = similarity_join(codes, codes, -float(c.lsh_planes), inclusive=True, k=c.k).select("src", "dst")
    full = near.join(nodes.select(F.col("node_id").alias("src"), F.col("emb").alias("x")), "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("emb").alias("y")), "dst")
    return ranked(full.select("src", "dst", dot(F.col("x"), F.col("y")).alias("weight")).filter(F.col("weight") > c.sim_threshold), "lsh")


def cluster_count(n: int, c: EngineConfig) -> int:
    """The number of spectral clusters of n nodes, by one rule for all n."""
    return min(n, max(2, min(c.n_clusters // 2, n // 20)))


class PowerIterationClustering:
    """k-means of one number a node: a random one, replaced ``maxIter`` times by the mean of the others', weighed by similarity.

    As in Spark's class of that name; that one holds a table of edges, which all similarities are too many for."""

    def __init__(self, k: int, maxIter: int, seed: int):
        self.k, self.maxIter, self.seed = k, maxIter, seed

    def assignClusters(self, edges: Similarities) -> DataFrame:
        """(id, cluster) of the nodes that have a similar one."""
        ids = edges.degrees()
        scratch = Scratch(ids.sparkSession, "power")
        rows = ids.select("node_id", (F.pmod(F.xxhash64("node_id", F.lit(self.seed)), F.lit(1 << 20)) / (1 << 19) - 1).alias("v0"))
        for i in range(self.maxIter):
            means = edges.times(rows, 1).join(ids, "node_id").select("node_id", (F.col("v0") / F.col("degree")).alias("v0"))
            rows = scratch.write(means, f"power-{i}")
            if i:
                scratch.drop(f"power-{i - 1}")
            size = rows.agg(F.avg(F.abs("v0"))).first()[0]
            rows = rows.select("node_id", (F.col("v0") / (size or 1.0)).alias("v0"))
        points = rows.select(F.col("node_id").alias("id"), array_to_vector(F.array("v0")).alias("features"))
        model = KMeans(k=self.k, seed=self.seed, maxIter=20).fit(points)
        return model.transform(points).select("id", F.col("prediction").alias("cluster"))


def spectral(nodes: DataFrame, c: EngineConfig) -> DataFrame:
    """Power iteration clusters of the positive similarities, then edges within clusters.

    All positive similarities count, whatever the number of nodes. A node that the clustering leaves out, as it has none,
    is a cluster of its own, which has no edge."""
    n = nodes.count()
    if n < 2:
        return knn(nodes, c).withColumn("method", F.lit("spectral"))
    near = Similarities(nodes)
    if near.degrees().isEmpty():
        return ranked(near.pairs(), "spectral")
    found = PowerIterationClustering(k=cluster_count(n, c), maxIter=10, seed=c.seed).assignClusters(near)
    clustered = nodes.join(found.withColumnRenamed("id", "node_id"), "node_id").select("node_id", "emb", "cluster")
    return intra_cluster(clustered, c, method="spectral")


#: Products with the affinity between two orthogonalisations, and how many times both are done.
POWERS, ROUNDS = 3, 10


def _affinity(near: DataFrame) -> DataFrame:
    """(src, dst, weight): weights of both directions averaged, over the square roots of the degrees of both ends."""
    both = near.select("src", "dst", "weight").unionAll(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    whole = both.filter("src <> dst").groupBy("src", "dst").agg((F.sum("weight") / 2).alias("weight"))
    degree = whole.groupBy("src").agg(F.sum("weight").alias("degree"))
    ends = whole.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("degree").alias("other")), "dst")
    return ends.select("src", "dst", (F.col("weight") / F.sqrt(F.col("degree") * F.col("other"))).alias("weight"), "degree")


def _narrow(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    return np.stack([np.asarray(batch.column(batch.schema.get_field_index(f"v{i}"))) for i in range(columns)], axis=1) if len(batch) else np.zeros((0, columns))


def _inner(left: DataFrame, columns: int, names: tuple[str, str] = ("v", "v")) -> np.ndarray:
    """The inner products of the columns of a tall matrix with those of itself or of another beside it: a square of
    columns for each task comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns))
        for batch in batches:
            x, y = (np.stack([np.asarray(batch.column(batch.schema.get_field_index(f"{n}{i}"))) for i in range(columns)], axis=1) for n in names)
            total += x.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()])], names=["g"])

    rows = left.select(*[f"{n}{i}" for n in dict.fromkeys(names) for i in range(columns)]).mapInArrow(run, "g array<double>").toArrow()
    return np.sum([np.array(g) for g in rows["g"].to_pylist()], axis=0).reshape(columns, columns)


def _times(rows: DataFrame, right: np.ndarray) -> DataFrame:
    """A tall matrix (node_id, v0, v1, ...) times a small one."""
    columns = right.shape[0]
    sent = rows.sparkSession.sparkContext.broadcast(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _narrow(batch, columns) @ sent.value
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(y[:, i]) for i in range(y.shape[1])]], names=["node_id", *[f"v{i}" for i in range(y.shape[1])]])

    return rows.select("node_id", *[f"v{i}" for i in range(columns)]).mapInArrow(run, ", ".join(["node_id long", *[f"v{i} double" for i in range(right.shape[1])]]))


def _scaled(rows: DataFrame, ids: DataFrame, names: list[str]) -> DataFrame:
    """The rows of a tall matrix over the square roots of their degrees."""
    return rows.join(ids, "node_id").select("node_id", *[(F.col(n) / F.sqrt("degree")).alias(n) for n in names])


def spectral_embedding(near: DataFrame | Similarities, components: int, seed: int = 42, rounds: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """((node_id, v0, v1, ...), eigenvalues): the first eigenvectors of the normalised affinity of (src, dst, weight), over
    the square roots of the degrees; ascending node ids and their weights are all that it depends on.

    Block power iteration: the affinity is a table of entries or all similarities of nodes, which are no table, the block
    a tall narrow table; a product is their join with sums by row, or goes over tiles. Entries are halved and the
    identity's half is added, which keeps the order of eigenvalues and makes all of them positive. Blocks are made orthogonal by their inner products, a square of columns that is
    all that comes to the driver; at the end the block is turned to the eigenvectors within its span."""
    tiled = isinstance(near, Similarities)
    scratch = Scratch(near.nodes.sparkSession if tiled else near.sparkSession, "spectral")
    if tiled:
        ids = near.degrees()
    else:
        entries = scratch.write(_affinity(near), "entries")
        ids = entries.groupBy(F.col("src").alias("node_id")).agg(F.first("degree").alias("degree"))
    # a few columns more than asked for make the wanted ones converge sooner
    columns = components + max(2, components // 4)
    names = [f"v{i}" for i in range(columns)]
    start = [(F.pmod(F.xxhash64("node_id", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / (1 << 19) - 1).alias(n) for i, n in enumerate(names)]
    block = scratch.write(ids.select("node_id", *start), "block-0")

    def sums(rows: DataFrame) -> DataFrame:
        if tiled:
            over = near.times(_scaled(rows, ids, names), columns)
            return scratch.write(_scaled(over, ids, names), f"sums-{near.products}")
        other = rows.withColumnRenamed("node_id", "dst")
        return entries.select("src", "dst", "weight").join(other, "dst").groupBy(F.col("src").alias("node_id")).agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names])

    def product(rows: DataFrame, half: bool = True) -> DataFrame:
        summed = sums(rows)
        if not half:
            return summed
        mine = rows.select("node_id", *[F.col(n).alias(f"own_{n}") for n in names])
        return summed.join(mine, "node_id").select("node_id", *[((F.col(n) + F.col(f"own_{n}")) / 2).alias(n) for n in names])

    for k in range(1, (ROUNDS if rounds is None else rounds) + 1):
        for _ in range(POWERS):
            block = product(block)
        block = scratch.write(block, f"powers-{k}")
        value, vector = np.linalg.eigh(_inner(block, columns))
        # columns that have become dependent go to zero rather than to noise
        scale = np.where(value > value.max() * 1e-13, 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
        block = scratch.write(_times(block, vector * scale), f"block-{k}")
        scratch.drop(f"powers-{k}", f"block-{k - 1}", *([f"sums-{near.products - i}" for i in range(POWERS)] if tiled else []))
    image = product(block, half=False).select("node_id", *[F.col(n).alias(f"w{i}") for i, n in enumerate(names)])
    turned = _inner(block.join(image, "node_id"), columns, ("v", "w"))
    value, vector = np.linalg.eigh((turned + turned.T) / 2)
    order = np.argsort(-value)[:components]
    found = _times(block, vector[:, order])
    shown = [f"v{i}" for i in range(components)]
    return found.join(ids, "node_id").select("node_id", *[(F.col(n) / F.sqrt("degree")).alias(n) for n in shown]), value[order]


def spectral_nodes(nodes: DataFrame, c: EngineConfig) -> DataFrame:
    """Clusters of the spectral embedding of the positive similarities, then edges within clusters.

    All positive similarities count, whatever the number of nodes. Every node has a cluster: one without a similar node
    stands at the origin of the embedding."""
    n = nodes.count()
    if n < 2:
        return knn(nodes, c).withColumn("method", F.lit("spectral_embedding"))
    k = cluster_count(n, c)
    near = Similarities(nodes)
    if near.degrees().isEmpty():
        return ranked(near.pairs(), "spectral_embedding")
    embedded, _ = spectral_embedding(near, k, c.seed)
    names = [f"v{i}" for i in range(k)]
    rows = nodes.select("node_id", "emb").join(embedded, "node_id", "left").fillna(0.0, names).select("node_id", "emb", array_to_vector(F.array(*names)).alias("features"))
    rows = Scratch(nodes.sparkSession, "embedded").write(rows, "rows")
    model = KMeans(k=k, seed=c.seed, maxIter=20).fit(rows)
    clustered = model.transform(rows).select("node_id", "emb", F.col("prediction").alias("cluster"))
    return intra_cluster(clustered, c, method="spectral_embedding")


#: Which method's weight an edge keeps, the last first.
HYBRID = {"knn": 1, "hierarchical": 2, "approximate": 3}


def merge(*edges: DataFrame) -> DataFrame:
    """The union of edge sets; of an edge in several the weight of the method that comes last in ``HYBRID``."""
    whole = edges[0]
    for e in edges[1:]:
        whole = whole.unionByName(e)
    order = F.create_map(*[F.lit(x) for kv in HYBRID.items() for x in kv])
    last = Window.partitionBy("src", "dst").orderBy(order[F.col("method")].desc())
    return whole.withColumn("last_", F.row_number().over(last)).filter("last_ = 1").drop("last_")


def hybrid_parts(nodes: DataFrame, c: EngineConfig, clustered: DataFrame | None = None) -> list[DataFrame]:
    """The edges that the hybrid method adds, method by method."""
    return [knn(nodes, c), hierarchical(nodes, c, clustered), approximate(nodes, c)]


def hybrid(nodes: DataFrame, c: EngineConfig, clustered: DataFrame | None = None) -> DataFrame:
    return ranked(merge(*hybrid_parts(nodes, c, clustered)).select("src", "dst", "weight"), "hybrid")


METHODS: dict[str, Callable[..., DataFrame]] = {
    "knn": knn, "hierarchical": hierarchical, "approximate": approximate, "multi_level": multi_level,
    "hybrid": hybrid, "lsh": lsh, "spectral": spectral, "spectral_embedding": spectral_nodes, "brute_force": brute_force,
}


def build(nodes: DataFrame, method: str, config: EngineConfig) -> DataFrame:
    """Edges by a named method; a name that isn't known gives brute force. The first nodes by id, up to the cap if there is
    one; a warning tells how many it leaves out."""
    if config.max_graph_size is not None and (more := nodes.count() - config.max_graph_size) > 0:
        warnings.warn(f"max_graph_size leaves out {more} nodes, those with the greatest ids", stacklevel=2)
    if config.metric == "cosine":
        nodes = nodes.withColumn("emb", normalise(F.col("emb")))
    return METHODS.get(method, brute_force)(capped(nodes, config.max_graph_size), config)


def capped(nodes: DataFrame, most: int | None) -> DataFrame:
    """The first nodes by id; all of them without a limit."""
    return nodes if most is None else nodes.orderBy("node_id").limit(most)
