import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkgraph.config import EngineConfig
from chunkgraph.functions import vectors
from chunkgraph.operators import graphs


def affinity(rng):
    """Three groups, weakly tied, in one graph."""
    n, group = 45, np.arange(45) % 3
    w = rng.uniform(0.5, 1, (n, n)) * np.where(group[:, None] == group[None, :], 1, 0.04 * (rng.random((n, n)) < 0.5))
    w = np.triu(w, 1)
    return w + w.T, group


def test_eigenvectors_are_those_of_the_whole_matrix(spark):
    w, _ = affinity(np.random.default_rng(6))
    near = spark.createDataFrame([(int(i) - 5, int(j) - 5, float(w[i, j])) for i, j in zip(*np.nonzero(w))], "src long, dst long, weight double").repartition(3)
    found, values = graphs.spectral_embedding(near, 3, rounds=6)
    degree = w.sum(1)
    value, vector = np.linalg.eigh(w / np.sqrt(degree[:, None] * degree[None, :]))
    order = np.argsort(-value)[:3]
    assert np.allclose(values, value[order], atol=1e-8)
    rows = {r.node_id + 5: [r.v0, r.v1, r.v2] for r in found.collect()}
    got = np.array([rows[i] for i in range(45)]) * np.sqrt(degree)[:, None]
    assert np.allclose(np.abs((got * vector[:, order]).sum(0)), 1, atol=1e-6)


def test_every_node_has_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(graphs, "ROUNDS", 3)
    rng = np.random.default_rng(9)
    x = np.concatenate([np.eye(5)[:3].repeat(20, axis=0) + 0.1 * rng.standard_normal((60, 5)), [[0, 0, 0, 0, -3.0]]])
    x[:60, 4] = np.abs(x[:60, 4])
    x /= np.linalg.norm(x, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, emb array<double>")
    c = EngineConfig(sim_threshold=0.3, k=4, n_clusters=6)
    edges = graphs.build(nodes, "spectral_embedding", c).persist()
    assert {r.src // 20 == r.dst // 20 for r in edges.collect()} == {True}
    assert {r.src for r in edges.select("src").union(edges.select("dst")).collect()} == set(range(60))
    assert graphs.spectral_nodes(nodes.filter("node_id = 0"), c).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "node_id long, emb array<double>")
    assert graphs.spectral_nodes(alone, c).count() == 0
    edges.unpersist()


def test_all_similarities_of_nodes_are_their_affinity(spark, monkeypatch):
    """Tile by tile, with several blobs; the embedding is that of their table."""
    monkeypatch.setattr(vectors, "BLOB_BYTES", 512)
    x = np.random.default_rng(3).standard_normal((70, 6)) + np.eye(6)[np.arange(70) % 3] * 4
    x[0] = -x[1:].sum(axis=0)
    w = x @ x.T
    w[w < 1e-9] = 0
    np.fill_diagonal(w, 0)
    nodes = spark.createDataFrame([(i - 9, v.tolist()) for i, v in enumerate(x)], "node_id long, emb array<double>")
    near = vectors.Similarities(nodes)
    assert near.blobs.count() > 1
    degree = {r.node_id + 9: r.degree for r in near.degrees().collect()}
    has = np.flatnonzero(w.sum(1))
    assert sorted(degree) == has.tolist() and np.allclose([degree[i] for i in has], w.sum(1)[has])
    v = np.random.default_rng(4).standard_normal((70, 2))
    summed = {r.node_id + 9: (r.v0, r.v1) for r in near.times(spark.createDataFrame([(i - 9, *map(float, r)) for i, r in enumerate(v)], "node_id long, v0 double, v1 double"), 2).collect()}
    assert np.allclose([summed[i] for i in range(70)], w @ v)
    got, values = graphs.spectral_embedding(near, 3, rounds=1)
    want, same = graphs.spectral_embedding(near.pairs(), 3, rounds=1)
    assert np.allclose(values, same)
    got, want = ({r.node_id: (r.v0, r.v1, r.v2) for r in f.collect()} for f in (got, want))
    assert sorted(got) == sorted(want)
    got, want = (np.array([f[i - 9] for i in has]) for f in (got, want))
    assert np.allclose(got * np.sign((got * want).sum(0)), want)


def test_no_switch_by_the_number_of_nodes(spark):
    """The rule for the number of clusters is one, and no nearest neighbours are asked for instead of all."""
    assert [graphs.cluster_count(n, EngineConfig(n_clusters=10)) for n in (1, 5, 60, 5000, 5001, 10**6)] == [1, 2, 3, 5, 5, 5]
    seen = []
    monkey = pytest.MonkeyPatch()
    monkey.setattr(graphs, "Similarities", lambda nodes: seen.append(nodes.count()) or vectors.Similarities(nodes.limit(0)))
    with monkey.context():
        nodes = spark.range(5001).select(F.col("id").alias("node_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("emb"))
        assert graphs.spectral_nodes(nodes, EngineConfig()).count() == 0
    monkey.undo()
    assert seen == [5001]


def test_power_iteration_takes_all_similarities(spark):
    """The clusters are those of the whole matrix's powers, and beyond the old switch no nearest neighbours are asked for."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.eye(4)[:2].repeat([30, 10], axis=0) + 0.05 * rng.standard_normal((40, 4)), [[0, 0, 0, -9.0]]])
    x[:40, 2:] = np.abs(x[:40, 2:])
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, emb array<double>")
    found = {r.id: r.cluster for r in graphs.PowerIterationClustering(k=2, maxIter=4, seed=42).assignClusters(vectors.Similarities(nodes)).collect()}
    assert sorted(found) == list(range(40))
    assert len({found[i] for i in range(30)}) == len({found[i] for i in range(30, 40)}) == 1 and found[0] != found[30]
    seen = []
    monkey = pytest.MonkeyPatch()
    monkey.setattr(graphs, "Similarities", lambda nodes: seen.append(nodes.count()) or vectors.Similarities(nodes.limit(0)))
    with monkey.context():
        many = spark.range(5001).select(F.col("id").alias("node_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("emb"))
        assert graphs.spectral(many, EngineConfig()).count() == 0
    monkey.undo()
    assert seen == [5001]
