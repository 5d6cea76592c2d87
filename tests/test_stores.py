import gzip
import json

import pytest
from pyspark.sql import functions as F

from chunkgraph.config import EngineConfig
from chunkgraph.operators import graphs, retrieval
from chunkgraph.operators.runtime import Metrics
from chunkgraph.plans import pipeline
from chunkgraph.sources import readers, sinks
from chunkgraph.sources.keyed import KeyedTable, RetrievalTable

FILES = "user_id string, filename string, size int"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), FILES)


def test_rows_are_replaced_by_key(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), FILES, ["user_id", "filename"], keep=2)
    assert t.read().count() == 0 and t.versions() == []
    assert t.replace(files(spark, ("u", "a", 1), ("u", "b", 2), (None, "a", 3))) == 1
    before = t.read()
    assert t.replace(files(spark, ("u", "a", 9), (None, "a", 7))) == 2
    assert sorted((r.user_id or "", r.filename, r.size) for r in t.read().collect()) == [("", "a", 7), ("u", "a", 9), ("u", "b", 2)]
    # a reader that began before sees what was there
    assert sorted(r["size"] for r in before.collect()) == [1, 2, 3]
    # the source may read the target
    assert t.replace(t.read().withColumn("size", F.col("size") + 1)) == 3
    assert sorted(r["size"] for r in t.read().collect()) == [3, 8, 10] and t.versions() == [2, 3]
    assert t.remove(F.col("user_id") == "u") == 4 and t.read().count() == 1
    with pytest.raises(ValueError):
        t.read(1)


def test_a_writer_that_fails_changes_nothing(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), FILES, ["filename"])
    t.replace(files(spark, ("u", "a", 1)))
    poisoned = files(spark, ("u", "a", 2)).withColumn("size", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        t.replace(poisoned)
    assert t.versions() == [1] and t.read().first()["size"] == 1
    # of two writers from one version the second fails
    t.commit(files(spark, ("u", "x", 5)), base=1)
    with pytest.raises(Exception):
        t.commit(files(spark, ("u", "y", 6)), base=1)
    assert t.read().first().filename == "x"


def test_batches_fail_alone(spark):
    spark.sql("DROP TABLE IF EXISTS chunks")
    rows = spark.range(200).select(F.col("id").cast("string").alias("chunk_id"), F.lit("text").alias("chunk"))
    poison = lambda batch: batch.withColumn("chunk", F.when(F.col("chunk_id") == "77", F.raise_error(F.lit("bad row"))).otherwise(F.col("chunk")))
    told = sinks.insert_batches(rows, "chunks", poison, batches=10, key="chunk_id").collect()
    assert sorted(r.status for r in told) == ["failed"] + ["success"] * 9 and "bad row" in next(r.error for r in told if r.error)
    lost = next(r.batch for r in told if r.status == "failed")
    kept = {r.chunk_id for r in spark.table("chunks").collect()}
    every = {r.chunk_id: r.b for r in rows.withColumn("b", F.pmod(F.xxhash64("chunk_id"), F.lit(10))).collect()}
    assert kept == {c for c, b in every.items() if b != lost}
    with pytest.raises(RuntimeError, match="all 10 batches"):
        sinks.insert_batches(rows, "chunks", lambda batch: batch.withColumn("chunk", F.raise_error(F.lit("bad")).cast("string")), batches=10)
    assert sinks.insert_batches(rows.limit(0), "chunks").count() == 0
    spark.sql("DROP TABLE chunks")


def ring(spark, n=12):
    import math

    nodes = spark.createDataFrame([(i, f"text {i}", [math.cos(i / 4), math.sin(i / 4)]) for i in range(n)], "node_id long, text string, emb array<double>")
    c = EngineConfig(sim_threshold=0.1, k=3, prune_thresh=0.55)
    return nodes, graphs.knn(nodes, c), c


def asked_of(nodes, *ids):
    return nodes.filter(F.col("node_id").isin(*ids)).select(F.col("node_id").alias("query_id"), F.concat(F.lit("about "), "text").alias("query"), "emb")


def test_known_queries_start_no_search(spark, tmp_path, monkeypatch):
    nodes, edges, c = ring(spark)
    cache, m, searched = RetrievalTable(spark, str(tmp_path / "cache")), Metrics(), []
    real = pipeline.search
    monkeypatch.setattr(pipeline, "search", lambda queries, *a, **k: searched.append(sorted(r.query_id for r in queries.collect())) or real(queries, *a, **k))
    show = lambda rows: sorted((r.query_id, tuple(r.path), round(r.score, 9), r.path_rank, r.full_text) for r in rows.collect())
    plain = show(pipeline.retrieve(asked_of(nodes, 0, 5), nodes, edges, 4, 3, c))
    searched.clear()
    ask = lambda ids, version=1: show(pipeline.retrieve(asked_of(nodes, *ids), nodes, edges, 4, 3, c, metrics=m, cache=cache, graph=("g", version)))
    assert plain and ask([0]) == [r for r in plain if r[0] == 0] and searched == [[0]]
    assert ask([0, 5]) == plain and searched == [[0], [5]]
    assert ask([0, 5]) == plain and searched == [[0], [5]]
    assert ask([0, 5], 2) == plain and searched == [[0], [5], [0, 5]]
    report = m.report()
    assert (report["cache_hits"], report["cache_misses"]) == (3, 4) and report["retrieval_time"] > 0 and report["path_pruning_time"] > 0
    cache.compact("g", 2)
    assert {r.version for r in cache.read().collect()} == {2}
    old = RetrievalTable(spark, str(tmp_path / "cache"), seconds=0)
    assert old.known("g", 2, 4, 3).count() == 0 and old.compact() and old.read().count() == 0


def test_metrics_are_taken_from_the_jobs(spark, tmp_path):
    nodes, edges, c = ring(spark)
    m, store = Metrics(), sinks.GraphStore(spark, str(tmp_path / "graphs"))
    store.save("g", nodes, edges, method="knn", metrics=m)
    report = m.report()
    assert (report["nodes_processed"], report["edges_created"]) == (12, edges.count()) and report["graph_build_time"] > 0
    found = pipeline.retrieve(asked_of(nodes, 0, 7), nodes, edges, 4, 3, c, metrics=m).count()
    whole = pipeline.retrieve(asked_of(nodes, 0, 7), nodes, edges, 4, 3, EngineConfig(sim_threshold=0.1, k=3, prune_thresh=0.0)).count()
    assert m.report()["paths_pruned"] == whole - found > 0


def test_bad_input_fails_on_the_live_path(spark):
    nodes, edges, c = ring(spark)
    good = asked_of(nodes, 0)
    with pytest.raises(ValueError, match="no nodes"):
        pipeline.retrieve(good, nodes.limit(0), edges, 3, 2, c)
    ragged = nodes.withColumn("emb", F.when(F.col("node_id") == 3, F.array(F.lit(1.0))).otherwise(F.col("emb")))
    lost = nodes.withColumn("emb", F.when(F.col("node_id") != 3, F.col("emb")))
    for bad in (ragged, lost):
        with pytest.raises(Exception, match="every node needs a vector"):
            pipeline.retrieve(good, bad, edges, 3, 2, c).count()
    for blank in (F.lit("  "), F.lit(None).cast("string")):
        with pytest.raises(Exception, match="must not be blank"):
            pipeline.retrieve(good.withColumn("query", blank), nodes, edges, 3, 2, c).count()
    with pytest.raises(Exception, match="size of the nodes"):
        pipeline.retrieve(good.withColumn("emb", F.array(F.lit(1.0))), nodes, edges, 3, 2, c).count()
    with pytest.raises(ValueError, match="top_k"):
        pipeline.retrieve(good, nodes, edges, 0, 2, c)
    seeds = spark.createDataFrame([(0, 0, 1), (0, 99, 2)], "query_id long, node_id long, rk int")
    with pytest.raises(ValueError, match="a seed is no node"):
        retrieval.simple_paths(seeds, edges, 2, c, nodes)


@pytest.mark.parametrize("compress", [True, False])
def test_node_link_documents(spark, tmp_path, compress):
    nodes, edges, _ = ring(spark)
    sinks.write_node_link(nodes, edges, str(tmp_path / "g"), compress)
    file = next(p for p in (tmp_path / "g").iterdir() if p.name.startswith("part"))
    whole = json.loads((gzip.open(file) if compress else open(file)).read())
    assert [n["id"] for n in whole["nodes"]] == list(range(12)) and whole["directed"] and len(whole["links"]) == edges.count()
    n, e = readers.node_link(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.select("node_id", "text", "emb").collect()))
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.select("src", "dst", "weight", "nbr_rank").collect()))


def test_node_link_of_another_writer(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"directed": True, "graph": {}, "nodes": [{"text": "a", "emb": [1, 0], "id": 4}, {"text": "b", "emb": [0.5, 1], "id": 2}], "links": [{"weight": 0.5, "source": 4, "target": 2}]}, indent=2))
    n, e = readers.node_link(spark, str(path))
    assert {(r.node_id, r.text, tuple(r.emb)) for r in n.collect()} == {(4, "a", (1.0, 0.0)), (2, "b", (0.5, 1.0))}
    assert [tuple(r) for r in e.collect()] == [(4, 2, 0.5, 1)]
    path.write_text(json.dumps({"nodes": [{"id": 1}], "edges": []}))
    n, e = readers.node_link(spark, str(path))
    assert n.count() == 1 and e.count() == 0
    path.write_text("{")
    with pytest.raises(Exception):
        readers.node_link(spark, str(path))[0].count()
