import pytest
from pyspark.sql import functions as F

from chunkgraph.config import EngineConfig
from chunkgraph.operators import graphs, stats
from chunkgraph.plans import pipeline
from chunkgraph.sources import readers, sinks
from chunkgraph.streaming.ingest import watch_folder


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(3):
        (d / f"f{i}.txt").write_text(f"File {i} tells of graphs. " + "words of file %d " % i * 60)
    (d / "a.md").write_text("# A\ntext")
    (d / "blank.md").write_text("  \n")
    (d / "x.exe").write_text("no")
    return str(d)


def test_files(spark, folder):
    assert readers.text_files(spark, folder).count() == 3
    assert [r.dir_name for r in readers.markdown_files(spark, folder).collect()] == ["in"]
    assert readers.list_files(spark, folder, max_mb=1).filter("accepted").count() == 3
    assert readers.list_files(spark, folder, max_mb=0.0001).filter("accepted").count() == 0


def test_modes(spark):
    docs = spark.createDataFrame([("a.txt", "x")], "file string, chunk string")
    ocr = spark.createDataFrame([("b.PDF", "y"), ("c.txt", "z")], "file string, chunk string")
    assert [readers.documents_and_ocr(docs, ocr, m).count() for m in ("all", "ocr_only", "no_ocr")] == [2, 1, 1]
    with pytest.raises(ValueError):
        readers.documents_and_ocr(docs, ocr, "none")


def test_store_versions_and_formats(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.6, 0.8])], "node_id long, text string, emb array<double>")
    edges = graphs.knn(nodes, EngineConfig(sim_threshold=0.1))
    store = sinks.GraphStore(spark, str(tmp_path / "graphs"))
    assert [store.save("g", nodes, edges, fmt=f) for f in ("parquet", "json")] == [1, 2]
    for version in (1, 2):
        n, e = store.load("g", version)
        assert (n.count(), e.count()) == (2, 2)
    with pytest.raises(ValueError):
        store.load("none")
    with pytest.raises(ValueError):
        store.save("g", nodes, edges, fmt="pickle")


def test_tables(spark):
    spark.sql("DROP TABLE IF EXISTS chunks")
    sinks.append(spark.createDataFrame([("c1", "text")], "chunk_id string, chunk string"), "chunks")
    assert readers.pull(spark, "chunks", ["chunk_id"], 5).collect()[0].chunk_id == "c1"
    assert sinks.reset(spark, chunks=True) == ["chunks"]
    assert spark.table("chunks").count() == 0
    spark.sql("DROP TABLE chunks")
    with pytest.raises(ValueError):
        sinks.reset(spark)
    with pytest.raises(ValueError):
        readers.pull(spark, "no name")


def test_from_files_to_answers(spark, folder):
    c = EngineConfig(sim_threshold=0.05, prune_thresh=0.0)
    chunks = pipeline.ingest(readers.text_files(spark, folder), size=200, overlap=20)
    assert chunks.filter(F.length("chunk") > 200).count() == 0
    nodes = pipeline.embed_chunks(chunks).persist()
    edges = graphs.build(nodes, "knn", c).persist()
    own = nodes.withColumn("text", F.concat(F.lit("mine: "), "text"))
    both = pipeline.together({"main": (nodes, edges), "u": (own, edges)})
    asked = nodes.filter("node_id = 0").select(F.explode(F.array(F.lit("u"), F.lit("other"))).alias("user_id"), F.lit("graphs?").alias("query"), "emb").withColumn("query_id", F.when(F.col("user_id") == "u", 0).otherwise(1).cast("long"))
    log = spark.createDataFrame([], "user_id string, query string, llm_response string, created_at long, entry_id string")
    answer = {r.user_id: r for r in pipeline.chat(asked, log, *both, "main", c).collect()}
    assert not answer["u"].cached and "RELEVANT INFORMATION FROM USER DOCUMENTS:\nQUERY: graphs?" in answer["u"].retrieval_context and "mine: " in answer["u"].retrieval_context
    assert "USER DOCUMENTS" not in answer["other"].retrieval_context and "RELEVANT GENERAL KNOWLEDGE:\nQUERY: graphs?" in answer["other"].retrieval_context
    log = spark.createDataFrame([("u", "graphs?", "known", 1, "e")], "user_id string, query string, llm_response string, created_at long, entry_id string")
    assert {(r.user_id, r.cached, r.llm_response == "known") for r in pipeline.chat(asked, log, *both, "main", c).collect()} == {("u", True, True), ("other", False, False)}


def test_binary_files(spark, folder):
    """Pages and images by extractors that stand in for a library."""
    pages = readers.binary_pages(spark, folder, lambda raw: raw.decode().split(" of ")[:2], "f*.txt")
    assert [(r.page_no, r.text) for r in pages.filter(F.col("file").endswith("f0.txt")).orderBy("page_no").collect()] == [(0, "File 0 tells"), (1, "graphs. words")]
    images = readers.binary_images(spark, folder, lambda raw: [(0, "png", raw[:4]), (3, "jpg", b"")], "f*.txt")
    assert sorted((r.page, r.img_no, r.ext, bytes(r.bytes)) for r in images.collect())[:1] == [(0, 0, "png", b"File")] and images.count() == 6


def test_text_of_images(spark):
    def broken(raw):
        raise OSError("no such model")

    engines = {"b": lambda raw: (raw.decode(), 20.1 if raw == b"two" else 1.0), "a": lambda raw: (raw.decode().upper(), 30.1 if raw == b"one" else 30.0), "c": broken}
    images = spark.createDataFrame([("f", 0, i, bytearray(x)) for i, x in enumerate((b"one", b"two", b"three"))], "file string, page int, img_no int, bytes binary")
    found = {r.img_no: (r.engine, r.text, r.accepted, r.error) for r in readers.extract_text(images, engines, "a").collect()}
    assert found == {0: ("a", "ONE", True, None), 1: ("b", "two", True, None), 2: ("b", "three", False, None)}
    found = [(r.engine, r.accepted, r.error) for r in readers.extract_text(images, {"c": broken}, "c", prepare=bytes).collect()]
    assert found == [(None, False, "c: no such model")] * 3
    with pytest.raises(ValueError):
        readers.extract_text(images, engines, "none")


def test_embedding_rows(spark):
    rows = spark.createDataFrame([("[1, 2.5]", " a\nb "), ("[1, null]", "c"), ("no", "d"), (None, "e")], "embedding string, chunk string")
    assert [(r.embedding, r.chunk) for r in readers.embedding_rows(rows).collect()] == [([1.0, 2.5], "a b")]


def test_stores(spark):
    for name, row in (("embed_vector", "chunk_id string"), ("chatbot", "user_id string")):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        sinks.append(spark.createDataFrame([("x",)], row), name)
        assert spark.table(name).count() == 1
    assert set(sinks.reset(spark, erase_all=True)) == {"chunks", "embed_vector", "chatbot"}
    found = {r.table_name: r.n_rows for r in stats.catalog_inventory(spark).collect()}
    assert found["embed_vector"] == 0
    for name in ("chunks", "embed_vector", "chatbot"):
        spark.sql(f"DROP TABLE {name}")


def test_user_graph_and_checkpoints(spark, folder, tmp_path):
    from chunkgraph.operators.runtime import CheckpointPolicy, Metrics, RetrievalCache, checkpoint

    store, c = sinks.GraphStore(spark, str(tmp_path / "graphs")), EngineConfig(sim_threshold=0.05)
    ocr = spark.createDataFrame([("s.pdf", "recognised words of a page", 80.0), ("s.pdf", "too unsure to keep", 5.0)], "file string, text string, confidence double")
    about = pipeline.build_user_graph(readers.text_files(spark, folder), ocr, "u1", store, c).collect()
    assert {r.filename for r in about} == {"f0.txt", "f1.txt", "f2.txt", "s.pdf"} and sum(r.num_ocr_chunks for r in about) == 1
    nodes, edges = store.load("u1")
    policy = CheckpointPolicy(every=10)
    assert checkpoint(store, "u1", nodes, edges, 9, policy) is None
    assert checkpoint(store, "u1", nodes, edges, 10, policy) == 2 and policy.last == 10
    cache = RetrievalCache(most=1)
    cache.put("u1", 1, "q", 5, [1, 2])
    assert cache.get("u1", 1, "q", 5) == [1, 2] and cache.get("u1", 2, "q", 5) is None
    with pytest.raises(KeyError):
        Metrics().add("none")


def test_stream(spark, folder, tmp_path):
    q = watch_folder(spark, folder + "/*.txt", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 3
