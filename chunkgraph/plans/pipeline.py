"""Ingest, graph building, retrieval and chat as whole plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.split import chunk_documents
from ..functions.text import clean_text
from ..functions.vectors import hashing_embedder, normalise
from ..operators import graphs, prompts, retrieval
from ..operators.runtime import Metrics
from ..scratch import Scratch
from ..sources.keyed import RetrievalTable
from ..sources.readers import documents_and_ocr


def ingest(files: DataFrame, size: int = 512, overlap: int = 50, lowercase: bool = True) -> DataFrame:
    """Chunks of (file, text): split, cleaned, blank ones dropped, each with an id made of its place. No shuffle."""
    pieces = chunk_documents(files, "text", size, overlap).withColumn("chunk", clean_text(F.col("chunk"), lowercase=lowercase))
    kept = pieces.filter(F.length("chunk") > 0).withColumn("size", F.length("chunk"))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]+$", "")
    return kept.withColumn("data_name", name).withColumn("chunk_id", F.md5(F.concat_ws("|", "file", F.col("chunk_index").cast("string"))))


def embed_chunks(chunks: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(node_id, chunk_id, text, emb) of the chunks with text; node_id is the rank of chunk_id."""
    rows = chunks.filter("chunk is not null and chunk <> ''").withColumn("emb", (embed or hashing_embedder())(F.col("chunk")).cast("array<double>"))
    rows = rows.withColumn("emb", normalise(F.col("emb")))
    rows = rows.filter("emb is not null").select(F.col("chunk_id").alias("node_id"), F.col("chunk").alias("text"), "emb")
    return graphs.numbers(rows).select(F.col("i").cast("long").alias("node_id"), F.col("node_id").alias("chunk_id"), "text", "emb")


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int, max_hops: int, config: EngineConfig, metrics: Metrics | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The paths between the seeds of each query; seeds and paths are timed and counted if there are metrics."""
    seeds = retrieval.top_nodes(queries, nodes, top_k, config.max_candidates)
    if metrics is None:
        return retrieval.simple_paths(seeds, edges, max_hops, config, scratch=scratch)
    scratch = scratch or Scratch(nodes.sparkSession, "search")
    with metrics.timed("retrieval_time"):
        seeds = scratch.write(seeds, "nearest")
    with metrics.timed("path_pruning_time"):
        # the score filter is the last step; what it drops is counted as the paths are written
        whole = retrieval.simple_paths(seeds, edges, max_hops, replace(config, prune_thresh=0.0), scratch=scratch)
        good = F.col("score") >= config.prune_thresh
        counted, seen = metrics.observe(whole, "paths_pruned", F.count_if(~good))
        found = scratch.write(counted.filter(F.lit(True)), "paths")
        metrics.take(seen, "paths_pruned")
    return found.filter(good)


def retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int, max_hops: int, config: EngineConfig, metrics: Metrics | None = None, cache: RetrievalTable | None = None, graph: tuple[str, int] = ("main", 0), scratch: Scratch | None = None) -> DataFrame:
    """Ranked paths with their texts, for (query_id, query, emb). With a graph_id each query stays in its graph.

    Nodes and queries are checked as they are read. With a cache, queries that it knows for this graph (id and version),
    top_k and max_hops take no part in the search; the others are kept in it."""
    if not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be positive")
    nodes, size = retrieval.checked_nodes(nodes)
    queries = retrieval.checked_queries(queries, size)
    if cache is None:
        paths = search(queries, nodes, edges, top_k, max_hops, config, metrics, scratch)
    else:
        scratch = scratch or Scratch(nodes.sparkSession, "cached")
        key = retrieval._keys(queries)
        asked = queries.withColumn("digest", cache.digest())
        told = scratch.write(asked.join(cache.known(*graph, top_k, max_hops), "digest", "left"), "asked")
        hits, misses = told.filter("paths is not null"), told.filter("paths is null").drop("paths")
        counts = told.agg(F.count("paths").alias("hits"), F.count_if(F.col("paths").isNull()).alias("misses")).first()
        if metrics is not None:
            metrics.add("cache_hits", counts.hits)
            metrics.add("cache_misses", counts.misses)
        paths = hits.select(*key, "query_id", F.inline("paths"))
        if counts.misses:
            found = scratch.write(search(misses, nodes, edges, top_k, max_hops, config, metrics, scratch).select(*paths.columns), "found")
            cache.put(*graph, top_k, max_hops, misses, found)
            paths = paths.unionByName(found)
    return retrieval.path_texts(retrieval.ranked_paths(paths), nodes)


def evidence(queries: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int, max_hops: int, config: EngineConfig) -> DataFrame:
    return prompts.evidence_prompts(queries, retrieve(queries, nodes, edges, top_k, max_hops, config))


def embed_queries(queries: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds emb, the unit vector of the query's text; blank queries are an error. A task's retries are its tries."""
    retrieval.check_queries(queries, 1)
    return queries.withColumn("emb", (embed or hashing_embedder())(F.col("query")).cast("array<double>")).withColumn("emb", normalise(F.col("emb")))


def together(graphs_by_id: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of several graphs, told apart by graph_id."""
    named = [[t.withColumn("graph_id", F.lit(name)) for t in graph] for name, graph in graphs_by_id.items()]
    nodes, edges = (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), side) for side in zip(*named))
    return nodes, edges


def dual_contexts(requests: DataFrame, nodes: DataFrame, edges: DataFrame, main_id: str, top_k: int, max_hops: int, config: EngineConfig) -> DataFrame:
    """(query_id, user_context, main_context) for requests (query_id, user_id, query, emb).

    One pipeline over both graphs of a request, the one whose graph_id is its user_id and the main one; a context
    is null where no path was found."""
    main = F.lit(main_id)
    sides = requests.select("query_id", "query", "emb", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("user_id").cast("string").alias("graph_id")), F.struct(F.lit(1).alias("side"), main.alias("graph_id")))).alias("s"))
    asked = sides.select((F.col("query_id") * 2 + F.col("s.side")).alias("query_id"), "query", "emb", F.col("s.graph_id").alias("graph_id")).filter("graph_id is not null")
    found = evidence(asked, nodes, edges, top_k, max_hops, config).filter("n_paths > 0")
    side = F.pmod("query_id", F.lit(2))
    return found.groupBy(((F.col("query_id") - side) / 2).cast("long").alias("query_id")).agg(F.max(F.when(side == 0, F.col("prompt"))).alias("user_context"), F.max(F.when(side == 1, F.col("prompt"))).alias("main_context"))


def chat(requests: DataFrame, log: DataFrame, nodes: DataFrame, edges: DataFrame, main_id: str, config: EngineConfig, system: str | None = None, generate: Callable[[Column], Column] = prompts.extractive_answer, top_k: int = 5, max_hops: int = 2) -> DataFrame:
    """Log rows for requests (query_id, user_id, query, emb): logged answers as they are, others from the user's graph
    and the main one among (nodes, edges) with a graph_id."""
    probed = prompts.probe_cache(requests.drop("emb"), log)
    misses = prompts.cache_misses(requests, log)
    context = misses.select("query_id", "user_id", "query").join(dual_contexts(misses, nodes, edges, main_id, top_k, max_hops, config), "query_id", "left")
    both = prompts.dual_context(F.col("user_context"), F.col("main_context"), F.col("query"))
    prompt = prompts.rag_prompt(both, F.col("query"), None if system is None else F.lit(system))
    answered = context.withColumn("retrieval_context", both).withColumn("llm_response", generate(prompt))
    hits = probed.filter("hit").select("query_id", "user_id", "query", "llm_response", F.lit(None).cast("string").alias("retrieval_context"), F.lit(True).alias("cached"))
    return hits.unionByName(answered.select("query_id", "user_id", "query", "llm_response", "retrieval_context", F.lit(False).alias("cached")))


def build_user_graph(files: DataFrame, ocr: DataFrame | None, user_id: str, store, config: EngineConfig, mode: str = "all", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """A user's files as a graph of their own, kept under the user's id; one row about each file.

    Chunks of more than ten characters of (file, text), with those of recognised text if there are any."""
    chunks = ingest(files).withColumn("source_type", F.lit("text"))
    if ocr is not None:
        read = ocr.filter((F.col("confidence") > 10) & (F.trim("text") != "")).select("file", F.trim("text").alias("text"))
        chunks = documents_and_ocr(chunks, ingest(read).withColumn("source_type", F.lit("ocr")).withColumn("chunk_id", F.concat(F.lit("ocr"), "chunk_id")), mode)
    scratch = Scratch(files.sparkSession, "user-graph")
    chunks = scratch.write(chunks.filter(F.length(F.trim("chunk")) > 10), "chunks")
    nodes = scratch.write(embed_chunks(chunks, embed), "nodes")
    version = store.save(user_id, nodes, graphs.build(nodes, "knn", config), method="knn", reason="upload")
    size = nodes.select(F.size("emb").alias("d")).agg(F.max("d").alias("embedding_dimension"))
    about = chunks.groupBy("file").agg(F.count("*").alias("num_chunks"), F.count_if(F.col("source_type") == "ocr").alias("num_ocr_chunks"), F.count_if(F.col("source_type") == "text").alias("num_text_chunks"))
    return about.join(F.broadcast(size)).select(F.lit(user_id).alias("user_id"), F.element_at(F.split("file", "/"), -1).alias("filename"), F.col("file").alias("file_path"), F.lit(f"{store.path}/graph_id={user_id}/version={version}").alias("graph_path"), "num_chunks", "num_ocr_chunks", "num_text_chunks", "embedding_dimension", F.current_timestamp().alias("processing_ts"))
