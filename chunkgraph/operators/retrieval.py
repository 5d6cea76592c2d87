"""Ranked seeds, bounded simple paths between them, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import preview
from ..functions.vectors import similarity_join
from ..scratch import Scratch


def check_nodes(nodes: DataFrame) -> int:
    """The size of the nodes' vectors; an error for no nodes, a node without a vector, or vectors of several sizes."""
    r = nodes.agg(F.count("*").alias("n"), F.count("emb").alias("vectors"), F.min(F.size("emb")).alias("least"), F.max(F.size("emb")).alias("most")).first()
    if not r.n:
        raise ValueError("the graph has no nodes")
    if r.vectors < r.n or r.least != r.most or r.least < 1:
        raise ValueError("every node needs a vector, all of one size")
    return r.most


def check_queries(queries: DataFrame, top_k: int, size: int | None = None) -> None:
    """An error for a blank query, a query vector of another size than the nodes', or a top_k below 1."""
    if not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be positive")
    if "query" in queries.columns and not queries.filter(F.col("query").isNull() | ~F.col("query").rlike(r"(?U)\S")).isEmpty():
        raise ValueError("a query must not be blank")
    if size is not None and not queries.filter(F.coalesce(F.size("emb"), F.lit(-1)) != size).isEmpty():
        raise ValueError("query vectors must have the size of the nodes' vectors")


def checked_nodes(nodes: DataFrame) -> tuple[DataFrame, int]:
    """The nodes, and the size of their vectors. No nodes are an error at once, a node without a vector of that size is one
    as soon as it is read."""
    first = nodes.select(F.size("emb").alias("size")).head()
    if first is None:
        raise ValueError("the graph has no nodes")
    good = F.coalesce(F.size("emb") == first.size, F.lit(False)) & F.lit((first.size or 0) > 0)
    return nodes.withColumn("emb", F.when(good, F.col("emb")).otherwise(F.raise_error(F.lit("every node needs a vector, all of one size")))), first.size


def checked_queries(queries: DataFrame, size: int) -> DataFrame:
    """The queries; a blank one, or one whose vector has another size, is an error as soon as it is read."""
    good = F.coalesce(F.size("emb") == size, F.lit(False))
    vector = F.when(good, F.col("emb")).otherwise(F.raise_error(F.lit("query vectors must have the size of the nodes' vectors")))
    if "query" in queries.columns:
        told = F.coalesce(F.col("query").rlike(r"(?U)\S"), F.lit(False))
        vector = F.when(told, vector).otherwise(F.raise_error(F.lit("a query must not be blank")))
    return queries.withColumn("emb", vector)


def top_nodes(queries: DataFrame, nodes: DataFrame, top_k: int, max_candidates: int | None = 100) -> DataFrame:
    """(query_id, node_id, sim, rk): the nearest nodes of (query_id, emb), at most ``max_candidates`` if
    that is a limit.

    A query's own node, if it is one, is a candidate. If both sides have a ``graph_id``, a query sees the nodes of its
    graph alone, and the result has the graph_id."""
    if top_k < 1:
        raise ValueError("top_k must be positive")
    asked, group = queries.withColumn("node_id", F.col("query_id")), None
    if "graph_id" in queries.columns and "graph_id" in nodes.columns:
        asked, nodes, group = asked.withColumn("scope", F.xxhash64("graph_id")), nodes.withColumn("scope", F.xxhash64("graph_id")), "scope"
    found = similarity_join(asked, nodes, float("-inf"), inclusive=True, k=top_k if max_candidates is None else min(top_k, max_candidates), distinct=False, group=group)
    found = found.select(F.col("src").alias("query_id"), F.col("dst").alias("node_id"), F.col("weight").alias("sim"), F.col("nbr_rank").alias("rk"))
    return found if group is None else found.join(queries.select("query_id", "graph_id"), "query_id")


def missing_nodes(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    return seeds.join(nodes.select(*_keys(nodes, "node_id")), _keys(nodes, "node_id"), "left_anti")


def _keys(rows: DataFrame, *names: str) -> list[str]:
    """The names, and graph_id where rows have one."""
    return [*(["graph_id"] if "graph_id" in rows.columns else []), *names]


#: Stems of a source that are completed first; each round after that takes four times as many.
FIRST_STEMS = 256


def simple_paths(seeds: DataFrame, edges: DataFrame, max_hops: int, config: EngineConfig, nodes: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, src, dst, path, rank_path, hops, n_nodes, weight_prod, score) from better to worse ranked seeds.

    The search meets in the middle: stems of half the hops go out from each seed, tails of the other half come back from
    the worse seeds, and the two are joined on the node where they meet, so that what is held grows with half the
    hops. Seeds, edges, stems and tails are written to the shared folder (``scratch``, if the caller has one to close).

    Of a pair of seeds the first ``max_paths_per_pair`` paths in the order of a depth-first search count (edges by
    nbr_rank); the score filter comes after. Stems are numbered in that order and completed in rounds: a pair that has
    its paths takes no part in the next round. Without that limit, there is one round, and stems and tails whose
    score is already too low are dropped, which loses nothing where weights are at most 1. Seeds that are none of
    ``nodes``, if they are given, are an error. If seeds and edges have a ``graph_id``, a query stays within its graph."""
    if not isinstance(max_hops, int) or max_hops < 1:
        raise ValueError("max_hops must be at least 1")
    scratch = scratch or Scratch(edges.sparkSession, "paths")
    key, most = _keys(edges), config.max_paths_per_pair
    seeds = seeds.select(*key, "query_id", "node_id", "rk")
    if nodes is not None:
        known = nodes.select(*_keys(nodes, "node_id"), F.lit(True).alias("known")).distinct()
        named = F.when(F.col("known"), F.col("node_id")).otherwise(F.raise_error(F.lit("a seed is no node of the graph")))
        seeds = seeds.join(known, _keys(nodes, "node_id"), "left").select(*key, "query_id", named.cast("long").alias("node_id"), "rk")
    try:
        seeds = scratch.write(seeds, "seeds")
    except Exception as e:
        if "a seed is no node of the graph" in str(e):
            raise ValueError("a seed is no node of the graph") from e
        raise
    edges = scratch.write(edges.select(*key, "src", "dst", "weight", F.col("nbr_rank").cast("int").alias("nbr_rank")), "edges")
    own = ["query_id", *key]
    fits = lambda hops: F.lit(True) if most is not None else F.col("weight_prod") * config.decay_rate**hops >= config.prune_thresh
    ends = seeds.select(*own, F.col("node_id").alias("last"), F.col("rk").alias("end_rk"))
    step = edges.select(*key, F.col("src").alias("last"), F.col("dst").alias("next"), "weight", "nbr_rank")
    half = (max_hops + 1) // 2
    stem = seeds.select(*own, F.col("node_id").alias("src"), "rk", F.col("node_id").alias("last"), F.array("node_id").alias("path"), F.expr("cast(array() as array<int>)").alias("rank_path"), F.lit(1.0).alias("weight_prod"))
    stems = None
    for hop in range(1, half + 1):
        moved = stem.join(step, [*key, "last"]).filter(~F.array_contains("path", F.col("next")))
        stem = moved.select(*own, "src", "rk", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"), F.concat("rank_path", F.array("nbr_rank")).alias("rank_path"), (F.col("weight_prod") * F.col("weight")).alias("weight_prod")).filter(fits(hop))
        whole = stem.join(ends, [*own, "last"]).filter("rk < end_rk").select(*stem.columns, F.lit(True).alias("whole"))
        stems = whole if stems is None else stems.unionByName(whole)
    if max_hops > half:
        stems = stems.unionByName(stem.withColumn("whole", F.lit(False)))
    # a path's place in the search is that of its stem, then that of its tail
    order = Window.partitionBy(*own, "src").orderBy("rank_path", F.col("whole").desc())
    stems = scratch.write(stems.withColumn("nth", F.row_number().over(order)), "stems")
    tails = None
    if max_hops > half:
        back = edges.select(*key, F.col("dst").alias("first"), F.col("src").alias("before"), "weight", "nbr_rank")
        middles = stems.filter("not whole").select(*own, F.col("last").alias("first")).distinct()
        # the end is the first of the nodes that the tail will go through
        tail = ends.select(*own, F.col("last").alias("first"), F.col("last").alias("dst"), "end_rk", F.array("last").alias("way"), F.expr("cast(array() as array<int>)").alias("rank_way"), F.lit(1.0).alias("weight_prod"))
        for hop in range(1, max_hops - half + 1):
            moved = tail.join(back, [*key, "first"]).filter(~F.array_contains("way", F.col("before")))
            tail = moved.select(*own, F.col("before").alias("first"), "dst", "end_rk", F.concat(F.array("before"), "way").alias("way"), F.concat(F.array("nbr_rank"), "rank_way").alias("rank_way"), (F.col("weight_prod") * F.col("weight")).alias("weight_prod")).filter(fits(hop))
            met = tail.join(middles, [*own, "first"], "left_semi")
            tails = met if tails is None else tails.unionByName(met)
        tails = tails.select(*own, F.col("first").alias("last"), "dst", "end_rk", F.slice("way", 2, max_hops).alias("way"), "rank_way", F.col("weight_prod").alias("weight_way"))

    def completed(some: DataFrame, open_: DataFrame | None, tails: DataFrame | None) -> DataFrame:
        """The paths of some stems, of the pairs that are open."""
        shown = [*own, "src", "dst", "path", "rank_path", "weight_prod"]
        found = some.filter("whole").withColumn("dst", F.col("last")).select(shown)
        if tails is not None:
            both = some.filter("not whole").join(tails, [*own, "last"]).filter((F.col("rk") < F.col("end_rk")) & ~F.arrays_overlap("path", "way"))
            found = found.unionByName(both.select(*own, "src", "dst", F.concat("path", "way").alias("path"), F.concat("rank_path", "rank_way").alias("rank_path"), (F.col("weight_prod") * F.col("weight_way")).alias("weight_prod")))
        if open_ is not None:
            found = found.join(open_, [*own, "src", "dst"], "left_semi")
        if most is not None:
            first = Window.partitionBy(*own, "src", "dst").orderBy("rank_path")
            found = found.withColumn("seen_", F.row_number().over(first)).filter(F.col("seen_") <= most).drop("seen_")
        return found

    longest = (stems.agg(F.max("nth")).first()[0] or 0) if most is not None else 0
    if longest <= FIRST_STEMS:
        found = completed(stems, None, tails)
    else:
        tails = tails if tails is None else scratch.write(tails, "tails")
        pairs = seeds.select(*own, F.col("node_id").alias("src"), "rk").join(ends, own).filter("rk < end_rk").select(*own, "src", F.col("last").alias("dst"))
        open_, found, low, high, number = pairs, None, 0, FIRST_STEMS, 0
        while low < longest:
            done = scratch.write(completed(stems.filter((F.col("nth") > low) & (F.col("nth") <= high)), open_, tails), f"round-{number}")
            found = done if found is None else found.unionByName(done)
            counts = found.groupBy(*own, "src", "dst").agg(F.count("*").alias("n")).filter(F.col("n") >= most)
            open_ = scratch.write(pairs.join(counts, [*own, "src", "dst"], "left_anti"), f"open-{number}")
            low, high, number = high, 4 * high, number + 1
        first = Window.partitionBy(*own, "src", "dst").orderBy("rank_path")
        found = found.withColumn("seen_", F.row_number().over(first)).filter(F.col("seen_") <= most).drop("seen_")
    found = found.withColumn("hops", F.size("path") - 1)
    scored = found.withColumn("n_nodes", F.col("hops") + 1).withColumn("score", F.col("weight_prod") * F.pow(F.lit(config.decay_rate), F.col("hops")))
    return scored.filter((F.col("score") >= config.prune_thresh) & (F.col("score") > 0))


def flow(weights: Column, decay: float) -> Column:
    """The score of a stored path from the weights of its edges; 0 for a path without an edge or with one unknown."""
    product = F.aggregate(weights, F.lit(1.0), lambda s, w: s * w)
    return F.when((F.size(weights) > 0) & product.isNotNull(), product * F.pow(F.lit(decay), F.size(weights))).otherwise(F.lit(0.0))


def ranked_paths(paths: DataFrame) -> DataFrame:
    """Adds path_rank: by score, then path."""
    return paths.withColumn("path_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "path")))


def path_texts(paths: DataFrame, nodes: DataFrame, size: int = 50) -> DataFrame:
    """Adds path_text, previews of the nodes' texts in order, and full_text, the texts as they are; Node_<id> for a
    node without one."""
    key = _keys(nodes, "node_id")
    steps = paths.select("query_id", *key[:-1], "path", F.posexplode("path").alias("at", "node_id"))
    named = steps.join(nodes.select(*key, "text"), key, "left")
    whole = F.coalesce("text", F.concat(F.lit("Node_"), F.col("node_id").cast("string")))
    listed = F.array_sort(F.collect_list(F.struct("at", preview(whole, size).alias("shown"), whole.alias("whole"))))
    text = lambda name: F.array_join(F.transform(listed, lambda s: s[name]), " → ")
    joined = named.groupBy("query_id", "path").agg(text("shown").alias("path_text"), text("whole").alias("full_text"))
    return paths.join(joined, ["query_id", "path"])


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose two ends are among the nodes."""
    kept = nodes.select("node_id")
    return edges.join(kept.withColumnRenamed("node_id", "src"), "src", "left_semi").join(kept.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
