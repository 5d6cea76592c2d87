import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkgraph.config import PROFILES, EngineConfig, parse_bool, parse_list, profile
from chunkgraph.functions import split, text
from chunkgraph.operators import graphs, prompts, retrieval, stats


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("dirty, clean", [("See https://a.b/c. Now", "see now"), ("and/or", "and"), ("a [1] b", "a b"), ("<b>x</b> y 😀", "x y"), ("", ""), (None, None)])
def test_clean_text(spark, dirty, clean):
    assert one(spark, text.clean_text(F.col("t"), lowercase=True), t=dirty) == clean


def test_html_text_leaves_out_scripts_and_fuses_blocks():
    assert text.html_text("<h1>a</h1><p>b &amp; c</p><script>x='</p>'</script><!-- d -->") == "ab & c"


@pytest.mark.parametrize("marked, plain", [
    ("# T\n\n**bold** and *it* [l](u) ![i](u)\n> q\n- a\n1. b\n---\n`c`\n```\ncode\n```", "T\nbold and it l \nq\na\nb\nc"),
    ("**a*b**", "a*b"), ("__a_b__ c", "a_b c"), ("[x]()", "x"), ("![a](b\nc)", "![a](b\nc)"), ("  > q", "> q"), ("x ` ` y", "x   y"), (" \u00a0#### t\u2003", "#### t"), ("٣. x", "x"), (None, None),
])
def test_strip_markdown(spark, marked, plain):
    assert one(spark, text.strip_markdown(F.col("t")), t=marked) == plain


def test_names(spark):
    at = F.lit("2025-01-02 03:04:05").cast("timestamp")
    name = one(spark, text.unique_filename(F.col("t"), at, F.lit(1)), t="My Report (2025).pdf")
    assert name.startswith("My_Report__2025_20250102_030405_") and name.endswith(".pdf")
    assert one(spark, text.unique_filename(F.col("t"), at, F.lit(1)), t="x.exe") is None
    assert one(spark, text.directory_name(F.col("t")), t="a b/" + "c" * 40) == "a_b_" + "c" * 26


def test_split_without_separator_keeps_size_and_overlap():
    found = split.split_text("a" * 600, 512, 50)
    assert all(len(x) <= 512 for x in found) and "".join(found).count("a") >= 600


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=800))
def test_split_pieces_are_short_and_of_the_text(t):
    for piece in split.split_text(t, 100, 20):
        assert 0 < len(piece) <= 100 and piece in t


def test_headers():
    found = split.split_headers("# Main Title\nx\n## Section 1\ny\n### Subsection 1.1\nz")
    assert [t for t, _ in found] == ["Main Title", "Main Title / Section 1", "Main Title / Section 1 / Subsection 1.1"]
    assert split.split_headers("") == []
    assert split.split_headers("```\n# x\n```") == [("No Title", "```\n# x\n```")]


def test_config_is_checked():
    for bad in ({"decay_rate": 0.0}, {"prune_thresh": -1.0}, {"sim_threshold": 2.0}, {"max_workers": 0}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    assert profile("production").decay_rate == 0.9 and len(PROFILES) == 3
    with pytest.raises(ValueError):
        profile("none")


@pytest.mark.parametrize("word, flag", [(" Yes ", True), ("t", True), ("1", True), ("ON", True), ("f", False), ("no", False), ("0", False), ("maybe", None), ("", None), (None, None)])
def test_parse_bool(spark, word, flag):
    assert one(spark, parse_bool(F.col("t")), t=word) is flag


def test_parse_settings(spark):
    assert one(spark, parse_list(F.col("t")), t="a, ,b") == ["a", "b"]


def edges_of(spark, rows):
    return graphs.ranked(spark.createDataFrame(rows, "src long, dst long, weight double"), "knn")


def seeds_of(spark, ids):
    return spark.createDataFrame([(0, n, 1.0, i + 1) for i, n in enumerate(ids)], "query_id long, node_id long, sim double, rk int")


def test_paths_and_scores(spark):
    c = EngineConfig(sim_threshold=0.1, prune_thresh=0.01)
    edges = edges_of(spark, [(0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.5)])
    found = retrieval.ranked_paths(retrieval.simple_paths(seeds_of(spark, [0, 2]), edges, 4, c)).orderBy("path_rank").collect()
    assert [(r.path, round(r.score, 4), r.hops, r.n_nodes) for r in found] == [([0, 1, 2], 0.4608, 2, 3), ([0, 2], 0.4, 1, 2)]
    assert retrieval.simple_paths(seeds_of(spark, [2, 0]), edges, 4, c).count() == 0


def test_limit_counts_paths_before_the_score_filter(spark):
    c = EngineConfig(sim_threshold=0.1, prune_thresh=0.2)
    ways = [(0, 10 + i, 0.9 - i * 0.01) for i in range(12)] + [(10 + i, 1, 0.1 if i < 10 else 0.9) for i in range(12)]
    assert retrieval.simple_paths(seeds_of(spark, [0, 1]), edges_of(spark, ways), 2, c).count() == 0


def test_negative_ids_are_nodes(spark):
    nodes = spark.createDataFrame([(-5, [1.0, 0.0]), (3, [0.6, 0.8])], "node_id long, emb array<double>")
    queries = spark.createDataFrame([(-5, [1.0, 0.0]), (3, [1.0, 0.0])], "query_id long, emb array<double>")
    found = {(r.query_id, r.node_id): (round(r.sim, 6), r.rk) for r in retrieval.top_nodes(queries, nodes, 5).collect()}
    assert found == {(-5, -5): (1.0, 1), (-5, 3): (0.6, 2), (3, -5): (1.0, 1), (3, 3): (0.6, 2)}


def test_pruned_search_finds_what_a_plain_one_finds(spark):
    """Every simple path of a random graph between better and worse seeds, with and without the limit."""
    import random

    rng = random.Random(3)
    weights = {(a, b): round(rng.uniform(0.3, 1), 3) for a in range(14) for b in range(14) if a != b and rng.random() < 0.25}
    edges = edges_of(spark, [(a, b, w) for (a, b), w in weights.items()])
    rank = {(r.src, r.dst): r.nbr_rank for r in edges.collect()}
    seeds = [4, 9, 0, 12]

    def walk(path, hops):
        if len(path) > 1:
            yield path
        if hops:
            for b in sorted((b for a, b in weights if a == path[-1]), key=lambda b: rank[path[-1], b]):
                if b not in path:
                    yield from walk([*path, b], hops - 1)

    for limit, hops in ((None, 4), (3, 4), (2, 1)):
        c = EngineConfig(sim_threshold=0.1, prune_thresh=0.05, max_paths_per_pair=limit)
        want = {}
        for i, a in enumerate(seeds):
            for b in seeds[i + 1 :]:
                for path in [p for p in walk([a], hops) if p[-1] == b][:limit]:
                    score = 0.8 ** (len(path) - 1)
                    for e in zip(path, path[1:]):
                        score *= weights[e]
                    if score >= 0.05:
                        want[tuple(path)] = round(score, 9)
        found = retrieval.simple_paths(seeds_of(spark, seeds), edges, hops, c).collect()
        assert {tuple(r.path): round(r.score, 9) for r in found} == want and len(found) == len(want)


def test_graphs_are_kept_apart(spark):
    """Two graphs with the same node ids in one retrieval."""
    nodes = spark.createDataFrame([(g, i, f"{g}{i}", [1.0, 0.1 * i]) for g in ("a", "b") for i in range(3)], "graph_id string, node_id long, text string, emb array<double>")
    edges = spark.createDataFrame([("a", 0, 1, 0.9, 1), ("b", 0, 2, 0.8, 1)], "graph_id string, src long, dst long, weight double, nbr_rank int")
    asked = spark.createDataFrame([(1, "q", "a", [1.0, 0.0]), (2, "q", "b", [1.0, 0.0])], "query_id long, query string, graph_id string, emb array<double>")
    from chunkgraph.plans import pipeline

    found = pipeline.retrieve(asked, nodes, edges, 3, 2, EngineConfig(sim_threshold=0.1)).collect()
    assert {(r.query_id, r.full_text) for r in found} == {(1, "a0 → a1"), (2, "b0 → b2")}


def test_groups_are_joined_in_blocks(spark, monkeypatch):
    """Clusters larger than a block, and small ones, against all pairs."""
    import numpy as np

    from chunkgraph.functions import vectors

    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x, cluster = rng.standard_normal((90, 8)), np.array([0] * 60 + [1] * 20 + [2] * 9 + [-3])
    rows = spark.createDataFrame([(i - 40, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, cluster))], "node_id long, emb array<double>, cluster long").repartition(5)
    s = x @ x.T
    want = {(i - 40, j - 40) for i in range(90) for j in range(90) if i != j and cluster[i] == cluster[j] and s[i, j] > 0.5}
    found = vectors.similarity_join(rows, rows, 0.5, inclusive=False, group="cluster").collect()
    assert {(r.src, r.dst) for r in found} == want and len(found) == len(want)
    best = vectors.similarity_join(rows, rows, float("-inf"), inclusive=True, k=3, group="cluster").collect()
    for i in range(90):
        near = sorted((j for j in range(90) if j != i and cluster[j] == cluster[i]), key=lambda j: (-s[i, j], j))[:3]
        assert [r.dst + 40 for r in sorted((r for r in best if r.src == i - 40), key=lambda r: r.nbr_rank)] == near


def test_inputs_are_checked(spark):
    nodes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "node_id long, emb array<double>")
    assert retrieval.check_nodes(nodes) == 2
    for bad in ([], [(0, None)], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [])]):
        with pytest.raises(ValueError):
            retrieval.check_nodes(spark.createDataFrame(bad, nodes.schema))
    asked = "query_id long, query string, emb array<double>"
    retrieval.check_queries(spark.createDataFrame([(0, "q", [1.0, 0.0])], asked), 3, 2)
    for row, top_k in (((0, " \u00a0", [1.0, 0.0]), 3), ((0, None, [1.0, 0.0]), 3), ((0, "q", [1.0]), 3), ((0, "q", None), 3), ((0, "q", [1.0, 0.0]), 0)):
        with pytest.raises(ValueError):
            retrieval.check_queries(spark.createDataFrame([row], asked), top_k, 2)
    edges = edges_of(spark, [(0, 1, 0.9)])
    with pytest.raises(ValueError):
        retrieval.simple_paths(seeds_of(spark, [0, 7]), edges, 2, EngineConfig(), nodes)
    with pytest.raises(ValueError):
        retrieval.simple_paths(seeds_of(spark, [0, 1]), edges, 0, EngineConfig())


def test_flow(spark):
    flow = lambda w: spark.createDataFrame([(w,)], "w array<double>").select(retrieval.flow(F.col("w"), 0.8).alias("x")).first().x
    assert round(flow([0.9, 0.8]), 6) == 0.4608 and flow([]) == 0 and flow([0.5, None]) == 0


def test_prompt_budget(spark):
    q = spark.createDataFrame([(0, "q"), (1, "none")], "query_id long, query string")
    paths = spark.createDataFrame([(0, i, 0.5, "x" * 1200) for i in range(1, 12)], "query_id long, path_rank int, score double, full_text string")
    got = {r.query_id: r for r in prompts.evidence_prompts(q, paths).collect()}
    lines = "\n".join(f"{i}. [Score: 0.500] {'x' * 1200}" for i in (1, 2, 3))
    assert got[0].prompt == f"QUERY: q\n\nRELATED EVIDENCE PATHS:\n{lines}\n... (7 more paths truncated)" and got[0].n_paths == 10
    assert (got[1].n_paths, got[1].prompt) == (0, "QUERY: none\n\nRELATED EVIDENCE PATHS:")
    # exactly at the limit: the header's 33 characters and a line of 18 + 100
    short = spark.createDataFrame([(0, 1, 0.5, "y" * 100)], paths.schema)
    for limit, shown in ((151, True), (150, False)):
        text_ = [r.prompt for r in prompts.evidence_prompts(q, short, max_length=limit).collect() if r.query_id == 0][0]
        assert ("y" * 100 in text_) is shown and text_.endswith("(1 more paths truncated)") is not shown


def test_whole_texts_in_prompts_and_previews_beside(spark):
    nodes = spark.createDataFrame([(0, "a" * 200), (1, "b" * 50)], "node_id long, text string")
    paths = spark.createDataFrame([(0, [0, 1, 2])], "query_id long, path array<long>")
    r = retrieval.path_texts(paths, nodes).first()
    assert r.full_text == "a" * 200 + " → " + "b" * 50 + " → Node_2"
    assert r.path_text == "a" * 50 + "... → " + "b" * 50 + " → Node_2"


def test_dual_context(spark):
    context = prompts.dual_context(F.col("a"), F.col("b"), F.lit("why?"))
    opening = 'You are a knowledgeable and professional AI assistant. A user has asked the following question:\n\nQuestion: "why?"\n\n'
    rule, closing = "\n\n" + "=" * 50, "\n\nPlease provide a comprehensive, accurate, and helpful response to the user's question."
    based = opening + "Based on the following relevant information:\n\n" + rule
    assert one(spark, context, a=" u\n", b="m") == based + "RELEVANT INFORMATION FROM USER DOCUMENTS:\nu\n\nRELEVANT GENERAL KNOWLEDGE:\nm" + closing
    assert one(spark, context, a="", b="m") == based + "RELEVANT GENERAL KNOWLEDGE:\nm" + closing
    assert one(spark, context, a=None, b=" ") == opening + prompts.NO_CONTEXT


def test_rag_prompt(spark):
    assert one(spark, prompts.rag_prompt(F.col("c"), F.col("q")), c="ctx", q="why?") == f"SYSTEM: {prompts.SYSTEM}\n\nCONTEXT: ctx\n\nUSER QUESTION: why?\n\nASSISTANT:"
    assert one(spark, prompts.extractive_answer(prompts.rag_prompt(F.col("c"), F.col("q"))), c="ctx\n\nmore", q="why?") == "ctx\n\nmore"


def test_sizes_and_json():
    import numpy as np

    class Thing:
        def __init__(self):
            self.a, self.b = np.float32(0.5), {1, 1}

    assert text.json_ready({1: b"a\xff", "x": np.arange(3), "y": (np.int64(4), Thing()), "z": None}) == {"1": "a\ufffd", "x": [0, 1, 2], "y": [4, {"a": 0.5, "b": [1]}], "z": None}


def test_size_text(spark):
    assert one(spark, text.size_text(F.col("n")), n=1610612736.0) == "File size: 1.50 GB" and one(spark, text.size_gb(F.col("n")), n=536870912.0) == 0.5


def test_first_text_and_accepted_ocr(spark):
    rows = spark.createDataFrame([(" ", "None", " x "), ("{}", None, "null"), ("a", "b", "c")], "p string, q string, r string")
    assert [r.t for r in rows.select(split.first_text(F.col("p"), F.col("q"), F.col("r")).alias("t")).collect()] == ["x", None, "a"]
    results = spark.createDataFrame([("i", " t ", 10.5), ("j", "u", 10.0), ("k", " ", 99.0)], "file string, text string, confidence double")
    assert [(r.file, r.text) for r in split.accepted_ocr(results).collect()] == [("i", "t")]


def test_text_of_any_chunk(spark):
    shape = "a string, b struct<text:string,content:string>, c map<string,string>, d array<string>, e struct<x:int>"
    rows = spark.createDataFrame([(" t ", ("x", " "), {"page_content": "p", "text": "null"}, ["q"], (1,)), ("None", ("x", "y"), {"k": "v"}, None, None)], shape)
    found = rows.select(*[split.text_of(rows, c).alias(c) for c in rows.columns]).collect()
    assert [tuple(r) for r in found] == [("t", "x", "p", '["q"]', '{"x":1}'), (None, "y", '{"k":"v"}', None, None)]


def test_limits_can_be_none(spark):
    nodes = spark.createDataFrame([(i, [1.0, i / 150]) for i in range(150)], "node_id long, emb array<double>")
    assert graphs.capped(nodes, 10).count() == 10 and graphs.capped(nodes, None).count() == 150
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, emb array<double>")
    assert retrieval.top_nodes(asked, nodes, 120).count() == 100 and retrieval.top_nodes(asked, nodes, 120, None).count() == 120
    c = EngineConfig(max_graph_size=None, max_candidates=None, sim_threshold=0.1, k=2)
    assert graphs.build(nodes, "knn", c).select("src").distinct().count() == 150


def test_golden_chunks(spark):
    """Pieces of a small text, written out."""
    words = "".join(f"word{i:02d} " for i in range(30))
    rows = spark.createDataFrame([(1, f"{words}\n\n{words}"), (2, "short"), (3, "  \n "), (4, None)], "doc_id long, text string")
    found = [(r.doc_id, r.chunk_index, r.chunk, r.size) for r in split.chunk_documents(rows, size=120, overlap=20).orderBy("doc_id", "chunk_index").collect()]
    first = [" ".join(f"word{i:02d}" for i in range(a, b)) for a, b in ((0, 17), (15, 30))]
    assert [f[2] for f in found if f[0] == 1] == first * 2 and found[-1] == (2, 0, "short", 5)
    assert split.split_markdown("intro\n# A\nx\n\ny\n## B\n```\n# no\n```\n# C\n") == [("No Title", "intro"), ("A", "x  \ny"), ("A / B", "```\n# no\n```")]


def test_outcomes_and_reports(spark):
    rows = spark.createDataFrame([("success",), ("failed",), (None,), ("success",)], "status string")
    r = stats.insert_report(stats.outcome_counts(rows)).first()
    assert (r.total, r.success_count, r.failed_count, r.message) == (4, 2, 2, "Chunking complete: 2 inserted, 2 failed.")
    assert stats.insert_report(stats.outcome_counts(rows.limit(0))).first().message == "No chunks generated from the input path."


def test_health_has_every_state(spark):
    rows = spark.createDataFrame([(10, 1.0), (95, 1.0), (10, 3.9), (95, 3.9)], "n_nodes long, memory double")
    found = stats.health(rows, F.col("memory"), EngineConfig(max_graph_size=100)).collect()
    assert [(r.n_issues, r.issues, r.status) for r in found] == [(0, "", "healthy"), (1, "nodes", "warning"), (1, "memory", "warning"), (2, "memory,nodes", "warning")]


def test_edges_added_and_kept(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "node_id long")
    one_, two = edges_of(spark, [(0, 1, 0.9)]), edges_of(spark, [(0, 1, 0.8), (1, 2, 0.7)])
    r = stats.graph_metrics(nodes, one_.unionByName(two).dropDuplicates(["src", "dst"]), one_.unionByName(two)).first()
    assert (r.n_nodes, r.n_edges, r.edges_added, round(r.avg_degree, 4)) == (3, 2, 3, 1.3333)


def test_metrics_and_session(spark):
    from chunkgraph.operators.runtime import METRICS, Metrics, RetrievalCache, session
    from chunkgraph.scratch import Scratch

    m = Metrics()
    assert set(m.report()) == set(METRICS)
    with pytest.raises(ZeroDivisionError), m.timed("retrieval_time"):
        1 / 0
    assert m.report()["retrieval_time"] > 0
    m.put("nodes_processed", 3)
    rows, seen = m.observe(spark.range(5), "edges_created")
    rows.collect()
    m.take(seen, "edges_created")
    assert (m.report()["nodes_processed"], m.report()["edges_created"]) == (3, 5)
    with pytest.raises(KeyError), m.timed("none"):
        pass
    cache, kept, scratch = RetrievalCache(), spark.range(3).persist(), Scratch(spark, "session")
    cache.put("g", 1, "q", 5, [1])
    written = scratch.write(kept, "x")
    with session(cache, kept, scratch=scratch):
        assert written.count() == 3
    assert not cache.entries and not kept.is_cached
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.path}/x").count()


def test_embedded_queries(spark):
    from chunkgraph.plans import pipeline

    rows = spark.createDataFrame([(0, "two words")], "query_id long, query string")
    v = pipeline.embed_queries(rows).first().emb
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-6
    with pytest.raises(ValueError):
        pipeline.embed_queries(spark.createDataFrame([(0, " ")], rows.schema))


def test_clusters_are_of_all_nodes(spark):
    """k-means and spectral edges stay within their clusters, found again from the same labels."""
    import numpy as np

    from chunkgraph.functions.vectors import nodes_of

    rng = np.random.default_rng(8)
    centres = np.eye(6)[:4] * 5
    x = np.concatenate([c + rng.standard_normal((15, 6)) * 0.2 for c in centres])
    n = nodes_of(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"))
    c = EngineConfig(sim_threshold=0.3, k=4, n_clusters=4, inter_centroid=1.0)
    labels = {r.node_id: r.cluster for r in graphs.clusters(n, 4, c.seed).collect()}
    assert len(labels) == 60 and all(len({labels[i] for i in range(b, b + 15)}) == 1 for b in range(0, 60, 15)) and len(set(labels.values())) == 4
    for edges in (graphs.hierarchical(n, c), graphs.spectral(n, EngineConfig(sim_threshold=0.3, k=4, n_clusters=8))):
        assert {r.src // 15 == r.dst // 15 for r in edges.collect()} == {True}


def test_ocr_cascade(spark):
    rows = [("i", "a", "t", 30.0), ("i", "b", "u", 20.1), ("j", "a", "t", 30.1), ("j", "b", "u", 99.0), ("k", "a", "t", 1.0), ("k", "c", "v", 2.0)]
    found = stats.ocr_cascade(spark.createDataFrame(rows, "image string, engine string, text string, confidence double"), "a", ["b", "c"])
    assert {r.image: (r.engine, r.accepted) for r in found.collect()} == {"i": ("b", True), "j": ("a", True), "k": ("c", False)}


def test_graph_invariants(spark):
    from chunkgraph.functions.vectors import nodes_of

    vectors = [(i, [float(i * 7 % 5 - 2), float(i % 3), 1.0]) for i in range(30)] + [(30, [0.0, 0.0, 0.0]), (31, None)]
    n = nodes_of(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    c = EngineConfig(sim_threshold=0.3, k=4, n_clusters=3)
    for name in graphs.METHODS:
        e = graphs.build(n, name, c).toPandas()
        assert (e.src != e.dst).all() and (e.weight >= 0.3 - 1e-12).all(), name
        assert not e.duplicated(["src", "dst"]).any(), name
    assert graphs.build(n, "knn", c).groupBy("src").count().agg(F.max("count")).first()[0] <= 4


def test_lsh_ranks_all_nodes_by_codes_of_whole_vectors(spark):
    import numpy as np

    from chunkgraph.functions.vectors import nodes_of

    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 384))
    x[60:, 64:] = x[:60, 64:]  # pairs that are alike beyond the first 64 components only
    x[60:, :64] = -x[:60, :64]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = EngineConfig(sim_threshold=0.1, k=4)
    found = {(r.src, r.dst) for r in graphs.build(nodes_of(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")), "lsh", c).collect()}
    side = x @ graphs.plane_signs(384, 128, c.seed) >= 0
    assert abs(graphs.plane_signs(384, 128, c.seed).mean()) < 0.02
    apart = (side[:, None] != side[None]).sum(2)
    want = set()
    for i in range(120):
        nearest = sorted((int(apart[i, j]), j) for j in range(120) if j != i)[:4]
        want |= {(i, j) for _, j in nearest if x[i] @ x[j] > 0.1}
    assert found == want and len({(i, i + 60) for i in range(60)} - found) <= 1


def test_spectral_clusters_by_all_positive_similarities(spark, monkeypatch):
    import numpy as np

    from chunkgraph.functions.vectors import nodes_of

    x = np.random.default_rng(4).standard_normal((40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen = {}

    class Clustering(graphs.PowerIterationClustering):
        def assignClusters(self, edges):
            seen["pairs"] = {(r.src, r.dst) for r in edges.collect()}
            return super().assignClusters(edges)

    monkeypatch.setattr(graphs, "PowerIterationClustering", Clustering)
    graphs.spectral(nodes_of(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")), EngineConfig(sim_threshold=0.7, k=3)).count()
    assert seen["pairs"] == {(i, j) for i in range(40) for j in range(40) if i != j and x[i] @ x[j] > 1e-9}


def _unit_rows(spark, x):
    return spark.createDataFrame([(i - 7, v.tolist()) for i, v in enumerate(x)], "node_id long, emb array<double>")


@pytest.mark.parametrize("held", [8192, 100])
def test_few_queries_are_held_and_nodes_stay(spark, monkeypatch, held):
    """What is sent are the best of each task; the nodes are in no exchange."""
    import numpy as np

    from chunkgraph.functions import vectors

    monkeypatch.setattr(vectors, "HELD", held)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    nodes = _unit_rows(spark, x).repartition(6).persist()
    asked = nodes.filter("node_id in (0, 1, 5)").select(F.col("node_id").alias("query_id"), "emb")
    found = retrieval.top_nodes(asked, nodes, 4)
    # one scan of the nodes, in no exchange before the products
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan.split("MapInArrow")[1]
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rk, r.node_id, round(r.sim, 9)))
    for q in (0, 1, 5):
        s = x @ x[q + 7]
        best = sorted(range(300), key=lambda j: (-s[j], j))[:4]
        assert sorted(got[q]) == [(k + 1, j - 7, round(s[j], 9)) for k, j in enumerate(best)]
    nodes.unpersist()


def test_far_cells_are_not_sent(spark, monkeypatch):
    """Two large sides go by cells around pivots: the same pairs, and no row goes where it has no partner."""
    import numpy as np

    from chunkgraph.functions import vectors

    monkeypatch.setattr(vectors, "HELD", 10)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(8), 30, axis=0) + 0.05 * rng.standard_normal((240, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = _unit_rows(spark, x)
    s = x @ x.T
    for inclusive, k in ((False, None), (True, 5)):
        found = vectors.similarity_join(rows, rows, 0.7, inclusive, k=k).collect()
        want = set()
        for i in range(240):
            near = sorted((j for j in range(240) if j != i and s[i, j] > 0.7), key=lambda j: (-s[i, j], j))[:k]
            want |= {(i - 7, j - 7) for j in near}
        assert {(r.src, r.dst) for r in found} == want and len(found) == len(want)
    own, sent, blocks = vectors.pivot_blocks(rows, rows, 0.7)
    assert own.count() == 240 and sent.count() < 240 * blocks / 3
    assert vectors.pivot_blocks(rows, rows, -2.0)[1].count() == 240 * blocks


def test_codes_are_bits(spark):
    import numpy as np

    from chunkgraph.functions import vectors

    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (40, 16), np.uint8)
    rows = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "node_id long, emb binary")
    far = np.array([[int(np.unpackbits(a ^ b).sum()) for b in codes] for a in codes])
    for r in vectors.similarity_join(rows, rows, -128.0, True, k=3).collect():
        near = sorted((j for j in range(40) if j != r.src), key=lambda j: (far[r.src, j], j))[r.nbr_rank - 1]
        assert (r.dst, r.weight) == (near, 128 - 2 * far[r.src, near])


@pytest.mark.parametrize("hops", [1, 2, 3, 4, 5])
def test_search_meets_in_the_middle(spark, monkeypatch, hops):
    """All simple paths up to the limit in depth-first order, also where stems are completed in many rounds."""
    import random

    rng = random.Random(hops)
    monkeypatch.setattr(retrieval, "FIRST_STEMS", 3)
    weights = {(a, b): round(rng.uniform(0.5, 1), 3) for a in range(11) for b in range(11) if a != b and rng.random() < 0.45}
    edges = edges_of(spark, [(a, b, w) for (a, b), w in weights.items()])
    after = {}
    for r in sorted(edges.collect(), key=lambda r: r.nbr_rank):
        after.setdefault(r.src, []).append(r.dst)

    def walk(path, left):
        if len(path) > 1:
            yield path
        for b in after.get(path[-1], []) if left else []:
            if b not in path:
                yield from walk([*path, b], left - 1)

    seeds, c = [3, 8, 1], EngineConfig(sim_threshold=0.1, prune_thresh=0.0, max_paths_per_pair=4)
    want = {tuple(p) for i, a in enumerate(seeds) for b in seeds[i + 1 :] for p in [p for p in walk([a], hops) if p[-1] == b][:4]}
    found = retrieval.simple_paths(seeds_of(spark, seeds), edges, hops, c).collect()
    assert {tuple(r.path) for r in found} == want and len(found) == len(want)


def test_left_out_nodes_are_told(spark):
    nodes = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(6)], "node_id long, emb array<double>")
    with pytest.warns(UserWarning, match="leaves out 2 nodes"):
        edges = graphs.build(nodes, "knn", EngineConfig(sim_threshold=0.1, max_graph_size=4))
    assert {r.src for r in edges.collect()} == {0, 1, 2, 3}
