import tracemalloc
from collections import defaultdict

from pyspark.sql import functions as F

from chunkgraph.functions import split


def test_pieces_of_a_long_text_are_never_one_array():
    for text, cut in (("word " * 200_000, split.text_pieces), ("x" * 400_000, split.text_pieces), ("a line of words\n" * 60_000, split.text_pieces), ("# a\ntext\n\n# b\nmore\n" * 40_000, split.markdown_pieces)):
        tracemalloc.start()
        n = sum(1 for _ in cut(text))
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert n > 600 and peak < 200_000


def test_segments_begin_with_the_separator():
    for text in ("", "a", "\n\na\n\n\n\nb\n\n", "\n\n", "a\n\nb"):
        head, *rest = text.split("\n\n")
        assert list(split._segments(text, "\n\n")) == [p for p in [head, *("\n\n" + r for r in rest)] if p]


def test_batches_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(split, "BATCH_PIECES", 5)
    texts = {1: "word " * 900, 2: None, 3: "", 4: "one", 5: "# a\n" + "text " * 300 + "\n## b\nc", 6: " \n "}
    docs = spark.createDataFrame([(i, t, t, [i, i + 1], None) for i, t in texts.items()], "doc_id long, text string, title string, tags array<int>, chunk_index string").repartition(2)
    sizes = docs.select("doc_id", "text").transform(lambda d: split.pieces_of(d, "text", lambda t: ((p,) for p in split.text_pieces(t, 120, 20)), ["chunk"]))
    got = defaultdict(list)
    for r in sizes.collect():
        got[r.doc_id].append((r.chunk_index, r.chunk))
    assert {i: [c for _, c in sorted(v)] for i, v in got.items()} == {i: split.split_text(t, 120, 20) for i, t in texts.items() if t and split.split_text(t, 120, 20)}
    assert all([k for k, _ in sorted(v)] == list(range(len(v))) for v in got.values())
    told = split.chunk_documents(docs.drop("title", "chunk_index"), size=120, overlap=20)
    assert told.columns == ["doc_id", "tags", "chunk_index", "chunk", "size"] and {(r.doc_id, tuple(r.tags)) for r in told.collect()} == {(1, (1, 2)), (4, (4, 5)), (5, (5, 6))}
    marked = split.chunk_markdown(docs.select("doc_id", F.col("text").alias("body")), "body", 120, 20)
    assert marked.columns == ["doc_id", "chunk_index", "title", "chunk", "size"]
    assert {(r.doc_id, r.chunk_index, r.title, r.chunk) for r in marked.collect()} == {(i, k, a, b) for i, t in texts.items() if t for k, (a, b) in enumerate(split.split_markdown(t, 120, 20))}
