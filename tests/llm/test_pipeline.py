"""The pipeline's stages against plain code, and the cases that they define."""

import itertools
from collections import Counter

import pytest

from chunkgraph.llm import op10_toxicity_mil

from test_pairs import brute_components, brute_hits, words_of

pipeline = pytest.importorskip("corpus_pipeline")
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "bucket", "cls", "spans", "c0_"]


@pytest.fixture(scope="module")
def tables(spark, docs, rows, tmp_path_factory):
    """Documents with null ids, null texts, repeated rows and columns that operators use themselves."""
    d = str(tmp_path_factory.mktemp("pipeline"))
    insults = [(900 + i, f"plain words of number {i} and then zlowt zlowen grunk. " + f"more of {i} " * 8) for i in range(40)]
    more = spark.createDataFrame([(i, t, "en", "s", len(t), 0, "c", None, "z") for i, t in insults], docs.schema)
    docs.unionByName(more).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(i, 0, 1) for i, _ in insults], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[8][1].split()[2:20])), (2, None), (None, "one")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def counted(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, tables, tokenizer_file):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_copies", "passages", "decontaminate", "encode"]
    # toxicity: what the operator's own scores say
    scores = op10_toxicity_mil.toxicity(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()
    bad = {r.doc_id for r in scores if r.predicted and r.doc_id is not None}
    assert len(bad & set(range(900, 940))) >= 36 and not bad & set(range(50))
    kept = stages["toxicity"](spark, docs, tables)
    assert kept.columns == NAMES
    want = Counter({k: n for k, n in counted(docs).items() if k[0] not in bad})
    assert counted(kept) == want
    # near copies: components by brute force
    texts = {i: t for i, t in want if i is not None}
    best = {i for i, (_, c) in brute_components(texts).items() if c == i}
    once = stages["near_copies"](spark, kept, tables)
    assert once.columns == NAMES and counted(once) == Counter({k: n for k, n in want.items() if k[0] is None or k[0] in best})
    # passages: no run of 50 words is left in two documents, words that no other document has stay, the rest is as it was
    cut = stages["passages"](spark, once, tables).collect()
    assert [c for c in once.columns] == NAMES and Counter(r.doc_id for r in cut) == Counter(r.doc_id for r in once.collect())
    runs = lambda t: {tuple(w[i : i + 50]) for w in [words_of(t)] for i in range(len(w) - 49)}
    after = {r.doc_id: r for r in cut if r.doc_id is not None}
    for a, b in itertools.combinations(sorted(after), 2):
        assert not runs(after[a].text) & runs(after[b].text)
    before = {r.doc_id: r.text for r in once.collect()}
    shared = Counter(x for t in before.values() for x in runs(t))
    for i, r in after.items():
        if not any(shared[x] > 1 for x in runs(before[i])):
            assert r.text == before[i]
        assert r.n_chars is None or r.n_chars == len(r.text)
    # decontamination: by brute force
    stay = spark.createDataFrame(cut, once.schema)
    clean = stages["decontaminate"](spark, stay, tables)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect() if r.item_id is not None]
    assert clean.columns == NAMES and counted(clean) == Counter({(r.doc_id, r.text): n for r, n in Counter(cut).items() if not brute_hits(items, r.text)[1]})
    # encoding: the library
    library = Tokenizer.from_file(tokenizer_file)
    encoded = stages["encode"](spark, clean, tables).collect()
    ids = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for (i, t), n in counted(clean).items() for _ in range(n))
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded) == ids and all(r.n_tokens == len(r.ids) for r in encoded)
    # and the whole
    assert Counter((r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, tables).collect()) == ids


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    # documents without labels and items: nothing is rejected but copies
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert counted(pipeline.toxicity(spark, docs, str(tmp_path))) == counted(docs) == counted(pipeline.decontaminate(spark, docs, str(tmp_path)))
