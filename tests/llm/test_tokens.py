import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkgraph.llm import bpe, op02_token_store, op07_bpe_codec, textops


@pytest.fixture(scope="session")
def library(tokenizer_file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file)


@pytest.fixture(scope="session")
def codec(tokenizer_file):
    return op07_bpe_codec.codec(open(tokenizer_file, encoding="utf-8").read())


def ids_of(codec, texts):
    out = []
    for _, _, data, offsets in textops.chunks(pa.array(texts, pa.string())):
        flat, counts = codec.encode(data, offsets)
        out += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("abest'rvlmd  \n\t!<|>019éß漢　\x85")), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=6))
def test_encodes_as_the_library(codec, library, texts):
    assert ids_of(codec, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_specials_and_contractions(codec, library):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "it's we'll I'd 's ''s 'S", "x  <|endoftext|>  y", "<|endoftext|" + "a" * 300, "<|endoftext|>" * 3, "abc" * 400]
    assert ids_of(codec, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_character_classes_are_those_of_the_library(library):
    split = library.pre_tokenizer.pre_tokenize_str
    kinds = bpe.character_classes()
    for c in [*range(0x20, 0x3000, 7), *range(0x10D40, 0x10D90), *range(0x1E5D0, 0x1E600), 9, 10, 13, 0x1C, 0x85, 0xA0, 0x3000]:
        x = chr(c)
        kind = 1 if len(split("a" + x + "a")) == 1 else 2 if len(split("1" + x + "1")) == 1 else 0 if len(split("!" + x + "!")) == 1 else 3
        assert kinds[c] == kind, hex(c)


def test_exact_merges_agree(codec):
    s = codec.speculative
    words = [w.encode() for w in ("hello", "aaaa", "aaaaa", "zqxjk", "unbelievable", "éß漢", "mississippi")]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    ids, counts = s.merge_many(data, ends - [len(w) for w in words], ends)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [s.merge(w) for w in words]


def test_digests(docs, rows, none, library, tokenizer_file):
    found = op07_bpe_codec.digests(docs, tokenizer_file).collect()
    assert len(found) == len(rows) + 2
    texts = {r[0]: r[1] for r in rows} | {None: "a row without an id"}
    for r in found:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert op07_bpe_codec.digests(none, tokenizer_file).count() == 0


def test_round_trip_keeps_columns(docs, tokenizer_file):
    encoded = op07_bpe_codec.encode(docs, tokenizer_file)
    assert encoded.columns == [*docs.columns, "ids", "n_tokens"]
    back = {r.doc_id: r.text for r in op07_bpe_codec.decode(encoded, tokenizer_file).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}


def test_columns_with_the_names_of_results_are_replaced(docs, tokenizer_file):
    from pyspark.sql import functions as F

    clash = docs.withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit("y"))
    encoded = op07_bpe_codec.encode(clash, tokenizer_file)
    assert encoded.columns == [*docs.columns, "ids", "n_tokens"]
    assert [(r.doc_id, r.ids) for r in encoded.orderBy("doc_id", "text").collect()] == [(r.doc_id, r.ids) for r in op07_bpe_codec.encode(docs, tokenizer_file).orderBy("doc_id", "text").collect()]


def test_store(spark, docs, rows, none, library, tokenizer_file, tmp_path):
    path = f"file://{tmp_path}/store"
    op02_token_store.write_store(docs, tokenizer_file, path)
    found = op02_token_store.read_digests(spark, path).orderBy("start").collect()
    texts = {r[0]: r[1] for r in rows} | {None: "a row without an id"}
    assert [r.doc_id for r in found] == sorted([r[0] for r in rows] + [10, None], key=lambda x: (x is not None, x))
    start = 0
    for r in found:
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for r in op02_token_store.read_ids(spark, path).collect():
        assert r.ids == [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
    head = [r for r in spark.read.parquet(f"{path}/manifest").collect() if r.part < 0]
    assert [(r.n_docs, r.n_tokens) for r in head] == [(len(found), start)]
    addresses = [a for r in spark.read.parquet(f"{path}/data").filter("kind = 'pack'").collect() for a in op02_token_store._leaves(r.addresses)]
    assert len(addresses) == len(set(addresses))
    op02_token_store.write_store(none, tokenizer_file, f"{path}-none")
    assert op02_token_store.read_digests(spark, f"{path}-none").count() == 0


def test_store_notices_changes(spark, docs, tokenizer_file, tmp_path):
    """A changed chunk, a lost or replaced recipe, a lost part and a changed manifest."""
    from pyspark.sql import functions as F

    path = f"file://{tmp_path}/store"
    op02_token_store.write_store(docs, tokenizer_file, path)
    whole = {x: spark.read.parquet(f"{path}/{x}") for x in ("data", "recipes", "manifest")}
    recipes, manifest = whole["recipes"], whole["manifest"]
    part = recipes.agg(F.max("part")).first()[0]
    flipped = F.when(F.col("kind") == "pack", F.expr("cast(concat(x'ffff', substring(ids, 3, 1 << 30)) as binary)"))
    last, pack = recipes.agg(F.max("start")).first()[0], whole["data"].agg(F.max("pack")).first()[0]
    changes = [
        ({"data": whole["data"].withColumn("ids", flipped)}, "address"),
        ({"recipes": recipes.filter(F.col("start") != last)}, "manifest"),
        ({"recipes": recipes.filter(F.col("start") != last).union(recipes.filter(F.col("start") == 0).withColumn("part", F.lit(part)).withColumn("start", F.lit(last)))}, "manifest"),
        ({"recipes": recipes.filter(F.col("part") != part)}, "parts"),
        ({"recipes": recipes.filter(F.col("part") != part), "manifest": manifest.filter(F.col("part") != part)}, "head"),
        ({"data": whole["data"].filter(F.col("pack").isNull() | (F.col("pack") != pack))}, "missing"),
    ]
    for k, (changed, word) in enumerate(changes):
        bad = f"{path}-bad-{k}"
        for name, df in (whole | changed).items():
            (df.write.partitionBy("kind") if name == "data" else df.write).parquet(f"{bad}/{name}")
        with pytest.raises(Exception, match=word):
            op02_token_store.read_digests(spark, bad).collect()


def test_store_of_a_wide_vocabulary(spark, tmp_path):
    """Ids beyond 16 bits are stored wider, which the files say."""
    import json

    import public_tokenizers

    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    wide = f"{tmp_path}/wide.json"
    json.dump(spec, open(wide, "w", encoding="utf-8"))
    texts = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    op02_token_store.write_store(texts, wide, f"file://{tmp_path}/store", end_id=70_000)
    assert {r.ids[-1] for r in op02_token_store.read_ids(spark, f"file://{tmp_path}/store").collect()} == {70_000}
    assert op02_token_store.read_digests(spark, f"file://{tmp_path}/store").count() == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=5))
def test_combined_crc(parts):
    size = np.array([len(p) for p in parts], np.int64)
    moved = op02_token_store.shifted_crc(np.array([zlib.crc32(p) for p in parts], np.uint32), size.sum() - np.cumsum(size))
    assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(b"".join(parts))


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50_000, 4000)
    cut = lambda ids: op02_token_store.cut_points(ids, np.array([len(ids)]))
    one, two = cut(passage), cut(np.concatenate([rng.integers(0, 50_000, 333), passage])) - 333
    assert len(set(one.tolist()) & set(two.tolist())) > 0.6 * len(one)
