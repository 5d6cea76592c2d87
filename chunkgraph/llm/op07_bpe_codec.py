"""BPE encoding and decoding by speculate and verify.

Greedy longest matches propose the tokens of every distinct piece, array comparisons test all adjacent pairs, and
only pieces that fail a test are merged exactly. No shuffle: a map over the documents. A worker holds the
vocabulary, its piece cache (about half a million pieces) and about a megabyte of text at a time.

Defined cases: a null text counts as empty (no tokens, the hash of no bytes); one output row for each input row,
repeated or not, null ids included; texts of any length are encoded whole; an empty table gives an empty result;
columns beyond the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PieceCache, Speculative, Vocabulary, per_document
from .textops import binary_column, chunks, list_column, ragged_take


class Codec:
    """Encodes and decodes whole texts of one tokenizer file."""

    def __init__(self, spec: str):
        self.vocabulary = Vocabulary(spec)
        self.speculative = Speculative(self.vocabulary)
        self.cache = PieceCache(self.speculative.encode)
        self.specials = [t.encode() for t in self.vocabulary.specials]
        sizes = np.array([len(t) for t in self.vocabulary.tokens], np.int64)
        self.token_bytes = np.frombuffer(b"".join(self.vocabulary.tokens), np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.token_size = sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return per_document(data, offsets, self.cache, self.specials)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all documents one after the other, offsets)."""
        size = self.token_size[ids]
        out = self.token_bytes[ragged_take(self.token_at[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return out, ends[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(2)
def codec(spec: str) -> Codec:
    return Codec(spec)


def _text(raw: bytes) -> bytes:
    """The UTF-8 of what a decoder shows: bytes that are no UTF-8 become U+FFFD."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()


def encode(docs: DataFrame, tokenizer_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array<int>) and ``n_tokens``; columns of docs with these names are replaced, all others stay."""
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    kept = docs.drop(ids, "n_tokens")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields)}, `{ids}` array<int>, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(batch.schema.get_field_index(text))):
                flat, counts = c.encode(data, offsets)
                own = [x.slice(a, b - a) for x in batch.columns]
                yield pa.RecordBatch.from_arrays([*own, list_column(pa.array(flat.astype(np.int32)), counts), pa.array(counts)], names=[*batch.schema.names, ids, "n_tokens"])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replaces ``ids`` with the decoded ``text``; a null list stays null. Other columns stay."""
    spec = encoded.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    kept = [f for f in encoded.schema.fields if f.name not in (ids, text)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            out = []
            for x in batch.column(batch.schema.get_field_index(ids)):
                if x.is_valid:
                    own = np.asarray(x.values, np.int64) if len(x) else np.zeros(0, np.int64)
                    out.append(_text(c.decode(own, np.array([len(own)]))[0].tobytes()).decode())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(out, pa.string())], names=[*(f.name for f in kept), text])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                flat, counts = c.encode(data, offsets)
                raw, ends = c.decode(flat, counts)
                wire, decoded = flat.astype("<u4").tobytes(), raw.tobytes()
                at = (np.concatenate([[0], np.cumsum(counts)]) * 4).tolist()
                own = [hashlib.sha256(wire[x:y]).hexdigest() for x, y in zip(at, at[1:])]
                ends = ends.tolist()
                shown = [hashlib.sha256(_text(decoded[x:y])).hexdigest() for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), pa.array(own), pa.array(shown)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


__all__ = ["Codec", "binary_column", "codec", "decode", "digests", "encode"]
