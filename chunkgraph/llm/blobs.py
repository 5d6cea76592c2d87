"""Moves numpy columns through a shuffle as one compressed binary row for each task and bucket."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "bucket int, rows long, blob binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("rows", pa.int64()), ("blob", pa.binary())])


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes first; that packs better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""


def pack(*columns: np.ndarray) -> bytes:
    """Columns as bytes; 64-bit ones that ascend go as differences."""
    parts = [struct.pack("<B", len(columns))]
    for c in columns:
        c = np.ascontiguousarray(c)
        kind = c.dtype.str[1:3].encode()
        if kind in _RISING and len(c) > 1 and (c[1:] >= c[:-1]).all():
            kind, c = _RISING[kind], np.concatenate([c[:1], c[1:] - c[:-1]])
        parts.append(struct.pack("<2sQ", kind, len(c)))
        parts.append(_planes(c))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


_RISING = {b"u8": b"U8", b"i8": b"I8"}


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 1, []
    for _ in range(raw[0]):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        at += 10
        dtype = np.dtype("<" + kind.decode().lower())
        flat = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at)
        at += n * dtype.itemsize
        c = np.ascontiguousarray(flat.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype) if n else np.zeros(0, dtype)
        out.append(np.cumsum(c, dtype=dtype) if kind in _RISING.values() else c)
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 64-bit keys that are spread evenly; buckets are ranges of the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each bucket that has any."""
    by = np.argsort(bucket, kind="stable")
    ids, first = np.unique(bucket[by], return_index=True)
    for b, x, y in zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), len(by)]):
        yield b, [c[by[x:y]] for c in columns]


class Outbox:
    """Gathers rows by bucket and hands out record batches of blobs once ``limit`` rows are held."""

    def __init__(self, buckets: int, limit: int = 1 << 20, merge: Callable[..., list[np.ndarray]] | None = None):
        self.buckets, self.limit, self.merge, self.held, self.size = buckets, limit, merge, [], 0

    def put(self, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((bucket, *columns))
        self.size += len(bucket)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            self.held = []
            return
        whole = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.size = [], 0
        if self.merge:
            whole = self.merge(*whole)
        rows = [(b, len(c[0]), pack(*c)) for b, c in split(*whole)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def exchange(df: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's blobs in a partition of its own."""
    from pyspark.sql import functions as F

    return df.repartitionById(buckets, F.col("bucket"))


def gather(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """All rows of a bucket's partition, column by column."""
    parts = [unpack(x) for batch in batches for x in batch.column(batch.schema.get_field_index("blob")).to_pylist()]
    return [np.concatenate(c) for c in zip(*parts)] if parts else None
