"""Token-id output as a content-addressed store.

Id streams are cut where a rolling hash of the last ids meets a mask, so equal passages give equal chunks wherever
they stand. A chunk's address is the hash of its ids; each address is stored once, in the pack of its address range.
A document's recipe lists the addresses of its chunks in order; its Merkle root covers them. The manifest has, for
each part, the Merkle root over the roots and starts of its recipes, and a head row with the root over all parts.
Reading recomputes addresses, document roots, part roots and the head, and fails on any difference.

Layout under the store's folder (Parquet, written by Spark alone):
  data/kind=pack/  pack, n, addresses, lengths, ids, width: one row for each pack; ids are little-endian, of as many
            bytes as width says (2 where the vocabulary allows, else 4)
  recipes/  part, doc_id, start, n_tokens, addresses, lengths, root: ascending by doc_id
  manifest/ part, n_docs, n_tokens, root; the head has part -1 and counts all parts

Skew: chunks are spread by address and equal ones are folded within a task before the shuffle, so a group of
copies adds one chunk for each task. The recipes of a part are rows of a range of doc_id. Numbers of packs and
parts follow the bytes of the input.

Reading sends the entries of recipes to the packs that hold their chunks and brings back a checksum for each entry;
checksums are put together by document (a document's entries are a small part of its text).

Defined cases: a null text is empty, and still has its end id; rows with a null doc_id come first; rows that share
a doc_id are ordered by number of tokens, then root; texts of any length are stored whole; an empty table gives an
empty store; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blobs
from .bpe import PieceCache, library_encoder, per_document
from .storage import Scratch, buckets_for, release
from .textops import binary_column, chunks, give_back, mix, ragged_take

ADDRESS = 16
WINDOW, LEAST, MOST, MASK = 16, 64, 4096, 255  # ids: rolling window, bounds of a chunk, cut when hash & MASK == 0
CACHE = 1_000_000  # distinct pieces that a worker remembers
_U = np.uint64


@lru_cache(2)
def _cache(spec: str) -> PieceCache:
    return PieceCache(library_encoder(spec), most=CACHE)


def cut_points(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of id streams that stand one after the other; ends: where each stream ends."""
    n = len(ids)
    value = mix(ids.astype(_U) + _U(0x5851F42D4C957F2D))
    total = np.zeros(n + 1, _U)
    np.cumsum(value * _odd_powers(n), out=total[1:])
    w = min(WINDOW, n)
    rolling = mix((total[w:] - total[: n + 1 - w]) * _odd_inverses(n + 1)[: n + 1 - w])
    candidates = np.flatnonzero(rolling & _U(MASK) == 0) + w
    out, last, k = [], 0, 0
    candidates, m = candidates.tolist(), len(candidates)
    for end in ends.tolist():
        start = last
        while k < m and candidates[k] < end:
            c = candidates[k]
            k += 1
            if c - start >= WINDOW and c - last >= LEAST:
                while c - last > MOST:
                    last += MOST
                    out.append(last)
                last = c
                out.append(last)
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end > last:
            last = end
            out.append(last)
    return np.array(out, np.int64)


_ODD = 0xC2B2AE3D27D4EB4F
_tables: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        p = np.full(max(n, 1 << 19), base, _U)
        p[0] = 1
        _tables[name] = np.cumprod(p, dtype=_U)
    return _tables[name][:n]


def _odd_powers(n: int) -> np.ndarray:
    return _table("powers", _ODD, n)


def _odd_inverses(n: int) -> np.ndarray:
    return _table("inverses", pow(_ODD, -1, 1 << 64), n)


def address(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=ADDRESS).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a leaf without a partner goes up as it is."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=ADDRESS).digest()
    while len(leaves) > 1:
        pairs = [hashlib.blake2b(a + b, digest_size=ADDRESS, person=b"node").digest() for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = pairs + ([leaves[-1]] if len(leaves) % 2 else [])
    return leaves[0]


def _leaves(raw: bytes) -> list[bytes]:
    return [raw[i : i + ADDRESS] for i in range(0, len(raw), ADDRESS)]


FLOW = "bucket int, blob binary, doc_id long, n_tokens long, addresses binary, lengths binary, root binary"
_FLOW = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("addresses", pa.binary()), ("lengths", pa.binary()), ("root", pa.binary())])
DATA = "kind string, pack int, n long, ids binary, width int, doc_id long, n_tokens long, addresses binary, lengths binary, root binary"


def _fold(keys: np.ndarray, lengths: np.ndarray, at: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One of each address, ascending, with its ids."""
    keys, first = np.unique(keys, return_index=True)
    lengths = lengths[first]
    return keys, lengths, flat[ragged_take(at[first], lengths)]


def _stager(spec, end_id: int, dtype: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(spec.value)
        specials = [t["content"].encode() for t in json.loads(spec.value)["added_tokens"]]
        held: dict[bytes, bytes] = {}
        size = 0

        def flush():
            keys = sorted(held)
            ids = [held[k] for k in keys]
            bucket = np.array([int.from_bytes(k[:4], "big") * buckets >> 32 for k in keys], np.int32)
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if keys else []
            rows = []
            for x, y in zip(at, [*at[1:], len(keys)]):
                address_bytes = np.frombuffer(b"".join(keys[x:y]), np.uint8)
                lengths = np.array([len(i) for i in ids[x:y]], np.uint32) // np.dtype(dtype).itemsize
                rows.append((int(bucket[x]), blobs.pack(address_bytes, lengths, np.frombuffer(b"".join(ids[x:y]), dtype))))
            none = [None] * len(rows)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows), none, none, none, none, none], _FLOW.types)], schema=_FLOW)

        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                flat, counts = per_document(data, offsets, cache, specials)
                at = np.cumsum(counts)
                ids = np.insert(flat, at, end_id).astype(dtype)
                ends = at + np.arange(1, b - a + 1)
                cuts = cut_points(ids, ends)
                raw, width = ids.tobytes(), ids.itemsize
                begin = np.concatenate([[0], cuts[:-1]])
                found = []
                for x, y in zip((begin * width).tolist(), (cuts * width).tolist()):
                    piece = raw[x:y]
                    found.append(key := address(piece))
                    if key not in held:
                        held[key] = piece
                        size += y - x
                lengths = (cuts - begin).astype("<u4").tobytes()
                of = np.searchsorted(cuts, ends, "left") + 1
                of = np.concatenate([[0], of]).tolist()
                own = [found[x:y] for x, y in zip(of, of[1:])]
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.arange(n) + a) % buckets, pa.int32()), pa.nulls(n, pa.binary()), batch.column(0).slice(a, n), pa.array(counts + 1), pa.array([b"".join(x) for x in own], pa.binary()), pa.array([lengths[4 * x : 4 * y] for x, y in zip(of, of[1:])], pa.binary()), pa.array([merkle(x) for x in own], pa.binary())],
                    schema=_FLOW,
                )
                if size > 4 << 20:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()
        held.clear()
        give_back()

    return run


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes as they are; the chunks of each bucket as one pack."""
    by: dict[int, list[bytes]] = {}
    names = [x.split()[0] for x in DATA.split(", ")]
    for batch in batches:
        recipe = np.asarray(batch.column(1).is_null())
        for i in np.flatnonzero(~recipe).tolist():
            by.setdefault(batch.column(0)[i].as_py(), []).append(batch.column(1)[i].as_py())
        kept = batch.filter(pa.array(recipe))
        n = len(kept)
        yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), *kept.columns[2:]], names=names)
    for bucket in sorted(by):
        parts = [blobs.unpack(x) for x in by.pop(bucket)]
        raw, lengths, flat = (np.concatenate(c) for c in zip(*parts))
        at = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))[:-1]])
        del parts
        keys, lengths, flat = _fold(raw.view(f"V{ADDRESS}"), lengths.astype(np.int64), at, flat)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["pack"]), pa.array([bucket], pa.int32()), pa.array([len(keys)]), pa.array([flat.tobytes()], pa.binary()), pa.array([flat.itemsize], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([lengths.astype("<u4").tobytes()], pa.binary()), pa.nulls(1, pa.binary())],
            names=names,
        )
    give_back()


def _data(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(DATA).parquet(f"{path}/data").filter(F.col("kind") == kind)


def write_store(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 0) -> None:
    """Encodes (doc_id, text) with the tokenizers library, appends ``end_id`` to each document and writes the store."""
    spark = docs.sparkSession
    text = open(tokenizer_file, encoding="utf-8").read()
    spec = json.loads(text)
    widest = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    dtype = "<u2" if widest < 1 << 16 else "<u4"
    scratch = Scratch(spark, "token-store")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = buckets_for(rows)
    flow = rows.mapInArrow(_stager(spark.sparkContext.broadcast(text), end_id, dtype, 4 * n), FLOW)
    flow.repartition(n, "bucket").mapInArrow(_packer, DATA).write.partitionBy("kind").parquet(f"{path}/data")
    del flow
    release(spark)
    recipes = _data(spark, path, "recipe").select("doc_id", "n_tokens", "addresses", "lengths", "root")
    ordered = scratch.write(recipes.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "n_tokens", "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "root").withColumn("part", F.spark_partition_id()), "ordered")
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).collect()  # one row for each partition
    base, bases = 0, []
    for r in sorted(parts):
        bases.append((r.part, base))
        base += r.tokens
    bases = spark.createDataFrame(pa.table({"part": pa.array([p for p, _ in bases], pa.int32()), "base": pa.array([b for _, b in bases], pa.int64())}))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "root").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(F.broadcast(bases), "part")
    placed.select("part", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "addresses", "lengths", "root").write.parquet(f"{path}/recipes")
    written = spark.read.parquet(f"{path}/recipes").select("part", "start", "n_tokens", "root")
    found = written.repartition(n, "part").sortWithinPartitions("part", "start").mapInArrow(_roots, MANIFEST).collect()  # one row for each partition
    rows = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(_head(found), *found), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=[x.split()[0] for x in MANIFEST.split(", ")])
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/manifest")
    scratch.close()


MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def _leaf(root: bytes, start: int) -> bytes:
    return hashlib.blake2b(root + start.to_bytes(8, "little"), digest_size=ADDRESS).digest()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part, whose recipes come together and ascending: the Merkle root over them."""
    part, leaves, tokens = None, [], 0

    def done():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(leaves)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([merkle(leaves)], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])

    for batch in batches:
        for p, start, n, root in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                if part is not None:
                    yield done()
                part, leaves, tokens = p, [], 0
            leaves.append(_leaf(root, start))
            tokens += n
    if part is not None:
        yield done()


def _head(parts: list) -> tuple[int, int, int, bytes]:
    """The manifest's head row: the Merkle root over the parts, in order, with their counts."""
    leaves = [hashlib.blake2b(bytes(r.root) + b"".join(int(x).to_bytes(8, "little") for x in (r.part, r.n_docs, r.n_tokens)), digest_size=ADDRESS).digest() for r in sorted(parts)]
    return -1, sum(r.n_docs for r in parts), sum(r.n_tokens for r in parts), merkle(leaves)


def read_manifest(spark: SparkSession, path: str) -> list:
    """The manifest's rows of parts (one for each partition written), checked against its head."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    parts = [r for r in rows if r.part >= 0]
    if [tuple(r) for r in rows if r.part < 0] != [_head(parts)]:
        raise ValueError("the manifest's parts do not match its head")
    return sorted(parts)


CHUNK_ROWS, ENTRY_ROWS, CRC_ROWS, RECIPE_ROWS = range(4)  # what a blob of the read path holds


def _blob(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    rows = [(b, len(part[0]), blobs.pack(np.array([kind], np.uint8), *part)) for b, part in blobs.split(bucket, *columns)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 3, (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "rows", "blob"])


def _by_kind(batches: Iterator[pa.RecordBatch]) -> dict[int, list[np.ndarray]]:
    """The columns of each kind of blob."""
    parts: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for raw in batch.column(2).to_pylist():
            kind, *columns = blobs.unpack(raw)
            parts.setdefault(int(kind[0]), []).append(columns)
    return {kind: [np.concatenate(c) for c in zip(*parts.pop(kind))] for kind in list(parts)}


def _addresses(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Addresses as two columns of 64 bits."""
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _spread(low: np.ndarray, buckets: int) -> np.ndarray:
    return blobs.bucket_of(mix(low), buckets)


def _pack_reader(buckets: int):
    """(address, number of ids, CRC-32 of the ids as 32-bit integers) of each chunk, checked against its address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _cache.cache_clear()  # the worker may still hold the pieces that it encoded
        give_back()
        for batch in batches:
            for raw, lengths, ids, width in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<u4").astype(np.int64))])
                wide = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                own, keys = memoryview(ids), _leaves(raw)
                crc = np.zeros(len(keys), np.uint32)
                for i, (key, x, y) in enumerate(zip(keys, at.tolist(), at[1:].tolist())):
                    if address(own[x * width : y * width]) != key:
                        raise ValueError(f"chunk {key.hex()} does not match its address")
                    crc[i] = zlib.crc32(wide[4 * x : 4 * y])
                low, high = _addresses(raw)
                yield _blob(CHUNK_ROWS, _spread(low, buckets), low, high, np.diff(at).astype(np.uint32), crc)

    return run


def _entries(buckets: int):
    """The entries of recipes: where in the stream a chunk stands, and how many ids of its document follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _cache.cache_clear()
        for batch in batches:
            part, start, raw, lengths = batch.columns
            count = np.asarray(pc.binary_length(raw), np.int64) // ADDRESS
            own = np.repeat(np.arange(len(batch)), count)
            low, high = _addresses(b"".join(raw.to_pylist()))
            size = np.frombuffer(b"".join(lengths.to_pylist()), "<u4")
            seq = ragged_take(np.zeros(len(count), np.int64), count).astype(np.uint32)
            yield _blob(ENTRY_ROWS, _spread(low, buckets), low, high, np.asarray(part, np.int32)[own], np.asarray(start, np.int64)[own], seq, size)

    return run


def _matched(buckets: int):
    """Adds to each entry the checksum of its chunk; sent on by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _by_kind(batches)
        if ENTRY_ROWS not in held:
            return
        low, high, part, start, seq, size = held.pop(ENTRY_ROWS)
        if CHUNK_ROWS not in held:
            raise ValueError("chunks of recipes are missing")
        key, key_high, n, crc = held.pop(CHUNK_ROWS)
        by = np.lexsort((key_high, key))
        key, key_high, n, crc = (c[by] for c in (key, key_high, n, crc))
        i = np.minimum(np.searchsorted(key, low), len(key) - 1)
        while True:  # addresses with equal low halves stand together
            other = (key[i] == low) & (key_high[i] < high) & (i + 1 < len(key))
            if not other.any():
                break
            i = i + other
        if not ((key[i] == low) & (key_high[i] == high) & (n[i] == size)).all():
            raise ValueError("a recipe's chunk is missing or has another length")
        yield _blob(CRC_ROWS, part % buckets, part, start, seq, size, low, high, crc[i])

    return run


def _recipes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _cache.cache_clear()
        for batch in batches:
            part, doc, start, n, root = batch.columns
            part = np.asarray(part, np.int32)
            low, high = _addresses(b"".join(root.to_pylist()))
            yield _blob(RECIPE_ROWS, part % buckets, part, np.asarray(doc.fill_null(0), np.int64), np.asarray(doc.is_valid()).astype(np.uint8), np.asarray(start, np.int64), np.asarray(n, np.int64), low, high)

    return run


@lru_cache(64)
def _zeros_operator(power: int) -> tuple[int, ...]:
    """The matrix over bits that appends 2**power zero bytes to a CRC-32."""
    if power:
        m = _zeros_operator(power - 1)
        return tuple(_times(m, x) for x in m)
    one = (0xEDB88320, *(1 << i for i in range(31)))  # appends one zero bit
    for _ in range(3):
        one = tuple(_times(one, x) for x in one)
    return one


def _times(matrix: tuple[int, ...], bits: int) -> int:
    out = 0
    for row in matrix:
        if bits & 1:
            out ^= row
        bits >>= 1
        if not bits:
            break
    return out


@lru_cache(64)
def _zeros_tables(power: int) -> np.ndarray:
    """The same matrix as a table for each byte of a CRC-32."""
    m = _zeros_operator(power)
    return np.array([[_times(m, b << 8 * k) for b in range(256)] for k in range(4)], np.uint32)


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRC-32 values moved before as many zero bytes as ``after`` says: the CRC-32 of a text is the exclusive or of
    those of its pieces, each moved by the bytes that follow it."""
    crc, after, power = crc.copy(), after.copy(), 0
    while after.any():
        some = np.flatnonzero(after & 1)
        if len(some):
            t, c = _zeros_tables(power), crc[some]
            crc[some] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        after >>= 1
        power += 1
    return crc


def _documents(expected):
    """Rows of documents from their recipes and entries, checked against the roots of documents and parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _by_kind(batches)
        if RECIPE_ROWS not in held:
            if CRC_ROWS in held:
                raise ValueError("entries without a recipe")
            return
        part, doc, valid, start, n, low, high = held.pop(RECIPE_ROWS)
        by = np.lexsort((start, part))
        part, doc, valid, start, n, low, high = (c[by] for c in (part, doc, valid, start, n, low, high))
        roots = _leaves(np.stack([low, high], 1).tobytes())
        entries = held.pop(CRC_ROWS, None) or [np.zeros(0, t) for t in (np.int32, np.int64, np.uint32, np.uint32, np.uint64, np.uint64, np.uint32)]
        by = np.lexsort((entries[2], entries[1]))
        _, own, seq, size, low, high, crc = (c[by] for c in entries)
        leaves = _leaves(np.stack([low, high], 1).tobytes())
        order = np.argsort(start, kind="stable")  # every document has its end id, so starts differ
        begin, end = np.searchsorted(own, start, "left"), np.searchsorted(own, start, "right")
        if int((end - begin).sum()) != len(own):
            raise ValueError("entries without a recipe")
        total = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
        if not (total[end] - total[begin] == n).all():
            raise ValueError("a document's chunks do not match its recipe")
        of = np.repeat(order, (end - begin)[order])  # the document of each entry
        moved = shifted_crc(crc, 4 * (total[end[of]] - total[1:]))
        mixed = np.concatenate([[0], np.bitwise_xor.accumulate(moved)]).astype(np.uint32)
        for i, (x, y) in enumerate(zip(begin.tolist(), end.tolist())):
            if merkle(leaves[x:y]) != roots[i]:
                raise ValueError("a document's chunks do not match its root")
        head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for x, y in zip(head.tolist(), [*head[1:].tolist(), len(part)]):
            now = (y - x, int(n[x:y].sum()), merkle([_leaf(r, s) for r, s in zip(roots[x:y], start[x:y].tolist())]))
            if expected.value.get(int(part[x])) != now:
                raise ValueError(f"part {part[x]} does not match the manifest")
        yield pa.RecordBatch.from_arrays([pa.array(doc, mask=valid == 0), pa.array(start), pa.array(n), pa.array((mixed[end] ^ mixed[begin]).astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: every chunk is read and checked against its address,
    every document against its Merkle root, every part against the manifest, and the manifest against its head."""
    parts = read_manifest(spark, path)
    expected = {r.part: (r.n_docs, r.n_tokens, bytes(r.root)) for r in parts}
    recipes, packs = spark.read.parquet(f"{path}/recipes"), _data(spark, path, "pack")
    if {r.part for r in recipes.select("part").distinct().collect()} != set(expected):  # one row for each partition
        raise ValueError("parts of the manifest are missing")
    n = buckets_for(recipes, per=32 << 20)
    chunk = packs.select("addresses", "lengths", "ids", "width").mapInArrow(_pack_reader(n), blobs.SCHEMA)
    entries = recipes.select("part", "start", "addresses", "lengths").mapInArrow(_entries(n), blobs.SCHEMA)
    m = max(1, len(parts))
    found = blobs.exchange(entries.union(chunk), n).mapInArrow(_matched(m), blobs.SCHEMA)
    known = recipes.select("part", "doc_id", "start", "n_tokens", "root").mapInArrow(_recipes(m), blobs.SCHEMA)
    return blobs.exchange(known.union(found), m).mapInArrow(_documents(spark.sparkContext.broadcast(expected)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>) put together again from the chunks."""

    def open_packs(batches):
        for batch in batches:
            for raw, lengths, ids, width in zip(*(c.to_pylist() for c in batch.columns)):
                sizes = np.frombuffer(lengths, "<u4").astype(np.int64)
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(_leaves(raw), pa.binary()), binary_column(wide.view(np.uint8), sizes * 4)], names=["address", "ids"])

    def entries(batches):
        for batch in batches:
            start, raw = (c.to_pylist() for c in batch.columns)
            own = [_leaves(x) for x in raw]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, x in zip(start, own) for _ in x], pa.int64()), pa.array([i for x in own for i in range(len(x))], pa.int32()), pa.array([y for x in own for y in x], pa.binary())], names=["start", "seq", "address"])

    def join(batches):
        for batch in batches:
            doc, start, parts = (c.to_pylist() for c in batch.columns)
            flat = [np.frombuffer(b"".join(x["ids"] for x in sorted(p, key=lambda x: x["seq"])), "<u4").astype(np.int32) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(flat, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    chunk = _data(spark, path, "pack").select("addresses", "lengths", "ids", "width").mapInArrow(open_packs, "address binary, ids binary")
    recipes = spark.read.parquet(f"{path}/recipes")
    rows = recipes.select("start", "addresses").mapInArrow(entries, "start long, seq int, address binary")
    found = rows.join(chunk, "address").groupBy("start").agg(F.collect_list(F.struct("seq", "ids")).alias("found"))
    return recipes.select("doc_id", "start").join(found, "start").select("doc_id", "start", "found").mapInArrow(join, "doc_id long, start long, ids array<int>")
