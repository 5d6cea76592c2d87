"""Interpolated modified Kneser-Ney language model of word triples (``order`` 3) or pairs (``order`` 2).

Counting: tasks fold equal keys and exchange them as packed arrays, so a frequent word or triple costs a task one
entry. Triples go by their middle word: whatever is counted of (u, v, w), that is the words after (u, v), those
before (v, w) and those after v, then lies in one bucket. A word so frequent that it would fill buckets of its own is
dealt to several by the word before it, and its pairs meet by their last word in a second exchange.

Storage: sorted arrays of hashes, one file for each bucket, in the shared folder; the files together grow with the
corpus, none has to fit into memory. A hash's first bits name its slot in a small index, the next 32 are stored.
Workers map the files and search them; where the shared folder is no local path, a host fetches a file once.

With start marks before a text and an end token after it, V distinct words and c the count of a triple:

  p3(w | u v) = (c(uvw) - D3) / c(uv) + g(uv) * p2(w | v)
  p2(w | v)   = (t(vw) - D2) / t(v) + g(v) * p1(w)
  p1(w)       = (t(w) - D1) / T + h / (V + 1)

t(vw) counts the distinct words before vw, and is the plain count where v is the start mark; t(v) sums it over w;
t(w) counts the distinct words before w, T the distinct pairs. D are the modified discounts by count (1, 2, 3 and
more), from the counts of counts of each order; g and h give back what the discounts took. An unseen context leaves
the lower order as it is. Order 2 has p2 as its highest, with plain counts.

A word's number is its rank among the sorted hashes, with 64 bits. Two different n-grams of a bucket meet in a slot's
32 bits about once in 10**9 pairs of lookups; everything else is exact.

Defined cases: a null or wordless text is the end token alone; rows with a null doc_id are learned from and not held
out; repeated rows count each time; without training rows every word is unknown and probabilities are those of a
uniform choice of one; texts of any length are scored whole; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blobs
from .storage import Scratch, buckets_for, release
from .textops import CHUNK, chunks, give_back, mix, word_hashes

FOLD = 7
HELD = 2
ORDER = 3
BUCKET_BYTES = 32 << 20  # of the input, for each bucket
HEAVY = 4  # a word with more than a HEAVY-th of a bucket's tokens is dealt to several
_U = np.uint64
END = np.array([0x9D5C0B7F3A1E6428], _U)  # the hash of the end token
START = 1 << 62  # the number of the start mark
FULL = 255  # counts from here on stand in files of their own
PER_SLOT = 8
SCORED = 3 << 20  # bytes of text that a worker looks up together
_K = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD == HELD, F.lit(False))


def write_file(folder: str, name: str, *columns: np.ndarray) -> None:
    """Writes columns one after the other; every attempt of a task writes the same bytes, under a name of its own first."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for c in columns:
            out.write(np.ascontiguousarray(c))
    fs.move(part, f"{path}/{name}")


@lru_cache(4096)
def mapped(folder: str, name: str, kinds: tuple[tuple[str, int], ...]) -> list[np.ndarray]:
    """The columns of a file, mapped into memory; kinds: numpy type and number of rows of each."""
    fs, path = pafs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    if not isinstance(fs, pafs.LocalFileSystem):
        # one copy for all workers of the host, in the executor's own temporary folder, which goes with the executor
        local = os.path.join(tempfile.gettempdir(), f"{folder.rstrip('/').replace('/', '_').rpartition(':')[2]}-{name}")
        if not os.path.exists(local):
            part = f"{local}.{uuid.uuid4().hex}"
            with fs.open_input_stream(path) as source, open(part, "wb") as out:
                while block := source.read(1 << 22):
                    out.write(block)
            os.replace(part, local)
        path = local
    if not any(n for _, n in kinds):
        return [np.zeros(0, k) for k, _ in kinds]
    whole, at, out = np.memmap(path, np.uint8, "r"), 0, []
    for k, n in kinds:
        size = np.dtype(k).itemsize * n
        out.append(np.frombuffer(whole[at : at + size], k) if size else np.zeros(0, k))
        at += size
    return out


def _by_bucket_order(bucket: np.ndarray, n: int) -> np.ndarray:
    """A stable order by bucket; few buckets sort by radix."""
    return np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")


def _runs(bucket: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first row, row after the last) of ascending buckets."""
    edges = np.searchsorted(bucket, np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, int(edges[b]), int(edges[b + 1])


@dataclass
class Table:
    """Sorted 64-bit hashes in buckets that are ranges of the hash, with one more column."""

    folder: str
    name: str
    sizes: list[int]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For ascending hashes: whether each is known, its bucket, its place there and its value."""
        n = len(self.sizes)
        bucket = blobs.bucket_of(keys, n)
        known, place, value = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for b, x, y in _runs(bucket, n):
            if not (rows := self.sizes[b]):
                continue
            own, count = mapped(self.folder, f"{self.name}-{b:05d}", (("<u8", rows), ("<u8", rows)))
            i = np.searchsorted(own, keys[x:y])
            i[i == len(own)] = 0
            hit = own[i] == keys[x:y]
            known[x:y], place[x:y] = hit, i
            value[x:y][hit] = count[i[hit]]
        return known, bucket, place, value


def slots_of(rows: int) -> int:
    return 1 << max(0, (rows // PER_SLOT).bit_length())


def write_grams(folder: str, name: str, keys: np.ndarray, *counts: np.ndarray) -> tuple[int, int]:
    """Writes distinct hashes with counts of a byte each; greater ones follow as rows of 64-bit counts.

    Returns the number of rows and of those."""
    by = np.argsort(keys)
    keys, counts = keys[by], [c[by] for c in counts]
    slots = slots_of(len(keys))
    shift = _U(64 - slots.bit_length() + 1)
    slot = (keys >> shift).astype(np.int64) if slots > 1 else np.zeros(len(keys), np.int64)
    index = np.searchsorted(slot, np.arange(slots + 1)).astype(np.uint32)
    low = ((keys << _U(slots.bit_length() - 1)) >> _U(32)).astype(np.uint32)
    large = np.flatnonzero(np.any([c >= FULL for c in counts], axis=0))
    write_file(folder, name, index, low, *(np.minimum(c, FULL).astype(np.uint8) for c in counts), large.astype(np.uint32), *(c[large].astype(np.uint64) for c in counts))
    return len(keys), len(large)


def read_grams(folder: str, name: str, rows: int, large: int, counts: int, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whether each hash is in a file, and its counts (0 where it isn't)."""
    out = [np.zeros(len(keys), np.int64) for _ in range(counts)]
    if not rows:
        return np.zeros(len(keys), bool), out
    slots = slots_of(rows)
    index, low, *rest = mapped(folder, name, (("<u4", slots + 1), ("<u4", rows), *[("u1", rows)] * counts, ("<u4", large), *[("<u8", large)] * counts))
    slot = (keys >> _U(64 - slots.bit_length() + 1)).astype(np.int64) if slots > 1 else np.zeros(len(keys), np.int64)
    want = ((keys << _U(slots.bit_length() - 1)) >> _U(32)).astype(np.uint32)
    at, end = index[slot].astype(np.int64), index[slot + 1].astype(np.int64)
    after, last = end.copy(), len(low) - 1
    for _ in range(int((end - at).max(initial=0)).bit_length()):  # binary search among a slot's few rows
        mid = (at + end) >> 1
        less = (low[np.minimum(mid, last)] < want) & (mid < end)
        at = np.where(less, mid + 1, at)
        end = np.where(less, end, mid)
    place = np.where((at < after) & (low[np.minimum(at, last)] == want), at, -1)
    found = np.flatnonzero(place >= 0)
    place = place[found]
    for o, c in zip(out, rest[:counts]):
        o[found] = c[place]
    if large:
        i = np.minimum(np.searchsorted(rest[counts], place), large - 1)
        some = np.flatnonzero(rest[counts][i] == place)
        for o, c in zip(out, rest[counts + 1 :]):
            o[found[some]] = c[i[some]]
    known = np.zeros(len(keys), bool)
    known[found] = True
    return known, out


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns changes."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    if n:
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _sum_words(bucket, key, count) -> list[np.ndarray]:
    by = np.argsort(key, kind="stable")
    key, count, bucket = key[by], count[by], bucket[by]
    head = _first_of_runs(key)
    return [bucket[head], key[head], np.add.reduceat(count, head)]


def _tokens(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words with the end token after each text, where each text ends)."""
    for a, _, data, offsets in chunks(column, limit):
        hashes, first = word_hashes(data, offsets)
        flat = np.insert(hashes, first[1:], END[0])
        yield a, flat, first[1:] + np.arange(1, len(first))


def _count_words(buckets: int):
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = blobs.Outbox(buckets, 1 << 20, _sum_words)
        for batch in batches:
            for _, flat, _ in _tokens(batch.column(0)):
                key, count = np.unique(flat, return_counts=True)
                yield from out.put(blobs.bucket_of(key, buckets), key, count.astype(np.uint64))
        yield from out.flush()

    return count_words


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    parts: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for b, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            parts.setdefault(b, []).append(blobs.unpack(raw))
    for b in sorted(parts):
        yield b, [np.concatenate(c) for c in zip(*parts.pop(b))]


def _store_words(folder: str, buckets: int):
    def store_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (key, count) in _by_bucket(batches):
            _, key, count = _sum_words(np.zeros(len(key), np.int32), key, count)
            write_file(folder, f"word-{b:05d}", key, count)
            total = int(count.sum())
            # what may be heavy in the whole: the bucket can't tell, its greatest counts suffice
            some = np.argsort(count)[::-1][: HEAVY * buckets]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(key)]), pa.array([total]), pa.array([some.tolist()], pa.list_(pa.int64())), pa.array([count[some].astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["bucket", "size", "total", "places", "counts"])

    return store_words


@dataclass
class Words:
    """Word hashes with counts; numbers are ranks over all buckets."""

    table: Table
    bases: np.ndarray
    tokens: int
    heavy: np.ndarray  # ascending numbers of the words that are dealt to several buckets
    ways: np.ndarray  # to how many

    @property
    def distinct(self) -> int:
        return int(sum(self.table.sizes))

    def distinct_of(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each distinct word, -1 if unknown; its count; the place of each token's word among them)."""
        keys, back = np.unique(flat, return_inverse=True)
        known, bucket, place, count = self.table.find(keys)
        return np.where(known, self.bases[bucket] + place, -1), count, back

    def heavy_place(self, v: np.ndarray) -> np.ndarray:
        """Where each number stands among the heavy ones, -1 if it isn't one."""
        if not len(self.heavy):
            return np.full(len(v), -1)
        i = np.minimum(np.searchsorted(self.heavy, v), len(self.heavy) - 1)
        return np.where(self.heavy[i] == v, i, -1)


def _spread(words: Words, v: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The hash whose first bits name the bucket of middle words; heavy ones are split by another word."""
    at = words.heavy_place(v)
    salt = np.zeros(len(v), _U)
    some = np.flatnonzero(at >= 0)
    salt[some] = (mix(by[some].astype(_U) + _K[2]) >> _U(32)) % words.ways[at[some]].astype(_U)
    return mix(v.astype(_U) * _K[0] + salt * _K[1] + _U(1))


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v.astype(_U) * _K[0] + mix(w.astype(_U) + _K[1]))


def _triple_hash(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(_pair_hash(v, w) + mix(u.astype(_U) + _K[2]) * _K[0])


def _before(number: np.ndarray, ends: np.ndarray, back: int) -> np.ndarray:
    """The number that stands so many places before each token, the start mark before the text."""
    out = np.full(len(number), START, np.int64)
    out[back:] = number[: len(number) - back] if back else number
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    for k in range(back):
        at = starts + k
        out[at[at < ends]] = START
    return out


def _order_key(spread: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """A key that sorts by middle word first, then by a hash of the rest."""
    return (spread & ~_U((1 << 40) - 1)) | (rest >> _U(24))


def _sum_grams(bucket: np.ndarray, rest: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """(bucket, u, v, w, count), summed over equal triples, by bucket and middle word, which packs well.

    rest: a hash of the triple, by which equal ones come together."""
    by = np.argsort(rest)
    by = by[np.lexsort((v[by], bucket[by]))]
    bucket, u, v, w, count = (c[by] for c in (bucket, u, v, w, count))
    head = _first_of_runs(u, v, w)
    return [bucket[head], u[head], v[head], w[head], np.add.reduceat(count, head) if len(head) else count]


def _count_grams(words, order: int, buckets: int):
    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _GramBox(words.value, order, buckets)
        for batch in batches:
            for _, flat, ends in _tokens(batch.column(0)):
                number, _, back = words.value.distinct_of(flat)
                number = number[back]
                u = _before(number, ends, 2) if order == 3 else np.zeros(len(number), np.int64)
                yield from out.put(u, _before(number, ends, 1), number)
        yield from out.flush()
        give_back()

    return count_grams


class _GramBox:
    """Gathers n-grams, folds equal ones and hands them out by bucket."""

    LIMIT = 3 << 19

    def __init__(self, words: Words, order: int, buckets: int):
        self.words, self.order, self.buckets, self.held, self.size = words, order, buckets, [], 0

    def put(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= self.LIMIT:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        u, v, w = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.size = [], 0
        bucket = blobs.bucket_of(_spread(self.words, v, u if self.order == 3 else w), self.buckets)
        bucket, *columns = _sum_grams(bucket, _triple_hash(u, v, w), u, v, w, np.ones(len(u), np.int64))
        rows = [(b, len(c[0]), blobs.pack(*c)) for b, c in blobs.split(bucket, *columns)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "rows", "blob"])


TIES, PAIRS, TOTALS, STORED = range(4)  # what a blob of the second exchange holds


def _of_counts(count: np.ndarray) -> np.ndarray:
    return np.array([(count == k).sum() for k in (1, 2, 3, 4)], np.int64)


def _kinds(count: np.ndarray, head: np.ndarray) -> list[np.ndarray]:
    """For runs of rows: the sum of the counts, and how many are 1, 2, and 3 or more."""
    if not len(head):
        return [np.zeros(0, np.int64)] * 4
    return [np.add.reduceat(count, head), *(np.add.reduceat((np.minimum(count, 3) == k).astype(np.int64), head) for k in (1, 2, 3))]


def _span(distinct: int, buckets: int) -> int:
    return max(1, -(-distinct // buckets))


def _store_grams(folder: str, words, order: int, ends: int):
    """Writes what a bucket of middle words has, and sends on what is counted by last word, to fewer buckets."""

    def store_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = words.value
        span = _span(m.distinct, ends)
        for b, (u, v, w, count) in _by_bucket(batches):
            _, u, v, w, count = _sum_grams(np.zeros(len(u), np.int32), _triple_hash(u, v, w), u, v, w, count)
            held = [b]
            if order == 3:
                held += write_grams(folder, f"triple-{b:05d}", _triple_hash(u, v, w), count)
                by = np.argsort(_order_key(mix(v.astype(_U)), _pair_hash(u, v)), kind="stable")
                cu, cv = u[by], v[by]
                head = _first_of_runs(cu, cv)
                stats = _kinds(count[by], head)
                # contexts of one occurrence are known by their pair, but for the start of a text
                keep = (stats[0] > 1) | (cv[head] == START)
                held += write_grams(folder, f"context-{b:05d}", _pair_hash(cu[head][keep], cv[head][keep]), *(s[keep] for s in stats))
                of_counts = _of_counts(count)
            else:
                held += [0, 0, 0, 0]
                of_counts = np.zeros(4, np.int64)
            by = np.argsort(_order_key(mix(v.astype(_U)), _pair_hash(v, w)), kind="stable")
            v, w = v[by], w[by]
            head = _first_of_runs(v, w)
            plain = np.add.reduceat(count[by], head) if len(head) else count
            v, w = v[head], w[head]
            t = plain if order == 2 else np.where(v == START, plain, np.diff(np.append(head, len(by))))
            heavy = m.heavy_place(v) >= 0
            held += write_grams(folder, f"pair-{b:05d}", _pair_hash(v[~heavy], w[~heavy]), t[~heavy])
            own = np.flatnonzero(~heavy)
            head = _first_of_runs(v[own])
            totals = _kinds(t[own], head)
            held += write_grams(folder, f"total-{b:05d}", mix(v[own][head].astype(_U)), *totals)
            ties, n = np.unique(w[own], return_counts=True)
            rows = [(x, len(c[0]), blobs.pack(np.array([TIES], np.uint8), *c)) for x, c in blobs.split((ties // span).astype(np.int32), ties, n)]
            far = np.flatnonzero(heavy)
            rows += [(x, len(c[0]), blobs.pack(np.array([PAIRS], np.uint8), *c)) for x, c in blobs.split((w[far] // span).astype(np.int32), v[far], w[far], t[far])]
            rows.append((b % ends, 0, blobs.pack(np.array([STORED], np.uint8), np.array(held, np.int64), of_counts, _of_counts(t[own]))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t_) for x, t_ in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "rows", "blob"])
        give_back()

    return store_grams


RESULTS = "kind int, bucket int, word long, numbers array<long>"


def _result(kind: int, bucket: int, word: list[int], numbers: list[list[int]]) -> pa.RecordBatch:
    n = len(word)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(word, pa.int64()), pa.array(numbers, pa.list_(pa.int64()))], names=[x.split()[0] for x in RESULTS.split(", ")])


def _store_ends(folder: str, words, ends: int):
    """Writes what is counted by last word: the distinct words before it, and the pairs of heavy words."""

    def store_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = words.value
        span = _span(m.distinct, ends)
        parts: dict[tuple[int, int], list[list[np.ndarray]]] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                kind, *columns = blobs.unpack(raw)
                if kind[0] == STORED:
                    held, of_triples, of_pairs = (c.tolist() for c in columns)
                    yield _result(STORED, held[0], [0], [[*held[1:], *of_triples, *of_pairs]])
                else:
                    parts.setdefault((b, int(kind[0])), []).append(columns)
        for b in sorted({b for b, _ in parts}):
            size = max(0, min(span, m.distinct - b * span))
            ties = np.zeros(size, np.int64)
            for w, n in parts.pop((b, TIES), []):
                np.add.at(ties, w - b * span, n)
            pairs, of_pairs, rows = [np.concatenate(c) for c in zip(*parts.pop((b, PAIRS), []))], np.zeros(4, np.int64), (0, 0)
            if pairs:
                v, w, t = pairs
                by = np.lexsort((w, v))
                v, w, t = v[by], w[by], t[by]
                head = _first_of_runs(v, w)
                v, w, t = v[head], w[head], np.add.reduceat(t, head)
                rows = write_grams(folder, f"far-{b:05d}", _pair_hash(v, w), t)
                np.add.at(ties, w - b * span, 1)
                of_pairs = _of_counts(t)
                head = _first_of_runs(v)
                yield _result(TOTALS, b, v[head].tolist(), np.stack(_kinds(t, head), 1).tolist())
            write_file(folder, f"ties-{b:05d}", ties)
            kinds = [int((np.minimum(ties, 3) == k).sum()) for k in (1, 2, 3)]
            yield _result(TIES, b, [size], [[*rows, *of_pairs.tolist(), *_of_counts(ties).tolist(), *kinds, int(ties.sum())]])

    return store_ends


def discounts(of_counts: list[int]) -> np.ndarray:
    """The modified Kneser-Ney discounts of counts 0, 1, 2, and 3 or more, from how many keys count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(x) for x in of_counts)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * (b / a) if a else 0.5 * k for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


@dataclass
class Grams:
    """The files of one kind of n-gram."""

    folder: str
    name: str
    rows: list[int]
    large: list[int]
    counts: int = 1

    def find(self, bucket: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For keys whose buckets ascend: whether each is known, and its counts."""
        known, out = np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in range(self.counts)]
        for b, x, y in _runs(bucket, len(self.rows)):
            if self.rows[b]:
                hit, got = read_grams(self.folder, f"{self.name}-{b:05d}", self.rows[b], self.large[b], self.counts, keys[x:y])
                known[x:y] = hit
                for o, g in zip(out, got):
                    o[x:y] = g
        return known, out


@dataclass
class Model:
    order: int
    words: Words
    triples: Grams
    contexts: Grams  # (sum, kinds) of what follows two words
    pairs: Grams
    totals: Grams  # (sum, kinds) of what follows a word
    far: Grams  # the pairs of heavy words
    heavy_totals: np.ndarray  # the same as totals for each heavy word
    folder: str
    sizes: list[int]  # of the files by last word
    span: int
    of: list[np.ndarray]  # discounts by order
    distinct_pairs: int
    given_back: float  # h

    def ties(self, number: np.ndarray) -> np.ndarray:
        """t of known numbers."""
        out = np.zeros(len(number), np.int64)
        bucket = number // self.span
        by = _by_bucket_order(bucket, len(self.sizes))
        for b, x, y in _runs(bucket[by], len(self.sizes)):
            out[by[x:y]] = mapped(self.folder, f"ties-{b:05d}", (("<i8", self.sizes[b]),))[0][number[by[x:y]] - b * self.span]
        return out

    def _taken(self, kinds: list[np.ndarray], order: int) -> np.ndarray:
        return sum(k * d for k, d in zip(kinds, self.of[order][1:]))

    def _lowest(self, number: np.ndarray) -> np.ndarray:
        """p1 of distinct words."""
        known = number >= 0
        t = np.zeros(len(number), np.int64)
        t[known] = self.ties(number[known])
        seen = np.maximum(t - self.of[1][np.minimum(t, 3)], 0)
        return seen / max(1, self.distinct_pairs) + self.given_back / (self.words.distinct + 1)

    def _totals(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What follows distinct numbers: the sum, and what the discounts take of it; 0 for unknown words."""
        heavy = self.words.heavy_place(v)
        spread = mix(v.astype(_U) * _K[0] + _U(1))
        bucket = blobs.bucket_of(spread, len(self.totals.rows))
        by = _by_bucket_order(bucket, len(self.totals.rows))
        _, found = self.totals.find(bucket[by], mix(v[by].astype(_U)))
        columns = []
        for k, f in enumerate(found):
            column = np.zeros(len(v), np.int64)
            column[by] = f
            if len(self.heavy_totals):
                column = np.where(heavy >= 0, self.heavy_totals[heavy, k], column)
            columns.append(np.where(v >= 0, column, 0))
        return columns[0], self._taken(columns[1:], 2)

    def log10(self, distinct: np.ndarray, back: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 p of every token after those before it; tokens as places among distinct numbers."""
        number = distinct[back]
        p = self._lowest(distinct)[back]
        v = _before(number, ends, 1)
        # what follows a word is looked up once for each distinct word, and for the start mark
        total, taken = self._totals(np.append(distinct, START))
        place = np.empty(len(back), np.int64)
        place[1:], place[np.concatenate([[0], ends[:-1]])[: len(ends)]] = back[:-1], len(distinct)
        total, taken = total[place], taken[place]
        heard = np.flatnonzero(total > 0)  # else the word before is unknown
        p[heard] *= taken[heard] / total[heard]
        pair = np.zeros(len(number), np.int64)  # t of the pair that each token ends
        both = (v >= 0) & (number >= 0)
        far = both & (self.words.heavy_place(v) >= 0)
        for grams, some in ((self.pairs, both & ~far), (self.far, far)):
            at = np.flatnonzero(some)
            if not len(at):
                continue
            bucket = number[at] // self.span if grams is self.far else blobs.bucket_of(mix(v[at].astype(_U) * _K[0] + _U(1)), len(grams.rows))
            by = _by_bucket_order(bucket, len(grams.rows))
            at = at[by]
            _, (found,) = grams.find(bucket[by], _pair_hash(v[at], number[at]))
            pair[at] = found
        seen = pair[heard]
        p[heard] += np.maximum(seen - self.of[2][np.minimum(seen, 3)], 0) / total[heard]
        if self.order == 2:
            return np.log10(p)
        u = _before(number, ends, 2)
        # two words before that were learned together, or the start of a text
        behind = np.zeros(len(number), np.int64)
        behind[1:] = pair[:-1]
        behind[v == START] = 0
        at = np.flatnonzero((u == START) & (v == START) & (self.words.tokens > 0) | (behind > 0))
        if not len(at):
            return np.log10(p)
        bucket = blobs.bucket_of(_spread(self.words, v[at], u[at]), len(self.contexts.rows))
        by = _by_bucket_order(bucket, len(self.contexts.rows))
        at, bucket = at[by], bucket[by]
        known, (total, *kinds) = self.contexts.find(bucket, _pair_hash(u[at], v[at]))
        once = ~known  # contexts of one occurrence are not stored
        total, kinds[0] = np.where(once, 1, total), np.where(once, 1, kinds[0])
        p[at] *= self._taken(kinds, 3) / total
        some = np.flatnonzero(number[at] >= 0)
        x = at[some]
        _, (count,) = self.triples.find(bucket[some], _triple_hash(u[x], v[x], number[x]))
        p[x] += np.maximum(count - self.of[3][np.minimum(count, 3)], 0) / total[some]
        return np.log10(p)


def train(docs: DataFrame, scratch: Scratch, order: int = ORDER) -> Model:
    """Counts (text) of docs and writes the model's files under the scratch folder."""
    if order not in (2, 3):
        raise ValueError("the model's order is 2 or 3")
    spark = docs.sparkSession
    folder = f"{scratch.path}/model"
    text = docs.select(F.col("text").cast("string").alias("text"))
    n = 2 * buckets_for(text, BUCKET_BYTES)
    rows = blobs.exchange(text.mapInArrow(_count_words(n), blobs.SCHEMA), n).mapInArrow(_store_words(folder, n), "bucket int, size long, total long, places array<long>, counts array<long>")
    tokens, sizes, often = 0, [0] * n, []
    for r in rows.toLocalIterator():  # one row for each bucket
        sizes[r.bucket] = r.size
        tokens += r.total
        often += [(r.bucket, p, c) for p, c in zip(r.places, r.counts) if c * HEAVY * n > r.total]
    bases = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    del rows
    release(spark)
    documents = text.count()
    often = [(int(bases[b]) + p, c) for b, p, c in often] + [(START, documents)]
    heavy = sorted((w, -(-c * HEAVY * n // tokens)) for w, c in often if c * HEAVY * n > tokens)
    words = Words(Table(folder, "word", sizes), bases, tokens, np.array([w for w, _ in heavy], np.int64), np.array([k for _, k in heavy], np.int64))
    sent, ends = spark.sparkContext.broadcast(words), max(1, n // 4)
    grams = blobs.exchange(text.mapInArrow(_count_grams(sent, order, n), blobs.SCHEMA), n).mapInArrow(_store_grams(folder, sent, order, ends), blobs.SCHEMA)
    stored = scratch.write(blobs.exchange(grams, ends).mapInArrow(_store_ends(folder, sent, ends), RESULTS), "stored")
    del grams
    release(spark)
    names = ["triple", "context", "pair", "total"]
    held = {name: ([0] * n, [0] * n) for name in names} | {"far": ([0] * ends, [0] * ends)}
    end_sizes, of_triples, of_pairs, of_words, kinds, distinct = [0] * ends, np.zeros(4, np.int64), np.zeros(4, np.int64), np.zeros(4, np.int64), [0, 0, 0], 0
    for r in stored.filter(F.col("kind") != TOTALS).toLocalIterator():  # two rows for each bucket
        if r.kind == STORED:
            for k, name in enumerate(names):
                held[name][0][r.bucket], held[name][1][r.bucket] = r.numbers[2 * k : 2 * k + 2]
            of_triples += r.numbers[8:12]
            of_pairs += r.numbers[12:16]
        else:
            end_sizes[r.bucket] = r.word
            held["far"][0][r.bucket], held["far"][1][r.bucket] = r.numbers[:2]
            of_pairs += r.numbers[2:6]
            of_words += r.numbers[6:10]
            kinds = [x + y for x, y in zip(kinds, r.numbers[10:13])]
            distinct += r.numbers[13]
    heavy_totals = np.zeros((len(heavy), 4), np.int64)
    summed = stored.filter(F.col("kind") == TOTALS).groupBy("word").agg(*[F.sum(F.col("numbers")[k]).alias(f"n{k}") for k in range(4)])
    for r in summed.toLocalIterator():  # one row for each heavy word
        heavy_totals[words.heavy_place(np.array([r.word]))[0]] = r[1:]
    word_discounts = discounts(of_words.tolist())
    given_back = sum(d * k for d, k in zip(word_discounts[1:], kinds)) / distinct if distinct else 1.0
    grams_of = lambda name, counts=1: Grams(folder, name, *held[name], counts)
    return Model(order, words, grams_of("triple"), grams_of("context", 4), grams_of("pair"), grams_of("total", 4), grams_of("far"), heavy_totals, folder, end_sizes, _span(words.distinct, ends), [np.zeros(4), word_discounts, discounts(of_pairs.tolist()), discounts(of_triples.tolist())], distinct, given_back)


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scorer(model):
    def score_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        whole = m.words.tokens + m.words.distinct + 1
        for batch in batches:
            for a, flat, ends in _tokens(batch.column(1), SCORED):
                number, count, back = m.words.distinct_of(flat)
                starts = np.concatenate([[0], ends[:-1]])
                base, known = np.log10((count + 1) / whole)[back], (count > 0).astype(np.int64)[back]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(ends)), pa.array(ends - starts), pa.array(np.add.reduceat(known, starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(m.log10(number, back, ends), starts))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return score_texts


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_scorer(sent), RESULT)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.words.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def language_model(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learns from the documents that are not held out, and scores all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(rows, train(rows.filter(~held_out()), Scratch(docs.sparkSession, "language-model"), order))
