"""Substring dedup with compact windows.

Each of ``HASHES`` functions orders the 5-word shingles of a text. A compact window (l, c, r) says that shingle c is
the least of every run that lies in [l, r] and holds c; windows of at least ``LEAST`` shingles come from the
Cartesian tree over the shingles that are least of some run of that length. Two passages of that length that are
alike share the least shingle of most functions, so windows are exchanged by (function, least shingle).

The windows of a signature form a group. Each window is paired with the group's first and with the one before it,
both of earlier documents; a task folds its own windows first and sends on the first of each group only, so a
passage of very many documents costs each task one row. That pairs all windows of a group of two. A second pass takes
the runs of ``LEAST`` shingles whose least is that of a larger group, under either of the first two functions, by the
hash of the whole run: documents with the same run are all paired with the first of them, so no verbatim passage
depends on who else has its least shingle. Larger groups are marked in a bitmap of fixed size; a bit that several
shingles share only adds runs. So are, in the same places, the runs of ``SHORT`` shingles: passages that are alike in
order have one in common, as with c common shingles they have c / 27 gaps at most, so a changed passage is found by any of
its runs that no earlier document has beside frequent wording. Pairs of documents with a common run, or whose windows meet under at least
``ENOUGH`` functions are verified on the shingles that the windows cover: matches score 1, others -3, and the
segments of positive score with at least ``LEAST`` shingles and a Jaccard similarity of at least 0.75 are passages.
So are ranges of matches outside of them that reach this similarity though the score cuts them into shorter segments
(with neighbours, if they are shorter than ``LEAST``), and a passage goes on over runs beside it while its last
``LEAST`` shingles and the run are alike.

Defined cases: a null text, or one of fewer than 50 words, has no passage; a passage repeated within one document
alone is not reported; rows with a null doc_id take no part; rows that share a doc_id are one document, searched
row by row; of equal passages that of the least doc_id stays; texts of any length are searched whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .graphs import BROADCAST_IDS
from .storage import Scratch, buckets_for, release
from .textops import FOLDED_BYTES, chunks, give_back, gram_hashes, mix, ragged_take, span_hashes, tidy, words

SHINGLE, WORDS = 5, 50
LEAST = WORDS - SHINGLE + 1  # shingles of a passage
SHORT = 18  # shingles of a run that passages that are alike have in common
HASHES, ENOUGH = 6, 2
FOLD = 1 << 18  # windows or runs that a task holds
HOT_BITS = 26  # of the bitmap of least shingles that more than two windows have
_U = np.uint64


def least_of_each_run(h: np.ndarray, t: int) -> np.ndarray:
    """The position of the (leftmost) least of every run of t values."""
    n = len(h)
    if n < t:
        return np.zeros(0, np.int64)
    size, best = 1, np.arange(n)
    while size < t:
        step = min(size, t - size)
        x, y = best[: len(best) - step], best[step:]
        best = np.where(h[x] <= h[y], x, y)
        size += step
    return best


def compact_windows(h: np.ndarray, t: int, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), r inclusive, of every compact window of at least t values, by c.

    begin: where texts begin, if several stand one after the other, and the end; no window crosses texts. The nearest
    lesser value beside a centre is itself the centre of a window, so a stack over centres suffices."""
    begin = np.array([0, len(h)]) if begin is None else begin
    best = least_of_each_run(h, t)
    if not len(best):
        return (np.zeros(0, np.int64),) * 3
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    best = best[text[: len(best)] == text[t - 1 :]]
    centres = best[np.concatenate([[True], best[1:] != best[:-1]])] if len(best) else best  # they ascend
    value, place, of, n = h[centres].tolist(), centres.tolist(), text[centres].tolist(), len(centres)
    left, right = begin[:-1][text[centres]].tolist(), (begin[1:][text[centres]] - 1).tolist()
    stack, now = [], -1
    for i in range(n):
        if of[i] != now:
            stack, now = [], of[i]
        v = value[i]
        while stack and value[stack[-1]] > v:  # an equal value further right belongs to the left one
            right[stack.pop()] = place[i] - 1
        if stack:
            left[i] = place[stack[-1]] + 1
        stack.append(i)
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    wide = right - left + 1 >= t
    return left[wide], centres[wide], right[wide]


def _grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle hashes in order) of every text with at least WORDS words."""
    for rows, begin, grams in _gram_chunks(column):
        for row, x, y in zip(rows.tolist(), begin.tolist(), begin[1:].tolist()):
            yield row, grams[x:y]


def _gram_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, where the shingles of each begin and the end, shingle hashes) of runs of texts with at least WORDS words."""
    for a, _, data, offsets in chunks(column):
        starts, ends, first = words(data, offsets)
        grams = gram_hashes(span_hashes(data, starts, ends, FOLDED_BYTES), SHINGLE)
        long = np.flatnonzero(np.diff(first) >= WORDS)
        size = np.diff(first)[long] - SHINGLE + 1
        yield a + long, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), grams[ragged_take(first[long], size)]


_SEEDS = mix(np.arange(1, HASHES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
ROWS, PAIRS = 0, 1  # what a blob holds


def pair_up(key, doc, c, l, r) -> tuple[list[np.ndarray], np.ndarray]:
    """Pairs (doc, earlier doc, c, c of it, left, right, key) from groups of equal keys, and the first row of each group."""
    by = np.lexsort((c, doc, key))
    key, doc, c, l, r = (x[by] for x in (key, doc, c, l, r))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    own = np.repeat(head, np.diff(np.append(head, len(key))))
    here = np.arange(len(key))
    before = np.maximum(here - 1, own)
    x = np.concatenate([here, here])
    y = np.concatenate([own, before])
    good = (doc[x] != doc[y]) & ~((x >= 0) & (np.arange(len(x)) >= len(here)) & (y == own[x]))
    x, y = x[good], y[good]
    left = np.minimum(c[x] - l[x], c[y] - l[y])
    right = np.minimum(r[x] - c[x], r[y] - c[y])
    fits = left + right + 1 >= LEAST
    x, y, left, right = x[fits], y[fits], left[fits], right[fits]
    return [doc[x], doc[y], c[x], c[y], left, right, key[x]], by[head]


def _windows(buckets: int):
    def fold(held):
        columns = [np.concatenate(c) for c in zip(*held)]
        pairs, first = pair_up(*columns)
        rows = [c[first] for c in columns]
        rows.append(np.unique(columns[0], return_counts=True)[1].astype(np.int32))  # keys ascend in both
        out = []
        for b, part in blobs.split(blobs.bucket_of(rows[0], buckets), *rows):
            out.append((b, len(part[0]), blobs.pack(np.array([ROWS], np.uint8), *part)))
        if len(pairs[0]):
            for b, part in blobs.split((pairs[0] % buckets).astype(np.int32), *pairs):
                out.append((b, len(part[0]), blobs.pack(np.array([PAIRS], np.uint8), *part)))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "rows", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, begin, grams in _gram_chunks(batch.column(1)):
                for f in range(HASHES):
                    h = mix(grams ^ _SEEDS[f])
                    l, c, r = compact_windows(h, LEAST, begin)
                    of = np.searchsorted(begin, c, "right") - 1
                    # the function's number takes the place of three bits, so that a key tells it
                    key = mix(h[c]) & ~_U(7) | _U(f)
                    held.append((key, ids[rows[of]], *((x - begin[of]).astype(np.int32) for x in (c, l, r))))
                    size += len(c)
                if size >= FOLD:
                    yield fold(held)
                    held, size = [], 0
        if size:
            yield fold(held)

    return run


#: A row without doc holds a piece of the bitmap of large groups, and as source its first byte.
PAIR_SCHEMA = "doc long, source long, c int, sc int, lft int, rgt int, f int, hot binary"


def _pair_batch(doc, source, c, sc, left, right, key) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(source), *(pa.array(x.astype(np.int32)) for x in (c, sc, left, right)), pa.array((key & _U(7)).astype(np.int32)), pa.nulls(len(doc), pa.binary())], names=["doc", "source", "c", "sc", "lft", "rgt", "f", "hot"])


def _hot_bit(key: np.ndarray) -> np.ndarray:
    return (key >> _U(64 - HOT_BITS)).astype(np.int64)


def _hot_batch(key: np.ndarray, windows: np.ndarray) -> pa.RecordBatch | None:
    """The bits of groups of more than two windows under the functions that the second pass goes by."""
    by = np.argsort(key, kind="stable")
    key, windows = key[by], windows[by]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    large = key[head][(np.add.reduceat(windows, head) > 2) & ((key[head] & _U(7)) < ENOUGH)]
    if not len(large):
        return None
    bit = _hot_bit(large)
    base = int(bit[0]) >> 3
    piece = np.zeros((int(bit[-1]) >> 3) - base + 1, np.uint8)
    np.bitwise_or.at(piece, (bit >> 3) - base, np.uint8(1) << (bit & 7).astype(np.uint8))
    none = pa.nulls(1, pa.int32())
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([base], pa.int64()), none, none, none, none, none, pa.array([blobs.pack(piece)], pa.binary())], names=["doc", "source", "c", "sc", "lft", "rgt", "f", "hot"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for raw in batch.column(2).to_pylist():
            kind, *columns = blobs.unpack(raw)
            if kind[0] == PAIRS:
                yield _pair_batch(*columns)
            else:
                rows.append(columns)
    if rows:
        *whole, windows = (np.concatenate(c) for c in zip(*rows))
        rows.clear()
        hot = _hot_batch(whole[0], windows)
        if hot is not None:
            yield hot
        pairs, _ = pair_up(*whole)
        del whole, windows
        for a in range(0, len(pairs[0]), 1 << 16):
            yield _pair_batch(*(x[a : a + (1 << 16)] for x in pairs))
        del pairs
        give_back()


def run_hashes(grams: np.ndarray, t: int) -> np.ndarray:
    """A hash of every run of t values, in order."""
    size, h, rest, done = 1, grams, None, 0
    while True:  # runs of powers of two put together
        if t & size:
            rest = h if rest is None else mix(rest[: len(h) - done] * _U(0x9E3779B97F4A7C15) + h[done:])
            done += size
            if done == t:
                return rest[: max(len(grams) - t + 1, 0)]
            rest = rest[: len(grams) - done + 1]
        h = mix(h[:-size] * _U(0xD6E8FEB86659FD93) + h[size:])
        size *= 2


HULLS = "doc long, source long, lo int, hi int, slo int, shi int"


def _hulls(doc, source, lo, hi, slo, shi) -> list[np.ndarray]:
    """One row a pair of documents."""
    by = np.lexsort((source, doc))
    doc, source, lo, hi, slo, shi = (x[by] for x in (doc, source, lo, hi, slo, shi))
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1])]))
    return [doc[head], source[head], np.minimum.reduceat(lo, head), np.maximum.reduceat(hi, head), np.minimum.reduceat(slo, head), np.maximum.reduceat(shi, head)]


def same_runs(run: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The hulls of documents with a run and the first document that has it, and the first row of each run; runs whose
    hash is odd are short."""
    by = np.lexsort((doc, run))
    run, doc, at = run[by], doc[by], at[by]
    head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    own = np.repeat(head, np.diff(np.append(head, len(run))))
    x = np.flatnonzero(doc != doc[own])
    y = own[x]
    # a short run's passage goes on beside it
    short = (run[x] & _U(1)).astype(bool)
    before, after = np.where(short, LEAST, 0).astype(np.int32), np.where(short, SHORT + LEAST - 1, LEAST - 1).astype(np.int32)
    pairs = _hulls(doc[x], doc[y], np.maximum(at[x] - before, 0), at[x] + after, np.maximum(at[y] - before, 0), at[y] + after) if len(x) else []
    return pairs, [run[head], doc[head], at[head]]


def _runs(hot, buckets: int):
    def fold(held):
        pairs, rows = same_runs(*(np.concatenate(c) for c in zip(*held)))
        out = []
        for b, part in blobs.split(blobs.bucket_of(rows[0], buckets), *rows):
            out.append((b, len(part[0]), blobs.pack(np.array([ROWS], np.uint8), *part)))
        if pairs:
            for b, part in blobs.split((pairs[0] % buckets).astype(np.int32), *pairs):
                out.append((b, len(part[0]), blobs.pack(np.array([PAIRS], np.uint8), *part)))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "rows", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(hot.value, np.uint8)
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, begin, grams in _gram_chunks(batch.column(1)):
                text = np.repeat(np.arange(len(rows)), np.diff(begin))
                asked = np.zeros(max(len(grams) - LEAST + 1, 0), bool)
                for f in range(ENOUGH):
                    h = mix(grams ^ _SEEDS[f])
                    bit = _hot_bit(mix(h))
                    asked |= (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)[least_of_each_run(h, LEAST)]
                at = np.flatnonzero(asked)
                at = at[text[at] == text[at + LEAST - 1]]  # the others cross texts
                if len(at):
                    marks = np.zeros(len(grams) + 1, np.int32)
                    marks[at] += 1
                    marks[at + LEAST - SHORT + 1] -= 1
                    near = np.flatnonzero(np.cumsum(marks) > 0)
                    # the last bit tells short runs
                    for run, where in ((run_hashes(grams, LEAST) & ~_U(1), at), (run_hashes(grams, SHORT) | _U(1), near)):
                        held.append((run[where], ids[rows[text[where]]], (where - begin[text[where]]).astype(np.int32)))
                        size += len(where)
                if size >= FOLD:
                    yield fold(held)
                    held, size = [], 0
        if size:
            yield fold(held)
            held = []
        give_back()

    return run


def _run_groups(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        out = blobs.Outbox(buckets)
        for batch in batches:
            for raw in batch.column(2).to_pylist():
                kind, *columns = blobs.unpack(raw)
                if kind[0] == PAIRS:
                    yield from out.put((columns[0] % buckets).astype(np.int32), *columns)
                else:
                    rows.append(columns)
        if rows:
            pairs, _ = same_runs(*(np.concatenate(c) for c in zip(*rows)))
            rows.clear()
            if pairs:
                yield from out.put((pairs[0] % buckets).astype(np.int32), *pairs)
        yield from out.flush()
        give_back()

    return run


def _run_hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair of documents with a common run, of all its pieces."""
    columns = blobs.gather(batches)
    if columns is None:
        return
    columns = _hulls(*columns)
    for a in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in columns], names=[x.split()[0] for x in HULLS.split(", ")])
    give_back()


def candidates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, source, lo, hi, slo, shi): the shingles of both documents that windows cover, per pair of documents."""
    spark = docs.sparkSession
    n = 2 * buckets_for(docs)
    docs = docs.filter("doc_id is not null")
    met = scratch.write(blobs.exchange(docs.mapInArrow(tidy(_windows(n)), blobs.SCHEMA), n).mapInArrow(_groups, PAIR_SCHEMA), "pairs")
    pairs = met.filter("doc is not null").groupBy("doc", "source").agg(
        F.min(F.col("c") - F.col("lft")).alias("lo"), F.max(F.col("c") + F.col("rgt")).alias("hi"), F.min(F.col("sc") - F.col("lft")).alias("slo"), F.max(F.col("sc") + F.col("rgt")).alias("shi"), F.expr("bit_or(shiftleft(1, f))").alias("functions")
    )
    pairs = pairs.filter(F.bit_count("functions") >= ENOUGH).drop("functions")
    release(spark)
    bits = np.zeros(1 << HOT_BITS - 3, np.uint8)
    for r in met.filter("doc is null").select("source", "hot").toLocalIterator():
        piece = blobs.unpack(r.hot)[0]
        bits[r.source : r.source + len(piece)] |= piece
    if bits.any():
        hot = spark.sparkContext.broadcast(bits.tobytes())
        same = blobs.exchange(docs.mapInArrow(_runs(hot, n), blobs.SCHEMA), n).mapInArrow(_run_groups(n), blobs.SCHEMA)
        same = blobs.exchange(same, n).mapInArrow(_run_hulls, HULLS)
        pairs = pairs.unionByName(same).groupBy("doc", "source").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("slo").alias("slo"), F.max("shi").alias("shi"))
    hulls = scratch.write(pairs, "hulls")
    pairs = same = met = None
    scratch.drop("pairs")
    release(spark)
    return hulls


#: Requests that a row with a text has at most, and pairs of a source that are verified together.
ASKED, SALT = 256, 64
SLICES = "source long, salt int, doc long, lo int, slo int, shi int, grams binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SLICES.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        for row, grams in _grams(batch.column(1)):
            asked = batch.column(2)[row].as_py()
            for a in range(0, len(asked), ASKED):
                out = []
                for q in asked[a : a + ASKED]:
                    part = grams[q["lo"] : q["hi"] + 1]
                    if len(part):
                        out.append((q["source"], q["salt"], q["doc"], q["lo"], q["slo"], q["shi"], blobs.pack(part >> _U(16))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)


def _maximal(edges: list[int], match: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments, where a match scores 1 and any other -3; edges bound runs of one kind."""
    total, found = 0, []  # of each: start, end, total before it, total after it
    for p, q in zip(edges, edges[1:]):
        if not match[p]:
            total -= 3 * (q - p)
            continue
        now = (p, q, total, total + q - p)
        total += q - p
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = (found[j][0], now[1], found[j][2], now[3])
            del found[j:]
    return [(s, e) for s, e, _, _ in found if e - s >= LEAST]


def _alike(own: np.ndarray, other: np.ndarray) -> bool:
    own, other = np.unique(own), np.unique(other)
    common = len(np.intersect1d(own, other, assume_unique=True))
    return 100 * common >= 75 * (len(own) + len(other) - common)


def _dense(hit: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of matches that hold every range of LEAST shingles or more of which three quarters match.

    Any range alike one of another document is such a range, if no shingle comes twice in it."""
    k = np.arange(len(hit))
    high = 4 * (k + 1) - 3 * (hit + 1)  # a range's gain is this at its end less what stands at its start
    low = 4 * k - 3 * hit
    later = np.maximum.accumulate(high[::-1])  # ascends as the place goes back
    end = len(hit) - np.searchsorted(later, low, "left")
    several = end - k >= -(-3 * LEAST // 4)
    marks = np.zeros(len(hit) + 1, np.int64)
    np.add.at(marks, k[several], 1)
    np.add.at(marks, end[several], -1)
    inside = np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _realigned(x: np.ndarray, a: np.ndarray, hit: list[int], at: list[int]) -> np.ndarray:
    """Places in a of the matches of x, moved to where the match before or after continues."""
    for step, order in ((1, range(1, len(hit))), (-1, range(len(hit) - 2, -1, -1))):
        for i in order:
            if hit[i] - hit[i - step] == step and 0 <= (j := at[i - step] + step) < len(a) and a[j] == x[hit[i]]:
                at[i] = j
    return np.array(at, np.int64)


def _padded(s: int, e: int, n: int, left: bool) -> tuple[int, int]:
    """The range with as many places beside it, on the named side first, as LEAST asks for."""
    need = max(LEAST - (e - s), 0)
    before = min(need, s) if left else need - min(need, n - e)
    return max(s - before, 0), min(e + need - before, n)


def _alike_between(x: np.ndarray, a: np.ndarray, hit: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Ranges between the ends of two verbatim runs that are alike, from each run to the furthest such end.

    A range of fewer than LEAST shingles is taken with its neighbours."""
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(at) != 1), [True]]))
    p, q = cut[:-1], cut[1:]
    xs, xe, as_, ae = hit[p], hit[q - 1] + 1, at[p], at[q - 1] + 1
    out, reach = [], 0
    for i in range(len(p)):
        own, other, common = np.maximum(xe[i:] - xs[i], LEAST), np.maximum(ae[i:] - as_[i], LEAST), q[i:] - p[i]
        able = (7 * common >= 3 * (own + other)) & (ae[i:] > as_[i]) & (xe[i:] > reach)
        for j in (np.flatnonzero(able)[::-1] + i).tolist():
            s, e = int(xs[i]), int(xe[j])
            for left in (True, False)[: 1 + (e - s < LEAST)]:
                y, z = _padded(s, e, len(x), left)
                lo, hi = _padded(int(as_[i]), int(ae[j]), len(a), left)
                if z - y >= LEAST and _alike(x[y:z], a[lo:hi]):
                    out.append((y, z))
                    reach = e
                    break
            if reach == e:
                break
    return out


def _extended(x: np.ndarray, a: np.ndarray, hit: np.ndarray, at: np.ndarray, s: int, e: int) -> int:
    """The end of a passage moved on over runs with which its last LEAST shingles are still alike."""
    while (k := int(np.searchsorted(hit, e))) < len(hit):
        q, p = k, int(np.searchsorted(hit, max(s, e - LEAST)))
        while q + 1 < len(hit) and hit[q + 1] == hit[q] + 1 and at[q + 1] == at[q] + 1:
            q += 1
        lo, hi = int(at[p]), int(at[q]) + 1
        if p >= k or 7 * (q + 1 - p) < 3 * (hit[q] + 1 - hit[p] + hi - lo) or hi <= lo or not _alike(x[hit[p] : hit[q] + 1], a[lo:hi]):
            break
        e = int(hit[q]) + 1
    return e


def passages(x: np.ndarray, a: np.ndarray) -> list[tuple[int, int]]:
    """Half-open shingle ranges of x that are alike a range of a."""
    keys, first = np.unique(a, return_index=True)
    i = np.searchsorted(keys, x)
    i[i == len(keys)] = 0
    match = keys[i] == x
    if 2 * match.sum() < LEAST:
        return []
    at, out = first[i], []
    edges = np.flatnonzero(np.concatenate([[True], match[1:] != match[:-1], [True]])).tolist()
    for start, end in _maximal(edges, match):
        hit = np.flatnonzero(match[start:end]) + start
        shift = at[hit] - hit
        near = hit[np.abs(shift - np.median(shift)) <= max(8, (end - start) // 4)]
        ranges = {(int(at[h].min()), int(at[h].max()) + 1) for h in (near, hit) if len(h)}
        if any(_alike(x[start:end], a[lo:hi]) for lo, hi in ranges):
            out.append((start, end))
            continue
        # not alike as a whole: what is verbatim in it
        run = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(at[hit]) != 1), [True]]))
        out.extend((int(hit[p]), int(hit[q - 1]) + 1) for p, q in zip(run.tolist(), run[1:].tolist()) if q - p >= LEAST)
    # what the segments leave out: ranges that are alike, and runs beside a passage
    free = match.copy()
    for s, e in out:
        free[s:e] = False
    if not free.any():
        return out
    hit = np.flatnonzero(match)
    at = _realigned(x, a, hit.tolist(), first[i[hit]].tolist())
    rest = np.flatnonzero(free[hit])
    for s, e in _dense(hit[rest]):
        out.extend(_alike_between(x, a, hit[rest[s:e]], at[rest[s:e]]))
    back, ago = len(x) - 1 - hit[::-1], len(a) - 1 - at[::-1]
    out = [(s, _extended(x, a, hit, at, s, e)) for s, e in out]
    return [(len(x) - _extended(x[::-1], a[::-1], back, ago, len(x) - e, len(x) - s), e) for s, e in out]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages from rows as ``SLICES``; a source's own, without a document, come first within a source and salt."""
    key, sources = None, []
    for batch in batches:
        rows = []
        for source, salt, doc, lo, slo, shi, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if (source, salt) != key:
                key, sources = (source, salt), []
            grams = blobs.unpack(raw)[0]
            if doc is None:
                sources.append((lo, grams))
                continue
            for at, other in sources:
                rows.extend((doc, lo + s, lo + e + SHINGLE - 1, source) for s, e in passages(grams, other[max(slo - at, 0) : shi - at + 1]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "first_word", "end_word", "source_id"])


def duplicate_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word, source_id): passages of a document that an earlier document has, half open.

    The pairs of a source are verified ``SALT`` at a time: for each such group its slice is sent once."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(spark, "passages")
    hulls = candidates(rows, scratch)
    groups = hulls.groupBy("source").agg(F.ceil(F.count("*") / SALT).cast("int").alias("groups"))
    salted = scratch.write(hulls.join(groups, "source").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("groups")).cast("int")), "salted")
    none = F.lit(None)
    own = salted.groupBy("source", "salt").agg(F.min("slo").alias("lo"), F.max("shi").alias("hi")).select(F.col("source").alias("doc_id"), "source", "salt", none.cast("long").alias("doc"), "lo", "hi", none.cast("int").alias("slo"), none.cast("int").alias("shi"))
    asked = own.union(salted.select(F.col("doc").alias("doc_id"), "source", "salt", "doc", "lo", "hi", "slo", "shi"))
    parts = asked.groupBy("doc_id").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    asked = asked.join(parts, "doc_id").withColumn("part", F.pmod(F.xxhash64("source", "salt", "doc"), F.col("parts")))
    asked = asked.groupBy("doc_id", "part").agg(F.collect_list(F.struct("source", "salt", "doc", "lo", "hi", "slo", "shi")).alias("asked")).drop("part")
    asked = scratch.write(asked, "asked")
    few = asked.limit(BROADCAST_IDS // 8 + 1).count() <= BROADCAST_IDS // 8 and hulls.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4
    found = rows.join(F.broadcast(asked) if few else asked.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "asked")
    slices = found.mapInArrow(tidy(_slices), SLICES)
    placed = slices.repartition(buckets_for(rows), "source", "salt").sortWithinPartitions("source", "salt", F.col("doc").asc_nulls_first())
    return placed.mapInArrow(tidy(_verify), "doc_id long, first_word int, end_word int, source_id long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, where = batch.schema.get_field_index("text"), batch.schema.get_field_index("cut_")
        texts, spans = batch.column(at), batch.column(where)
        if spans.null_count < len(batch):
            changed = texts.to_pylist()
            for i in np.flatnonzero(np.asarray(spans.is_valid())).tolist():
                if changed[i] is None:
                    continue
                raw = changed[i].encode()
                data = np.frombuffer(raw, np.uint8)
                starts, _, _ = words(data, np.array([0, len(data)]))
                kept, last = [], 0
                for s, e in merged([(x["first_word"], x["end_word"]) for x in spans[i].as_py()]):
                    if s >= len(starts):
                        continue
                    kept.append(raw[last : starts[s]])
                    last = int(starts[e]) if e < len(starts) else len(raw)
                kept.append(raw[last:])
                changed[i] = b"".join(kept).decode()
            texts = pa.array(changed, pa.string())
        yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns) if i != where], names=[x for x in batch.schema.names if x != "cut_"])


def remove_passages(docs: DataFrame) -> DataFrame:
    """The documents without the passages that an earlier document has; all columns and rows stay."""
    spark = docs.sparkSession
    spans = Scratch(spark, "cuts").write(duplicate_passages(docs).groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "end_word")).alias("cut_")).withColumnRenamed("doc_id", "cut_id_"), "spans")
    few = spans.limit(BROADCAST_IDS // 8 + 1).count() <= BROADCAST_IDS // 8
    names = docs.columns
    inner = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c).alias(f"c{i}_") for i, c in enumerate(names)])
    key = F.col(f"c{names.index('doc_id')}_").cast("long") == F.col("cut_id_")
    both = inner.join(F.broadcast(spans) if few else spans.hint("shuffle_merge"), key, "left").drop("cut_id_")
    kept = both.mapInArrow(_cut, inner.schema)
    return kept.select(*[F.col(c if c == "text" else f"c{i}_").alias(c) for i, c in enumerate(names)])
