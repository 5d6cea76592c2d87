"""N-gram Jaccard join: rare-first prefix filtering, one verification for each pair, then components.

A document's set is its distinct 5-word shingles. Documents with equal sets form a class and take part once. The
shingles of a set are ordered rare first, by a count sketch over all documents that has a fixed size (any common
order gives the same links; the counts only make prefixes selective). Two sets with a Jaccard similarity of at
least 75 % share a shingle among the first ``n - ceil(0.75 n) + 1`` of each, so prefixes are exchanged by shingle.
Pairs of a shingle pass a length and a positional filter; distinct pairs pass a suffix filter, an upper bound of
the overlap from parities, one bit or more for each shingle of a set; what is left is verified on the sets, once.
Sets go from the scan of the texts to their hubs at once, and only those of pairs that are left.

Large groups of near copies don't give all their pairs: a shingle with more than ``ALL_PAIRS`` classes first gives
the pairs with its few classes that have least of their own. Only pairs that the links found so far don't connect
follow, each at the first of the shingles that both have (as far as the first ``NAMING`` of each tell), so components
are those of all links. Equal sets are linked by class.

Skew: tokens of a shingle are folded by class within a task and spread by hash; the pairs of a shingle of very many
classes are dealt to several tasks as blocks of rows and columns; a hub's verification is salted.

Defined cases: a null or wordless text has an empty set, n_shingles 0, and is linked with nothing; fewer than five
words are one shingle; rows that share a doc_id are one document; rows with a null doc_id are linked by nothing
and keep a null component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .graphs import BROADCAST_IDS, by_id, components
from .storage import Scratch, buckets_for, partitions, release
from .textops import chunks, mix, ragged_take, shingles, tidy, word_hashes

SHINGLE = 5
SKETCH_BITS, SLICE_BITS = 22, 16
ALL_PAIRS = 12  # classes of a shingle that give all their pairs at once
HUBS, EARLY = 4, 8  # of a larger group: classes that the others are paired with, and for how many of their shared shingles
NAMING = 16  # shingles of a class by which a pair of the second step is known to be named before
TESTS = 1 << 18  # pairs of rows of a shingle that a task looks at together
SALT = 64  # pairs of a hub that are verified together
PARITIES = 1 << 10, 1 << 20  # least and most bits of a set's parities
SENT = 8 << 20  # bytes of sets in a batch
_U = np.uint64

INFO = "doc_id long, n long, cls long, check long, slice int, counts binary"


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of every text."""
    for a, _, data, offsets in chunks(column):
        hashes, first = word_hashes(data, offsets)
        for i, s in enumerate(shingles(hashes, first, SHINGLE)):
            yield a + i, np.unique(s) if len(s) > 1 else s


def _class(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed integers."""
    a = mix(s).sum(dtype=_U, keepdims=True)
    b = mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=_U, keepdims=True)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    names = [x.split()[0] for x in INFO.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        rows = []
        for i, s in _sets(batch.column(1)):
            sketch_at = (s >> _U(64 - SKETCH_BITS)).astype(np.int64)
            np.add.at(sketch, sketch_at, 1)
            rows.append((len(s), *_class(s)))
        n, cls, check = zip(*rows) if rows else ((), (), ())
        none = [None] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([batch.column(0), n, cls, check, none, none], kinds)], names=names)
    step = 1 << SLICE_BITS
    for k in range(len(sketch) // step):
        part = sketch[k * step : (k + 1) * step]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([[None]] * 4 + [[k], [blobs.pack(part)]], kinds)], names=names)


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = blobs.unpack(raw)[0].astype(np.uint64)
            total[k] = total[k] + part if k in total else part
    for k, counts in total.items():
        level = np.minimum(np.log2(counts.astype(np.float64) + 1) * 6, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "levels"])


def survey(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bytes]:
    """(size and class of every document; levels of the sketch: always 2**22 bytes)."""
    staged = scratch.write(docs.mapInArrow(tidy(_survey), INFO), "survey")
    n = min(partitions(docs.sparkSession), 1 << SKETCH_BITS - SLICE_BITS)
    slices = staged.filter("slice is not null").select("slice", "counts").repartition(n, "slice").mapInArrow(tidy(_add_slices), "slice int, levels binary").collect()
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in slices:
        levels[r.slice << SLICE_BITS : (r.slice + 1) << SLICE_BITS] = np.frombuffer(r.levels, np.uint8)
    return staged.filter("slice is null").select("doc_id", "n", "cls", "check"), levels.tobytes()


def prefix_size(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def _by_first(bucket, first, *rest) -> list[np.ndarray]:
    """Rows that ascend by their first column, which packs better."""
    by = np.argsort(first, kind="stable")
    return [c[by] for c in (bucket, first, *rest)]


def _prefixes(levels, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        out = blobs.Outbox(buckets, 1 << 19, _by_first)
        seen: set[int] = set()
        for batch in batches:
            for _, s in _sets(batch.column(0)):
                if not len(s):
                    continue
                cls = _class(s)[0]
                if cls in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(cls)
                n = len(s)
                rank = level[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(_U) << _U(56) | mix(s) >> _U(8)
                p = prefix_size(n)
                token = np.sort(np.partition(rank, p - 1)[:p] if p < n else rank)
                spread = mix(token)
                yield from out.put(blobs.bucket_of(spread, buckets), spread, np.full(p, cls, np.int64), np.full(p, n, np.int32), np.arange(p, dtype=np.int32))
        yield from out.flush()

    return run


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and sizes of the runs of equal keys."""
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(key)))


def _shared(buckets: int):
    """Of the exchanged prefixes those shingles that several classes have, sent on by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = blobs.gather(batches)
        if columns is None:
            return
        token, cls, n, pos = columns
        by = np.lexsort((cls, token))
        token, cls, n, pos = (c[by] for c in (token, cls, n, pos))
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, n, pos = (c[keep] for c in (token, cls, n, pos))
        head, size = _groups(token)
        several = np.repeat(size > 1, size)
        token, cls, n, pos = (c[several] for c in (token, cls, n, pos))
        out = blobs.Outbox(buckets, merge=_by_first)
        yield from out.put(blobs.bucket_of(mix(cls.view(_U)), buckets), cls, token, n, pos)
        yield from out.flush()

    return run


def _ranked(buckets: int):
    """Adds to each shared shingle how many shared ones stand before it in its prefix, and how many of the prefix are
    not shared; sent on by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = blobs.gather(batches)
        if columns is None:
            return
        cls, token, n, pos = columns
        by = np.lexsort((pos, cls))
        cls, token, n, pos = (c[by] for c in (cls, token, n, pos))
        head, size = _groups(cls)
        before = (np.arange(len(cls)) - np.repeat(head, size)).astype(np.int32)
        alone = n - (3 * n + 3) // 4 + 1 - np.repeat(size, size).astype(np.int32)  # of the prefix
        out = blobs.Outbox(buckets, merge=_by_first)
        yield from out.put(blobs.bucket_of(token, buckets), token, cls, n, pos, before, alone)
        yield from out.flush()

    return run


CANDIDATES = "a long, b long, token long, cls long, n int, pos int, before int"


def _possible(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Length and positional filters for rows (n, pos, before) of a common shingle.

    What is common lies among the shared shingles before it, or is it, or follows it."""
    (na, pa_, ba), (nb, pb_, bb) = ([c.astype(np.int64) for c in r] for r in (x, y))
    overlap = np.minimum(ba, bb) + np.minimum(na - pa_, nb - pb_)
    return (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (7 * overlap >= 3 * (na + nb))


def _partners(n: np.ndarray, pos: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of one shingle that ascend by n: the range of rows, up to its own, that each may be alike.

    A row has at most ``before + n - pos`` in common with any other, which bounds the size of its partner."""
    n, most = n.astype(np.int64), before.astype(np.int64) + n - pos
    low = np.searchsorted(n, -(-3 * n // 4), "left")
    high = np.minimum(np.searchsorted(n, 7 * most // 3 - n, "right"), np.arange(len(n)))
    return low, np.maximum(high, low)


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    k = len(pairs)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=[x.split()[0] for x in CANDIDATES.split(", ")])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = blobs.gather(batches)
    if columns is None:
        return
    by = np.lexsort((columns[1], columns[2], columns[0]))
    token, cls, n, pos, before, alone = (c[by] for c in columns)
    head, size = _groups(token)
    left, right, later = [], [], []
    small = np.repeat(size <= ALL_PAIRS, size)
    place = np.arange(len(token)) - np.repeat(head, size)
    of = np.repeat(size, size)
    for d in range(1, ALL_PAIRS):  # partners that stand d places further on in groups that give all pairs
        x = np.flatnonzero(small & (place + d < of))
        left.append(x)
        right.append(x + d)
    for h, k in zip(head[size > ALL_PAIRS].tolist(), size[size > ALL_PAIRS].tolist()):
        own = slice(h, h + k)
        low, high = _partners(n[own], pos[own], before[own])
        count = high - low
        if count.sum() <= 2 * k:
            left.append(np.repeat(np.arange(h, h + k), count))
            right.append(h + ragged_take(low, count))
            continue
        # the members with the fewest shingles of their own, the same ones for most shingles of a group of copies
        some = np.arange(h, h + k)
        hubs = h + np.lexsort((cls[own], alone[own]))[:HUBS]
        early = some[before[own] < EARLY]
        left.append(np.repeat(early, len(hubs)))
        right.append(np.tile(hubs, len(early)))
        later.append(some)
    x, y = np.concatenate(left), np.concatenate(right)
    good = (x != y) & _possible([n[x], pos[x], before[x]], [n[y], pos[y], before[y]])
    yield _pair_batch(cls[x[good]], cls[y[good]])
    if later:
        z = np.concatenate(later)
        k = len(z)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(token[z].view(np.int64)), pa.array(cls[z]), *(pa.array(c[z].astype(np.int32)) for c in (n, pos, before))], names=[x.split()[0] for x in CANDIDATES.split(", ")])


ACROSS = "token long, cls long, n int, pos int, before int, component long, main long, block int, side int, early array<long>"


def _named(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether rows x and y of a shingle have one of the first shingles before it in common."""
    sizes = np.fromiter(map(len, y), np.int64, len(y))
    flat, row = np.concatenate(y), np.repeat(np.arange(len(y)), sizes)
    by = np.argsort(flat, kind="stable")
    flat, row = flat[by], row[by]
    out = np.zeros((len(x), len(y)), bool)
    for i, own in enumerate(x):
        low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        for p, q in zip(low.tolist(), high.tolist()):
            out[i, row[p:q]] = True
    return out


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components from rows as ``ACROSS``, which come together by token and block.

    Side 0 has rows outside the token's largest component, side 1 rows of all; each row of side 0 takes those of the
    largest component, and those of others whose class is greater."""
    held: list[list[np.ndarray]] = []

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        left, right = ([c[np.flatnonzero(rows[8] == side)] for c in rows] for side in (0, 1))
        _, cls, n, pos, before, component, main, _, _, early = right
        if not len(cls):
            return
        largest = component == main
        for a in range(0, len(left[0]), 64):
            _, own_cls, own_n, own_pos, own_before, own_component, _, _, _, own_early = (c[a : a + 64, None] for c in left)
            good = (own_component != component) & (largest | (cls > own_cls))
            good &= _possible([own_n, own_pos, own_before], [n, pos, before])
            if good.any():
                good &= ~_named(own_early[:, 0].tolist(), early.tolist())
            x, y = np.nonzero(good)
            if len(x):
                yield _pair_batch(own_cls[x, 0], cls[y]).select(["a", "b"])

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        lists = batch.column(9)
        flat, at = np.asarray(lists.values, np.int64), np.asarray(lists.offsets)
        token = np.asarray(batch.column(0), np.int64)
        early = np.empty(len(batch), object)
        for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
            first = flat[a:b]  # those that stand before this one, which the classes' common order tells
            here = np.flatnonzero(first == token[i])
            early[i] = first[: here[0]] if len(here) else first
        return [*(np.asarray(c, np.int64) for c in batch.columns[:9]), early]

    for batch in batches:
        held.append(columns(batch))
        whole = [np.concatenate(c) for c in zip(*held)]
        change = (whole[0][1:] != whole[0][:-1]) | (whole[7][1:] != whole[7][:-1])
        head = np.flatnonzero(np.concatenate([[True], change])) if len(whole[0]) else np.zeros(0, np.int64)
        for x, y in zip(head[:-1].tolist(), head[1:].tolist()):
            yield from pairs([c[x:y] for c in whole])
        held = [[c[head[-1] :] for c in whole]] if len(head) else []
    if held and len(held[0][0]):
        yield from pairs([np.concatenate(c) for c in zip(*held)])


def _packed(s: np.ndarray) -> bytes:
    """40 bits of each hash, ascending."""
    return blobs.pack(np.sort(s >> _U(24)))


def _parities(s: np.ndarray) -> bytes:
    """Whether the shingles of each part by hash are odd in number; at least as many parts as shingles, up to a limit."""
    parts = min(max(PARITIES[0], 1 << (len(s) - 1).bit_length()), PARITIES[1])
    odd = np.bincount((s & _U(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(p: bytes, q: bytes) -> int:
    """Shingles that one of two sets has alone, at least: one for each part whose parities differ."""
    x, y = sorted((np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


MARKS = "cls long, n long, parities binary"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(_class(s)[0], len(s), _parities(s)) for _, s in _sets(batch.column(0))]
        columns = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64(), pa.int64(), pa.binary()])], names=[x.split()[0] for x in MARKS.split(", ")])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that end with the sizes and parities of both sets, those that may have enough in common."""
    for batch in batches:
        sizes = np.asarray(batch.column(5), np.int64) + np.asarray(batch.column(6), np.int64)
        apart = np.fromiter(map(_apart, batch.column(7).to_pylist(), batch.column(8).to_pylist()), np.int64, len(batch))
        yield batch.filter(pa.array(sizes >= 7 * apart)).select([0, 1, 2, 3, 4])


PLACE = "struct<cls: long, hub: long, other: long, u: long, v: long, salt: int>"
SENDING = "hub long, other long, u long, v long, salt int, packed binary"


def _needed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(_class(s)[0], _packed(s)) for _, s in _sets(batch.column(0))]
        cls, packed = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(packed, pa.binary())], names=["cls", "packed"])


def _sent_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of texts for each place of their class, from rows (text, places)."""
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
    names = [x.split()[0] for x in SENDING.split(", ")]
    for batch in batches:
        rows, size = [], 0
        places = batch.column(1)
        for i, s in _sets(batch.column(0)):
            cls, packed = _class(s)[0], None
            for x in places[i].as_py():
                if x["cls"] != cls:  # of another text with this doc_id
                    continue
                packed = packed or _packed(s)
                rows.append((x["hub"], x["other"], x["u"], x["v"], x["salt"], packed))
                size += len(packed)
                if size >= SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) from rows (hub, other, u, v, packed set); a hub's own set comes first, without another."""
    hub, hub_set = None, None
    for batch in batches:
        links = []
        for key, other, u, v, packed in zip(*(c.to_pylist() for c in batch.columns)):
            own = blobs.unpack(packed)[0]
            if other is None:
                hub, hub_set = key, own
                continue
            if key != hub:
                raise ValueError("a pair came without its hub")
            i = np.searchsorted(hub_set, own)
            i[i == len(hub_set)] = 0
            common = int((hub_set[i] == own).sum())
            if 100 * common >= 75 * (len(own) + len(hub_set) - common):
                links.append((u, v))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links) if links else ([], []))], names=["u", "v"])


class Join:
    """One run over (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.scratch = Scratch(self.spark, "jaccard")
        self.n = buckets_for(self.docs)
        info, levels = survey(self.docs, self.scratch)
        self.levels = self.spark.sparkContext.broadcast(levels)
        whole = info.filter("doc_id is not null and n > 0")
        reps = whole.groupBy("cls", "check").agg(F.min("doc_id").alias("rep"))
        self.classes = self.scratch.write(reps, "classes")
        self.members = info.select("doc_id", "n", "cls", "check")

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """(pairs of classes, members of the shingles that give their other pairs later)."""
        n = 2 * self.n
        rows = self.docs.filter("doc_id is not null").select("text").mapInArrow(tidy(_prefixes(self.levels, n)), blobs.SCHEMA)
        shared = blobs.exchange(rows, n).mapInArrow(tidy(_shared(n)), blobs.SCHEMA)
        ranked = blobs.exchange(shared, n).mapInArrow(tidy(_ranked(n)), blobs.SCHEMA)
        found = self.scratch.write(blobs.exchange(ranked, n).mapInArrow(tidy(_candidates), CANDIDATES), "candidates")
        del rows, shared, ranked
        release(self.spark)
        pairs = found.filter("a is not null").select("a", "b").distinct()
        return pairs, found.filter("token is not null").select("token", "cls", "n", "pos", "before")

    def sent(self, hubs: DataFrame) -> DataFrame:
        """Rows as ``SENDING``: the set of each pair's other class, and the hub's own once for each salt.

        While there are few, the places that sets go to are broadcast to where the texts are scanned."""
        none = F.lit(None).cast("long")
        place = lambda *c: F.struct(*c).cast(PLACE).alias("place")
        right = hubs.select(F.col("v").alias("doc_id"), place("other", "hub", "other", "u", "v", "salt"))
        left = hubs.select("hub", "u", "salt").distinct().select(F.col("u").alias("doc_id"), place("hub", "hub", none, none, none, "salt"))
        places = left.unionByName(right)
        if hubs.limit(BROADCAST_IDS // 8 + 1).count() <= BROADCAST_IDS // 8:
            places = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
            return self.docs.join(F.broadcast(places), "doc_id").select("text", "places").mapInArrow(tidy(_sent_sets), SENDING)
        sets = by_id(self.docs, places.select("doc_id").distinct(), "left_semi").select("text").mapInArrow(tidy(_needed_sets), "cls long, packed binary")
        return places.select("place.*").join(sets, "cls").select([x.split()[0] for x in SENDING.split(", ")])

    def verify(self, pairs: DataFrame, label: str) -> DataFrame:
        """Links (u, v) between the first documents of classes whose sets have at least 75 % in common.

        The parities of each set's parts by hash bound what a pair can have in common, so that few sets are sent that
        are not alike. The class with more pairs is a pair's hub."""
        pairs = self.scratch.write(pairs, f"{label}-pairs")
        degree = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("degree"))
        named = self.scratch.write(degree.join(self.classes, "cls").select("cls", "rep", "degree"), f"{label}-classes")
        marks = by_id(self.docs, named.select(F.col("rep").alias("doc_id")), "left_semi").select("text").mapInArrow(tidy(_marks), MARKS)
        info = self.scratch.write(named.join(marks, "cls").select("cls", "rep", "n", "parities", "degree"), f"{label}-marks")
        both = pairs.join(info.toDF("a", "ra", "na", "pa", "da"), "a").join(info.toDF("b", "rb", "nb", "pb", "db"), "b")
        first = F.col("da") >= F.col("db")
        ends = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "hub"), ("b", "a", "other"), ("ra", "rb", "u"), ("rb", "ra", "v"))]
        hubs = both.select(*ends, F.greatest("da", "db").alias("degree"), "na", "nb", "pa", "pb")
        hubs = hubs.mapInArrow(tidy(_suffixes), "hub long, other long, u long, v long, degree long")
        hubs = self.scratch.write(hubs.withColumn("salt", F.pmod(F.xxhash64("other"), F.ceil(F.col("degree") / SALT)).cast("int")).drop("degree"), f"{label}-hubs")
        together = self.sent(hubs).repartition(self.n, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("other").asc_nulls_first())
        links = self.scratch.write(together.select("hub", "other", "u", "v", "packed").mapInArrow(tidy(_verify), "u long, v long"), f"{label}-links")
        self.scratch.drop(f"{label}-classes", f"{label}-marks", f"{label}-hubs")
        release(self.spark)
        return links

    def labels(self, links: DataFrame, name: str) -> DataFrame:
        """(cls, component): the least doc_id that links reach from a class."""
        rep = self.classes.select("cls", "rep")
        if name == "all":  # rows that share a doc_id tie their classes together
            tied = self.members.filter("doc_id is not null and n > 0").select("doc_id", "cls").distinct()
            tied = tied.join(tied.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1"), "doc_id").join(rep, "cls")
            links = links.union(tied.select("doc_id", "rep"))
        found = components(links, self.scratch, f"components-{name}")
        return rep.join(found.withColumnRenamed("u", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component"))

    def links(self) -> DataFrame:
        """Links between classes, by their first documents, that have the components of all links."""
        pairs, big = self.candidates()
        links = self.verify(pairs, "first")
        if big.isEmpty():
            return links
        tested = self.scratch.read("first-pairs", pairs.schema)
        label = self.labels(links, "first")
        big = self.scratch.write(big.join(label, "cls"), "big")
        # shingles whose classes are not all connected, and into how many rows and columns of blocks their pairs are cut
        held = big.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("rows"), F.max(F.struct("k", "component")).alias("m"))
        rest = F.col("rows") - F.col("m.k")
        torn = held.filter(rest > 0).select("token", F.col("m.component").alias("main"), F.ceil(F.sqrt(F.col("rows") * rest / TESTS)).cast("int").alias("cuts"))
        torn = self.scratch.write(torn, "torn")
        few = torn.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2
        big = self.scratch.write(big.join(F.broadcast(torn) if few else torn.hint("shuffle_merge"), "token"), "torn-rows")
        self.scratch.drop("big", "candidates")
        first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "token"))), 1, NAMING), lambda x: x["token"])
        big = big.join(big.groupBy("cls").agg(first.alias("early")), "cls")
        own, cuts = F.pmod(F.xxhash64("cls"), F.col("cuts")), F.sequence(F.lit(0), F.col("cuts") - 1)
        left = big.filter("component <> main").withColumn("side", F.lit(0)).withColumn("block", F.explode(F.transform(cuts, lambda j: own * F.col("cuts") + j)))
        right = big.withColumn("side", F.lit(1)).withColumn("block", F.explode(F.transform(cuts, lambda i: i * F.col("cuts") + own)))
        names = [x.split()[0] for x in ACROSS.split(", ")]
        blocks = left.select(names).union(right.select(names)).withColumn("block", F.col("block").cast("int"))
        more = blocks.repartition(self.n, "token", "block").sortWithinPartitions("token", "block").mapInArrow(tidy(_across), "a long, b long")
        more = self.verify(more.distinct().join(tested, ["a", "b"], "left_anti"), "second")
        self.scratch.drop("torn", "torn-rows", "first-pairs", "second-pairs")
        return links.union(more)

    def documents(self) -> DataFrame:
        label = self.scratch.write(self.labels(self.links(), "all"), "labels")
        linked = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("cls"))
        rows = self.members.withColumn("cls", linked).join(label, "cls", "left")
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs."""
    return Join(docs).documents()


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the least of their component, all columns as they are."""
    found = near_duplicates(docs)
    return by_id(docs, found.filter("component_id <> doc_id").select("doc_id").distinct(), "left_anti")
