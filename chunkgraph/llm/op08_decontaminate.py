"""Benchmark decontamination with suffix arrays over the training documents.

Documents are indexed in shards of whole texts: a shard's suffix array holds its word positions sorted by the words
that follow. Every suffix of every test item is looked up by binary search, which gives all places of its first
ten words (the window), and its matches are followed word by word to their ends. Words that no test item has sort as
one symbol that matches nothing, and suffixes that begin with one are left out: no test suffix can begin there.

Test items are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text (one item at least); a shard is indexed
once, by the words of all blocks, and searched with one block after the other. The documents pass once for
``ROUND_BYTES`` of test items; if there are more, they pass again with the next blocks, and carry with them what has been
found, through a table in the shared folder. So what a worker holds doesn't grow with the items. There is no shuffle, so no skew: a passage in many documents gives matches in each
shard only, and windows that items share are searched once.

Defined cases: a null text has no words and is hit by nothing; an item without words has no window; one of fewer
than ten words is one window; item rows with a null item_id are left out; rows that share an item_id are one item;
one result row for each row of docs, whatever its doc_id; texts of any length are searched whole, and a window
never crosses documents; of equally long matches the one that comes first in the document counts, then the least
item_id as text; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .textops import ALNUM_WORD, chunks, ragged_take, word_hashes

WINDOW = 10
SHARD = 1 << 20  # bytes of text in a suffix array
BLOCK_BYTES, ROUND_BYTES = 8 << 20, 64 << 20
_U = np.uint64


class Tests:
    """The suffixes of a block of test items; words are ranked by a vocabulary that all blocks share."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, vocabulary: np.ndarray | None = None):
        self.window = window
        flat, self.owner = item_words(items)
        self.names = [str(i) for i, _ in items]
        self.vocabulary = np.unique(flat) if vocabulary is None else vocabulary
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.ranks = np.searchsorted(self.vocabulary, flat) + 1
        sizes = np.bincount(self.owner, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.place = np.arange(len(flat)) - begin[self.owner] if len(flat) else np.zeros(0, np.int64)
        self.left = sizes[self.owner] - self.place if len(flat) else np.zeros(0, np.int64)
        length = np.minimum(sizes[self.owner], window) if len(flat) else np.zeros(0, np.int64)
        self.opens = self.left >= length  # the suffixes that a whole window begins
        self.length = length
        self.keys = pack_words(self.ranks, begin, self.bits, window)
        # equal windows are searched once: their suffixes stand together
        at = np.flatnonzero(self.opens)
        by = at[np.lexsort([*(k[at] for k in self.keys), length[at]])]
        columns = [length[by], *(k[by] for k in self.keys)]
        head = np.zeros(len(by), bool)
        head[:1] = True
        for c in columns:
            head[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(head)
        self.suffixes, self.group_at, self.group_size = by, first, np.diff(np.append(first, len(by)))
        self.one = by[first]  # a suffix of each different window

    def bounds(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Least and greatest keys that begin with each different window."""
        per = 64 // self.bits
        low, high = [], []
        for k, key in enumerate(self.keys):
            inside = np.clip(self.length[self.one] - k * per, 0, per)
            free = ((per - inside) * self.bits).astype(_U)
            full = free >= _U(64)
            fill = np.where(full, ~_U(0), (_U(1) << np.where(full, _U(0), free)) - _U(1))
            low.append(key[self.one] & ~fill)
            high.append(key[self.one] | fill)
        return low, high


def item_words(items: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all items one after the other, and the item of each word."""
    hashes, owner = [], []
    for a, _, data, offsets in chunks(pa.array([t for _, t in items], pa.string())):
        h, first = word_hashes(data, offsets, ALNUM_WORD)
        hashes.append(h)
        owner.append(np.repeat(np.arange(a, a + len(first) - 1), np.diff(first)))
    return (np.concatenate(hashes), np.concatenate(owner)) if hashes else (np.zeros(0, _U), np.zeros(0, np.int64))


def pack_words(ranks: np.ndarray, begin: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    """The next ``depth`` ranks from every position, 0 beyond the end of its text, as 64-bit keys in order."""
    n, texts = len(ranks), len(begin) - 1
    text = np.repeat(np.arange(texts), np.diff(begin))
    padded = np.zeros(n + texts * depth + depth, _U)
    at = np.arange(n) + text * depth
    padded[at] = ranks
    per = 64 // bits
    keys = []
    for k in range(0, depth, per):
        key = np.zeros(n, _U)
        for j in range(k, k + per):
            key = key << _U(bits)
            if j < depth:
                key |= padded[at + j]
        keys.append(key)
    return keys


def _before(keys: list[np.ndarray], i: np.ndarray, query: list[np.ndarray], equal: bool) -> np.ndarray:
    """Whether entry i sorts before the query, or is equal if ``equal``."""
    out = np.full(len(i), equal)
    for key, q in zip(reversed(keys), reversed(query)):
        x = key[i]
        out = (x < q) | ((x == q) & out)
    return out


def search(keys: list[np.ndarray], query: list[np.ndarray], right: bool = False) -> np.ndarray:
    """Binary search of many queries at once in keys sorted together."""
    n, m = len(keys[0]), len(query[0])
    low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
    for _ in range(int(n).bit_length()):
        open_ = low < high
        mid = (low + high) >> 1
        less = open_ & _before(keys, np.minimum(mid, max(n - 1, 0)), query, right) if n else np.zeros(m, bool)
        low = np.where(less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


class Shard:
    """The suffix array of some documents."""

    def __init__(self, vocabulary: np.ndarray, window: int, data: np.ndarray, offsets: np.ndarray):
        hashes, self.first = word_hashes(data, offsets, ALNUM_WORD)
        i = np.searchsorted(vocabulary, hashes)
        i[i == len(vocabulary)] = 0
        known = vocabulary[i] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        self.ranks = np.where(known, i + 1, 0)
        keys = pack_words(self.ranks, self.first, max(1, int(len(vocabulary) + 1).bit_length()), window)
        at = np.flatnonzero(known)
        self.array = at[np.lexsort([k[at] for k in reversed(keys)])]
        self.keys = [k[self.array] for k in keys]

    def hits(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """(word position, different window) of every occurrence of a window."""
        low, high = tests.bounds()
        a, b = search(self.keys, low), search(self.keys, high, right=True)
        count = b - a
        return self.array[ragged_take(a, count)], np.repeat(np.arange(len(tests.one)), count)

    def follow(self, tests: Tests, position: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """How many words are equal from each position and test suffix on, within a document and an item."""
        end = self.first[self.document(position) + 1]
        length, live = np.zeros(len(position), np.int64), np.arange(len(position))
        while len(live):
            d = length[live]
            live = live[(d < tests.left[suffix[live]]) & (position[live] + d < end[live])]
            live = live[tests.ranks[suffix[live] + length[live]] == self.ranks[position[live] + length[live]]]
            length[live] += 1
        return length

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def longest(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """(length in words, word position) of each test suffix's longest match here; beside its place in the array."""
        at = search(self.keys, tests.keys)
        best, where = np.zeros(len(tests.ranks), np.int64), np.zeros(len(tests.ranks), np.int64)
        if not len(self.array):
            return best, where
        # beyond the window's depth equal keys are in no order: each of them is followed to its end
        right = search(self.keys, tests.keys, right=True)
        first, last = np.maximum(at - 1, 0), np.minimum(right + 1, len(self.array))
        count = last - first
        suffix = np.repeat(np.arange(len(tests.ranks)), count)
        position = self.array[ragged_take(first, count)]
        length = self.follow(tests, position, suffix)
        by = np.lexsort((position, -length, suffix))
        head = np.flatnonzero(np.concatenate([[True], suffix[by][1:] != suffix[by][:-1]]))
        best[suffix[by][head]], where[suffix[by][head]] = length[by][head], position[by][head]
        return best, where


@lru_cache(8)
def _tests(items: tuple[tuple[str, str], ...], vocabulary: bytes) -> Tests:
    return Tests(list(items), WINDOW, np.frombuffer(vocabulary, _U))


Block = tuple[tuple[str, str], ...]


def rounds(benchmark: DataFrame) -> Iterator[tuple[list, object, bool]]:
    """(broadcasts of blocks of test items, that of the words they have, whether it is the last) of about ``ROUND_BYTES``
    each; one block at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, each = max(1, -(-total // BLOCK_BYTES)), max(1, ROUND_BYTES // BLOCK_BYTES)
    context = benchmark.sparkSession.sparkContext
    for first in range(0, n, each):
        sent, words_ = [], np.zeros(0, _U)
        for k in range(first, min(first + each, n)):
            rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
            block: Block = tuple(sorted((r.item_id, r.text) for r in rows))
            sent.append(context.broadcast(block))
            words_ = np.union1d(words_, item_words(list(block))[0])
        yield sent, context.broadcast(words_.tobytes()), first + each >= n


STATE = "spans binary, items array<string>, longest int, longest_at int, longest_item string"
NAMES = [x.split()[0] for x in STATE.split(", ")]


def _scan(sent, vocabulary, kept: list[str], carried: bool):
    """Adds the hits of all blocks to each document, beside those of earlier rounds if there were any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(batch.schema.get_field_index("text")), SHARD):
                shard = Shard(np.frombuffer(vocabulary.value, _U), WINDOW, data, offsets)
                change = np.zeros(len(shard.ranks) + 1, np.int64)
                found: dict[int, set[str]] = {}
                best: dict[int, tuple[int, int, str]] = {}
                if carried:
                    spans, items, *longest = (batch.column(batch.schema.get_field_index(c)).slice(a, b - a).to_pylist() for c in NAMES)
                    for d, (x, names, n, p, i) in enumerate(zip(spans, items, *longest)):
                        if names:
                            edge = np.frombuffer(x, "<i4").reshape(-1, 2) + shard.first[d]
                            np.add.at(change, edge[:, 0], 1)
                            np.add.at(change, edge[:, 1], -1)
                            found[d], best[d] = set(names), (-n, p, i)
                for block in sent:
                    tests = _tests(block.value, vocabulary.value)
                    position, window = shard.hits(tests)
                    if not len(position):
                        continue
                    np.add.at(change, position, 1)
                    np.add.at(change, position + tests.length[tests.one[window]], -1)
                    document = shard.document(position)
                    pairs = np.unique(document << 32 | window)  # a document and a window of it, then the window's items
                    d, w = pairs >> 32, pairs & 0xFFFFFFFF
                    owner = tests.owner[tests.suffixes[ragged_take(tests.group_at[w], tests.group_size[w])]]
                    for x, i in np.unique(np.stack([np.repeat(d, tests.group_size[w]), owner], 1), axis=0).tolist():
                        found.setdefault(x, set()).add(tests.names[i])
                    # a longest match begins where none does a word before it; every item of its window is followed
                    count = tests.group_size[window]
                    suffix = tests.suffixes[ragged_take(tests.group_at[window], count)]
                    place = np.repeat(position, count)
                    opening = (place == shard.first[shard.document(place)]) | (tests.place[suffix] == 0)
                    inner = np.flatnonzero(~opening)
                    opening[inner] = shard.ranks[place[inner] - 1] != tests.ranks[suffix[inner] - 1]
                    suffix, place = suffix[opening], place[opening]
                    length, of = shard.follow(tests, place, suffix), shard.document(place)
                    at = place - shard.first[of]
                    by = np.lexsort((tests.owner[suffix], at, -length, of))
                    head = by[np.flatnonzero(np.concatenate([[True], of[by][1:] != of[by][:-1]]))] if len(by) else by
                    for x, n, p, i in zip(of[head].tolist(), length[head].tolist(), at[head].tolist(), tests.owner[suffix[head]].tolist()):
                        mine = (-n, p, tests.names[i])
                        best[x] = min(best.get(x, mine), mine)
                hit = np.cumsum(change[:-1]) > 0
                own = []
                for d in range(b - a):
                    x, y = int(shard.first[d]), int(shard.first[d + 1])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[x:y].astype(np.int8), [0]]))) if d in found else np.zeros(0, np.int64)
                    own.append(edge.astype("<i4").tobytes())
                columns = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in kept]
                longest = [best.get(d) for d in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(shard.first)), pa.array(own, pa.binary()), pa.array([sorted(found.get(d, ())) for d in range(b - a)], pa.list_(pa.string())), pa.array([x and -x[0] for x in longest], pa.int32()), pa.array([x and x[1] for x in longest], pa.int32()), pa.array([x and x[2] for x in longest], pa.string())],
                    names=[*kept, "n_words", *NAMES],
                )

    return run


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of docs with ``n_words``, ``spans`` (pairs of 32-bit word positions, half open), ``items``, and the
    longest verbatim match: ``longest`` words from word ``longest_at`` on, of ``longest_item``; null for none.

    Columns of docs with these names are replaced."""
    added = ["n_words", *NAMES]
    fields = [f for f in docs.schema.fields if f.name not in added]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fields)}, n_words long, {STATE}"
    kept = [f.name for f in fields]
    rows, scratch, carried = docs.select(*kept), None, False
    for k, (sent, vocabulary, last) in enumerate(rounds(benchmark)):
        rows = rows.mapInArrow(_scan(sent, vocabulary, kept, carried), schema)
        if last:
            break
        scratch, carried = scratch or Scratch(docs.sparkSession, "items"), True
        rows = scratch.write(rows, f"round-{k}")
        for x in [*sent, vocabulary]:
            x.unpersist()
        if k:
            scratch.drop(f"round-{k - 1}")
    return rows


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, n_words, spans, items, *longest = batch.columns
        hit = [int(np.diff(np.frombuffer(x, "<i4").reshape(-1, 2).astype(np.int64)).sum()) for x in spans.to_pylist()]
        names = items.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [doc, n_words, pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]), pa.array([x > 0 for x in hit]), *longest],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at", "longest_item"],
        )


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at, longest_item) of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest int, longest_at int, longest_item string"
    return matches(rows, benchmark).drop("text").select("doc_id", "n_words", "spans", "items", "longest", "longest_at", "longest_item").mapInArrow(_digest, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no window occurs in, columns as they are."""
    names = docs.columns
    inner = docs.select(*[F.col(c).alias(c if c == "text" else f"c{i}_") for i, c in enumerate(names)])
    found = matches(inner, benchmark).filter(F.size("items") == 0)
    return found.select(*[F.col(c if c == "text" else f"c{i}_").alias(c) for i, c in enumerate(names)])


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(item_id, item_word, length, doc_id, doc_word): each test suffix's longest verbatim match and a place of it,
    the least doc_id and position of equals; suffixes that match no word are left out."""

    def searched(sent, vocabulary):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, _, data, offsets in chunks(batch.column(1), SHARD):
                    shard = Shard(np.frombuffer(vocabulary.value, _U), WINDOW, data, offsets)
                    for block in sent:
                        tests = _tests(block.value, vocabulary.value)
                        length, position = shard.longest(tests)
                        some = np.flatnonzero(length)
                        d = shard.document(position[some])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([tests.names[i] for i in tests.owner[some].tolist()], pa.string()), pa.array(tests.place[some]), pa.array(length[some]), batch.column(0).take(pa.array(a + d)), pa.array(position[some] - shard.first[d])],
                            names=["item_id", "item_word", "length", "doc_id", "doc_word"],
                        )

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [rows.mapInArrow(searched(sent, vocabulary), "item_id string, item_word long, length long, doc_id long, doc_word long") for sent, vocabulary, _ in rounds(benchmark)]
    found = reduce(DataFrame.unionAll, parts)
    best = found.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "doc_word")).alias("m"))
    return best.select("item_id", "item_word", (-F.col("m.less")).alias("length"), "m.doc_id", "m.doc_word")
