"""Byte-level BPE: a vectorised split into pieces, a piece cache, and speculate-and-verify encoding.

Texts are cut into pieces by whole-array comparisons of character classes. Each distinct piece of a worker is
encoded once. :class:`Speculative` proposes the greedy longest match of every new piece in lockstep, tests all
adjacent token pairs with array operations, and merges exactly only the pieces that fail a test.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from .textops import mix, ragged_take, span_hashes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Letters and numbers that Unicode 16 adds to what Python's tables may know; (first, last).
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Contractions that are pieces of their own after an apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def character_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    t = np.frombuffer(bytes(kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8).copy()
    t[[9, 10, 11, 12, 13, 0x85]] = SPACE
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            t[a : b + 1] = kind
    return t


def pieces(data: np.ndarray, offsets: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of all documents, and the index of each document's first piece.

    A special token's text inside a document is one piece, and splits what stands around it.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    raw = data.tobytes()
    lead = (data & 0xC0) != 0x80
    at_byte = np.flatnonzero(lead)
    code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    n = len(code)
    cut = np.zeros(n + 1, bool)
    cut[np.searchsorted(at_byte, offsets)] = True
    cut[0] = cut[n] = True
    whole = []
    for special in specials:
        i = raw.find(special)
        while i >= 0:
            a = int(np.searchsorted(at_byte, i))
            if not cut[a + 1 : a + len(special)].any():  # else it spans two documents
                whole.append((a, a + len(special)))
                i += len(special) - 1
            i = raw.find(special, i + 1)
    for a, b in whole:
        cut[a] = cut[b] = True
    kind = character_classes()[code]
    space = kind == SPACE
    change = cut[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    blank = code == 0x20
    start = change.copy()
    glued = np.zeros(n, bool)  # what follows a blank belongs to the blank's piece
    glued[1:] = blank[:-1] & ~space[1:] & ~cut[1:n]
    start &= ~glued
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~cut[1:n]
    start |= last
    for i in np.flatnonzero((code == 0x27) & start).tolist():
        for tail in CONTRACTIONS:
            e = i + 1 + len(tail)
            if e <= n and not cut[i + 1 : e].any() and all(code[i + 1 + j] == ord(x) for j, x in enumerate(tail)):
                start[i + 1 : e] = False
                if e < n and kind[e] == LETTER and not cut[e]:
                    start[e] = True
                break
    for a, b in whole:
        start[a] = True
        start[a + 1 : b] = False
    starts = at_byte[np.flatnonzero(start)]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, offsets)


class Vocabulary:
    """A tokenizer file's tokens as bytes, its merges by rank and its special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*model["vocab"].values(), *self.specials.values()])
        self.tokens = [b""] * self.size
        for shown_as, i in model["vocab"].items():
            self.tokens[i] = self._bytes(shown_as)
        for content, i in self.specials.items():
            self.tokens[i] = content.encode()
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in self.byte_of.items():
            self.byte_ids[b] = ids[c]

    def _bytes(self, shown_as: str) -> bytes:
        return bytes(self.byte_of[c] for c in shown_as)


class Speculative:
    """Exact BPE of byte strings by greedy proposals, vectorised pair checks and exact merges of what fails."""

    LONG = 64  # bytes; longer failing words are merged one by one with a heap

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.special_ids = {t.encode(): i for t, i in v.specials.items()}
        self.rank = np.full(v.size, -1, np.int64)
        self.left, self.right = np.arange(v.size), np.arange(v.size)
        for (a, b), (rank, c) in v.merges.items():
            if self.rank[c] < 0 and c not in (a, b):
                self.rank[c], self.left[c], self.right[c] = rank, a, b
        keys = np.array([a << 32 | b for a, b in v.merges], np.int64).reshape(-1)
        by = np.argsort(keys)
        self.pair_keys = keys[by]
        self.pair_ranks = np.array([r for r, _ in v.merges.values()], np.int64).reshape(-1)[by]
        self.pair_tokens = np.array([c for _, c in v.merges.values()], np.int64).reshape(-1)[by]
        self._build_trie()
        special = set(v.specials.values())
        self.sound = np.array([i not in special and len(t) > 0 and self.merge(t) == [i] for i, t in enumerate(v.tokens)])
        self.checked_pairs = np.zeros(0, np.int64)
        self.checked_good = np.zeros(0, bool)
        self.proposed = self.failed = 0

    def _build_trie(self) -> None:
        child: dict[int, int] = {}
        accept = [-1]
        for i, t in enumerate(self.v.tokens):
            if not t or i in self.v.specials.values():
                continue
            node = 0
            for b in t:
                key = node << 8 | b
                if key not in child:
                    child[key] = len(accept)
                    accept.append(-1)
                node = child[key]
            accept[node] = i
        keys = np.fromiter(child.keys(), np.int64, len(child))
        by = np.argsort(keys)
        self.edges, self.targets, self.accept = keys[by], np.fromiter(child.values(), np.int64, len(child))[by], np.array(accept)
        self.root = np.full(256, -1, np.int64)
        top = self.edges < 256
        self.root[self.edges[top]] = self.targets[top]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one word by a heap of its pairs: the least rank first, the leftmost of equals."""
        ids = self.v.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        merges, n = self.v.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = merges[pair][1], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in merges:
                    heapq.heappush(heap, (merges[p][0], x, p))
        return [i for i in ids if i is not None]

    def merge_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words at once: each round merges every word's pair of least rank."""
        lengths = ends - starts
        token = self.v.byte_ids[data[ragged_take(starts, lengths)]]
        word = np.repeat(np.arange(len(starts)), lengths)
        none = np.iinfo(np.int64).max
        out_word, out_token = [], []
        while len(word):
            key = token[:-1] << 32 | token[1:]
            i = np.searchsorted(self.pair_keys, key)
            i[i == len(self.pair_keys)] = 0
            real = (self.pair_keys[i] == key) & (word[1:] == word[:-1])
            rank = np.full(len(word), none)
            rank[:-1][real] = self.pair_ranks[i[real]]
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(word))))
            done = least == none
            if done.any():
                out_word.append(word[done])
                out_token.append(token[done])
            hit = (rank == least) & ~done
            place = np.arange(len(word))  # of pairs that overlap, as in three equal tokens, every second one merges
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, -1))
            hit &= (place - run) % 2 == 0
            gone = np.concatenate([[False], hit[:-1]])
            token = np.where(hit, self.pair_tokens[np.append(i, 0)], token)
            stay = ~gone & ~done
            word, token = word[stay], token[stay]
        word, token = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_word, out_token))
        return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(starts))

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words in lockstep: (word of each token, token), by word and place."""
        owner = np.arange(len(starts))
        at = starts.copy()
        out_word, out_token, out_at = [], [], []
        while len(owner):
            node = self.root[data[at]]
            token, length = self.accept[node], np.ones(len(at), np.int64)
            live, depth = np.arange(len(at)), 1
            while True:
                live = live[at[live] + depth < ends[owner[live]]]
                if not len(live):
                    break
                key = node[live] << 8 | data[at[live] + depth]
                i = np.searchsorted(self.edges, key)
                i[i == len(self.edges)] = 0
                hit = self.edges[i] == key
                live, i = live[hit], i[hit]
                node[live] = self.targets[i]
                depth += 1
                done = self.accept[node[live]]
                good = done >= 0
                token[live[good]], length[live[good]] = done[good], depth
            out_word.append(owner)
            out_token.append(token)
            out_at.append(at)
            at = at + length
            more = at < ends[owner]
            owner, at = owner[more], at[more]
        word, token, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_word, out_token, out_at))
        by = np.lexsort((place, word))
        return word[by], token[by]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        i = np.searchsorted(self.pair_keys, key)
        i[i == len(self.pair_keys)] = 0
        if not len(self.pair_keys):
            return np.full(len(a), -1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b, each the encoding of its own bytes, stay apart side by side.

        Undoes merges from both ends of the border, the latest first. A merge across the border that ranks
        before the merge that was undone last would have come first; on equal ranks the leftmost wins.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self._rank_of(x, y)
            bad = (across >= 0) & (across < limit[live])
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            rx, ry = self.rank[x], self.rank[y]
            open_ = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[open_], x[open_], y[open_], rx[open_], ry[open_]
            undo_left = rx > ry
            a[live[undo_left]], limit[live[undo_left]] = self.right[x[undo_left]], rx[undo_left]
            r = ~undo_left
            # a merge over the border of the same rank as the one undone on the right stands further left: it wins
            b[live[r]], limit[live[r]] = self.left[y[r]], ry[r] + 1
        return good

    def _pairs_good(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(a << 32 | b, return_inverse=True)
        i = np.searchsorted(self.checked_pairs, pairs)
        i[i == len(self.checked_pairs)] = 0
        known = self.checked_pairs[i] == pairs if len(self.checked_pairs) else np.zeros(len(pairs), bool)
        good = np.zeros(len(pairs), bool)
        if known.any():
            good[known] = self.checked_good[i[known]]
        new = pairs[~known]
        if len(new):
            good[~known] = self.compatible(new >> 32, new & 0xFFFFFFFF)
            keep = len(self.checked_pairs) < 1_000_000
            keys = np.concatenate([self.checked_pairs, new]) if keep else new
            by = np.argsort(keys)
            self.checked_good = (np.concatenate([self.checked_good, good[~known]]) if keep else good[~known])[by]
            self.checked_pairs = keys[by]
        return good[back]

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words one after the other, number of ids of each word)."""
        word, token = self.propose(data, starts, ends)
        bad_token = ~self.sound[token]
        inner = word[1:] == word[:-1]
        bad_pair = np.zeros(len(inner), bool)
        if inner.any():
            bad_pair[inner] = ~self._pairs_good(token[:-1][inner], token[1:][inner])
        failing = np.unique(np.concatenate([word[bad_token], word[:-1][bad_pair]]))
        count = np.bincount(word, minlength=len(starts))
        self.proposed += len(starts)
        self.failed += len(failing)
        exact: dict[int, list[int]] = {}
        for text, i in self.special_ids.items():
            for w in np.flatnonzero(ends - starts == len(text)).tolist():
                if data[starts[w] : ends[w]].tobytes() == text:
                    exact[w] = [i]
        long = ends[failing] - starts[failing] > self.LONG
        for w in failing[long].tolist():
            if w not in exact:
                exact[w] = self.merge(data[starts[w] : ends[w]].tobytes())
        short = np.array([w for w in failing[~long].tolist() if w not in exact], np.int64)
        ids, lengths = self.merge_many(data, starts[short], ends[short])
        which = np.concatenate([short, np.array(list(exact), np.int64)])
        if not len(which):
            return token, count
        ids = np.concatenate([ids, *(np.array(x, np.int64) for x in exact.values())])
        lengths = np.concatenate([lengths, np.array([len(x) for x in exact.values()], np.int64)])
        keep = np.ones(len(starts), bool)
        keep[which] = False
        new_count = count.copy()
        new_count[which] = lengths
        begin = np.concatenate([[0], np.cumsum(new_count)[:-1]])
        out = np.zeros(int(new_count.sum()), np.int64)
        kept = np.flatnonzero(keep)
        out[ragged_take(begin[kept], new_count[kept])] = token[keep[word]]
        out[ragged_take(begin[which], lengths)] = ids
        return out, new_count


class PieceCache:
    """Ids of the distinct pieces that a worker has met: sorted hashes over one flat array of ids."""

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int = 500_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.front_key = np.zeros(1 << 20, np.uint64)
        self.front_at = np.full(1 << 20, -1, np.int32)
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _add(self, data, starts, ends, keys) -> np.ndarray:
        ids, count = self.encode(data, starts, ends)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.arange(len(self.begin), len(self.begin) + len(keys), dtype=np.int32)
        self.begin = np.concatenate([self.begin, self.used + np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)])
        self.count = np.concatenate([self.count, count.astype(np.int32)])
        self.used += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at = np.insert(self.keys, place, keys), np.insert(self.at, place, at)
        return at

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each piece)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.keys) > self.most:
            self.clear()
        h = span_hashes(data, starts, ends)
        slot = h >> np.uint64(44)
        at = np.where(self.front_key[slot] == h, self.front_at[slot], -1)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            keys, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            i = np.searchsorted(self.keys, keys)
            i[i == len(self.keys)] = 0
            known = self.keys[i] == keys if len(self.keys) else np.zeros(len(keys), bool)
            found = np.zeros(len(keys), np.int32)
            if known.any():
                found[known] = self.at[i[known]]
            if not known.all():
                new = miss[first[~known]]
                found[~known] = self._add(data, starts[new], ends[new], keys[~known])
            at[miss] = found[back]
            self.front_key[slot[miss]], self.front_at[slot[miss]] = h[miss], found[back]
        count = self.count[at].astype(np.int64)
        return self.ids[ragged_take(self.begin[at], count)], count


def library_encoder(text: str):
    """Encodes distinct pieces with the tokenizers library, in the calling thread alone: a worker has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    # a token shows each of its bytes as one character; added tokens are shown as they are
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    size = np.zeros(1 + max([0, *vocabulary.values(), *added]), np.int64)
    for shown, i in vocabulary.items():
        size[i] = len(shown)
    for i, content in added.items():
        size[i] = len(content.encode())

    def encode(data, starts, ends):
        raw = data.tobytes()
        some = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        ids = np.array(tokenizer.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        # the pieces' ends by bytes, as their tokens hold the same bytes
        at, want = np.cumsum(size[ids]), np.cumsum(ends - starts)
        last = np.searchsorted(at, want)
        if len(ids) and at[-1] == want[-1] and (at[last] == want).all():
            return ids, np.diff(last, prepend=-1)
        found = [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(count.sum())), count

    return encode


def per_document(data, offsets, cache: PieceCache, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents one after the other, number of ids of each)."""
    starts, ends, first = pieces(data, offsets, specials)
    ids, count = cache.lookup(data, starts, ends)
    total = np.concatenate([[0], np.cumsum(count)])
    return ids, np.diff(total[first])


__all__ = ["PieceCache", "Speculative", "Vocabulary", "character_classes", "library_encoder", "mix", "per_document", "pieces"]
