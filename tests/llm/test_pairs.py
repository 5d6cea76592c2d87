import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkgraph.llm import graphs, op03_substring_dedup, op04_jaccard_join, op08_decontaminate
from chunkgraph.llm.graphs import components
from chunkgraph.llm.storage import Scratch
from chunkgraph.llm.textops import gram_hashes, mix


def low(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    above = {d: d for d in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_jaccard_join(docs, rows, none):
    found = op04_jaccard_join.near_duplicates(docs).collect()
    assert len(found) == len(rows) + 2
    want = brute_components({r[0]: r[1] for r in rows})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == want
    assert [(r.n_shingles, r.component_id) for r in found if r.doc_id is None] == [(1, None)]
    assert op04_jaccard_join.near_duplicates(none).count() == 0


def test_jaccard_join_of_many_near_copies(spark):
    """A star: copies that are alike their base but not each other, and a large group of alike ones."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
    texts = {0: " ".join(base)}
    for k in range(1, 40):
        own = list(base)
        for i in rng.choice(200, 5, replace=False):
            own[i] = f"x{k}_{i}"
        texts[k] = " ".join(own)
    other = [f"v{i}" for i in range(150)]
    for k in range(40, 90):
        own = list(other)
        own[int(rng.integers(0, 150))] = f"y{k}"
        texts[k] = " ".join(own)
    found = op04_jaccard_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts)


def test_jaccard_join_cuts_hot_shingles_into_blocks(spark, monkeypatch):
    """Families that share a common passage and few links: what the first step leaves apart is tested in blocks."""
    monkeypatch.setattr(op04_jaccard_join, "TESTS", 40)
    rng = np.random.default_rng(6)
    common, texts = [f"c{i}" for i in range(100)], {}
    for k in range(70):
        own = list(common)
        for i in rng.choice(100, int(rng.integers(1, 9)), replace=False):
            own[i] = f"x{k}_{i}"
        texts[k] = " ".join(own)
    found = op04_jaccard_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = brute_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and 1 < len({c for _, c in want.values()}) < 70


def test_jaccard_join_sends_no_sets_of_large_texts_that_are_not_alike(spark, monkeypatch):
    """Of all pairs of 4 large texts only the pair that is alike may have its sets sent."""
    rng = np.random.default_rng(8)
    texts = {k: [f"w{i}" for i in rng.integers(0, 10**6, 5000)] for k in range(3)}
    texts[3] = [*texts[0][:4800], *texts[1][:200]]
    join = op04_jaccard_join.Join(spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string"))
    cls = [r.cls for r in join.classes.collect()]
    pairs = spark.createDataFrame([(min(p), max(p)) for p in itertools.combinations(cls, 2)], "a long, b long")
    rows, write = {}, join.scratch.write

    def counted(df, label):
        out = write(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(join.scratch, "write", counted)
    found = {frozenset((r.u, r.v)) for r in join.verify(pairs, "first").collect()}
    assert found == {frozenset((0, 3))} and rows["first-pairs"] == 6 and rows["first-hubs"] == 1


def test_jaccard_join_with_places_that_are_not_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(op04_jaccard_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(graphs, "BROADCAST_IDS", 0)
    found = op04_jaccard_join.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == brute_components({r[0]: r[1] for r in rows})


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 2**32))
def test_parities_never_tell_sets_further_apart_than_they_are(common, x, y, seed):
    h = np.unique(mix(np.arange(common + x + y, dtype=np.uint64) + np.uint64(seed)))
    own, other = h[: len(h) - y], np.concatenate([h[:common], h[len(h) - y :]])
    apart = op04_jaccard_join._apart(op04_jaccard_join._parities(own), op04_jaccard_join._parities(other))
    assert apart <= len(np.setxor1d(own, other)) and apart == op04_jaccard_join._apart(op04_jaccard_join._parities(other), op04_jaccard_join._parities(own))


def test_one_of_each_group_stays(docs, rows):
    kept = op04_jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, (_, c) in brute_components({r[0]: r[1] for r in rows}).items() if d == c}
    assert {r.doc_id for r in kept.collect()} == want | {None}


def test_rows_that_share_an_id_are_one_document(spark):
    texts = [(1, "a b c d e f g"), (1, "k l m n o p q"), (0, "a b c d e f g"), (2, "k l m n o p q"), (3, "r s t u v w x")]
    found = op04_jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(0, 0), (1, 0), (2, 0), (3, 3)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long").repartition(7)
    found = {r.u: r.component for r in components(edges, Scratch(spark, "test"), "c").collect()}
    assert found == {i: 0 for i in range(1, 201)} | {501: 500}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 12))
def test_compact_windows_cover_every_run_once(values, t):
    h = np.array(values, np.uint64)
    found = list(zip(*(x.tolist() for x in op03_substring_dedup.compact_windows(h, t))))
    for i in range(len(values)):
        for j in range(i + t - 1, len(values)):
            least = min(values[i : j + 1])
            inside = [c for l, c, r in found if l <= i <= c <= j <= r]
            assert len(inside) == 1 and values[inside[0]] == least


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def test_passages(docs, rows, none):
    found = op03_substring_dedup.duplicate_passages(docs).collect()
    texts = {r[0]: words_of(r[1]) for r in rows}
    covered, first = defaultdict(set), {}
    for d, w in texts.items():
        own = {}
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if first.get(k, d) != d:
                covered[d].update(range(i, i + 50))
            own[k] = d
        for k in own:
            first.setdefault(k, d)
    got = defaultdict(set)
    for r in found:
        assert r.source_id < r.doc_id and r.end_word - r.first_word >= 50
        a, b = shingle_set(" ".join(texts[r.doc_id][r.first_word : r.end_word])), shingle_set(" ".join(texts[r.source_id]))
        assert len(a & b) >= 0.75 * len(a)
        got[r.doc_id].update(range(r.first_word, r.end_word))
    for d, places in covered.items():
        assert places <= got[d], d
    assert op03_substring_dedup.duplicate_passages(none).count() == 0


def test_passages_within_frequent_wording(spark):
    """Pairs that share 50 words of which 40 are a line that many documents have, dealt over several tasks."""
    rng = np.random.default_rng(7)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    line, texts, pairs = words(40), {}, {}
    for k in range(60):
        texts[k] = words(30) + line + words(30)
    for k in range(60, 120, 2):
        before, after = words(5), words(5)
        for d in (k, k + 1):
            texts[d] = words(30) + before + line + after + words(30)
        pairs[k + 1] = k
    for k in range(120, 150):
        texts[k] = words(30) + line + words(30)
    order = [int(k) for k in rng.permutation(150)]
    docs = spark.createDataFrame([(k, " ".join(texts[k])) for k in order], "doc_id long, text string").repartition(7)
    got = defaultdict(set)
    for r in op03_substring_dedup.duplicate_passages(docs).collect():
        got[r.doc_id, r.source_id].update(range(r.first_word, r.end_word))
    for d, source in pairs.items():
        assert set(range(30, 80)) <= got[d, source], d


def test_passages_with_one_changed_word():
    """Every place of the change in passages of 50 to 70 words: what still is alike is found in its whole length."""
    rng = np.random.default_rng(11)
    words = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    grams = lambda w: gram_hashes(w, 5)
    for n in range(50, 71):
        for place in range(n):
            shared = words(n)
            changed = shared.copy()
            changed[place] = 1
            x, a = grams(np.concatenate([words(90), changed, words(80)])), grams(np.concatenate([words(40), shared, words(70)]))
            found = op03_substring_dedup.passages(x, a)
            covered = set()
            for s, e in found:
                assert e - s >= 46 and any(op03_substring_dedup._alike(x[s:e], a[lo:hi]) for lo in range(34, 48) for hi in range(40 + n - 12, 40 + n + 6))
                covered.update(range(s, e))
            assert set(np.flatnonzero(np.isin(x, a)).tolist()) <= covered, (n, place)
            assert len(covered) <= n - 4 + 5, (n, place)


@pytest.mark.parametrize("n", (50, 58, 66))
def test_passages_beside_a_repeated_line(n):
    """The other document has the passage's first words twice."""
    rng = np.random.default_rng(n)
    words = lambda k: rng.integers(0, 1 << 62, k).astype(np.uint64)
    shared = words(n)
    changed = shared.copy()
    changed[14] = 1
    x = gram_hashes(np.concatenate([words(60), changed, words(60)]), 5)
    a = gram_hashes(np.concatenate([shared[:12], words(60), shared, words(60)]), 5)
    assert any(s <= 60 and e >= 60 + n - 4 for s, e in op03_substring_dedup.passages(x, a))


def test_run_hashes():
    values = np.random.default_rng(3).integers(0, 3, 4000).astype(np.uint64)
    for t in (1, 2, 5, 7, 46):
        found = op03_substring_dedup.run_hashes(values, t).tolist()
        runs = [tuple(values[i : i + t].tolist()) for i in range(len(values) - t + 1)]
        assert len(found) == len(runs) and len(set(zip(found, runs))) == len(set(found)) == len(set(runs))


def test_cut_passages(docs, rows):
    kept = op03_substring_dedup.remove_passages(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 2
    after = {r.doc_id: r.text for r in kept.collect()}
    for d, t in [(r[0], r[1]) for r in rows[:6]]:
        assert after[d] == t
    seen = set()
    for d in sorted(k for k in after if k is not None):
        w = words_of(after[d])
        own = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        assert not own & seen
        seen |= own


def brute_hits(items, t):
    windows = defaultdict(set)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, x in items:
        w = word.findall(low(x))
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(str(i))
    w, hit, names = word.findall(low(t)), set(), set()
    for k in {len(x) for x in windows}:
        for j in range(len(w) - k + 1):
            if own := windows.get(tuple(w[j : j + k])):
                hit.update(range(j, j + k))
                names |= own
    return len(w), len(hit), names


def brute_longest(items, t):
    """The longest run of words that begins with a window of an item, its place and item; first and least of equals."""
    word, best = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (0, 0, "")
    w = word.findall(low(t))
    for i, x in items:
        v = word.findall(low(x))
        for a in range(len(v) - min(10, len(v)) + 1 if v else 0):
            for b in [b for b in range(len(w)) if w[b] == v[a]]:
                n = 0
                while a + n < len(v) and b + n < len(w) and v[a + n] == w[b + n]:
                    n += 1
                if n >= min(10, len(v)):
                    best = min(best, (-n, b, str(i)))
    return (-best[0], best[1], best[2]) if best[0] else (None, None, None)


@pytest.fixture(scope="session")
def items(rows):
    word = lambda i, a, b: " ".join(rows[i][1].split()[a:b])
    return [(1, word(8, 3, 25).upper()), (2, word(9, 0, 10)), (3, word(12, 1, 4)), (4, "no such words anywhere at all in this corpus of ours"), (5, ""), (6, None), (10, "same same same"), (7, word(48, 100, 140)), (7, word(48, 100, 140)), (8, "naïve-ÉTÉ")]


def test_hits(spark, docs, rows, none, items, monkeypatch):
    bench = spark.createDataFrame([*items, (None, "one two three four")], "item_id long, text string")
    texts = {r[0]: r[1] for r in rows}
    for block, whole in ((op08_decontaminate.BLOCK_BYTES, op08_decontaminate.ROUND_BYTES), (200, op08_decontaminate.ROUND_BYTES), (200, 400)):  # in one block, in several, and in several rounds
        monkeypatch.setattr(op08_decontaminate, "BLOCK_BYTES", block)
        monkeypatch.setattr(op08_decontaminate, "ROUND_BYTES", whole)
        found = op08_decontaminate.digests(docs, bench).collect()
        assert len(found) == len(rows) + 2
        for r in found:
            if r.doc_id is None:
                continue
            n, hit, names = brute_hits(items, texts[r.doc_id])
            digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), digest, hit > 0), r.doc_id
            assert (r.longest, r.longest_at, r.longest_item) == brute_longest(items, texts[r.doc_id]), r.doc_id
    assert op08_decontaminate.digests(none, bench).count() == 0
    assert op08_decontaminate.digests(docs, bench.limit(0)).filter("contaminated").count() == 0
    kept = op08_decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, t in texts.items() if not brute_hits(items, t)[1]} | {None}


def test_longest_matches(spark, docs, items):
    found = op08_decontaminate.longest_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    best = {(r.item_id, r.item_word): (r.length, r.doc_id) for r in found}
    assert best[("1", 0)][0] >= 20 and best[("7", 0)] == (40, 48)


def test_mixing_is_one_to_one():
    x = np.arange(1 << 16, dtype=np.uint64) << np.uint64(40)
    assert len(np.unique(mix(x))) == len(x)
