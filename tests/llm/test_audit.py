"""Filter audit, hard negatives and divergence rules against plain loops, with the cases that they define."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkgraph.llm import op11_filter_audit as audit
from chunkgraph.llm import op12_hard_negatives as negatives
from chunkgraph.llm import op13_divergence as divergence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, digest string, part string, n long, w string, grams int"


def texts():
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 6))) for _ in range(400)]
    out = [None, "", " \n\t", "one", "A B C # d", "x " * 300, "UP " * 30 + "down " * 10, "a | b\na | b\n\nc\n \nc\nc", "same three words " * 80]
    out += [" ".join(rng.choice(vocabulary, n)) for n in (10, 60, 199, 200, 201, 450, 900)]
    out += [out[10], out[10], "", None, out[12] + " $", "ß Ü É é 漢字 １ ٣ " * 40, "w " * 20 + "new word\u0085 x"]
    return out


def corpus(spark, langs=("en", "de", None, "")):
    rows = [(i * 3 % 29, t, langs[i % len(langs)], "s", "d", "p", i, "w", 1) for i, t in enumerate(texts())]
    rows += [rows[3], rows[12], (None, texts()[10], "en", None, None, None, None, None, None), (None, "", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


def masks(rows):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r[0] is not None and r[0] > first[t]}
        yield r[0], r[2] or "", {k for k, v in fails.items() if v}


def test_audit_is_that_of_every_order(spark):
    docs, rows = corpus(spark)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 29, 2)] + [(6, 1, 1), (6, 0, 0), (None, 1, 1), (8, None, None), (500, 1, 1)]
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    good, toxic = ({i for i, *kinds in labels if i is not None and kinds[k] == 1} for k in (0, 1))
    told = list(masks(rows))
    want, shapley = {}, Counter()
    for part in {p for _, p, _ in told}:
        own = [(i, m) for i, p, m in told if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, m) for i, m in left if x in m]
                failing = [m for _, m in own if x in m]
                left = [(i, m) for i, m in left if x not in m]
                shapley[part, x] += len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(m == {x} for m in failing), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    found = audit.audit(docs, labelled).collect()
    assert len(found) == len(want) == 600 * len({p for _, p, _ in told})
    for r in found:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_audit_of_other_filters_and_of_nothing(spark):
    docs, rows = corpus(spark, ("en",))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = audit.audit(docs, labels, {"s": lambda text, w: F.size(w) < 3}, "c").collect()
    assert len(found) == 2 * 2 * len({r.part for r in found}) and {r.filter_order for r in found} == {"sc", "cs"}
    short = sum(len(WORD.findall(r[1] or "")) < 3 for r in rows)
    assert sum(r.removed for r in found if r.filter_order == "sc" and r.step == 1) == short
    assert audit.audit(docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        audit.audit(docs, labels, {"ab": lambda text, w: F.lit(True)})


def mined(rows, every=50, positives=5, negatives_=3):
    rows = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, lab, v in {(i, lab, tuple(v)) for i, lab, v in rows if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(v, u)), i, x) for i, x, u in rows if i != a and len(u) == len(v))
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            far = [(n, t) for t, n, x in scored if x != lab and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k, n, -s, -t) for k, (n, t) in enumerate(far[:negatives_], 1)]
    return sorted(out)


def vectors(rng, n=160):
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(0.1, 0.3, 5)]) for i in range(n)]
    rows += [(1000 + i, 1, rows[20][2]) for i in range(40)]  # one vector many times
    rows += [(700, 1, [0.5] * 5), (750, 2, [0.5] * 4), (751, 1, [0.4] * 4), (752, 2, [0.45] * 4), (800, 0, [0.0] * 5), (850, 1, [-1.0] * 5)]
    rows += [(None, 1, [1.0] * 5), (900, None, [1.0] * 5), (901, 1, None), (902, 1, [1.0, None, 1.0, 1.0, 1.0]), (903, 1, [float("nan")] + [1.0] * 4), (904, 1, [float("inf")] + [1.0] * 4), (950, 1, [])]
    return [*rows, rows[30], rows[100]]


VECTORS = "vec_id long, label int, embedding array<double>, key long, block int"


@pytest.mark.parametrize("block", [8192, 2])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BATCH", 37)
    monkeypatch.setattr(negatives, "CELLS", 64)
    monkeypatch.setattr(negatives, "GROUP", 2)
    rows = vectors(np.random.default_rng(3))
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS).repartition(5)
    found = negatives.mine(frame, F.col("vec_id") % 50 == 0, block=block)
    got = sorted(tuple(r) for r in found.collect())
    assert got == mined(rows) and len({r[0] for r in got}) >= 3
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_beyond_floats_and_of_nothing(spark):
    rows = [(50 * i, i % 2, [float(2**20 + i), 3.0 * i, -1.0]) for i in range(6)] + [(50 * i + 1, (i + 1) % 2, [0.7 * (2**20 + i), 1.0, 2.0]) for i in range(6)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)
    assert sorted(tuple(r) for r in negatives.mine(frame, F.col("vec_id") % 50 == 0).collect()) == mined(rows)
    for none in (frame.limit(0), frame.filter("vec_id = 1")):
        assert negatives.mine(none, F.col("vec_id") % 50 == 0).count() == 0


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed)


def test_counts_of_divergence_rules(spark):
    docs, rows = corpus(spark)
    long = " ".join(f"w{i % 9973}" for i in range(60_000)) + "\n" + " ".join(f"w{i}" for i in range(20_000))
    rows = [*rows, (900, long, "en", None, None, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(rows[-1:], DOCS))
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in divergence.judge(docs).collect())
    assert found == Counter((r[0], *plain(r[1])) for r in rows)
    assert divergence.judge(docs.limit(0)).count() == 0


def prose(rng, words, n):
    weights = 1 / np.arange(1, len(words) + 1)
    return " ".join(str(x) + ("." if rng.random() < 0.1 else "") for x in rng.choice(words, n, p=weights / weights.sum()))


def test_strange_documents_go_and_the_others_stay(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = {x: [x + "".join(rng.choice(list("abcdefghi"), rng.integers(1, 5))) for _ in range(600)] for x in "kz"}
    docs = [(i, prose(rng, words["kz"[i % 2]], int(rng.integers(60, 500))), "kz"[i % 2]) for i in range(120)]
    docs += [(1000 + i, docs[0][1], "k") for i in range(60)]  # a third of a language is one text
    docs += [(2000, prose(rng, words["z"], 300), "k"), (2001, prose(rng, words["k"], 300).upper(), "k"), (2002, " ".join(f"{i}|" for i in range(400)), "z")]
    docs += [(3000 + i, " ".join(f"{a}{i} kab" for a in range(900)), "k") for i in range(3)]  # few documents repeat one word very often
    docs += [(4000, prose(rng, words["z"], 40), "k"), (4001, prose(rng, words["k"], 300), "other")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    for languages, few in ((5000, 100), (5000, 0), (1, 0)):
        monkeypatch.setattr(divergence, "FEW_LANGUAGES", few)
        monkeypatch.setattr(divergence.distances, "__defaults__", (languages,))
        kept = {r.doc_id: r.kept for r in divergence.judge(frame).collect()}
        assert len(kept) == len(docs)
        base = {i for i, t, _ in docs if plain(t)[-1]}
        assert {i for i, k in kept.items() if not k} - base == {2000, 2001, 2002, 3000, 3001, 3002}
        assert kept[4001] and not kept[4000]


def test_divergence_is_that_of_two_histograms(spark):
    p, q = [3.0, 0.0, 1.0], [2.0, 5.0, 0.0]
    row = spark.createDataFrame([(p, q, [0.0] * 3)], "p array<double>, q array<double>, z array<double>")
    r = row.select(divergence.squared_distance(F.col("p"), F.col("q")).alias("d"), divergence.squared_distance(F.col("p"), F.col("p")).alias("same"), divergence.squared_distance(F.col("p"), F.col("z")).alias("none")).first()
    x, y = np.array(p) / 4, np.array(q) / 7
    m = (x + y) / 2
    want = sum(a * np.log2(a / c) for a, c in zip(x, m) if a) / 2 + sum(b * np.log2(b / c) for b, c in zip(y, m) if b) / 2
    assert abs(r.d - want) < 1e-12 and abs(r.same) < 1e-12 and r.none is None
