import math
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkgraph.llm import op01_quality_rules, op05_ngram_lm, op06_html_blocks, op09_ann_projections, op10_toxicity_mil
from chunkgraph.llm.storage import Scratch


def auc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    rank = np.argsort(np.argsort(score))
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def labelled(spark):
    """Shouted texts are poor; insults, some of them inflected, make a text toxic wherever they stand."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abdeilmnorstu"), rng.integers(2, 9))) for _ in range(600)]
    docs, labels = [], []
    for i in range(700):
        w = [str(x) for x in rng.choice(words, rng.integers(8, 120))]
        poor, toxic = i % 7 == 0, i % 9 == 0
        if toxic:
            for at in rng.integers(0, len(w), 3):
                w[at] = str(rng.choice(["zlowt", "zlowen", "zlowish", "grunk"]))
        t = ". ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))
        docs.append((i, t.upper() + "!!" if poor else t))
        labels.append((i, 0 if poor else 1, int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "no id"), (3, docs[3][1])]
    labels += [(5000, 1, 0), (None, 1, 1), (7, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def check_scores(found, docs, labels, label, least):
    rows = found.collect()
    assert len(rows) == docs.count()
    y = {r.doc_id: r[label] for r in labels.collect()}
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.score, y[r.doc_id]) for r in rows if r.held_out and y.get(r.doc_id) is not None]
    assert auc(*zip(*held)) > least
    return rows


def test_quality(spark, labelled):
    docs, labels = labelled
    rows = check_scores(op01_quality_rules.quality(docs, labels), docs, labels, "quality", 0.95)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert op01_quality_rules.quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in op01_quality_rules.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_rules_and_columns_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.4)).astype(float)
    model = op01_quality_rules.fit(["p", "q", "r"], x, y)
    assert auc(model.scores(["p", "q", "r"], x), y) > 0.99 and len(model.rules) < 60
    frame = spark.createDataFrame(x.tolist(), "p double, q double, r double").select(model.column().alias("s"))
    assert np.allclose([r.s for r in frame.collect()], model.scores(["p", "q", "r"], x))


def test_toxicity(spark, labelled):
    docs, labels = labelled
    found = op10_toxicity_mil.toxicity(docs, labels)
    rows = check_scores(found, docs, labels, "toxic", 0.97)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.score == 0 for r in rows if not texts[r.doc_id])
    insult = re.compile("zlow|grunk", re.I)
    wrong = [r for r in rows if bool(insult.search(texts[r.doc_id] or "")) != bool(r.predicted)]
    assert len(wrong) <= 0.02 * len(rows)
    kept = op10_toxicity_mil.reject(docs.withColumn("score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    assert kept.count() == sum(not r.predicted for r in rows)
    model = op10_toxicity_mil.train(docs, labels)
    places = op10_toxicity_mil.locate(docs, model).collect()
    assert places and all(insult.search(r.text) for r in places)
    assert {r.score for r in op10_toxicity_mil.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert op10_toxicity_mil.toxicity(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs, rows, none, order):
    """Against a plain count of n-grams in dictionaries."""
    found = op05_ngram_lm.language_model(docs, order).collect()
    assert len(found) == len(rows) + 2
    texts = [(r.doc_id, (r.text or "")) for r in docs.select("doc_id", "text").collect()]
    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)})) + ["\0end"]) for d, t in texts]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    start, c, top = "\0start", Counter(), Counter()
    grams = lambda w: zip(*([*[start] * (order - 1), *w][k:] for k in range(order)))
    for d, w in tokens:
        if not held(d):
            c.update(w)
            top.update(grams(w))
    n, v = sum(c.values()), len(c)
    levels = {order: top}
    if order == 3:
        plain, pairs = Counter(), Counter(g[1:] for g in top)
        for g, k in top.items():
            plain[g[1:]] += k
        levels[2] = Counter({g: plain[g] if g[0] == start else k for g, k in pairs.items()})
    levels[1] = Counter(g[1:] for g in levels[2])
    counts = lambda x: [sum(k == i for k in x.values()) for i in (1, 2, 3, 4)]
    less = {k: op05_ngram_lm.discounts(counts(x)) for k, x in levels.items()}
    total, taken = defaultdict(int), defaultdict(float)
    for k, x in levels.items():
        for g, m in x.items():
            total[g[:-1]] += m if k > 1 else 1 * m
            taken[g[:-1]] += less[k][min(m, 3)]

    def p(context, w):
        k = len(context) + 1
        lower = p(context[1:], w) if k > 1 else taken[()] / total[()] / (v + 1)
        if k > 1 and not total[context]:
            return lower
        m = levels[k][(*context, w)]
        seen = max(m - less[k][min(m, 3)], 0) / total[context]
        return seen + (taken[context] / total[context] * lower if k > 1 else lower)

    context = ("one", "two")[-(order - 1) :]
    assert math.isclose(sum(p(context, w) for w in c) + p(context, "\0unknown"), 1, rel_tol=1e-9)
    want = {}
    for d, w in tokens:
        want[d] = (held(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(g[:-1], g[-1])) for g in grams(w)))
    for r in found:
        x = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4]
        assert math.isclose(r.base_score, x[4], rel_tol=1e-9) and math.isclose(r.score, x[5], rel_tol=1e-9), r
    assert op05_ngram_lm.language_model(none, order).count() == 0


def test_large_counts_are_whole(tmp_path):
    """Counts beyond a byte and beyond 32 bits come back; unknown hashes have none."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    one, two = rng.integers(1, 3, len(keys)), np.full(len(keys), 7)
    one[::50], two[3] = 300 + (1 << 40), 254
    rows, large = op05_ngram_lm.write_grams(f"file://{tmp_path}", "t", keys, one, two)
    known, (x, y) = op05_ngram_lm.read_grams(f"file://{tmp_path}", "t", rows, large, 2, keys[::-1])
    assert known.all() and (x[::-1] == one).all() and (y[::-1] == two).all()
    known, (x, y) = op05_ngram_lm.read_grams(f"file://{tmp_path}", "t", rows, large, 2, rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    assert not known.any() and not x.any() and not y.any()


def test_language_model_without_training(spark):
    d = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = op05_ngram_lm.language_model(spark.createDataFrame([(d, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


PAGES = [
    ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=/x>x</a></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p>One.<p>Two  <b>three</b>\n four<br>five<!-- c --><p>Six</article><footer>&copy; f</footer>", "Head & more\nOne.\nTwo three four five\nSix"),
    ("<header><h1>Site</h1></header><main><p>Body text<aside>side</aside><form><input><label>mail</label></form><div class='comments'><p>first!</p></div><p>End</main>", "Body text\nEnd"),
    ("<article><p>A<script>never closed", "A"),
    ("<article><!-- open <p>x", ""),
    ("plain words without any markup at all, just one long paragraph of them", "plain words without any markup at all, just one long paragraph of them"),
    ("", ""),
    (None, ""),
    ("<nav>only a menu</nav>", ""),
    ("<article><p>&lt;tag&gt; &#233; &nbsp; x &amp", "ok"),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "t") for i, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], "t")], "page_id long, url string, html string, text string")
    found = op06_html_blocks.extract(pages).collect()
    assert len(found) == len(PAGES) + 1
    want = {i: t for i, (_, t) in enumerate(PAGES)} | {8: "<tag> é x &"}
    for r in found:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text), r.page_id
    assert op06_html_blocks.extract(pages.limit(0)).count() == 0


def text_of(page):
    return op06_html_blocks.main_text(page, op06_html_blocks.train())


def test_main_text_by_words_and_links():
    """Pages that say nothing by their elements, and articles with menus that only their links tell."""
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(5))
    long = "This is a paragraph of some length that tells the reader, in plain words and without links, what the page is about."
    assert text_of("<div><h1>Title</h1><p>Short one.</p><p>Another longer paragraph with a few more words in it.</p></div>") == "Title\nShort one.\nAnother longer paragraph with a few more words in it."
    assert text_of(f"<div><ul>{menu}</ul></div><div><h1>Title here</h1><p>{long}</p><p>Short.</p><p>{long}</p></div><div><a href=x>About us</a> <a href=y>Contact</a></div>") == f"Title here\n{long}\nShort.\n{long}"
    assert text_of(f"<article><h1>Title here</h1><p>{long}</p><p>{long}</p><ul>{menu}</ul></article>") == f"Title here\n{long}\n{long}"
    assert text_of(f"<article><p>{long}</p><p><a href=x>See this</a></p><p>{long} <a href=y>there</a></p></article>") == f"{long}\nSee this\n{long} there"
    assert text_of(f"<div>{long}</div><article><p>Mine.</p></article><div>{long}</div>") == "Mine."


def test_no_markup_in_text():
    for page, want in [
        ('<article><p title="abc>Hello there my friend</p><p>next</p></article>', "Hello there my friend\nnext"),
        ("<article><p data=it's>kept <b class=\"x\"id='y'>bold</b></p></article>", "kept bold"),
        ('<article><p title="a > b" hidden-not>x</p><p title="<b>bold</b>">y</p></article>', "x\ny"),
        ('<article><a title="x>Hello <a href="u">v</a></article>', "Hello v"),
        ("<article>a < b and 3 <4 d</article>", "a < b and 3 <4 d"),
        ("<article><p>text</p><b never closed", "text"),
        ("<article><!DOCTYPE x><?php y ?><![CDATA[z]]>w</article>", "w"),
    ]:
        assert text_of(page) == want, page


def test_pages_take_linear_time():
    """Malformed and deeply nested markup of megabytes, in the time that twice the half takes."""
    for piece in ("<a ", '<a href="', "<div>", "</x>", "<p><x>", "<!--", "<a b='", '<p title="x>y', "<x><p>", "word <b>word</b> ", "<li><a href=x>y</a>", "&amp;"):
        page = piece * (2_000_000 // len(piece))
        began = time.process_time()
        op06_html_blocks.blocks(page)
        assert time.process_time() - began < 20, piece
    long = "word " * 600_000
    assert len(text_of(f"<article><p>{long}</p></article>")) == 5 * 600_000 - 1


def vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[100:160] = x[100]  # many equal vectors
    return x


def test_neighbours(spark):
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (None, [1.0] * 16), (2080, [1.0, 2.0]), (40, x[40].tolist()), (2100, [])]
    found = op09_ann_projections.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).toPandas()
    assert set(found.query_id) == set(range(0, 900, 20))
    hit = 0
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        hit += len(set(best) & set(own.vec_id))
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, s[own.vec_id], rtol=1e-12)
        assert list(zip(-own.score, own.vec_id)) == sorted(zip(-own.score, own.vec_id))
    assert hit >= 0.9 * 20 * found.query_id.nunique()
    few = op09_ann_projections.neighbours(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]
    assert op09_ann_projections.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_chi_square_quantile():
    assert math.isclose(op09_ann_projections.chi_square_quantile(0.95, 2), 5.991, abs_tol=1e-3)
    assert math.isclose(op09_ann_projections.chi_square_quantile(0.95, 12), 21.026, abs_tol=1e-3)


def test_scratch_is_removed(spark):
    s = Scratch(spark, "test")
    assert s.write(spark.range(3), "x").count() == 3
    s.drop("x")
    s.close()


def test_quality_does_not_depend_on_partitions(spark):
    """Equal scores from two partitionings of the test tables, the compiled column against the arrays, and labels of
    held-out rows that the scores tell apart."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    one = {r.doc_id: (r.score, r.predicted) for r in op01_quality_rules.quality(docs.repartition(2), labels.repartition(3)).collect()}
    described = op01_quality_rules.describe(docs.repartition(7, "text"))
    model = op01_quality_rules.train(described, labels)
    two = {r.doc_id: (r.score, r.predicted) for r in op01_quality_rules.score(described, model).collect()}
    assert one == two
    names = [c for c in described.columns if c != "doc_id"]
    rows = described.toPandas()
    assert np.allclose(model.scores(names, rows[names].to_numpy(np.float64)), [two[i][0] for i in rows.doc_id], rtol=1e-12)
    y = {r.doc_id: r.quality for r in labels.filter("quality in (0, 1)").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in two}
    assert auc([two[i][0] for i in y], [y[i] for i in y]) > 0.95


def test_toxicity_of_held_out_rows(spark):
    import os

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").filter("toxic in (0, 1)").collect()}
    found = {r.doc_id: r for r in op10_toxicity_mil.toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()}
    held = [(found[i].predicted, t) for i, t in labels.items() if i in found and found[i].held_out]
    both, said, true = sum(p and t for p, t in held), sum(p for p, _ in held), sum(t for _, t in held)
    assert both / said > 0.94 and both / true > 0.83


def test_copies_have_one_label_and_like_shingles():
    h = lambda text: np.array([zlib.crc32(w.encode()) * 7919 for w in text.split()], np.uint64)
    bag = lambda label, text: (label, np.concatenate([h(text)] * 3), np.zeros(3 * len(text.split()), np.int32))
    base = " ".join(f"w{i}" for i in range(60))
    near, far = base.replace("w30", "x"), base + " " + " ".join(f"v{i}" for i in range(60))
    bags = [bag(0, base), bag(0, base), bag(1, base), bag(0, near), bag(0, far), bag(0, ""), bag(0, ""), bag(1, ""), bag(0, "a b"), bag(0, "a b"), bag(0, "b a")]
    kept = op10_toxicity_mil.without_copies(bags)
    assert [next(i for i, b in enumerate(bags) if b is k) for k in kept] == [0, 2, 4, 5, 7, 8, 10]


def test_toxicity_learns_without_texts_on_the_driver(spark):
    """What training holds on the driver doesn't follow the sample's words, and copies in any partition count once."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abdeilmnorstu"), rng.integers(2, 9))) for _ in range(3000)]
    docs, labels = [], []
    for i in range(240):
        w = rng.choice(words, 2500).tolist()
        if i % 6 == 0:
            w[i] = ["zlowt", "grunk"][i % 4 // 2]
        docs.append((5 * i + next(k for k in range(5) if zlib.crc32(str(5 * i + k).encode()) % 5), ". ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))))
        labels.append((docs[-1][0], int(i % 6 == 0)))
    table, known = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).persist(), spark.createDataFrame(labels, "doc_id long, toxic int").persist()
    assert table.count() == known.count() == 240
    tracemalloc.start()
    try:
        model = op10_toxicity_mil.train(table, known)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.words) and most < 4 << 20, most
    copies = [(10_000 + i, docs[1 + i % 3][1] + " end" * (i % 2)) for i in range(300)]
    more = op10_toxicity_mil.train(table.union(spark.createDataFrame(copies, "doc_id long, text string").repartition(4)), known.union(spark.createDataFrame([(i, 0) for i, _ in copies], "doc_id long, toxic int")))
    assert (more.words == model.words).all() and np.allclose(more.weights, model.weights, atol=0.02)
    found = {r.doc_id: r.predicted for r in op10_toxicity_mil.score(table, model).collect()}
    assert sum(found[i] != t for i, t in labels) <= 2


def test_clashing_columns_and_long_texts(spark, labelled):
    """Columns that the operators use themselves are no input, and very long texts are scored whole."""
    docs, labels = labelled
    plain1, plain10 = ({r.doc_id: r.score for r in f(docs, labels).collect()} for f in (op01_quality_rules.quality, op10_toxicity_mil.toxicity))
    for c in ("score", "label", "words", "chars", "text_", "words_", "held_out", "predicted", "sentence"):
        docs, labels = docs.withColumn(c, F.lit("x")), labels.withColumn(c, F.lit("x"))
    long = docs.filter("doc_id = 9").withColumn("doc_id", F.lit(7000).cast("long")).withColumn("text", F.concat(F.repeat(F.lit("some plain words. "), 100_000), F.lit("zlowt grunk zlowen.")))
    found = {r.doc_id: r.score for r in op01_quality_rules.quality(docs.union(long), labels).collect()}
    assert {i: found[i] for i in plain1} == plain1 and 0 <= found[7000] <= 1
    found = {r.doc_id: r.score for r in op10_toxicity_mil.toxicity(docs.union(long), labels).collect()}
    assert {i: found[i] for i in plain10} == plain10 and found[7000] > 0.5


def test_neighbours_over_many_shards(spark, monkeypatch):
    """Recall with small shards, many equal vectors, vectors of another size and clashing columns."""
    monkeypatch.setattr(op09_ann_projections, "SHARD", 60)
    monkeypatch.setattr(op09_ann_projections, "SAMPLE", 200)
    x = vectors()
    x[300:600] = x[300]
    rows = [(i, v.tolist(), 1, 2, 3.0, 4) for i, v in enumerate(x)] + [(5000 + i, [float(i), 1.0, 2.0], 1, 2, 3.0, 4) for i in range(30)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, size int, box long, score double, shard int").repartition(5)
    found = op09_ann_projections.neighbours(docs).toPandas()
    hit = 0
    for q, own in found[found.query_id < 900].groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        hit += len(set(s[best]) & set(s[own.vec_id])) / len(set(s[best]))
        assert len(own) == 20 and list(own.sort_values("rank").vec_id) == [v for _, v in sorted(zip(-own.score, own.vec_id))]
    assert hit >= 0.9 * found[found.query_id < 900].query_id.nunique() == 0.9 * 45
    assert set(found[found.query_id >= 5000].query_id) == {5000, 5020} and (found[found.query_id >= 5000].vec_id >= 5000).all()
