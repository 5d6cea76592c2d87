"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics are Spark expressions. Boosted trees on a bounded sample of labelled rows give conjunctive rules (every
path to a node), a lasso logistic fit keeps few of them, and what is kept compiles into one Spark expression.

No shuffle over the documents: statistics are a projection, and the sample (at most ``SAMPLE`` ids) is broadcast.
Training takes place on the driver over at most ``SAMPLE`` rows of a few numbers each.

Defined cases: a null text counts as empty; an empty text has statistics 0 and gets a score like any other; rows
with a null doc_id are scored and not held out; repeated rows are scored alike; an id's row counts for each
text that it has in training, at most four times the bound in all; labels other than 0 and 1 are left
out; without labels of both kinds the score is the share of label 1, or 0.5; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows
from .storage import Scratch

#: Labelled documents that training sees at most.
SAMPLE = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE = 40, 3, 48, 0.3
LASSO = 2e-4


def pieces(text: Column) -> dict[str, Column]:
    """What statistics are taken from: the text, its lower-cased words and its lines that are not empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return {"text_": t, "words_": F.array_remove(F.split(F.lower(t), r"[ \t\n\x0B\f\r]+"), ""), "lines_": F.array_remove(F.split(t, "\n"), "")}


def statistics() -> dict[str, Column]:
    """Numbers that describe a whole text, whatever its language, from columns as ``pieces`` names them."""
    t, words, lines = F.col("text_"), F.col("words_"), F.col("lines_")
    size, n, rows = F.length(t).cast("double"), F.size(words).cast("double"), F.size(lines).cast("double")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("double")
    of = lambda characters: size - F.length(F.translate(t, characters, "")).cast("double")
    again = F.size(F.array_remove(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.coalesce(a == b, F.lit(False))), False)).cast("double")
    return {
        "chars": size,
        "words": n,
        "word_length": share(size, n),
        "upper": share(left(r"[^\p{Lu}]+"), size),
        "letters": share(left(r"[^\p{L}]+"), size),
        "digits": share(of("0123456789"), size),
        "shouts": share(of("!?"), size),
        "symbols": share(of("#$%&*@^~=+<>\\"), size),
        "bars": share(of("|"), size),
        "stops": share(of(".,;:"), size),
        "distinct": share(F.size(F.array_distinct(words)).cast("double"), n),
        "repeats": share(again, n),
        "line_length": share(size, rows),
        "distinct_lines": share(F.size(F.array_distinct(lines)).cast("double"), rows),
    }


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, whether above, threshold)


@dataclass
class Rules:
    """A logistic model over conjunctions."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    constant: float | None = None  # the score of every text

    def column(self) -> Column:
        """The score from columns named as the statistics."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        z = F.lit(float(self.bias))
        for rule, weight in self.rules:
            parts = [F.col(f"`{name}`") > t if above else F.col(f"`{name}`") <= t for name, above, t in rule]
            hold = parts[0]
            for p in parts[1:]:
                hold = hold & p
            z = z + F.when(hold, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))

    def scores(self, names: list[str], x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * holds(rule, names, x)
        return 1 / (1 + np.exp(-z))


def holds(rule: Rule, names: list[str], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, t in rule:
        v = x[:, names.index(name)]
        out &= v > t if above else v <= t
    return out


def _grow(binned, cuts, names, gradient, hessian, rows, path, depth, paths, leaf) -> None:
    """Splits rows by the best gain; records the path to every node, and the step of every leaf."""
    if path:
        paths.add(tuple(sorted(path)))
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for j in range(binned.shape[1]):
            size = len(cuts[j]) + 1
            gl = np.cumsum(np.bincount(binned[rows, j], gradient[rows], size))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], hessian[rows], size))[:-1]
            if not len(gl):
                continue
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(hl < 0.5) | (h - hl < 0.5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    if best[1] is None:
        leaf[rows] = -g / (h + 1)
        return
    _, j, k = best
    below = binned[rows, j] <= k
    for part, above in ((rows[below], False), (rows[~below], True)):
        _grow(binned, cuts, names, gradient, hessian, part, (*path, (names[j], above, float(cuts[j][k]))), depth - 1, paths, leaf)


def extract_rules(names: list[str], x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, in an order of their own."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    z, paths = np.zeros(len(y)), set()
    rng = np.random.default_rng(7)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        if not len(rows):
            rows = np.arange(len(y))
        leaf = np.zeros(len(y))
        _grow(binned, cuts, names, p - y, p * (1 - p), rows, (), DEPTH, paths, leaf)
        step[rows] = leaf[rows]
        z += RATE * step
    return sorted(paths)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the bias bears no penalty."""
    n, m = a.shape
    scale = np.maximum(a.std(0), 1e-3)
    a = a / scale
    size = 0.25 * max(1e-9, float(np.linalg.norm(np.concatenate([a, np.ones((n, 1))], 1), 2) ** 2) / n)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ vw + vb))) - y
        nw = vw - (a.T @ r / n) / size
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / size, 0)
        nb = vb - r.mean() / size
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w / scale


def fit(names: list[str], x: np.ndarray, y: np.ndarray) -> Rules:
    if not len(y):
        return Rules(constant=0.5)
    if y.min() == y.max():
        return Rules(constant=float(y[0]))
    rules = extract_rules(names, x, y)
    if not rules:
        return Rules(bias=float(np.log(y.mean() / (1 - y.mean()))))
    held = np.stack([holds(r, names, x) for r in rules], 1).astype(np.float64)
    _, first = np.unique(held, axis=1, return_index=True)
    first = np.sort(first)
    bias, weights = lasso_logistic(held[:, first], y, LASSO)
    return Rules(bias, [(rules[i], float(w)) for i, w in zip(first, weights) if abs(w) > 1e-4])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each document. Words and lines are split once, in a projection of their own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(name) for name, c in pieces(F.col("text")).items()])
    return rows.select("doc_id", *[c.alias(name) for name, c in statistics().items()])


def train(described: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Rules:
    """Fits a model to the labelled rows of a table of statistics.

    Rows are taken and fitted in the order of their values, so the model doesn't depend on how they are dealt to
    partitions."""
    names = [c for c in described.columns if c != "doc_id"]
    rows = described.join(F.broadcast(training_rows(labels, "quality", bound)), "doc_id").select("doc_id", "label", *names)
    rows = rows.orderBy("doc_id", "label", *names).limit(4 * bound).toPandas()
    return fit(names, rows[names].to_numpy(np.float64), rows["label"].to_numpy(np.float64))


def score(described: DataFrame, model: Rules) -> DataFrame:
    scored = described.select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document; the texts are read once."""
    described = Scratch(docs.sparkSession, "quality").write(describe(docs), "statistics")
    return score(described, train(described, labels))
