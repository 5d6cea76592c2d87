"""Audit of how filters interact, by Shapley values from the multilinear extension.

A document's mask has a bit for each filter that it fails. For the documents of a part with mask m, the chance to
survive if each filter i is applied with chance x_i is the product of (1 - x_i) over i in m; summed over the part
that is a multilinear polynomial, whose coefficient at the product of x_i over i in T is (-1)^|T| times the number of
documents that fail all of T. What is removed is the number of documents less that polynomial. So, from the mask
counts of a part alone:

- the survivors of a set of filters are the polynomial's value at that set's corner of the cube, and what a filter
  removes at its step of an order is the difference of two corners;
- a filter's Shapley value is the integral over the diagonal of its partial derivative of the removal polynomial.
  The term at T has t^(|T| - 1), whose integral is 1 / |T|. These rationals have the common denominator
  lcm(1, ..., n), so the sum is exact in integers; times n! it is what the filter removes over all orders.

Documents are read once, as their masks and a digest of their text (SHA-256, 32 bytes). They meet their labels by
doc_id, and copies meet by digest in groups that are counted before the shuffle, so a text of a third of all rows is
a few rows for each task. What is left are at most 2^n counts for each part; orders and steps are made from them, part by
part.

Defined cases: a null text is the empty one, and a copy of other empty ones; a null part is the empty string; a
document is a copy if the same text has a smaller doc_id anywhere, so repeated rows with one id are no copies of each
other, and rows with a null doc_id neither are copies nor make any; labels of an id that has several count if any of
them is 1; ids without a label are neither good nor toxic. No documents give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import left_by, let, whole, words

#: Failure conditions by letter, of the text (null is empty) and its words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, w: F.size(w) < 200,
    "B": lambda text, w: 100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
    "C": lambda text, w: 100 * F.length(left_by(text, "[^A-Z]+")) > 3 * F.length(text),
    "D": lambda text, w: text.rlike(r"[#$%&*|]"),
}
#: The letter of the filter that takes copies.
COPIES = "E"
MOST = 8  # filters; orders grow as the factorial


def failures(docs: DataFrame, filters: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """(doc_id, part, mask, digest): bit k of the mask is set if the document fails the k-th filter."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("lang")).alias("part"), whole(F.col("text")).alias("text")).withColumn("w", words(F.col("text")))
    mask = sum((F.when(f(F.col("text"), F.col("w")), 1 << k).otherwise(0) for k, f in enumerate(filters.values())), F.lit(0))
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, copies: str = COPIES) -> DataFrame:
    """(part, mask, n, good, toxic) of all parts and masks that occur; the highest bit of a mask is that of copies."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("doc_id is not null and (good or toxic)")
    known = known.groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    rows = failures(docs, filters).join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kinds = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    groups = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    least = F.min("first").over(Window.partitionBy("digest"))
    copied = F.col("n") - F.col("nameless") - F.coalesce(F.when(F.col("first") == F.col("least"), F.col("n_first")), F.lit(0))
    told = groups.withColumn("least", least).withColumn("copied", copied).select("part", "mask", "good", "toxic", "n", "copied")
    top = 1 << len(filters)
    sides = told.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", (F.col("n") - F.col("copied")).alias("n")), F.struct((F.col("mask") + top).alias("mask"), F.col("copied").alias("n")))).alias("s"))
    n = F.col("s.n")
    return sides.groupBy("part", F.col("s.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def polynomial(entries: Column, field: str, n: int) -> Column:
    """The coefficients of the survival polynomial of a count, at each set of filters, from (mask, counts) entries."""
    failing = lambda t: F.aggregate(F.filter(entries, lambda e: e["mask"].bitwiseAND(t) == t), F.lit(0).cast("long"), lambda s, e: s + e[field])
    return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda t: F.when(F.bit_count(t) % 2 == 1, -failing(t)).otherwise(failing(t)))


def corners(coefficients: Column, n: int) -> Column:
    """The polynomial's values at the corners of the cube: at a set, the sum of the coefficients of its subsets."""
    subsets = lambda c, s: F.aggregate(F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda t: t.bitwiseAND(s) == t), F.lit(0).cast("long"), lambda x, t: x + F.get(c, t))
    return let(coefficients, lambda c: F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda s: subsets(c, s)))


def diagonal_integrals(coefficients: Column, n: int) -> Column:
    """For each filter n! times the integral of the removal polynomial's partial derivative along the diagonal.

    Numerators over the common denominator of 1, 1/2, ..., 1/n, which divides n!."""
    denominator = lcm(*range(1, n + 1))
    shares = F.array(*[F.lit(denominator // k).cast("long") for k in range(1, n + 1)])
    of = lambda c, i: F.aggregate(
        F.filter(F.sequence(F.lit(1), F.lit((1 << n) - 1)), lambda t: F.get(F.array(*[F.lit(1 << k) for k in range(n)]), i).bitwiseAND(t) > 0),
        F.lit(0).cast("long"), lambda x, t: x - F.get(c, t) * F.get(shares, F.bit_count(t) - 1),
    )
    return let(coefficients, lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: of(c, i) * (factorial(n) // denominator)))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, copies: str = COPIES) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row for
    each part, order and step; shapley is the sum over all orders of what the step's filter removes."""
    letters = "".join(filters) + copies
    n = len(letters)
    if not 1 <= n <= MOST or len(set(letters)) < n or any(len(x) != 1 for x in [*filters, copies]):
        raise ValueError(f"up to {MOST} filters with a letter each")
    # at most 2^n entries for each part
    parts = mask_counts(docs, labels, filters, copies).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))
    parts = parts.withColumns({f"{c}_terms": polynomial(F.col("entries"), c, n) for c in ("n", "good", "toxic")})
    parts = parts.select("part", *[corners(F.col(f"{c}_terms"), n).alias(f"{c}_left") for c in ("n", "good", "toxic")], diagonal_integrals(F.col("n_terms"), n).alias("shapleys"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    bits = F.create_map(*[F.lit(x) for k, letter in enumerate(letters) for x in (letter, 1 << k)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    steps = steps.withColumn("applied", F.transform(F.split("filter_order", ""), lambda x: F.element_at(bits, x)))
    before = F.aggregate(F.slice("applied", F.lit(1), F.col("step") - 1), F.lit(0), lambda s, x: s.bitwiseOR(x))
    steps = steps.withColumn("before", before).withColumn("own", F.element_at("applied", F.col("step"))).withColumn("after", F.col("before").bitwiseOR(F.col("own")))
    left = lambda count, at: F.get(f"{count}_left", at)
    gone = lambda count: left(count, F.col("before")) - left(count, F.col("after"))
    every = (1 << n) - 1
    return steps.select(
        "part", "filter_order", "step", left("n", F.col("after")).alias("kept"), gone("n").alias("removed"),
        (left("n", F.lit(0)) - left("n", F.col("own")) - gone("n")).alias("redundant"),
        (left("n", F.col("own").bitwiseXOR(F.lit(every))) - left("n", F.lit(every))).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shapleys", F.bit_count(F.col("own") - 1).cast("int")).alias("shapley"),
    )
