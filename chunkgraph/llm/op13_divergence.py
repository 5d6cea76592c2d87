"""Quality rules by the divergence of a document from its language.

A document has two histograms: its characters by class (``CLASSES``), and its words by whether they are one of the
language's ``COMMON`` commonest of at most ``SHORT`` bytes, each a cell, or another. They are compared with those of the language's reference by
the Jensen-Shannon distance (base 2, from 0 to 1). A document is rejected if a squared distance is above the limit's
square by more than what a faithful sample of that size strays: for n draws into k cells the expected squared distance
is about (k - 1) / (8 n ln 2). Texts below ``MIN_CHARS`` or ``MIN_WORDS`` aren't judged by that histogram, nor is any
by a reference of fewer than ``MIN_REFERENCE`` words.

The references are the means of the histograms' shares over all documents with ``MIN_WORDS`` words, so that one
document weighs like any other however often it repeats a word. Shares are counted in whole units, which makes sums
exact. Beside them stand base rules: too few words, or too many in windows that repeat.

All of it is Spark expressions. The first pass counts words by language, with partial counts before the shuffle, and
keeps the commonest without sorting a vocabulary in one task (a limit by rank goes into each task). The second is a map:
references are one row for each language, broadcast while there are at most ``LANGUAGES``; beyond that, texts meet them by
language and one of ``SALTS`` copies, so no language is one task. Windows of words are compared by 64-bit hashes.

Defined cases: a null text has no words, no lines and fails the base rules; a null language is the empty string;
a language without a reference rejects nothing; ties among common words go to the lesser word; repeated rows are judged
alike, and count as often as they come; texts are read whole; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import SPACES, left_by, let, whole, words
from .storage import Scratch

#: What is taken from a text one after the other, and the class of characters that it counts to: 0 lower
#: case, 1 white space, 2 upper case, 3 other letters and marks, 4 numbers, 5 punctuation; what is left is class 6.
CLASSES = ((r"[a-z]+", 0), (SPACES, 1), (r"\p{Ll}+", 0), (r"\p{Lu}+", 2), (r"[\p{L}\p{M}]+", 3), (r"\p{N}+", 4), (r"\p{P}+", 5))
CELLS = 7
#: Characters that count as symbols, and any other character.
NOT_SYMBOLS = "[^#*$%&|<>]+"
COMMON = 24  # words of a reference; each has a character of its own after FIRST_CODE
SHORT = 8  # bytes of a common word at most
FIRST_CODE = 64
#: Units of a document's share of a word, and of a class of characters.
WORD_UNITS, CLASS_UNITS = 10**8, 10**4
MIN_WORDS, MIN_CHARS, MIN_REFERENCE = 50, 200, 1000
CLASS_LIMIT, WORD_LIMIT = 0.3, 0.25
LANGUAGES, FEW_LANGUAGES, SALTS = 5000, 100, 32


def windows(w: Column) -> Column:
    """A hash of each run of three words."""
    runs = let(w, lambda all_: F.transform(F.slice(all_, F.lit(1), F.size(all_) - 2), lambda x, i: F.xxhash64(x, F.get(all_, i + 1), F.get(all_, i + 2))))
    return F.when(F.size(w) < 3, F.expr("cast(array() as array<long>)")).otherwise(runs)


#: Different windows that repeat, up to which a window is looked for among them; more are found by sorting places.
FEW = 12


def repeated_words(grams: Column) -> Column:
    """How many words lie in windows that are found twice or more, from all windows in order."""

    def places(ordered: Column) -> Column:
        same = lambda s, j: F.coalesce(F.get(ordered, j)["h"] == s["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(ordered, lambda s, k: F.when(same(s, k - 1) | same(s, k + 1), s["i"])), lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(3))).alias("n")), lambda s: s["n"])

    def by_place(g: Column) -> Column:
        return let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda o: covered(places(o)))

    def among(g: Column, several: Column) -> Column:
        return covered(F.filter(F.transform(g, lambda h, i: F.when(F.array_contains(several, h), i)), lambda i: i.isNotNull()))

    def counted(g: Column) -> Column:
        several = let(F.sort_array(g), lambda o: F.array_distinct(F.filter(o, lambda h, k: h == F.get(o, k + 1))))
        return let(several, lambda x: F.when(F.size(x) <= FEW, among(g, x)).otherwise(by_place(g)))

    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(grams, counted))


def base(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text, w): the words of a text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("lang")).alias("lang"), whole(F.col("text")).alias("text"))
    return rows.withColumn("w", words(F.col("text")))


def class_counts(text: Column) -> Column:
    """The number of characters of each class, and then that of symbols, which are characters of a class as well."""

    def cut(rest: Column, patterns: tuple, taken: list[Column]) -> Column:
        if not patterns:
            of = lambda k: sum((n for n, (_, c) in zip(taken, CLASSES) if c == k), F.lit(0))
            return F.array(*[of(k).cast("double") for k in range(CELLS - 1)], F.length(rest).cast("double"))
        return let(left_by(rest, patterns[0][0]), lambda r: cut(r, patterns[1:], [*taken, F.length(rest) - F.length(r)]))

    symbols = lambda r: F.array(F.length(left_by(r, NOT_SYMBOLS)).cast("double"))
    # symbols are neither lower case nor white space
    return let(left_by(text, CLASSES[0][0]), lambda r: let(left_by(r, CLASSES[1][0]), lambda q: F.concat(cut(q, CLASSES[2:], [F.length(text) - F.length(r), F.length(r) - F.length(q)]), symbols(q))))


def references(rows: DataFrame, common: int = COMMON) -> DataFrame:
    """(lang, common, word_counts, class_counts, n): a language's commonest words in order, their shares and that of
    all others, the shares of its classes of characters, each as a sum over documents, and the number of its words."""
    if not 1 <= common <= 60:
        raise ValueError("a reference has 1 to 60 common words")
    w = F.col("w")
    size = F.size(w).cast("long")
    unit = F.expr(f"{WORD_UNITS} div size(w)")
    # no word has white space in it: " k n" stands for n of kind k; 1 to 7 the classes, then the words' units, then words
    cells = F.transform(F.slice(class_counts(F.col("text")), 1, CELLS), lambda n: F.floor(n * CLASS_UNITS / F.length("text")))
    told = F.transform(F.concat(cells, F.array(unit * size, size)), lambda n, k: F.concat(F.lit(" "), (k + 1).cast("string"), F.lit(" "), n.cast("string")))
    rows = rows.filter(F.size(w) >= MIN_WORDS).select("lang", unit.alias("unit"), F.explode(F.concat(w, told)).alias("word"))
    counts = rows.filter((F.octet_length("word") <= SHORT) | F.col("word").startswith(" ")).groupBy("lang", "word").agg(F.count("*").alias("n"), F.sum("unit").alias("units"))
    parts, kind = F.split("word", " "), F.col("word").startswith(" ")
    counts = counts.select("lang", F.when(kind, F.get(parts, F.lit(1)).cast("int")).otherwise(0).alias("kind"), F.when(kind, "").otherwise(F.col("word")).alias("word"), F.when(kind, F.col("n") * F.get(parts, F.lit(2)).cast("long")).otherwise(F.col("units")).alias("n"))
    counts = counts.groupBy("lang", "kind", "word").agg(F.sum("n").cast("double").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "word"))
    best = counts.withColumn("r", rank).filter(F.col("r") <= common).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("kind", "r", "word", "n"))).alias("best"))
    known, kinds = F.filter("best", lambda b: b["kind"] == 0), F.transform(F.filter("best", lambda b: b["kind"] > 0), lambda b: b["n"])
    sums = best.select("lang", F.transform(known, lambda b: b["word"]).alias("common"), F.transform(known, lambda b: b["n"]).alias("known"), F.slice(kinds, 1, CELLS).alias("class_counts"), F.element_at(kinds, -2).alias("units"), F.element_at(kinds, -1).alias("n"))
    others = F.col("units") - F.aggregate("known", F.lit(0.0), lambda s, x: s + x)
    return sums.select("lang", "common", F.concat("known", F.array(others)).alias("word_counts"), "class_counts", "n")


def squared_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon divergence, base 2, of two histograms of counts; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return let(
        F.struct(p.alias("p"), q.alias("q"), total(p).alias("a"), total(q).alias("b")),
        lambda h: F.when((h["a"] > 0) & (h["b"] > 0), total(F.zip_with(F.transform(h["p"], lambda x: x / h["a"]), F.transform(h["q"], lambda y: y / h["b"]), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2))),
    )


def word_histogram(w: Column, common: Column, any_common: list[str] | None = None) -> Column:
    """The counts of the common words, and that of the other words. ``any_common``, if given, are the common words of
    all languages; what is none of them is looked for no further."""
    likely = F.filter(w, lambda x: x.isin(any_common) if any_common else F.octet_length(x) <= SHORT)
    # a word becomes a character, its own if it is common, so that a count is a difference of lengths
    codes = F.array_join(F.transform(likely, lambda x: F.char(F.array_position(common, x) + FIRST_CODE)), "")
    count = lambda told, k: (F.octet_length(told) - F.octet_length(F.replace(told, F.char(k + (FIRST_CODE + 1)), F.lit("")))).cast("double")
    known = let(codes, lambda told: F.transform(common, lambda _, k: count(told, k)))
    return let(known, lambda n: F.concat(n, F.array(F.size(w) - F.aggregate(n, F.lit(0.0), lambda s, x: s + x))))


def distances(rows: DataFrame, reference: DataFrame, languages: int = LANGUAGES) -> DataFrame:
    """Adds class_divergence and word_divergence to rows with w and cells: squared distances, null where there is nothing
    to compare."""
    some = reference.select("common").take(languages + 1)
    any_common = sorted({x for r in some for x in r.common}) if len(some) <= FEW_LANGUAGES else None
    if len(some) <= languages:
        joined = rows.join(F.broadcast(reference), "lang", "left")
    else:
        copies = reference.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(copies, ["lang", "salt"], "left").drop("salt")
    enough = F.col("n") >= MIN_REFERENCE
    by_class = F.when(enough & (F.length("text") >= MIN_CHARS), squared_distance(F.slice("cells", 1, CELLS), F.col("class_counts")))
    by_word = F.when(enough & (F.size("w") >= MIN_WORDS), squared_distance(word_histogram(F.col("w"), F.col("common"), any_common), F.col("word_counts")))
    return joined.withColumn("class_divergence", by_class).withColumn("word_divergence", by_word)


def allowance(cells: Column, draws: Column) -> Column:
    """The squared distance that a sample of so many draws has from what it is drawn from, as a rule."""
    return (cells - 1) / (8 * log(2) * draws)


def judge(docs: DataFrame, common: int = COMMON, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_divergence,
    word_divergence) of each document."""
    scratch = Scratch(docs.sparkSession, "divergence")
    rows = base(docs)
    reference = scratch.write(references(rows, common), "references")
    rows = rows.withColumn("cells", class_counts(F.col("text"))).withColumn("grams", windows(F.col("w")))
    w, text = F.col("w"), F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    told = distances(rows, reference).select(
        "doc_id", F.size(w).cast("long").alias("n_words"), (F.length(text) - F.get("cells", F.lit(1))).cast("long").alias("word_chars"), F.get("cells", F.lit(CELLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeated_words(F.col("grams")).alias("n_repeat_words"), F.length(text).alias("chars"), "class_divergence", "word_divergence",
    )
    told = told.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    far = (F.col("class_divergence") > class_limit**2 + allowance(F.lit(CELLS), F.col("chars"))) | (F.col("word_divergence") > word_limit**2 + allowance(F.lit(common + 1), F.col("n_words")))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), F.round("class_divergence", 6).alias("class_divergence"), F.round("word_divergence", 6).alias("word_divergence"))
