"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the words it has, and of how its
words begin (so that inflected words share evidence); a document is toxic if any sentence is (noisy-or). Weights are
trained from document labels alone, and the sentences that make a document toxic are found by their own scores.

Near copies of the sample with equal labels train once (``without_copies``), as a large group of them would outvote
all other texts.

No shuffle over the documents: the ids of the sample (at most ``SAMPLE``, twice as many rows, of texts up to
``LONGEST`` bytes) and the model (words of the sample) are broadcast, both bounded by the sample's parameter. Tasks
leave out the sample's copies, count its words and number the sentences that have words of the model; the driver gets
these numbers alone, no texts and no hashes of their words, and finds the weights.

Defined cases: a null or wordless text has no sentences and scores 0; a text without sentence ends is one
sentence, however long; rows with a null doc_id are scored and not held out; repeated rows are scored alike;
labels other than 0 and 1 are left out; without labels of both kinds the score is the share of label 1, or 0 where
there are none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows
from .storage import Scratch
from .textops import ALNUM_WORD, FOLDED_BYTES, chunks, gram_hashes, mix, span_hashes, tidy, words

#: Labelled documents that training sees at most.
SAMPLE = 5_000
THRESHOLD = 0.5
STEMS = (4, 6)  # bytes
#: Bytes of a text that training takes; longer ones are scored whole, but teach nothing.
LONGEST = 256 << 10
LEAST_DOCS = 5  # documents of the sample that a word of the model occurs in
LEAST_Z = 4.0  # standard deviations between a word's share of toxic documents and that of the sample
EPOCHS, RATE, SHRINK = 200, 0.25, 1e-3


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends, the sentence of each word, and each document's first word.

    A sentence ends with a line, or with . ! or ? before white space. Numbers of sentences ascend over documents."""
    starts, ends, first = words(data, offsets, ALNUM_WORD)
    if not len(starts):
        return starts, ends, np.zeros(0, np.int64), first
    stop = (data == 0x2E) | (data == 0x21) | (data == 0x3F)
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    cut = data == 0x0A
    cut[:-1] |= stop[:-1] & blank[1:]
    total = np.concatenate([[0], np.cumsum(cut)])[starts]
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    change = np.concatenate([[True], (total[1:] != total[:-1]) | (document[1:] != document[:-1])])
    return starts, ends, np.cumsum(change) - 1, first


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its first bytes, for each of ``STEMS`` (of a shorter word: of the whole)."""
    stems = [mix(span_hashes(data, starts, np.minimum(starts + k, ends), FOLDED_BYTES) + np.uint64(k)) for k in STEMS]
    return [span_hashes(data, starts, ends, FOLDED_BYTES), *stems]


@dataclass
class Model:
    """Ascending word hashes with their weights, and the weight of any sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def sentence_logits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        count = int(sentence[-1]) + 1 if len(sentence) else 0
        z = np.full(count, self.bias)
        if not len(self.words):
            return z
        pairs = []
        for hashes in features(data, starts, ends):
            i = np.searchsorted(self.words, hashes)
            i[i == len(self.words)] = 0
            hit = np.flatnonzero(self.words[i] == hashes)
            pairs.append(i[hit] << 32 | sentence[hit])
        pair = np.unique(np.concatenate(pairs))  # a word counts once in a sentence
        return z + np.bincount(pair & 0xFFFFFFFF, self.weights[pair >> 32], count)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def shingle_set(words_: np.ndarray) -> np.ndarray:
    """The distinct five-word shingles of a document's words in ascending order; with fewer words, the whole as one."""
    if len(words_) >= 5:
        return np.unique(gram_hashes(words_, 5))
    return words_[:0] if not len(words_) else mix(words_ * np.arange(1, 2 * len(words_), 2, np.uint64)).sum(dtype=np.uint64, keepdims=True)


def own_words(hashes: np.ndarray) -> np.ndarray:
    """Of a document's features the words; what follows are their beginnings."""
    return hashes[: len(hashes) // (1 + len(STEMS))]


def without_copies(bags: Iterable[tuple]) -> Iterator[tuple]:
    """The first document of each group of near copies with the same label, so that a large group counts once.

    bags: (label, word hashes, ...) of each document. A copy has the same least five-word shingle as the first, and
    sets of shingles that are alike by 0.75 or more; documents of other labels are no copies, whatever their text."""
    firsts: dict[tuple[int, int], list[np.ndarray]] = {}
    for b in bags:
        grams = shingle_set(own_words(b[1]))
        others = firsts.setdefault((b[0], int(grams[0]) if len(grams) else -1), [])
        if any(alike(grams, o) for o in others):
            continue
        others.append(grams)
        yield b


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets have three quarters of their union in common; two empty ones do."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def bags_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(label, word hashes, sentence of each word, row) of each document of a batch of labels and texts."""
    label = batch.column(0).to_pylist()
    for a, b, data, offsets in chunks(batch.column(1)):
        starts, ends, sentence, first = sentences(data, offsets)
        kinds = features(data, starts, ends)
        for k, (x, y) in enumerate(zip(first.tolist(), first[1:].tolist()), a):
            own = sentence[x:y] - sentence[x] if y > x else sentence[:0]
            yield label[k], np.concatenate([h[x:y] for h in kinds]), np.tile(own, len(kinds)), k


@tidy
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with what copies have in common, and with their order among them."""
    for batch in batches:
        least, head, size = [], [], []
        for _, hashes, _, _ in bags_of(batch):
            grams = shingle_set(own_words(hashes))
            least.append(int(grams[:1].view(np.int64)[0]) if len(grams) else -1)
            head.append(hashes[:64].tobytes())
            size.append(len(hashes))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.int64()), pa.array(head, pa.binary()), pa.array(size, pa.int32())], names=["label", "text", "least", "head", "size"])


@tidy
def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without near copies of an earlier one; the copies of a document are in its partition."""
    held: list[pa.RecordBatch] = []

    def bags() -> Iterator[tuple]:
        for batch in batches:
            held[:] = [batch]
            yield from bags_of(batch)

    for b in without_copies(bags()):
        yield held[0].slice(b[3], 1).select(["label", "text"])


@tidy
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents, and in how many toxic ones, each word is."""
    for batch in batches:
        seen, toxic = [], []
        for label, hashes, _, _ in bags_of(batch):
            seen.append(np.unique(hashes))
            toxic.append(np.full(len(seen[-1]), label))
        if not seen:
            continue
        word, at = np.unique(np.concatenate(seen), return_inverse=True)
        df, toxic_df = np.bincount(at, minlength=len(word)), np.bincount(at, np.concatenate(toxic), len(word)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(df), pa.array(toxic_df)], names=["word", "df", "toxic_df"])


def _numbered(vocabulary):
    """Of each document: its label, its sentences without a word of the vocabulary, and for each pair of a word and a
    sentence that has it the number of either; sentences count from 0."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            rows = []
            for label, hashes, own, _ in bags_of(batch):
                i = np.searchsorted(known, hashes)
                i[i == len(known)] = 0
                hit = known[i] == hashes
                pair = np.unique(i[hit] << 32 | own[hit])  # a word counts once in a sentence
                some, sentence = np.unique(pair & 0xFFFFFFFF, return_inverse=True)
                count = int(own.max()) + 1 if len(own) else 0
                rows.append((label, count - len(some), (pair >> 32).astype("<i4").tobytes(), sentence.astype("<i4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["label", "plain", "feature", "sentence"])

    return run


def fit(vocabulary: np.ndarray, rows: list[tuple[int, int, bytes, bytes]]) -> Model:
    """rows: what ``_numbered`` gives of each document."""
    rows = sorted(rows)  # so that sums don't depend on the order that tasks end in
    y, plain = (np.array([r[k] for r in rows], np.float64) for k in (0, 1))
    feature, sentence, owner, base = [], [], [], 0
    for k, (_, _, words_, own) in enumerate(rows):
        own = np.frombuffer(own, "<i4")
        count = int(own.max()) + 1 if len(own) else 0
        feature.append(np.frombuffer(words_, "<i4"))
        sentence.append(own + np.int32(base))
        owner.append(np.full(count, k, np.int32))
        base += count
    feature, sentence, owner = (np.concatenate(x) for x in (feature, sentence, owner))
    m = len(vocabulary)
    w, b = np.zeros(m), -6.0
    first, second, fb, sb = np.zeros(m), np.zeros(m), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        z = b + np.bincount(sentence, w[feature], base)
        # minus the log of the chance that no sentence is toxic; those without known words are alike
        bag = np.bincount(owner, softplus(z), len(y)) + plain * softplus(b)
        slope = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(bag, 500)), 1e-9), 1.0) / len(y)
        gz = slope[owner] / (1 + np.exp(-z))
        gw, gb = np.bincount(feature, gz[sentence], m) + SHRINK / len(y) * w, gz.sum() + (slope * plain).sum() / (1 + np.exp(-b))
        first, second = 0.9 * first + 0.1 * gw, 0.99 * second + 0.01 * gw**2
        fb, sb = 0.9 * fb + 0.1 * gb, 0.99 * sb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w = w - RATE * (first / c1) / (np.sqrt(second / c2) + 1e-7)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * 0.02, 0)  # words that tell nothing fall to zero
        b -= RATE * (fb / c1) / (np.sqrt(sb / c2) + 1e-7)
    keep = np.abs(w) > 1e-3
    return Model(vocabulary[keep], w[keep], float(b))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """A model of at most ``bound`` labelled documents."""
    spark, none = docs.sparkSession, np.zeros(0, np.uint64)
    sample = F.broadcast(training_rows(labels, "toxic", bound))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("label", "text")
    # an id may repeat, so rows are bounded too
    rows = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).limit(2 * bound).repartition(spark.sparkContext.defaultParallelism)
    keyed = rows.mapInArrow(_keyed, "label int, text string, least long, head binary, size int").repartition(spark.sparkContext.defaultParallelism, "label", "least")
    with Scratch(spark, "toxicity") as scratch:
        bags = scratch.write(keyed.sortWithinPartitions("label", "least", "head", "size", "text").mapInArrow(_firsts, "label int, text string"), "sample")
        n, toxic = bags.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        if not 0 < toxic < n:
            return Model(none, np.zeros(0), 0.0, toxic / n if n else 0.0)
        # words whose share of toxic documents differs from the sample's by more than chance makes likely
        df, share = F.col("df"), F.lit(toxic / n)
        apart = F.abs(F.col("toxic_df") - df * share) / F.sqrt(df * share * (1 - share) * F.greatest(1 - df / F.lit(float(n)), F.lit(1e-9)))
        counts = bags.mapInArrow(_counts, "word long, df long, toxic_df long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("toxic_df").alias("toxic_df"))
        found = counts.filter((df >= LEAST_DOCS) & (apart >= LEAST_Z)).select("word").collect()
        if not found:
            return Model(none, np.zeros(0), 0.0, toxic / n)
        vocabulary = np.sort(np.array([r.word for r in found], np.int64).view(np.uint64))
        sent = spark.sparkContext.broadcast(vocabulary)
        numbers = bags.mapInArrow(_numbered(sent), "label int, plain int, feature binary, sentence binary")
        return fit(vocabulary, [(r.label, r.plain, bytes(r.feature), bytes(r.sentence)) for r in numbers.toLocalIterator()])


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores = []
            for a, b, data, offsets in chunks(batch.column(1)):
                starts, ends, sentence, first = sentences(data, offsets)
                z = m.sentence_logits(data, starts, ends, sentence)
                document = np.zeros(len(z), np.int64)
                document[sentence] = np.repeat(np.arange(b - a), np.diff(first))
                p = -np.expm1(-np.bincount(document, softplus(z), b - a))
                scores.append(p if m.constant is None else np.full(b - a, m.constant))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scorer(sent), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def locate(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """(doc_id, sentence, score, text) of every sentence that scores at least ``least``, from its first word to its last."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for a, _, data, offsets in chunks(batch.column(1)):
                starts, ends, sentence, first = sentences(data, offsets)
                z = m.sentence_logits(data, starts, ends, sentence)
                p = 1 / (1 + np.exp(-z))
                head = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(sentence) else np.zeros(0, np.int64)
                tail = np.append(head[1:], len(sentence)) - 1
                some = np.flatnonzero(p >= least)
                row = np.searchsorted(first, head[some], "right") - 1
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(a + row)), pa.array(some - sentence[np.minimum(first[row], len(sentence) - 1)] if len(some) else some), pa.array(p[some]), pa.array([raw[x:y].decode() for x, y in zip(starts[head[some]].tolist(), ends[tail[some]].tolist())], pa.string())],
                    names=["doc_id", "sentence", "score", "text"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, sentence long, score double, text string")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, columns as they are; a map without shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            pair = pa.RecordBatch.from_arrays([text, text], names=["doc_id", "text"])
            for scored in scorer(iter([pair])):
                yield batch.filter(pa.array(np.asarray(scored.column(1)) < THRESHOLD))

    inner = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c).alias(f"c{i}_") for i, c in enumerate(names)])
    kept = inner.mapInArrow(run, inner.schema)
    return kept.select(*[F.col(c if c == "text" else f"c{i}_").alias(c) for i, c in enumerate(names)])
