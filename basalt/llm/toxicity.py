"""Toxicity: a linear classifier fitted by non-negative positive-unlabelled learning.

Learns from confirmed toxic documents and unlabelled documents alone; labels of 0 serve the class prior (the
share of toxic rows among usable labels) and the place of the threshold. Features are the presence of words, and of beginnings of
words, that confirmed documents hold clearly more often than all documents do. The ``VOCABULARY`` terms that tell most
are chosen: candidates from the confirmed documents, counted by Spark over all documents. The risk is

    prior * R+(confirmed) + max(0, R-(unlabelled) - prior * R-(confirmed)),

with logistic losses; where the second part falls below zero, the step goes uphill on it, as the method asks.
The bias is then set by the scores of usable labelled documents: where the shares of toxic and of other ones
above a logit differ most, the score becomes ``THRESHOLD``. Shares within each class depend neither on how
often a class is labelled nor on how often it stands among the documents.
The fitted samples are bounded (``CONFIRMED_ROWS``, ``UNLABELLED_ROWS``, ``PLACING_ROWS`` labelled documents of each
class, those with the smallest hashes, one row a doc_id); all rows are scored, whole texts each. The prior is the
share of toxic rows with one row of each class added, so it is never 0 or 1.

Defined cases: null and empty texts have no words and get the score of the bias; without confirmed documents
all scores equal the prior; where no usable document is labelled 0 the fitted bias stays; null or repeated
label rows count once, by their largest label; rows may repeat, and of the rows of a chosen doc_id the smallest
text is learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, tune
from .quality import fold
from .textkernel import chunks, mix, word_hashes, word_spans

THRESHOLD = 0.7
CONFIRMED_ROWS = 10_000
UNLABELLED_ROWS = 20_000
PLACING_ROWS = 10_000
VOCABULARY = 512
#: Bytes of the beginnings of words that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A word is considered if so many confirmed documents hold it and its share there is so many times as large.
LEAST_DOCUMENTS = 3
LEAST_RATIO = 2.0
# Lower case; ASCII that is neither letter nor digit separates words.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or 48 <= c < 58 else 32 for c in range(128)]


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def _terms(column: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each chunk its number of texts and, by kind of term, the terms' hashes with the texts they stand in."""
    for lo, hi, data, offsets in chunks(column):
        plain = _PLAIN[data]
        starts, ends, first = word_spans(plain, offsets)
        owner = np.repeat(np.arange(hi - lo), np.diff(first))
        kinds = [(word_hashes(plain, starts, ends), owner)]
        for size in BEGINNINGS:
            some = ends - starts > size
            kinds.append((mix(word_hashes(plain, starts[some], starts[some] + size) ^ np.uint64(size)), owner[some]))
        yield hi - lo, kinds


def _word_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct terms' hashes."""
    for n, kinds in _terms(column):
        owner = np.concatenate([o for _, o in kinds])
        words = np.concatenate([w for w, _ in kinds])[np.argsort(owner, kind="stable")]
        cuts = np.searchsorted(np.sort(owner), np.arange(n + 1))
        for i in range(n):
            yield np.unique(words[cuts[i] : cuts[i + 1]])


_COUNTS = pa.schema([("word", pa.int64()), ("n", pa.int64())])


def _rows_of(words: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(words), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 50_000].view(np.int64)), pa.array(n[lo : lo + 50_000].astype(np.int64))], schema=_COUNTS)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of all terms in a batch."""
    for batch in batches:
        sets = list(_word_sets(batch.column("text")))
        if sets:
            yield from _rows_of(*np.unique(np.concatenate(sets), return_counts=True))


def _count_known(terms):
    """Document counts of given terms in a partition, a row a term."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for x in _present(known, batch.column("text")):
                total[x] += 1
        some = total > 0
        yield from _rows_of(known[some], total[some])

    return task


def _present(vocabulary: np.ndarray, column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the places of its terms in the vocabulary."""
    size = max(1, len(vocabulary))
    for n, kinds in _terms(column):
        found = []
        for words, owner in kinds if len(vocabulary) else []:
            at = np.minimum(np.searchsorted(vocabulary, words), size - 1)
            hit = vocabulary[at] == words
            found.append(owner[hit] * size + at[hit])
        found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cuts = np.searchsorted(found, np.arange(n + 1) * size)
        for i in range(n):
            yield found[cuts[i] : cuts[i + 1]] % size


def _features(vocabulary: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tolist() for x in _present(vocabulary, batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"confirmed": batch.column("confirmed"), "found": found}, schema=pa.schema([("confirmed", pa.bool_()), ("found", pa.list_(pa.int32()))]))

    return task


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier with the least non-negative risk (full-batch Adam)."""
    x = np.concatenate([positive, unlabelled]).astype(np.float64)
    x = np.hstack([x, np.ones((len(x), 1))])
    n_p = len(positive)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = x @ w
        s = 1 / (1 + np.exp(-z))
        negative_risk = np.logaddexp(0, z[n_p:]).mean() - prior * np.logaddexp(0, z[:n_p]).mean()
        plus = x[:n_p].T @ (s[:n_p] - 1) / n_p * prior
        minus = x[n_p:].T @ s[n_p:] / (len(x) - n_p) - prior * (x[:n_p].T @ s[:n_p]) / n_p
        g = plus + minus if negative_risk >= 0 else -minus
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _shift(toxic: np.ndarray, other: np.ndarray) -> float:
    """What to add to logits so that the threshold falls where it tells labelled documents apart best.

    Of the places between neighbouring logits at which the share of ``toxic`` above less that of ``other`` is
    largest, the widest counts.
    """
    if not len(toxic) or not len(other):
        return 0.0
    z = np.unique(np.concatenate([toxic, other]))
    if len(z) < 2:
        return 0.0
    toxic, other = np.sort(toxic), np.sort(other)
    apart = np.searchsorted(other, z[:-1], "right") / len(other) - np.searchsorted(toxic, z[:-1], "right") / len(toxic)
    at = int(np.argmax(np.where(apart >= apart.max() - 1e-12, np.diff(z), -1)))
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (z[at] + z[at + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, usable: F.Column, label: str = "toxic") -> Model:
    """Learns labels only from rows for which ``usable`` (a condition on doc_id) holds."""
    spark = docs.sparkSession
    tune(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(usable & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = known.agg(F.sum("y"), F.count("*")).first()
    prior = ((counts[0] or 0) + 1) / (counts[1] + 2)
    bare = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not counts[0]:
        return bare
    order = F.xxhash64("doc_id"), "doc_id"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def texts_of(chosen: DataFrame, *columns: str) -> DataFrame:
        """One text for each chosen doc_id; the choice is bounded, so it is broadcast."""
        return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *columns).agg(F.min("text").alias("text"))

    confirmed = known.filter("y = 1").orderBy(*order).limit(CONFIRMED_ROWS).select("doc_id", F.lit(True).alias("confirmed"))
    toxic = texts_of(confirmed, "confirmed")
    n_toxic, n_all = toxic.count(), rows.count()
    found = toxic.select("text").mapInArrow(_count_terms, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS)
    p = {r["word"]: r["n"] for r in found.collect()}  # at most the terms of CONFIRMED_ROWS documents
    known_terms = np.sort(np.array(list(p), np.int64).view(np.uint64))
    every = rows.select("text").mapInArrow(_count_known(spark.sparkContext.broadcast(known_terms)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    told = []
    for r in every.collect():  # the same terms
        share = p[r["word"]] / n_toxic
        ratio = (share + 0.5 / n_toxic) / ((r["n"] + 0.5) / n_all)
        if ratio >= LEAST_RATIO:
            told.append((-p[r["word"]] * np.log(ratio), r["word"]))
    vocabulary = np.sort(np.array([w for _, w in sorted(told)[:VOCABULARY]], np.int64).view(np.uint64))
    drawn = rows.select("doc_id").filter("doc_id is not null").distinct().orderBy(*order).limit(UNLABELLED_ROWS).select("doc_id", F.lit(False).alias("confirmed"))
    texts = toxic.unionByName(texts_of(drawn, "confirmed")).select("confirmed", "text")
    rows_x = texts.mapInArrow(_features(vocabulary), "confirmed boolean, found array<int>").collect()  # bounded by the samples
    rows_x.sort(key=lambda r: (r["confirmed"], r["found"]))  # the same model however the rows were dealt
    x = np.zeros((len(rows_x), len(vocabulary)), np.float32)
    for i, r in enumerate(rows_x):
        x[i, r["found"]] = 1
    flag = np.array([r["confirmed"] for r in rows_x], bool)
    if not flag.any() or flag.all():
        return bare
    weights, bias = fit_nnpu(x[flag], x[~flag], prior)
    model = Model(vocabulary, weights, bias)
    placing = known.filter("y = 1").orderBy(*order).limit(PLACING_ROWS).union(known.filter("y = 0").orderBy(*order).limit(PLACING_ROWS))
    held = texts_of(placing, "y").select("doc_id", "y", "text")
    logits = held.mapInArrow(_logits(spark.sparkContext.broadcast(model)), "doc_id long, y int, z double")
    placed = [(r["y"], round(r["z"], 9)) for r in logits.collect()]  # a row for each doc_id of the bounded samples
    model.bias += _shift(*(np.array([z for y, z in placed if y == side]) for side in (1, 0)))
    return model


def _logits(broadcast):
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("z", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            z = np.array([model.weights[x].sum() for x in _present(model.words, batch.column("text"))]) + model.bias
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "z": z}, schema=schema)

    return task


def _score(broadcast, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            z = np.array([model.weights[x].sum() for x in _present(model.words, batch.column("text"))]) + model.bias
            p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= threshold).astype(np.int32)}, schema=schema)

    return task


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score, predicted."""
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), threshold), "doc_id long, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; labels of the held-out third are never seen."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
