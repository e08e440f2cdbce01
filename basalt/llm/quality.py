"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed with numpy from the bytes of whole texts. The model is fitted on the driver from the
statistics of at most ``SAMPLE_ROWS`` labelled rows (a documented bound: those with the smallest hashes), and
broadcast as flat arrays; all rows are scored.

Defined cases: null and empty texts are scored like any other, from statistics of zero; label rows that are
null, repeated or of unknown documents add nothing wrong (the smallest label of a doc_id counts); without
usable labels every score is 0.5; rows may repeat, and of the rows of a labelled doc_id the smallest text is learned
from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import read_table, tune
from .textkernel import chunks, lower_ascii, word_hashes, word_spans

THRESHOLD = 0.7
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_spread", "long_words", "upper", "lower", "digits", "non_ascii", "white", "stops", "commas",
    "exclamations", "pipes", "symbols", "quotes", "other_marks", "lines_a_word", "distinct_words", "top_word", "repeated_lines", "distinct_lines",
    "words_with_marks", "upper_words", "same_neighbours", "distinct_pairs",
)
# Kinds of bytes, in the order of the counts below.
_KINDS = np.full(256, 9, np.int64)
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:], _KINDS[[9, 10, 11, 12, 13, 32]] = 0, 1, 2, 3, 4
for _i, _chars in enumerate((b".", b",", b"!", b"|")):
    _KINDS[list(_chars)] = 5 + _i
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*+<=>@\\^_`~{}[]")] = True
_QUOTES = np.zeros(256, bool)
_QUOTES[list(b"\"'()-:;/?")] = True


def _runs(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_counts=True)[1]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    parts = []
    for lo, hi, data, offsets in chunks(column):
        n = hi - lo
        x = np.zeros((n, len(FEATURES)))
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(lower_ascii(data), starts, ends)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        kinds = np.bincount(doc * 10 + _KINDS[data], minlength=n * 10).reshape(n, 10)
        symbols = np.bincount(doc[_SYMBOLS[data]], minlength=n)
        quotes = np.bincount(doc[_QUOTES[data]], minlength=n)
        size = np.diff(offsets).astype(float)
        n_words = np.diff(first).astype(float)
        lengths = (ends - starts).astype(float)
        owner = np.repeat(np.arange(n), np.diff(first))
        per = lambda w: np.bincount(owner, w, n)
        size1, words1 = np.maximum(size, 1), np.maximum(n_words, 1)
        mean = per(lengths) / words1
        x[:, 0], x[:, 1], x[:, 2] = np.log1p(size), np.log1p(n_words), mean
        x[:, 3] = np.sqrt(np.maximum(per(lengths**2) / words1 - mean**2, 0))
        x[:, 4] = per(lengths > 14) / words1
        x[:, 5:12] = kinds[:, [0, 1, 2, 3, 4, 5, 6]] / size1[:, None]
        x[:, 12], x[:, 13] = kinds[:, 7] / size1, kinds[:, 8] / size1
        x[:, 14], x[:, 15] = symbols / size1, quotes / size1
        x[:, 16] = (kinds[:, 9] - symbols - quotes) / size1
        breaks = np.flatnonzero(data == 10)
        x[:, 17] = np.bincount(doc[breaks], minlength=n) / words1
        if len(starts):
            last = _KINDS[data[ends - 1]]
            x[:, 22] = per(last >= 5) / words1
            second = np.minimum(starts + 1, ends - 1)
            x[:, 23] = per((_KINDS[data[starts]] == 0) & (_KINDS[data[second]] == 0) & (lengths > 1)) / words1
        line_starts = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
        line_starts = line_starts[line_starts < len(data)]
        line_ends = np.append(line_starts[1:], len(data))
        line_hash = word_hashes(data, line_starts, line_ends) if len(line_starts) else np.zeros(0, np.uint64)
        line_first = np.searchsorted(line_starts, offsets)
        for i in range(n):
            w = words[first[i] : first[i + 1]]
            if len(w):
                counts = _runs(w)
                x[i, 18], x[i, 19] = len(counts) / len(w), counts.max() / len(w)
                x[i, 24] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
                x[i, 25] = len(_runs(w[1:] * np.uint64(3) + w[:-1])) / (len(w) - 1) if len(w) > 1 else 1
            lines = line_hash[line_first[i] : line_first[i + 1]]
            if len(lines):
                counts = _runs(lines)
                x[i, 20], x[i, 21] = counts[counts > 1].sum() / len(lines), len(counts) / len(lines)
        parts.append(x)
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def fold(doc_id: str, divisor: int) -> F.Column:
    """crc32 of the doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def labelled_sample(labels: DataFrame, label: str, usable: F.Column, rows: int) -> DataFrame:
    """At most ``rows`` usable labelled ids, those with the smallest hashes: (doc_id, y)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(usable & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "x": [r.tolist() for r in x]}, schema=pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))]))


def train(docs: DataFrame, labels: DataFrame, usable: F.Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> boosting.Trees:
    """Fit on at most ``rows`` labelled documents for which ``usable`` (a condition on doc_id) holds."""
    tune(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, label, usable, rows))  # bounded by ``rows``
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    got = known.mapInArrow(_rows, "y int, x array<double>").collect()  # bounded by ``rows``
    got.sort(key=lambda r: (r["x"], r["y"]))  # the same model however the rows were dealt
    return boosting.fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], float))


def _score(model, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            p = trees.predict(statistics(batch.column("text")))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= threshold).astype(np.int32)}, schema=schema)

    return task


def score(docs: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score, predicted."""
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), threshold), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, whole, whose text scores ``threshold`` at least."""
    tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = held.value.predict(statistics(batch.column("text"))) >= threshold
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; labels of the held-out quarter are never seen."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
