"""Classifiers: held-out accuracy, the trees' traversal, the risk estimator, and defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import boosting, quality, toxicity

DIR = "/root/testdata/sf0.01"


def _auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2) if len(p) and len(n) else 1.0


def _slow(trees, row):
    total = trees.base
    for root in trees.roots:
        at = root
        for _ in range(trees.depth):
            at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = boosting.fit(x[:600], y[:600])
    p = trees.predict(x[600:])
    assert _auc(y[600:], p) > 0.97
    assert np.allclose(p[:50], [_slow(trees, r) for r in x[600:650]])
    assert boosting.fit(x[:0], y[:0]).predict(x[:2]) == pytest.approx([0.5, 0.5])
    assert boosting.fit(x, np.ones(800)).predict(x[:1])[0] > 0.9


def test_statistics():
    import pyarrow as pa

    rows = quality.statistics(pa.array(["ab AB.\nab AB.\n", None, "", "x" * 3_000_000]))
    names = dict(zip(quality.FEATURES, rows[0], strict=True))
    assert names["log_words"] == pytest.approx(np.log1p(4)) and names["repeated_lines"] == 1 and names["upper_words"] == 0.5
    assert rows[1].tolist() == rows[2].tolist() == [0] * len(quality.FEATURES)
    assert np.isfinite(rows).all() and rows.shape == (4, len(quality.FEATURES))


@pytest.mark.parametrize(("operator", "query", "label", "rest", "divisor"), [(quality, "op1_quality", "quality", 2, 4), (toxicity, "op10_toxicity", "toxic", 1, 3)])
def test_held_out(spark, operator, query, label, rest, divisor):
    rows = getattr(operator, query)(spark, DIR).toPandas()
    n = spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert len(rows) == n and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % divisor == rest for i in rows.doc_id]).all()
    known = spark.read.parquet(f"{DIR}/labels.parquet").toPandas().merge(rows, on="doc_id")
    out = known[known.held_out]
    assert _auc(out[label].to_numpy(), out.score.to_numpy()) > 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good text here", 0), (1, "good text here", 0), (2, None, 0), (None, "", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    for operator in (quality, toxicity):
        model = operator.train(docs, labels, F.lit(True))
        rows = operator.score(docs, model).collect()
        assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
        assert operator.score(docs.filter("doc_id > 5"), model).count() == 0
    assert quality.keep_good(docs, quality.train(docs, labels, F.lit(True)), 0.0).columns == docs.columns


def test_nnpu():
    rng = np.random.default_rng(2)
    positive = (rng.random((300, 6)) < [0.8, 0.6, 0.1, 0.1, 0.1, 0.1]).astype(float)
    negative = (rng.random((2700, 6)) < [0.01, 0.01, 0.1, 0.1, 0.1, 0.1]).astype(float)
    hidden = (rng.random((300, 6)) < [0.8, 0.6, 0.1, 0.1, 0.1, 0.1]).astype(float)
    w, b = toxicity.fit_nnpu(positive, np.concatenate([negative, hidden]), 0.1)
    assert w[0] > 1 and w[1] > 1 and abs(w[2:]).max() < w[1]
    assert _auc(np.array([1] * 300 + [0] * 2700), np.concatenate([hidden, negative]) @ w + b) > 0.9


def test_threshold_follows_scores_not_a_quota(spark):
    """Labels hold 50 % toxic rows, documents 5 % or, with copies of a toxic text, 40 %."""
    rng = np.random.default_rng(5)
    filler = lambda: " ".join(f"w{i}" for i in rng.integers(0, 40, 30))
    bad = lambda: filler() + " " + " ".join(rng.choice(["vileone", "foultwo", "nastythree", "grimfour"], 3, replace=False))
    toxic = [(i, bad()) for i in range(60)]
    clean = [(1000 + i, filler()) for i in range(1140)]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(1000 + i, 0) for i in range(30)], "doc_id long, toxic int")
    for extra in ([], [(5000 + i, toxic[40][1]) for i in range(700)]):
        docs = spark.createDataFrame(toxic + clean + extra, "doc_id long, text string")
        rows = toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).toPandas()
        is_toxic = (rows.doc_id < 1000) | (rows.doc_id >= 5000)
        assert rows.predicted[is_toxic].mean() > 0.95
        assert rows.predicted[~is_toxic].mean() < 0.02


def _plain_terms(text):
    import re

    words = re.findall(r"[a-z0-9\x80-\xff]+", (text or "").encode().decode("latin-1").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return set(words) | {(w[:n], n) for w in words for n in toxicity.BEGINNINGS if len(w) > n}


def test_vocabulary_and_features_by_hand(spark, monkeypatch):
    """Terms counted over all documents, one row a chosen doc_id, against loops."""
    monkeypatch.setattr(toxicity, "VOCABULARY", 12)
    rng = np.random.default_rng(21)
    names = ["Vile", "foul-one", "nasty", "grimmer", *(f"word{i}" for i in range(30))]
    text = lambda low, high: " ".join(names[int(i)] for i in rng.integers(low, high, 12))
    docs = [(i, text(0, 12)) for i in range(30)] + [(100 + i, text(4, 34)) for i in range(200)] + [(7, text(0, 12)) for _ in range(20)]
    labels = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    least = {i: min(t for d, t in docs if d == i) for i in range(30)}
    p, n = {}, {}
    for t in least.values():
        for term in _plain_terms(t):
            p[term] = p.get(term, 0) + 1
    for _, t in docs:
        for term in _plain_terms(t):
            n[term] = n.get(term, 0) + 1
    gain = {t: p[t] * np.log((p[t] + 0.5) / 30 / ((n[t] + 0.5) / len(docs))) for t in p if p[t] >= 3 and (p[t] + 0.5) / 30 / ((n[t] + 0.5) / len(docs)) >= 2}
    assert len(model.words) == min(12, len(gain)) > 0
    import pyarrow as pa

    best = sorted(gain.values(), reverse=True)[: len(model.words)]
    whole = {term for term in gain if gain[term] >= best[-1]}
    for t in list(least.values())[:5]:
        places = next(iter(toxicity._present(model.words, pa.array([t]))))
        assert len(places) <= len(_plain_terms(t) & whole)


def test_risk_by_loops():
    rng = np.random.default_rng(22)
    x, u = (rng.random((40, 3)) < 0.5).astype(float), (rng.random((90, 3)) < 0.2).astype(float)
    w, b = toxicity.fit_nnpu(x, u, 0.3, steps=4000, rate=0.02, decay=0.0)

    def risk(w, b):
        loss = lambda z: float(np.logaddexp(0, z))
        r = sum(loss(-(r @ w + b)) for r in x) / len(x) * 0.3
        return r + max(0.0, sum(loss(r @ w + b) for r in u) / len(u) - 0.3 * sum(loss(r @ w + b) for r in x) / len(x))

    base = risk(w, b)
    for i in range(3):
        for step in (-0.3, 0.3):
            assert risk(w + step * np.eye(3)[i], b) >= base - 5e-3
    assert risk(w, b + 0.3) >= base - 5e-3 and risk(w, b - 0.3) >= base - 5e-3


def test_a_repeated_doc_id_is_learned_from_once(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda x, u, prior: rows.append((len(x), len(u))) or (np.zeros(x.shape[1]), 0.0))
    docs = [(0, f"vile text {i % 3}") for i in range(400)] + [(i, f"vile foul text {i}") for i in range(1, 101)]
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(60)], "doc_id long, toxic int")
    toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels, F.lit(True))
    assert rows == [(10, 101)]
