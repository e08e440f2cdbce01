"""Exact top-k search, mixing and the pipeline."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import exact_topk, mixing

sys.path.insert(0, str(Path(__file__).parent))

DIR = "/root/testdata/sf0.001"


def test_search(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(60)]  # ties
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (450, [float("nan")] * 8), (402, [float("inf")] * 8), (403, [0.5] * 7), (None, [9.0] * 8), (500, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double").repartition(4)
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in kept:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in kept if i != q and len(y) == len(x))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    got = sorted(tuple(r) for r in exact_topk.search(df).collect())
    assert got == sorted(want)
    assert exact_topk.search(df.filter("vec_id < 0")).count() == 0


def _plain(rows, k=5):
    whole = [(i, [int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for q, x in whole:
        if q % 50 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=True)))), i) for i, y in whole if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_search_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK_COMPONENTS", 64 * 40)
    monkeypatch.setattr(exact_topk, "QUERY_ROWS", 3)
    df = spark.read.parquet(f"{DIR}/embeddings.parquet")
    blocks = sorted(tuple(r) for r in exact_topk.search(df).collect())
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    assert blocks == _plain(rows)


def test_search_with_outliers_and_huge_components(spark):
    rng = np.random.default_rng(19)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(200)]
    rows[3] = (3, [1e6, 0.0, 0.0, 0.0, 0.0, -1e6])  # an outlier must not blur the others' cells
    rows[50] = (50, [1e15, -3.0, 1.0, 1.0, 1e9, 2.0])
    rows[7] = (7, [1e300, 1.0, 0.0, 0.0, 0.0, 0.0])
    rows[8] = (8, [-1.7e308, 1.0, 0.0, 0.0, 1e308, 0.0])
    rows[100] = (100, [1.7e308, 0.0, 0.0, 0.0, 0.0, 1.0])
    got = sorted(tuple(r) for r in exact_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == _plain(rows)


def test_reads_follow_the_bounds(monkeypatch):
    """Few exact vectors are read, and a pack and a file need little memory."""
    import tracemalloc

    rng = np.random.default_rng(20)
    e = rng.normal(0, 0.2, (2048, 64))
    file = exact_topk.File(np.arange(2048), e)
    read = []
    plain = exact_topk.exact_scores
    monkeypatch.setattr(exact_topk, "exact_scores", lambda a, b: read.append(len(a)) or plain(a, b))
    best = exact_topk.Best(np.arange(5000, 5064), rng.normal(0, 0.2, (64, 64)), 5)
    assert (best.e @ e.T * 65536 <= file.bounds(best.e) + 256 * 64 * 8).all()
    tracemalloc.start()
    best.scan(file)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(read) < 64 * 2048 / 4 and peak < 60 << 20
    scores = exact_topk.quantised(best.e) @ exact_topk.quantised(e).T
    assert (np.sort(scores, 1)[:, ::-1][:, :5] == best.scores).all()


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s] + 1e-9] if free else []
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            full.add(s)
        left = sum(sizes.values()) - sum(target.values())


def test_mixing(spark):
    rng = np.random.default_rng(10)
    docs = []
    for s, n in (("a", 400), ("b", 20), ("c", 1), ("d", 60), (None, 30), ("é", 5), ("empty", 2)):
        docs += [(len(docs) + i, "" if s == "empty" else "w " * int(rng.integers(0, 60)), s, "x") for i in range(n)]
    docs += [(len(docs) + i, "same " * 30, "a", "x") for i in range(300)] + [(None, "null id", "b", "x"), (1, None, "a", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size string").repartition(5)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    sizes = {}
    for _, t, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = _targets(sizes)
    source = {d: s for d, _, s, _ in docs if d is not None and d != 1}
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        if r["doc_id"] in source:
            s = source[r["doc_id"]]
            assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
        else:
            s = "a" if r["doc_id"] == 1 else "b"
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= (0 if t == 3 * sizes[s] else 60), s
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, map(tuple, rows)))
    assert mixing.mix(df.filter("doc_id < 0")).count() == 0


def test_fit_is_exact_where_it_can_be():
    rng = np.random.default_rng(11)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 40, 8))
        counts = rng.integers(1, 6, len(lengths))
        words = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit(lengths, counts, words)
        assert (take >= 0).all() and (take <= counts).all() and (lengths * take).sum() <= words
        left = words - int((lengths * take).sum())
        spare = [int(n) for n, c, t in zip(lengths, counts, take, strict=True) for _ in range(int(c - t))]
        assert not any(s <= left for s in spare)


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from basalt.llm import quality, secrets
    from helpers import components

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    good = pipeline.keep_quality(spark, docs, DIR)
    model = quality.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"), quality.fold("doc_id", 4) != 2)
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.score(docs, model).filter("predicted = 1").collect()}
    single = pipeline.drop_near_duplicates(spark, good, DIR)
    plain = components([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in plain.items() if i == c}
    clean = pipeline.drop_secrets(spark, single, DIR)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in secrets.scan(single).filter(F.size("found") == 0).collect()}
    mixed = pipeline.mix_sources(spark, clean, DIR)
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(clean).filter("taken > 0").collect()}
    assert good.columns == single.columns == clean.columns == mixed.columns == columns
    assert pipeline.run(spark, DIR).count() == mixed.count()
