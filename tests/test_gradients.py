"""Models fitted by summed gradients: gradients against differences, jobs against models, planted signals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from basalt.operators import gradients, metrics, splits
from basalt.plans import tasks



def test_net_gradient():
    rng = np.random.default_rng(0)
    net = gradients.PairNet(hidden=3)
    x, y, label = rng.normal(size=(7, 4)), rng.normal(size=(7, 4)), rng.integers(0, 2, 7).astype(float)
    flat = rng.normal(size=4 * 3 + 3 + 3 + 1)
    got, _ = net.gradient(flat, x, y, label)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        slope = (net.gradient(flat + step, x, y, label)[1] - net.gradient(flat - step, x, y, label)[1]) / 2e-6
        assert got[i] == pytest.approx(slope, abs=1e-4)


def test_linear_gradients():
    rng = np.random.default_rng(1)
    sweep = gradients.LinearSweep([gradients.Task("a", 1, 2, [0.3, 0.7]), gradients.Task("b", 1, 3), gradients.Task("c", 1, 1, centre=0.2, scale=2.0)], [0.1])
    x, y = rng.normal(size=(9, 4)), [rng.integers(0, 2, 9), rng.integers(0, 3, 9), rng.normal(size=9)]
    labels = [[{"task": t, "y": float(y[t][i]), "split": i % 2} for t in range(3)] for i in range(9)]
    batch = pa.RecordBatch.from_pydict({"x": x.tolist(), "labels": labels})
    weights = rng.normal(size=(5, 5))
    whole = lambda w: sweep._partial(w, np.ones((5, 3)))(batch)
    gradient, losses = whole(weights)[:25].reshape(5, 5), lambda w: whole(w)[25:28].sum()
    for i in range(5):
        for j in range(5):
            step = np.zeros((5, 5))
            step[i, j] = 1e-6
            assert gradient[i, j] == pytest.approx((losses(weights + step) - losses(weights - step)) / 2e-6, abs=1e-4)


@pytest.fixture(scope="module")
def genomes(spark):
    v = np.random.default_rng(6).normal(size=(400, 6))
    rows = [(i, f"g{i % 31}", x.tolist(), str(int(x[0] > x[1])), ["a", "b", "c"][int(np.argmax(x[:3]))], str(int(x[3] > x[4]))) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id int, genus string, v array<double>, a string, b string, c string")


def test_jobs_do_not_follow_the_targets(spark, genomes, monkeypatch):
    passes = []
    plain = gradients.summed
    monkeypatch.setattr(gradients, "summed", lambda rows, partial: passes.append(1) or plain(rows, partial))
    small = genomes.select("id", "genus", "v")
    counts = []
    for targets, seeds in ((["a"], (1,)), (["a", "b", "c"], (1, 2, 3))):
        passes.clear()
        found = tasks.trait_probes(small, genomes.select("id", *targets), targets, "id", "v", "genus", seeds, 20).collect()
        counts.append(len(passes))
        assert {(r["target"], r["seed"]) for r in found} == {(t, s) for t in targets for s in seeds}
        assert all(r["macro_auroc"] > 0.9 and r["skipped"] is None and r["n_train"] + r["n_val"] + r["n_test"] == 400 for r in found)
    assert counts[1] <= 62 and counts[0] <= 62  # passes are bounded by the epochs, not by targets times seeds times strengths


def test_early_stopping_keeps_the_best_state(spark):
    """Labels of noise: validation loss only rises after the first passes, so few are made and the kept model is near nothing."""
    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=30).tolist(), [{"task": 0, "y": float(rng.integers(0, 2)), "split": int(i % 4 == 0)}]) for i in range(160)]
    table = spark.createDataFrame(rows, "x array<double>, labels array<struct<task:int,y:double,split:int>>")
    made = []
    sweep = gradients.LinearSweep([gradients.Task("noise", 1, 2)], [1e-4], patience=3)
    plain = sweep._partial
    sweep._partial = lambda w, mask: made.append(w.copy()) or plain(w, mask)
    sweep.fit(table)
    assert len(made) < 60 and np.abs(sweep.weights).max() < np.abs(made[-1]).max()
    seeds = [gradients.LinearSweep([gradients.Task("noise", s, 2)], [1e-2], dropout=0.2, patience=3).fit(table).weights for s in (1, 1, 2)]
    assert np.allclose(seeds[0], seeds[1]) and seeds[0].shape == seeds[2].shape


def test_split_sweep_equals_single_splits(spark):
    rows = [(i, f"g{i % 11}", t, str(i % 2)) for i in range(200) for t in ("p", "q") if t == "p" or i % 3]
    long = spark.createDataFrame(rows, "id int, g string, target string, class string")
    found = splits.split_sweep(long, "id", "g", "class", (1, 2))
    for target in ("p", "q"):
        for seed in (1, 2):
            one = splits.group_split(long.filter(f"target = '{target}'"), "g", seed)
            both = [sorted((r["id"], r["split"]) for r in df.select("id", "split").collect()) for df in (one, found.filter(f"target = '{target}' and seed = {seed}"))]
            assert both[0] == both[1]
    few = long.withColumn("g", long["class"])  # two groups: by class
    by_class = splits.split_sweep(few, "id", "g", "class", (1,))
    assert {(r["class"], r["split"]): r["count"] for r in by_class.filter("target = 'p'").groupBy("class", "split").count().collect()}[("0", "train")] == 70


def test_pair_net_beats_a_linear_probe_where_proteins_act_nonlinearly(spark):
    rng = np.random.default_rng(7)
    genes, edges = [], []
    for contig in range(30):
        v = rng.normal(size=(20, 4))
        genes += [(contig, i, x.tolist()) for i, x in enumerate(v)]
        far = np.abs(v[:, 0] - v[:, 1])
        edges += [(contig, i, j, 900 if far[i] + far[j] > 2.2 else 100) for i in range(20) for j in range(i + 1, 20, 2)]
    g = spark.createDataFrame(genes, "contig long, gene_idx long, v array<double>")
    e = spark.createDataFrame(edges, "contig long, i long, j long, score long")
    pairs = tasks.ppi_pairs(g, e, "contig")
    assert pairs.groupBy("contig").agg({"split": "max"}).join(pairs.groupBy("contig").agg({"split": "min"}), "contig").filter("`max(split)` <> `min(split)`").count() == 0
    found = tasks.ppi_supervised(pairs, "contig", hidden=16).collect()
    assert found and np.mean([r["auroc"] for r in found]) > 0.9 and all(r["loss"] < 0.6 for r in found)
    from basalt.functions.vectors import pair_mean
    from pyspark.sql import functions as F

    code = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    means = pairs.select("contig", pair_mean(F.col("x"), F.col("y")).alias("x"), F.array(F.struct(F.lit(0).alias("task"), F.col("class").cast("double").alias("y"), code.alias("split"))).alias("labels"))
    linear = gradients.LinearSweep([gradients.Task("t", 1, 2)], [1e-3]).fit(means).scored(means, ["contig"]).filter("split = 2")
    plain = metrics.ranking(linear.withColumn("s", F.get("probabilities", F.lit(1))), [], "class", "s").first()["auroc"]
    assert plain < 0.75


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "x array<double>, labels array<struct<task:int,y:double,split:int>>")
    with pytest.raises(ValueError):
        gradients.LinearSweep([gradients.Task("t", 1, 2)], [0.1]).fit(empty)
