"""Running sums and places of keys that are cut into ranges equal those of one window."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt.operators import metrics, running, splits


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(x), int(a)) for k, n in (("big", 3000), ("skewed", 2000), ("small", 5), (None, 700)) for x, a in zip(rng.normal(size=n) ** (9 if k == "skewed" else 1), rng.integers(0, 5, n), strict=True)]
    rows += [("big", float("inf"), 3), ("big", float("-inf"), 4), ("small", -0.5, 1)]
    return spark.createDataFrame(rows, "k string, s double, a int").dropDuplicates(["k", "s"])


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sums(cells, keys):
    df = cells if keys else cells.dropDuplicates(["s"])
    plain = df.withColumn("run", F.sum("a").over(Window.partitionBy(*keys).orderBy(F.desc("s"))))
    want = sorted(map(tuple, plain.collect()), key=repr)
    for large, ranges in ((1 << 20, 1 << 10), (600, 16), (0, 64)):
        got = running.running_sums(df, keys, "s", {"run": "a"}, large, ranges)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert running.running_sums(df.limit(0), keys, "s", {"run": "a"}).count() == 0


def test_no_window_holds_a_large_key(cells, monkeypatch):
    """The largest window of the cut key holds about a range, not the key."""
    some = cells.filter("k = 'skewed'")
    cuts = some.agg(F.array_distinct(F.percentile_approx("s", [i / 16 for i in range(1, 16)], 1000)).alias("c"))
    ranges = some.crossJoin(F.broadcast(cuts)).groupBy(running.range_of(F.col("s"), F.col("c"))).count()
    assert ranges.count() == 16 and ranges.agg(F.max("count")).first()[0] <= 2 * 2000 / 16


def test_ranking_of_a_cut_key(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i % 2, int(y), float(s)) for i, (y, s) in enumerate(zip(rng.integers(0, 2, 2000), rng.integers(0, 900, 2000), strict=True))] + [(0, 1, None), (0, 0, None)]
    df = spark.createDataFrame(rows, "k int, y int, s double")
    want = sorted(map(tuple, metrics.ranking(df, ["k"], "y", "s").collect()))
    plain = running.running_sums
    monkeypatch.setattr(metrics, "running_sums", lambda df, keys, order, sums: plain(df, keys, order, sums, 100, 32))
    assert [pytest.approx(r) for r in sorted(map(tuple, metrics.ranking(df, ["k"], "y", "s").collect()))] == want
    ones, zeros = ([(-1e9 if s is None else s) for k, y, s in rows if k == 0 and y == c] for c in (1, 0))
    auroc = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
    assert want[0][1] == pytest.approx(auroc)


def test_places(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(2000)], "id int, y int")
    digest = F.md5(F.col("id").cast("string"))
    plain = df.withColumn("p", F.row_number().over(Window.partitionBy("y").orderBy(digest, "id"))).withColumn("n", F.count("*").over(Window.partitionBy("y")))
    got = running.places(df, ["y"], digest, "id").select("id", "y", "_place", "_total")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    parts = splits.stratified_split(df, "id", "y", 3)
    assert parts.count() == 2000 and parts.filter("y is null and split = 'train'").count() == 280
