"""Jobs and streams that are stopped and started again, models that fail on some texts."""

from __future__ import annotations

import sys

import numpy as np
import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from basalt.operators import embed, jobs, models
from basalt.streaming import ingest

register_pickle_by_value(sys.modules[__name__])  # workers don't import test modules


def test_a_crash_loses_one_file(spark, tmp_path):
    rows = spark.createDataFrame([(f"f/{i % 4}", i) for i in range(12)], "file string, id int")
    out, seen = str(tmp_path / "out"), []

    def job(df, broken=None):
        name = df.select("file").first()[0]
        seen.append(name)
        if name == broken:
            return df.withColumn("id", F.raise_error(F.lit("the worker died")).cast("int"))
        return df

    with pytest.raises(Exception, match="the worker died"):
        jobs.run_pending(rows, "file", None, lambda df: job(df, "f/2"), out, 0, 3, workers=1)
    assert sorted((r["file"], r["rows"]) for r in jobs.done_files(spark, out, "file").collect()) == [("f/0", 3), ("f/1", 3)]
    seen.clear()
    jobs.run_pending(rows, "file", None, job, out, workers=1)
    assert sorted(seen) == ["f/2", "f/3"]
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(12))
    jobs.run_pending(rows, "file", None, job, out)
    assert len(seen) == 2 and jobs.done_files(spark, str(tmp_path / "none"), "file").count() == 0


def test_totals_go_on_after_a_restart(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "k string, v long"

    def come(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        ingest.running_totals(ingest.stream(spark, folder, spark.read.parquet(folder).schema, 1), ["k"], {"n": F.count("*"), "v": F.sum("v")}, out, checkpoint)
        return {r["k"]: (r["n"], r["v"]) for r in ingest.current_totals(spark, out, ["k"]).collect()}

    come([("a", 1), ("b", 2), (None, 5)])
    assert run() == {"a": (1, 1), "b": (1, 2), None: (1, 5)}
    come([("b", 7), ("c", 1)])
    assert run() == {"a": (1, 1), "b": (2, 9), "c": (1, 1), None: (1, 5)}
    last = spark.read.parquet(out).agg(F.max("change")).first()[0]
    assert {r["k"] for r in spark.read.parquet(out).filter(F.col("change") == last).collect()} == {"b", "c"}  # what did not change is not written
    for name in (f"{last}", f".{last}.crc"):  # the crash comes after the batch was written and before it was committed
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    assert run()["b"] == (2, 9)


def _picky(texts):
    if any("x" in t for t in texts):
        raise ValueError("x")
    return [np.array([[len(t), 1.0], [0.0, 0.0]]) for t in texts]


def test_one_bad_text_is_one_skipped_row(spark):
    texts = ["ab", "x", None, "", "abcd", "a" * 200, "bx"]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, text string, other string").coalesce(1)
    got = {r["id"]: r for r in models.embed(df, "text", models.Model("picky", lambda: _picky, max_seq_len=100)).collect()}
    assert [got[i]["skipped"] for i in range(7)] == [None, "ValueError: x", "no_text", "no_text", None, None, "ValueError: x"]
    assert got[0]["embedding"] == [1.0, 0.5] and got[5]["embedding"] == [50.0, 0.5] and got[1]["embedding"] is None and got[4]["other"] == "kept"
    first = models.embed(df.filter("id = 4"), "text", models.Model("picky", lambda: _picky, pooling="cls")).first()
    assert first["embedding"] == [4.0, 1.0]
    assert models.embed(df.limit(0), "text", models.Model("picky", lambda: _picky)).count() == 0
    with pytest.raises(ValueError):
        models.Model("m", lambda: _picky, pooling="max")


def test_batches_stay_within_their_budget():
    lengths = [5, 1, 9, 2, 2, 100, 3, 0]
    groups = list(models.batches(lengths, 10))
    assert sorted(i for g in groups for i in g) == list(range(8))
    assert all(max(lengths[i] for i in g) * len(g) <= 10 or len(g) == 1 for g in groups)


def test_a_model_is_loaded_once(spark):
    made = []
    model = models.Model("counted", lambda: made.append(1) or embed.letter_vectors)
    for _ in range(3):
        assert model.loaded()(["AC"])[0].tolist() == [[1, 0, 0, 0], [0, 1, 0, 0]]
    assert len(made) == 1


def test_memory_follows_the_budget_not_the_longest_text(spark):
    """A text of a million letters stands alone in its batch."""
    seen = []
    lengths = [10**6, *([8] * 5000)]
    for group in models.batches(lengths, 16_384):
        seen.append(max(lengths[i] for i in group) * len(group))
    assert sorted(seen)[-1] == 10**6 and sorted(seen)[-2] <= 16_384


def test_whole_genomes(spark):
    df = spark.createDataFrame([(1, "ACGT" * 10 + " AAAA"), (2, "C" * 30)], "g int, dna string")
    got = {r["g"]: r["embedding"] for r in embed.embed_whole_genome(df, "g", "dna", "mean", models.Model("letters2", lambda: embed.letter_vectors), 16, 4).collect()}
    assert got[2] == [0, 1, 0, 0] and got[1][0] > got[1][1] > 0
    with pytest.raises(ValueError):
        embed.embed_whole_genome(df, "g", "dna", "median", models.Model("letters2", lambda: embed.letter_vectors))
