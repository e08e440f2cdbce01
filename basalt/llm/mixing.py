"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating; they share all words by weight, no
target above three times its source's words, what is over shared again by weight: water filling, solved in
closed form over the sources' table. A source's budget gives every document whole copies; what is left is
fitted with single documents: documents are counted by exact length, each length gets its proportional part,
and a bounded-knapsack dynamic program over the lengths' remaining documents fits the words still missing.
Its table is as long as those words: at most ``DP_WORDS`` or the longest document. The documents of a length
are then chosen by a seeded hash: in buckets, counted first, so that a group of one source and length that
holds a large part of all documents is spread over tasks.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source; repeated rows are
documents of their own; ties of the hash go by doc_id; an empty table gives an empty result; other columns
are ignored. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
WEIGHTS = 3
SEED = 17
DP_WORDS = 1 << 16
BUCKETS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source (``no_source``, ``source``) of ``sizes``: source_size and target."""
    words = sizes.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("no_source", "source"))
    named = words.withColumn("weight", (place - 1) % WEIGHTS + 1).withColumn("most", MOST_COPIES * F.col("source_size"))
    ratio = F.col("most").cast("double") / F.col("weight")
    order = Window.orderBy(ratio, "no_source", "source")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - (F.sum("most").over(order) - F.col("most"))).cast("double") / (F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight"))
    filled = named.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= ratio, F.col("level"))).over(everything))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("most").cast("double")))
    return filled.select("no_source", "source", "source_size", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """How many documents of each length (all positive) to take so that their words come as near below ``words`` as can be found."""
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if not total or words <= 0:
        return take
    parts = [divmod(int(c) * words, total) for c in counts]
    take = np.array([min(p[0], int(c)) for p, c in zip(parts, counts, strict=True)], np.int64)
    rest = words - int((lengths * take).sum())
    small = max(DP_WORDS, int(lengths.max()))
    for i in sorted(range(len(lengths)), key=lambda i: (-parts[i][1], -lengths[i])):  # largest fractions first
        if rest <= small:
            break
        if take[i] < counts[i]:
            take[i] += 1
            rest -= int(lengths[i])
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    by = np.full(rest + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        left, step = int(counts[i] - take[i]), 1
        while left > 0 and not reached[rest]:
            n = min(step, left)
            size = n * int(lengths[i])
            if size > rest:
                break
            fresh = np.flatnonzero(reached[:-size] & ~reached[size:]) + size
            by[fresh] = len(items)
            reached[fresh] = True
            items.append((int(i), n))
            left -= n
            step *= 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    some = pdf["size"].to_numpy() > 0
    out = pdf[["no_source", "source", "size"]].copy()
    out["n"] = 0
    out.loc[some, "n"] = fit(pdf["size"].to_numpy()[some], pdf["c"].to_numpy()[some], int(pdf["left_over"].iloc[0]))
    return out


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), word_count(F.col("text")).alias("size"))
    hashed = F.xxhash64("doc_id", F.lit(seed))
    sizes = materialize(sizes.withColumn("rank_hash", hashed).withColumn("bucket", F.pmod("rank_hash", F.lit(BUCKETS)).cast("int")), "sizes")
    goal = targets(sizes).withColumn("budget", F.floor("target").cast("long"))
    copies = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long")
    goal = materialize(goal.withColumn("copies", copies).withColumn("left_over", F.col("budget") - F.col("copies") * F.col("source_size")), "targets")
    buckets = sizes.groupBy("no_source", "source", "size", "bucket").agg(F.count("*").alias("c"))
    lengths = buckets.groupBy("no_source", "source", "size").agg(F.sum("c").alias("c")).join(goal.select("no_source", "source", "left_over"), ["no_source", "source"])
    fitted = lengths.groupBy("no_source", "source").applyInPandas(_fit_source, "no_source boolean, source string, size long, n long")
    before = F.sum("c").over(Window.partitionBy("no_source", "source", "size").orderBy("bucket")) - F.col("c")
    limits = buckets.join(fitted, ["no_source", "source", "size"]).select("no_source", "source", "size", "bucket", F.greatest(F.col("n") - before, F.lit(0)).alias("limit"))
    key = ["no_source", "source", "size", "bucket"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("rank_hash", "doc_id"))
    chosen = sizes.join(limits, key).withColumn("extra", (place <= F.col("limit")).cast("long"))
    final = chosen.join(goal.select("no_source", "source", "source_size", "target", "copies"), ["no_source", "source"])
    return final.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("extra"))).alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` over the whole of ``documents``."""
    return mix(read_table(spark, sf_dir, "documents"))
