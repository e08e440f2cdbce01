"""Element-wise pooling of vectors, from tokens to genes to genomes. Long form, so that partial sums combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rebuilt(long: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_v")))
    return long.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_v"]).alias(name))


def pool(df: DataFrame, keys: Sequence[str], vector: str, how: str = "mean", name: str | None = None) -> DataFrame:
    """Element-wise ``mean`` or ``max`` of the vectors of each key."""
    if how not in ("mean", "max"):
        raise ValueError("pooling is by mean or max")
    long = df.select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    value = F.avg(F.col("_x").cast("double")) if how == "mean" else F.max(F.col("_x").cast("double"))
    return _rebuilt(long.groupBy(*keys, "_pos").agg(value.alias("_v")), keys, name or vector)


def masked_mean(df: DataFrame, keys: Sequence[str], vector: str, mask: str) -> DataFrame:
    """Mean over the tokens whose mask is 1."""
    return pool(df.filter(F.col(mask) == 1), keys, vector)


def gene_masked_mean(df: DataFrame, keys: Sequence[str], vector: str, gene: str, attended: str) -> DataFrame:
    """Sum over gene tokens divided by the number of all attended tokens."""
    long = df.select(*keys, F.col(gene).alias("_g"), F.col(attended).alias("_a"), F.posexplode(vector).alias("_pos", "_x"))
    value = F.sum(F.col("_x").cast("double") * F.col("_g")) / F.sum("_a")
    return _rebuilt(long.groupBy(*keys, "_pos").agg(value.alias("_v")), keys, vector)


def first_token(df: DataFrame, keys: Sequence[str], vector: str, position: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(vector, position).alias(vector))


def end_token(df: DataFrame, keys: Sequence[str], vector: str, token: str, end: Column | int) -> DataFrame:
    return df.filter(F.col(token) == end).select(*keys, vector)


def ragged_mean(tokens: DataFrame, lengths: DataFrame, batch: str, position: str, vector: str) -> DataFrame:
    """Mean per sequence over tokens laid end to end without padding.

    ``lengths``: (batch, seq, length); ``tokens``: (batch, position from 0, vector).
    """
    ends = F.sum("length").over(Window.partitionBy(batch).orderBy("seq"))
    spans = lengths.withColumn("_end", ends).filter("length > 0").select(batch, "seq", F.explode(F.sequence(F.col("_end") - F.col("length"), F.col("_end") - 1)).alias(position))
    return pool(tokens.join(spans, [batch, position]), [batch, "seq"], vector)
