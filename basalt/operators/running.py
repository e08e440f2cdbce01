"""Running sums and places within keys of any size.

A window over a whole key is one task. Here a large key is cut into ranges of its order column: quantiles of the column
are the cuts, a sum for each range gives what lies before it, and a window runs within a range only. Small keys take a plain
window; both give the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of more rows are cut into ``RANGES`` ranges.
LARGE = 1 << 20
RANGES = 1 << 10


def range_of(value: Column, cuts: Column) -> Column:
    """How many of the sorted ``cuts`` are below ``value``, by bisection."""
    steps = F.ceil(F.log2(F.size(cuts) + F.lit(1.0))).cast("int")
    begin = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        below = (s["lo"] < s["hi"]) & (F.get(cuts, middle) < value)
        return F.struct(F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), steps), begin, halve, lambda s: s["lo"])


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], large: int = LARGE, ranges: int = RANGES) -> DataFrame:
    """``df`` with running sums from the largest ``order`` on, this row included. ``sums``: new column to column. ``order`` is a number,
    differs between the rows of a key and is not null. Without keys all rows are one key."""
    keys = list(keys) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if keys == ["_all"] else df
    rows = rows.withColumn("_o", F.col(order).cast("double"))
    cuts = F.percentile_approx("_o", [i / ranges for i in range(1, ranges)], 10 * ranges)
    # only large keys have cuts; a key of null is a key like any other, so keys are compared by a struct
    big = rows.groupBy(F.struct(*keys).alias("_k")).agg(F.count("*").alias("_n"), F.min("_o").alias("_least")).filter(F.col("_n") > large).select("_k")
    rows = rows.withColumn("_k", F.struct(*keys))
    some = rows.join(big, "_k", "left_semi")
    cut = some.groupBy("_k").agg(F.array_distinct(cuts).alias("_cuts"))
    ranged = some.join(cut, "_k").withColumn("_r", range_of(F.col("_o"), F.col("_cuts"))).drop("_cuts")
    totals = ranged.groupBy("_k", "_r").agg(*(F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())))
    above = Window.partitionBy("_k").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = totals.select("_k", "_r", *(F.coalesce(F.sum(f"_t{i}").over(above), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    within = Window.partitionBy("_k", "_r").orderBy(F.desc("_o"))
    run = ranged.join(before, ["_k", "_r"])
    run = run.withColumns({name: F.col(f"_b{i}") + F.sum(c).over(within) for i, (name, c) in enumerate(sums.items())})
    whole = Window.partitionBy("_k").orderBy(F.desc("_o"))
    plain = rows.join(big, "_k", "left_anti").withColumns({name: F.sum(c).over(whole) for name, c in sums.items()})
    return plain.select(*df.columns, *sums).unionByName(run.select(*df.columns, *sums))


def places(df: DataFrame, keys: Sequence[str], digest: Column, tie: str, place: str = "_place", total: str = "_total") -> DataFrame:
    """``df`` with its rows' places from 1 within each key in the order of a hexadecimal ``digest`` and ``tie``, and the key's number of
    rows. Places are counted by the digest's first three digits, so that a task orders 1/4096 of a key."""
    keys = list(keys)
    rows = df.withColumns({"_h": digest, "_k": F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))}).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy("_k", "_b").agg(F.count("*").alias("_m"))
    upto = Window.partitionBy("_k").orderBy("_b")  # 4,096 rows a key
    before = sizes.select("_k", "_b", (F.sum("_m").over(upto) - F.col("_m")).alias("_before"), F.sum("_m").over(Window.partitionBy("_k")).alias(total))
    within = Window.partitionBy("_k", "_b").orderBy("_h", tie)
    return rows.join(before, ["_k", "_b"]).withColumn(place, F.col("_before") + F.row_number().over(within)).drop("_h", "_k", "_b", "_before")
