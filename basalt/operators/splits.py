"""Targets and splits, deterministic: all draws are ranks of md5 values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators.running import places

# Words that name a trait's negative and positive class.
NEGATIVE = ("no", "0", "-", "false", "negative", "neg", "n")
POSITIVE = ("yes", "1", "+", "true", "positive", "pos", "y")


def to_long(wide: DataFrame, key: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Wide label table to (key, target, value) without nulls."""
    text = wide.select(*key, *(F.col(t).cast("string").alias(t) for t in targets))
    return text.unpivot(list(key), list(targets), "target", "value").filter("value is not null")


def usable_targets(long: DataFrame, least_rows: int = 500, least_class: int = 50) -> DataFrame:
    """Targets with enough rows and two classes large enough: target, rows, classes."""
    per = long.groupBy("target", "value").count()
    return per.groupBy("target").agg(F.sum("count").alias("rows"), F.count_if(F.col("count") >= least_class).alias("classes")).filter((F.col("rows") >= least_rows) & (F.col("classes") >= 2))


def usable_regression_targets(long: DataFrame, least_rows: int = 500) -> DataFrame:
    per = long.groupBy("target").agg(F.count("*").alias("rows"), F.count_distinct("value").alias("values"))
    return per.filter((F.col("rows") >= least_rows) & (F.col("values") > 1))


def drop_rare_classes(long: DataFrame, least: int) -> DataFrame:
    kept = long.groupBy("target", "value").count().filter(F.col("count") >= least).drop("count")
    return long.join(kept, ["target", "value"])


def encode_classes(long: DataFrame) -> DataFrame:
    """``class``: classes of a target numbered in the order of their text."""
    classes = long.select("target", "value").distinct()
    return long.join(classes.withColumn("class", F.row_number().over(Window.partitionBy("target").orderBy("value")) - 1), ["target", "value"])


def binary_classes(long: DataFrame) -> DataFrame:
    """``class`` of two-valued targets: in the order of their text, turned round where only that puts a known positive word at 1 or a known negative one at 0."""
    sides = long.groupBy("target").agg(F.min("value").alias("_a"), F.max("value").alias("_b"), F.count_distinct("value").alias("_n")).filter("_n = 2")
    a, b = F.lower("_a"), F.lower("_b")
    fits = a.isin(*NEGATIVE) | b.isin(*POSITIVE)
    turned = ~fits & (a.isin(*POSITIVE) | b.isin(*NEGATIVE))
    sides = sides.select("target", F.when(turned, F.col("_a")).otherwise(F.col("_b")).alias("_one"))
    return long.join(sides, "target").withColumn("class", (F.col("value") == F.col("_one")).cast("int")).drop("_one")


def trait_classes(long: DataFrame) -> DataFrame:
    """``class``: known words decide the order of two values, text the order of more; targets of one value are class 0."""
    two = binary_classes(long)
    rest = long.join(two.select("target").distinct(), "target", "left_anti")
    columns = [*long.columns, "class"]
    return two.select(columns).unionByName(encode_classes(rest).select(columns))


def first_targets(targets: DataFrame, most: int | None = None) -> list[str]:
    """Names in their order, at most ``most``; a row a target, so they fit the driver."""
    ordered = targets.select("target").orderBy("target")
    return [r["target"] for r in (ordered.limit(most) if most is not None else ordered).collect()]


def _cut(place: Column, total: Column, train: float, val: float) -> Column:
    first = F.floor(total * train + 1e-9)
    second = first + F.floor((total - first) * (val / (1 - train)) + 1e-9)
    return F.when(place <= first, "train").when(place <= second, "validation").otherwise("test")


def _checked(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError("the parts of a split must sum to 1")


def group_split(df: DataFrame, group: str, seed: int, train: float = 0.7, val: float = 0.1, test: float = 0.2) -> DataFrame:
    """``split`` by whole groups; the parts are shares of the groups."""
    _checked(train, val, test)
    groups = places(df.select(group).distinct(), [], F.md5(F.concat_ws(":", F.lit(seed), F.col(group))), group)
    return df.join(groups.select(group, _cut(F.col("_place"), F.col("_total"), train, val).alias("split")), group)


def stratified_split(df: DataFrame, key: str, label: str, seed: int, train: float = 0.7, val: float = 0.1, test: float = 0.2) -> DataFrame:
    """``split`` with equal parts of each class, whatever its size; rows without a class are one too."""
    _checked(train, val, test)
    placed = places(df, [label], F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key)
    return placed.withColumn("split", _cut(F.col("_place"), F.col("_total"), train, val)).drop("_place", "_total")


def plain_split(df: DataFrame, key: str, seed: int, train: float = 0.7, val: float = 0.1, test: float = 0.2) -> DataFrame:
    """``split`` row by row by the first 52 bits of an md5: no row is ranked against others, so nothing is shuffled."""
    _checked(train, val, test)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "validation").otherwise("test"))


def split_sweep(long: DataFrame, key: str, group: str, label: str, seeds: Sequence[int], train: float = 0.7, val: float = 0.1, test: float = 0.2) -> DataFrame:
    """``long`` (with target) once for each seed, with ``seed`` and ``split``; all targets and seeds in one query. A target is split by
    group where it has three groups or more, else by class where each has three rows or more, else plainly."""
    _checked(train, val, test)
    smallest = long.groupBy("target", label).count().groupBy("target").agg(F.min("count").alias("_least"))
    rules = long.groupBy("target").agg(F.count_distinct(group).alias("_groups")).join(smallest, "target")
    rule = F.when(F.col("_groups") >= 3, "group").when(F.col("_least") >= 3, "class").otherwise("plain")
    rows = long.join(rules.select("target", rule.alias("_rule")), "target").withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))
    digest = lambda c: F.md5(F.concat_ws(":", F.col("seed"), F.col(c)))
    cut = _cut(F.col("_place"), F.col("_total"), train, val).alias("split")
    columns = [*long.columns, "seed", "split"]
    by_group = rows.filter("_rule = 'group'")
    groups = places(by_group.select("target", "seed", group).distinct(), ["target", "seed"], digest(group), group).select("target", "seed", group, cut)
    by_class = places(rows.filter("_rule = 'class'"), ["target", "seed", label], digest(key), key).withColumn("split", cut)
    u = F.conv(F.substring(digest(key), 1, 13), 16, 10).cast("double") / float(1 << 52)
    plain = rows.filter("_rule = 'plain'").withColumn("split", F.when(u < train, "train").when(u < train + val, "validation").otherwise("test"))
    return by_group.join(groups, ["target", "seed", group]).select(columns).unionByName(by_class.select(columns)).unionByName(plain.select(columns))


def split_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "validation", "test")))
