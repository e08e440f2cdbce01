"""Linear probes on vector features: all targets, seeds and strengths in one fit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.vectors import layer_norm
from basalt.operators import metrics, splits
from basalt.operators.gradients import SPLITS, LinearSweep, Task
from basalt.sources.tables import scratch

GRID = (0.001, 0.01, 0.1)
#: Splits and the columns of a result row that hold their sizes.
SIZES = {"train": "n_train", "validation": "n_val", "test": "n_test"}


def features(df: DataFrame, vector: str, name: str = "x") -> DataFrame:
    """The layer-normalised vector."""
    return df.withColumn(name, layer_norm(F.col(vector).cast("array<double>")))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table that every pass reads; a lost executor loses nothing."""
    path = scratch(df.sparkSession, "probe")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def balance(share: float | None) -> list[float]:
    """Weights that give both classes half of the loss; ``share``: the part of class 1."""
    share = min(max(share or 0.5, 1e-6), 1 - 1e-6)
    return [0.5 / (1 - share), 0.5 / share]


def split_code() -> Column:
    code = F.lit(None).cast("int")
    for name, n in SPLITS.items():
        code = F.when(F.col("split") == name, n).otherwise(code)
    return code


def best_models(sweep: LinearSweep, rated: DataFrame, value: str) -> list[int]:
    """For each task the model that ``rated`` (model, ``value``) puts highest; of equal ones, and where none has a value, the first."""
    found = {r["model"]: r[value] for r in rated.select("model", value).collect()}  # a row a model
    worst = float("-inf")
    rank = lambda m: worst if found.get(m) is None else found[m]
    return [max((m for m, (t, _) in enumerate(sweep.models) if t == task), key=lambda m: (rank(m), -m)) for task in range(len(sweep.tasks))]


def reason(sizes: dict[str, int], classes: int, least: int = 2) -> str | None:
    """Why a probe cannot be fitted: ``no_data``, ``empty_split``, ``one_class``; None where it can. ``classes``: those of the train split."""
    if not sum(sizes.values()):
        return "no_data"
    if not all(sizes.values()):
        return "empty_split"
    return "one_class" if classes < least else None


def examine(rows: DataFrame, label: str, classes: int = 2) -> tuple[dict[str, int], str | None]:
    """The size of each split of one target, and ``reason``."""
    per = {r["split"]: r for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(label).alias("classes")).collect()}  # three rows
    sizes = {column: per[split]["n"] if split in per else 0 for split, column in SIZES.items()}
    return sizes, reason(sizes, per["train"]["classes"] if "train" in per else 0, classes)


def sweep(genomes: DataFrame, classes: DataFrame, targets: Sequence[str], key: str, vector: str, group: str, seeds: Sequence[int], names: Sequence[str], measure: Callable[[DataFrame, list[str]], DataFrame],
          primary: str, numbers: bool = False, reasons: dict[str, str] | None = None) -> DataFrame:
    """A result row for each target and seed: the metrics ``names`` of the test split, sizes of the splits, ``skipped``.

    ``classes``: key, target, class. ``measure(scored, keys)`` gives the metrics by ``keys``; the strength with the highest ``primary`` on validation
    rows counts. Rows without vector or group are left out. The number of jobs does not follow the targets; what comes to
    the driver is a few rows and a model for each target and seed.
    """
    spark = genomes.sparkSession
    rows = features(genomes.dropna(subset=[vector, group]), vector).select(key, group, "x")
    labels = classes.filter(F.col("target").isin(list(targets))).join(rows.select(key, group), key).select(key, group, "target", F.col("class").cast("double").alias("class"))
    parts = written(splits.split_sweep(labels, key, group, "class", seeds))
    per = parts.groupBy("target", "seed", "split").agg(F.count("*").alias("n"), F.count_distinct("class").alias("classes"), F.max("class").alias("most"), F.avg("class").alias("centre"), F.coalesce(F.stddev_pop("class"), F.lit(0.0)).alias("scale"))
    found = {(r["target"], r["seed"], r["split"]): r for r in per.collect()}
    told, tasks = [], []
    for target in targets:
        for seed in seeds:
            own = {s: found.get((target, seed, s)) for s in SIZES}
            sizes = {SIZES[s]: r["n"] if r else 0 for s, r in own.items()}
            why = (reasons or {}).get(target) or reason(sizes, own["train"]["classes"] if own["train"] else 0, 1 if numbers else 2)
            told.append((target, seed, *sizes.values(), why))
            if why is None and numbers:
                tasks.append(Task(target, seed, 1, centre=own["train"]["centre"], scale=own["train"]["scale"] or 1.0))
            elif why is None:
                tasks.append(Task(target, seed, 1 + int(max(r["most"] for r in own.values()))))
    schema = ", ".join(["target string", "seed int", *(f"{n} long" for n in SIZES.values()), "skipped string"])
    results = spark.createDataFrame(told, schema)
    if not tasks:
        return results.select(*(F.lit(None).cast("double").alias(n) for n in names), *SIZES.values(), "skipped", "target", "seed")
    numbered = F.broadcast(spark.createDataFrame([(t.target, t.seed, i) for i, t in enumerate(tasks)], "target string, seed int, task int"))  # a row a task
    one = F.struct("task", F.col("class").alias("y"), split_code().alias("split"))
    table = written(parts.join(numbered, ["target", "seed"]).groupBy(key).agg(F.collect_list(one).alias("labels")).join(rows.select(key, "x"), key))
    fitted = LinearSweep(tasks, GRID).fit(table)
    rated = measure(fitted.scored(table).filter(F.col("split") == SPLITS["validation"]), ["model"])
    test = fitted.scored(table, chosen=best_models(fitted, rated, primary)).filter(F.col("split") == SPLITS["test"])
    got = measure(test, ["target", "seed"]).select("target", "seed", *(F.col(n).cast("double").alias(n) for n in names))
    return results.join(got, ["target", "seed"], "left").select(*names, *SIZES.values(), "skipped", "target", "seed")


def rollup(results: DataFrame, primary: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each metric over targets and seeds, by ``keys``; rows that were skipped or lack the primary metric are left out."""
    kept = results.filter(F.col(primary).isNotNull())
    kept = kept.filter("skipped is null") if "skipped" in results.columns else kept
    return kept.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n"))


def group_rollup(results: DataFrame, groups: DataFrame, primary: str, columns: Sequence[str]) -> DataFrame:
    """The roll-up for each group of ``groups`` (group, phenotype); targets without a group are left out."""
    return rollup(results.join(groups.withColumnRenamed("phenotype", "target"), "target"), primary, columns, ["group"])
