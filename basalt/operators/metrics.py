"""Exact metrics as grouped queries. Equal scores are summed first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.running import running_sums


#: A label that marks a row as outside the evaluation.
IGNORED = -100


def ranking(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """auroc (ties count half), auprc (average precision over distinct thresholds), n, n_pos per key; null metrics for one class.
    Scores are compared as doubles; a row without one ranks last. A key may hold any number of scores (see ``running``)."""
    y = F.col(label).cast("long")
    cells = df.filter(y.isNotNull() & (y != IGNORED)).groupBy(*keys, F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("_s")).agg(F.sum(y).alias("_tp"), F.sum(1 - y).alias("_fp"))
    run = running_sums(cells, keys, "_s", {"_ctp": "_tp", "_cfp": "_fp"})
    p, n = F.sum("_tp"), F.sum("_fp")
    area = F.sum(F.col("_fp") * (F.col("_ctp") - F.col("_tp") / 2.0))
    precision = F.sum(F.col("_tp") * F.col("_ctp") / (F.col("_ctp") + F.col("_cfp")))
    both = (p > 0) & (n > 0)
    return run.groupBy(*keys).agg(F.when(both, area / (p * n)).alias("auroc"), F.when(both, precision / p).alias("auprc"), (p + n).alias("n"), p.alias("n_pos"))


def confusion(df: DataFrame, keys: Sequence[str], label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """f1, balanced_accuracy and accuracy at ``score >= threshold``; null where a key has one class."""
    df = df.filter(F.col(label).isNotNull() & (F.col(label) != IGNORED))
    y, p = F.col(label) == 1, F.col(score) >= threshold
    c = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"))
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))
    balanced = (F.try_divide("tp", F.col("tp") + F.col("fn")) + F.try_divide("tn", F.col("tn") + F.col("fp"))) / 2
    accuracy = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return c.select(*keys, F.when(both, f1).alias("f1"), F.when(both, balanced).alias("balanced_accuracy"), F.when(both, accuracy).alias("accuracy"))


def regression(df: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """r2 and pearson per key (null for a constant truth, pearson also for a constant guess), mse and n."""
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    r2 = 1 - F.try_divide(F.sum((y - p) * (y - p)), F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0)))
    # not F.corr: it divides by zero for a constant side
    pearson = F.try_divide(F.covar_pop(y, p), F.sqrt(F.var_pop(y)) * F.sqrt(F.var_pop(p)))
    return df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(*keys).agg(r2.alias("r2"), pearson.alias("pearson"), F.avg((y - p) * (y - p)).alias("mse"), F.count("*").alias("n"))


def multiclass(df: DataFrame, keys: Sequence[str], label: str, guess: str) -> DataFrame:
    """macro_f1 over the classes of truth or guess, macro_recall over those of the truth, accuracy."""
    cells = df.groupBy(*keys, F.col(label).alias("_y"), F.col(guess).alias("_p")).count()
    one = cells.select(*keys, F.explode(F.array(F.struct(F.col("_y").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(F.col("_p").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("g")))).alias("_x"), (F.col("_y") == F.col("_p")).cast("int").alias("_hit"), "count")
    per = one.groupBy(*keys, F.col("_x.c").alias("_c")).agg(F.sum(F.col("count") * F.col("_x.t")).alias("_t"), F.sum(F.col("count") * F.col("_x.g")).alias("_g"), F.sum(F.col("count") * F.col("_hit") * F.col("_x.t")).alias("_tp"))
    f1 = 2.0 * F.col("_tp") / (F.col("_t") + F.col("_g"))
    return per.groupBy(*keys).agg(F.avg(f1).alias("macro_f1"), F.avg(F.when(F.col("_t") > 0, F.col("_tp") / F.col("_t"))).alias("macro_recall"), (F.sum("_tp") / F.sum("_t")).alias("accuracy"))


def macro_ranking(df: DataFrame, keys: Sequence[str], label: str, probabilities: str) -> DataFrame:
    """macro_auroc and macro_auprc: two classes by the score of class 1, else one class against the rest, averaged over present classes."""
    long = df.select(*keys, F.col(label).alias("_y"), F.size(probabilities).alias("_n"), F.posexplode(probabilities).alias("_c", "_s"))
    long = long.filter((F.col("_n") > 2) | (F.col("_c") == 1)).withColumn("_is", (F.col("_y") == F.col("_c")).cast("int"))
    per = ranking(long, [*keys, "_c"], "_is", "_s")
    return per.groupBy(*keys).agg(F.avg("auroc").alias("macro_auroc"), F.avg("auprc").alias("macro_auprc"))


def medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lower: bool = False) -> DataFrame:
    """Medians: interpolated, or with ``lower`` the lower of the two middle values."""
    form = "percentile_disc(0.5) within group (order by {0})" if lower else "percentile({0}, 0.5)"
    return df.groupBy(*keys).agg(*(F.expr(form.format(c)).alias(c) for c in columns))


def clustering(df: DataFrame, keys: Sequence[str], label: str, cluster: str) -> DataFrame:
    """ari and nmi (arithmetic mean of the entropies) from the contingency table."""
    pairs = lambda n: n * (n - 1) / 2.0
    cells = df.groupBy(*keys, F.col(label).alias("_l"), F.col(cluster).alias("_c")).agg(F.count("*").alias("_n"))
    entropy = lambda n, total: -F.sum(n / total * F.log(n / total))
    total = cells.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.sum(pairs(F.col("_n"))).alias("_both"))

    def side(c: str, p: str, h: str) -> DataFrame:
        sums = cells.groupBy(*keys, c).agg(F.sum("_n").alias("_m"))
        joined = sums.join(total, list(keys)) if keys else sums.crossJoin(total)  # one row of totals
        return joined.groupBy(*keys).agg(F.sum(pairs(F.col("_m"))).alias(p), entropy(F.col("_m"), F.col("_total")).alias(h))

    a, b = side("_l", "_pl", "_hl"), side("_c", "_pc", "_hc")
    joint = (cells.join(total, list(keys)) if keys else cells.crossJoin(total)).groupBy(*keys).agg(entropy(F.col("_n"), F.col("_total")).alias("_hj"))
    every = total
    for x in (a, b, joint):
        every = every.join(x, list(keys)) if keys else every.crossJoin(x)
    expected = F.col("_pl") * F.col("_pc") / pairs(F.col("_total"))
    top = (F.col("_pl") + F.col("_pc")) / 2
    ari = F.when(top == expected, 1.0).otherwise((F.col("_both") - expected) / (top - expected))
    half = (F.col("_hl") + F.col("_hc")) / 2
    nmi = F.when(half == 0, 1.0).otherwise((F.col("_hl") + F.col("_hc") - F.col("_hj")) / half)
    return every.select(*keys, ari.alias("ari"), nmi.alias("nmi"))


def silhouette(distances: DataFrame, sizes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean silhouette ``asw`` by ``keys``. ``distances``: (keys, i, ci, cj, total) sums of i's distances to each cluster; ``sizes``: (keys, c, n)."""
    d = distances.join(sizes.select(*keys, F.col("c").alias("cj"), F.col("n").alias("nj")), [*keys, "cj"])
    own = F.max(F.when(F.col("ci") == F.col("cj"), F.when(F.col("nj") > 1, F.col("total") / (F.col("nj") - 1))))
    other = F.min(F.when(F.col("ci") != F.col("cj"), F.col("total") / F.col("nj")))
    return mean_silhouette(d.groupBy(*keys, "i").agg(own.alias("a"), other.alias("b")), keys)


def mean_silhouette(per: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``asw`` by ``keys`` of (keys, i, a, b): the mean distance to the own cluster, and to the nearest other one."""
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.groupBy(*keys).agg(F.avg(value).alias("asw"))


def log_loss(label: Column, logit: Column, weight: float = 1.0) -> Column:
    """Binary cross-entropy of a logit, stable for large ones; ``weight`` is the positive class's."""
    return (1 - label) * logit + (1 + (weight - 1) * label) * (F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0)))


def cross_entropy(label: Column, logits: Column) -> Column:
    """Negative log of the softmax of class ``label`` (from 0), stable for large logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return top + F.log(total) - F.get(logits, label)


def one_against(df: DataFrame, keys: Sequence[str], positive: str, score: str) -> DataFrame:
    """Retrieval of one positive among negatives, in closed form: auroc and auprc."""
    best = df.filter(F.col(positive) == 1).groupBy(*keys).agg(F.max(score).alias("_p"))
    n = F.count("*")
    low, tie = F.count_if(F.col(score) < F.col("_p")), F.count_if(F.col(score) == F.col("_p"))
    rest = df.filter(F.col(positive) == 0).join(best, list(keys)).groupBy(*keys)
    return rest.agg(((low + tie / 2.0) / n).alias("auroc"), (1.0 / (1 + n - low)).alias("auprc"))
