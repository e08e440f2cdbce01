"""The benchmark's task queries, each a composition of operators over gene, operon, edge or genome tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions import vectors as vec
from basalt.functions.vectors import cosine, mean_pairwise_cosine
from basalt.operators import community, gradients, intervals, knn, metrics, nested, probes, splits


def ppi_zero_shot(genes: DataFrame, edges: DataFrame, genome: str, threshold: float = 0.6, most_pairs: int | None = None, most_proteins: int | None = None) -> DataFrame:
    """Per genome: how well the cosine of two proteins ranks their interaction."""
    picked = intervals.sample_edges(edges, genome, most_pairs) if most_pairs else edges
    if most_proteins:
        picked = picked.filter((F.col("i") < most_proteins) & (F.col("j") < most_proteins))
    side = lambda i, v: genes.select(genome, F.col("gene_idx").alias(i), F.col("v").alias(v))
    labelled = intervals.edge_labels(picked, F.col("score"), threshold)
    scored = labelled.join(side("i", "x"), [genome, "i"]).join(side("j", "y"), [genome, "j"]).withColumn("s", cosine(F.col("x"), F.col("y")))
    proteins = genes.groupBy(genome).agg(F.count("*").alias("n_proteins"))
    found = metrics.ranking(scored, [genome], "label", "s").withColumnsRenamed({"n": "n_ppi_pairs", "n_pos": "n_pos_triples"})
    return found.join(proteins, genome)


def operon_adjacency(genes: DataFrame, operons: DataFrame, contig: Sequence[str]) -> DataFrame:
    """Per contig: how well the similarity of neighbours ranks being in one operon."""
    scored = intervals.adjacency_scores(genes, contig, "gene_idx", "v", "strand")
    labelled = intervals.adjacency_labels(scored, operons, contig, "gene_idx", "members")
    return metrics.ranking(labelled, contig, "label", "score")


def prefix_sums(genes: DataFrame, contig: Sequence[str]) -> DataFrame:
    """Per gene the sums of unit vectors and of their squared lengths up to it: (contig, gene_idx, total, squares)."""
    rows = genes.select(*contig, F.col("gene_idx").cast("long").alias("gene_idx"), F.col("v").cast("array<double>").alias("v"))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in contig) + ", gene_idx long, total array<double>, squares double"

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        """One contig: a matrix of its genes."""
        pdf = pdf.sort_values("gene_idx")
        v = np.stack(pdf["v"].to_numpy())
        size = np.sqrt((v * v).sum(1, keepdims=True))
        u = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        out = pdf[[*contig, "gene_idx"]].copy()
        out["total"] = list(np.cumsum(u, 0))
        out["squares"] = np.cumsum((u * u).sum(1))
        return out

    return rows.groupBy(*contig).applyInPandas(sums, schema)


def window_similarity(windows: DataFrame, sums: DataFrame, contig: Sequence[str]) -> DataFrame:
    """``similarity``: mean pairwise cosine of the genes [start, start + size), from two prefix sums a window."""
    end = sums.select(*contig, F.col("gene_idx").alias("_last"), F.col("total").alias("_t1"), F.col("squares").alias("_q1"))
    begin = sums.select(*contig, (F.col("gene_idx") + 1).alias("start"), F.col("total").alias("_t0"), F.col("squares").alias("_q0"))
    both = windows.withColumn("_last", F.col("start") + F.col("size") - 1).join(end, [*contig, "_last"]).join(begin, [*contig, "start"], "left")
    total = F.when(F.col("_t0").isNull(), F.col("_t1")).otherwise(F.zip_with("_t1", "_t0", lambda a, b: a - b))
    value = mean_pairwise_cosine(total, F.col("_q1") - F.coalesce("_q0", F.lit(0.0)), F.col("size"))
    return both.withColumn("similarity", value).drop("_last", "_t0", "_t1", "_q0", "_q1")


def operon_windows(genes: DataFrame, operons: DataFrame, contig: Sequence[str], n: int = 10, seeds: Sequence[int] = intervals.SEEDS) -> DataFrame:
    """Per operon of two or more genes and seed: its similarity against that of ``n`` random windows of its size."""
    counts = genes.groupBy(*contig).agg(F.count("*").alias("n_genes"))
    sized = operons.withColumn("size", F.size("members").cast("long")).filter(F.col("size") >= 2).join(counts, list(contig))
    key = [*contig, "operon"]
    drawn = intervals.sample_windows(sized.select(*key, "size", "n_genes"), key, "size", "n_genes", n, seeds).select(*key, "size", "seed", F.col("start").cast("long").alias("start"), F.lit(0).alias("positive"))
    own = sized.filter(F.col("n_genes") - F.col("size") >= n).select(*key, "size", F.explode(F.array(*(F.lit(s) for s in seeds))).alias("seed"), F.array_min("members").cast("long").alias("start"), F.lit(1).alias("positive"))
    rated = window_similarity(drawn.unionByName(own), prefix_sums(genes, contig), contig).withColumn("similarity", F.round("similarity", 9))
    return metrics.one_against(rated, [*key, "size", "seed"], "positive", "similarity")


def essential_predictions(genes: DataFrame, genome: str, vector: str, label: str, seeds: Sequence[int] = (1,)) -> DataFrame:
    """Every gene (with ``split``) once for each seed, with ``class``, the ``score`` of a linear probe and ``predicted``; of the
    regularisations the one with the best median auroc over validation genomes counts. Classes are weighed alike."""
    rows = probes.features(genes.withColumn("class", F.col(label).cast("int")).filter(F.col("class").isNotNull() & F.col(vector).isNotNull()), vector)
    labels = F.array(*(F.struct(F.lit(i).alias("task"), F.col("class").cast("double").alias("y"), probes.split_code().alias("split")) for i in range(len(seeds))))
    table = probes.written(rows.withColumn("labels", labels).withColumnRenamed("class", "_class"))
    share = table.filter("split = 'train'").agg(F.avg("_class")).first()[0]
    fitted = gradients.LinearSweep([gradients.Task("essential", s, 2, probes.balance(share)) for s in seeds], probes.GRID, dropout=0.2).fit(table)
    validation = fitted.scored(table, [genome]).filter(F.col("split") == gradients.SPLITS["validation"]).withColumn("s", F.get("probabilities", F.lit(1)))
    rated = metrics.medians(metrics.ranking(validation, ["model", genome], "class", "s"), ["model"], ["auroc"], lower=True)
    keep = [c for c in table.columns if c not in ("x", "labels", "split", "_class", "seed", "target")]
    names = {n: name for name, n in gradients.SPLITS.items()}
    split = F.lit(None).cast("string")
    for n, name in names.items():
        split = F.when(F.col("split") == n, name).otherwise(split)
    scored = fitted.scored(table, keep, probes.best_models(fitted, rated, "auroc"))
    told = scored.withColumns({"split": split, "class": F.col("class").cast("int"), "score": F.get("probabilities", F.lit(1))})
    return told.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("probabilities", "model", "target")


def essential_genes(predictions: DataFrame, genome: str) -> DataFrame:
    """Per split and seed the lower medians over genomes of auroc, auprc and f1, and the number of genomes that have them."""
    keys = ["split", "seed", genome]
    per = metrics.ranking(predictions, keys, "class", "score").join(metrics.confusion(predictions, keys, "class", "score"), keys)
    sizes = per.groupBy("split", "seed").agg(F.count("auroc").alias("n_genomes"))
    return metrics.medians(per, ["split", "seed"], ["auroc", "auprc", "f1"], lower=True).join(sizes, ["split", "seed"])


def ppi_pairs(genes: DataFrame, edges: DataFrame, genome: str, threshold: float = 0.6, seed: int = 1) -> DataFrame:
    """Labelled pairs of proteins with both vectors and a split by whole genomes: no protein stands on two sides."""
    side = lambda i, v: probes.features(genes, "v", v).select(genome, F.col("gene_idx").alias(i), v)
    labelled = intervals.edge_labels(edges, F.col("score"), threshold).withColumnRenamed("label", "class")
    return splits.group_split(labelled.join(side("i", "x"), [genome, "i"]).join(side("j", "y"), [genome, "j"]), genome, seed)


def ppi_supervised(pairs: DataFrame, genome: str, hidden: int = 32, seed: int = 1) -> DataFrame:
    """Per genome of the test split: ranking of interactions and log loss by a net with a dense block before the pairs' mean.
    ``pairs``: x, y, class, split."""
    table = probes.written(pairs)
    scored = gradients.PairNet(hidden, seed).fit(table).scored(table.filter("split = 'test'"))
    logit = F.log(F.greatest("p", F.lit(1e-12)) / F.greatest(1 - F.col("p"), F.lit(1e-12)))
    loss = scored.groupBy(genome).agg(F.avg(metrics.log_loss(F.col("class"), logit)).alias("loss"))
    return metrics.ranking(scored, [genome], "class", "p").join(loss, genome)


def strain_clustering(vectors: DataFrame, key: str, vector: str, levels: Sequence[str], ks: Sequence[int] = (5, 10, 15), resolutions: Sequence[float] = (0.1, 0.25, 0.5, 1.0)) -> DataFrame:
    """ari, nmi and asw for each number of neighbours, resolution and level. All settings are clustered together, and one
    clustering serves all levels."""
    spark = vectors.sparkSession
    neighbours = probes.written(knn.nearest(vectors, key, vector, max(ks)))
    settings = [(n, k, float(r)) for n, (k, r) in enumerate((k, r) for k in ks for r in resolutions)]
    told = spark.createDataFrame(settings, "setting int, k_neighbors int, resolution double")
    graphs = None
    for k in ks:
        own = F.array(*(F.struct(F.lit(n).alias("setting"), F.lit(r).alias("resolution")) for n, kk, r in settings if kk == k))
        part = community.fuzzy_weights(neighbours.filter(F.col("rank") <= k), k).select(F.inline(own), "i", "j", "w")
        graphs = part if graphs is None else graphs.unionByName(part)
    found = community.communities_of(graphs)
    rows = probes.written(vectors.join(found.withColumnRenamed("node", key), key).select(key, "setting", "community", *levels))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("setting", "community"))), lambda s: s["community"].cast("string"))
    clustered = vectors.select(key, vector).join(found.groupBy(F.col("node").alias(key)).agg(labels.alias("clusters")), key)
    width = metrics.mean_silhouette(knn.cluster_nearness(clustered, key, vector, "clusters"), ["setting"])
    out = None
    for level in levels:
        part = metrics.clustering(rows, ["setting"], level, "community").withColumn("taxa_level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out.join(width, "setting").join(told, "setting").select("ari", "nmi", "asw", "k_neighbors", "resolution", "taxa_level")


TRAIT_METRICS = ("macro_auroc", "macro_auprc", "macro_f1", "macro_recall", "accuracy")
DRUG_METRICS = ("auroc", "auprc", "f1", "balanced_accuracy", "accuracy")
MIC_METRICS = ("r2", "pearson", "mse")


def _macro(scored: DataFrame, keys: list[str]) -> DataFrame:
    whole = scored.withColumns({"class": F.col("class").cast("int"), "prediction": vec.argmax(F.col("probabilities")).cast("int")})
    return metrics.macro_ranking(whole, keys, "class", "probabilities").join(metrics.multiclass(whole, keys, "class", "prediction"), keys)


def _binary(scored: DataFrame, keys: list[str]) -> DataFrame:
    p = scored.withColumn("p", F.get("probabilities", F.lit(1)))
    return metrics.ranking(p, keys, "class", "p").join(metrics.confusion(p, keys, "class", "p"), keys)


def _number(scored: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.regression(scored.withColumn("prediction", F.get("probabilities", F.lit(0))), keys, "class", "prediction")


def trait_probes(genomes: DataFrame, wide: DataFrame, targets: Sequence[str], key: str, vector: str, group: str, seeds: Sequence[int] = (1, 2, 3), least: int = 50, most_targets: int | None = None) -> DataFrame:
    """Per trait and seed: macro metrics of the test split, sizes of the splits, ``skipped``. Every genome must have one row of
    labels; rows of rare classes are dropped, and traits that then lack two classes are left out."""
    long = splits.drop_rare_classes(splits.to_long(nested.inner_checked(genomes.select(key), wide, key), [key], targets), least)
    usable = splits.first_targets(splits.usable_targets(long, 0, least), most_targets)
    classes = splits.trait_classes(long.filter(F.col("target").isin(usable)))
    return probes.sweep(genomes, classes, usable, key, vector, group, seeds, TRAIT_METRICS, _macro, "macro_auroc")


def resistance_probes(genomes: DataFrame, long: DataFrame, key: str, vector: str, group: str, seeds: Sequence[int] = (1, 2, 3), least_rows: int = 500, least_class: int = 50, most_targets: int | None = None) -> DataFrame:
    """Per drug and seed: metrics of a binary probe, sizes of the splits, ``skipped`` (``not_binary`` for a drug of more than two classes)."""
    usable = splits.first_targets(splits.usable_targets(long, least_rows, least_class), most_targets)
    many = long.groupBy("target").agg(F.count_distinct("value").alias("n")).filter("n > 2")
    reasons = dict.fromkeys(splits.first_targets(many), "not_binary")
    classes = splits.encode_classes(long.filter(F.col("target").isin(usable)))
    return probes.sweep(genomes, classes, usable, key, vector, group, seeds, DRUG_METRICS, _binary, "auroc", reasons=reasons)


def mic_probes(genomes: DataFrame, long: DataFrame, key: str, vector: str, group: str, seeds: Sequence[int] = (1, 2, 3), least_rows: int = 500, most_targets: int | None = None) -> DataFrame:
    """Per drug and seed: r2, pearson and mse of a regression probe on the test split, sizes of the splits, ``skipped``."""
    usable = splits.first_targets(splits.usable_regression_targets(long, least_rows), most_targets)
    values = long.filter(F.col("target").isin(usable)).select(key, "target", F.col("value").cast("double").alias("class"))
    return probes.sweep(genomes, values, usable, key, vector, group, seeds, MIC_METRICS, _number, "r2", numbers=True)
