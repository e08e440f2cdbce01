"""Genes along contigs: neighbours, gaps, windows, layouts. Positions 1-based inclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.sequence import slice_dna
from basalt.functions.vectors import cosine

SEEDS = (1, 12, 123, 1234, 12345)


def adjacency_scores(genes: DataFrame, contig: Sequence[str], index: str, vector: str, strand: str) -> DataFrame:
    """Per gene but the last of a contig: cosine to the next mapped to [0, 1], 0 where the strands differ."""
    order = Window.partitionBy(*contig).orderBy(index)
    following = genes.withColumn("_v", F.lead(vector).over(order)).withColumn("_s", F.lead(strand).over(order)).filter("_v is not null")
    score = F.when(F.col(strand) == F.col("_s"), (cosine(F.col(vector), F.col("_v")) + 1) / 2).otherwise(0.0)
    return following.withColumn("score", score).drop("_v", "_s")


def gene_gaps(genes: DataFrame, contig: Sequence[str], index: str) -> DataFrame:
    """``gap``: the next gene's start less this gene's end; negative where they overlap, null for the last."""
    return genes.withColumn("gap", F.lead("start").over(Window.partitionBy(*contig).orderBy(index)) - F.col("end"))


def adjacency_labels(genes: DataFrame, operons: DataFrame, contig: Sequence[str], index: str, members: str) -> DataFrame:
    """``label`` 1 for each gene from the first to the last but one of an operon, holes included; else 0."""
    low, high = F.array_min(members), F.array_max(members)
    inside = operons.filter(high > low).select(*contig, F.explode(F.sequence(low.cast("long"), high.cast("long") - 1)).alias(index)).distinct().withColumn("label", F.lit(1))
    return genes.drop("label").join(inside, [*contig, index], "left").fillna(0, ["label"])


def intergenic(genes: DataFrame, contigs: DataFrame, contig: str = "contig_name") -> DataFrame:
    """Gaps between genes (by the largest end so far, so nested genes make none) and before the first and after the last: contig, start, end."""
    order = Window.partitionBy(contig).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = genes.select(contig, F.coalesce(F.max("end").over(order), F.lit(0)).alias("last"), "start").select(contig, (F.col("last") + 1).alias("start"), (F.col("start") - 1).alias("end"))
    ends = genes.groupBy(contig).agg(F.max("end").alias("last"))
    tail = contigs.join(ends, contig, "left").select(contig, (F.coalesce("last", F.lit(0)) + 1).alias("start"), F.col("length").alias("end"))
    return before.unionByName(tail).filter("start <= end")


def interval_table(genes: DataFrame, contigs: DataFrame, contig: str = "contig_name") -> DataFrame:
    """CDS and gaps of every contig with their sequences; strand 0 for gaps."""
    cds = genes.select(contig, "start", "end", F.col("strand").cast("tinyint").alias("strand"), F.lit("cds").alias("sequence_type"))
    gaps = intergenic(genes, contigs, contig).select(contig, "start", "end", F.lit(0).cast("tinyint").alias("strand"), F.lit("intergenic").alias("sequence_type"))
    # spans are gathered per contig, so that a contig's text is read once and never copied to its genes
    spans = cds.unionByName(gaps).groupBy(contig).agg(F.array_sort(F.collect_list(F.struct("start", "end", "strand", "sequence_type"))).alias("spans"))
    rows = contigs.select(contig, "dna_sequence").join(spans, contig)
    cut = F.transform("spans", lambda s: F.struct(F.upper(slice_dna(F.col("dna_sequence"), s["start"], s["end"] - s["start"] + 1)).alias("sequence"), s["start"].alias("start"), s["end"].alias("end"), s["strand"].alias("strand"), s["sequence_type"].alias("sequence_type")))
    return rows.select(contig, F.inline(cut))


def elements(genes: DataFrame, contigs: DataFrame, contig: str = "contig_name") -> DataFrame:
    """Genes and the gaps between neighbours (by the previous gene's end alone), flanks included: contig, element_idx, kind, start, end, strand."""
    order = Window.partitionBy(contig).orderBy("start", "end")
    g = genes.withColumn("prev", F.coalesce(F.lag("end").over(order), F.lit(0)))
    gaps = g.select(contig, (F.col("prev") + 1).alias("start"), (F.col("start") - 1).alias("end"), F.lit("intergenic").alias("kind"), F.lit(0).alias("strand"))
    last = genes.groupBy(contig).agg(F.max_by("end", F.struct("start", "end")).alias("last")).join(contigs.select(contig, "length"), contig)
    tail = last.select(contig, (F.col("last") + 1).alias("start"), F.col("length").alias("end"), F.lit("intergenic").alias("kind"), F.lit(0).alias("strand"))
    both = g.select(contig, "start", "end", F.lit("cds").alias("kind"), F.col("strand").cast("int").alias("strand")).unionByName(gaps.unionByName(tail).filter("start <= end"))
    return both.withColumn("element_idx", F.row_number().over(Window.partitionBy(contig).orderBy("start", "end", "kind")) - 1)


def sample_windows(operons: DataFrame, key: Sequence[str], size: str, genes: str, n: int = 10, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """``n`` starts of windows of each operon's size per seed, in [0, genes - size), without replacement: one from each of ``n``
    equal parts of the range, placed by an md5 value. Only the starts that are drawn are ever made."""
    span = (F.col(genes) - F.col(size)).cast("long")
    drawn = operons.filter(span >= n).withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds)))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    low, high = F.floor(F.col("_i") * span / n), F.floor((F.col("_i") + 1) * span / n)
    value = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("seed"), *(F.col(k) for k in key), F.col("_i"))), 1, 8), 16, 10).cast("long")
    return drawn.withColumn("start", (low + value % (high - low)).cast("int")).drop("_i")


def token_layout(genes: DataFrame, genome: str, most: int, cls: int, sep: int, prot: int, end: int, max_contigs: int = 1000) -> DataFrame:
    """Tokens of a genome: CLS, per contig its proteins and SEP, cut to ``most`` - 1, then END: position, token, contig_type, gene_idx."""
    kind = lambda k: F.lit(k).alias("_k")
    body = genes.select(genome, F.col("contig_idx").cast("int").alias("contig_idx"), kind(1), F.col("gene_idx").cast("long").alias("gene_idx"), F.lit(prot).alias("token"))
    ends = genes.select(genome, F.col("contig_idx").cast("int").alias("contig_idx")).distinct().select(genome, "contig_idx", kind(2), F.lit(None).cast("long").alias("gene_idx"), F.lit(sep).alias("token"))
    first = genes.select(genome).distinct().select(genome, F.lit(-1).alias("contig_idx"), kind(0), F.lit(None).cast("long").alias("gene_idx"), F.lit(cls).alias("token"))
    every = first.unionByName(body).unionByName(ends)
    placed = every.withColumn("position", F.row_number().over(Window.partitionBy(genome).orderBy("contig_idx", "_k", "gene_idx")) - 1).filter(F.col("position") < most - 1)
    last = placed.groupBy(genome).agg((F.max("position") + 1).alias("position"), F.max("contig_idx").alias("contig_idx")).select(genome, "contig_idx", F.lit(None).cast("long").alias("gene_idx"), F.lit(end).alias("token"), "position")
    clamp = F.greatest(F.least(F.col("contig_idx"), F.lit(max_contigs - 1)), F.lit(0))
    return placed.drop("_k").unionByName(last).select(genome, "position", "token", clamp.alias("contig_type"), "gene_idx")


def edge_labels(edges: DataFrame, score: Column, threshold: float | None) -> DataFrame:
    """``label``: whether an edge's score of 0 to 1000 reaches the threshold of 0 to 1."""
    return edges.withColumn("label", (score >= int((threshold or 0) * 1000)).cast("int"))


def sample_edges(edges: DataFrame, key: str, most: int, seed: int = 1) -> DataFrame:
    """At most ``most`` edges of each key, by md5 rank."""
    rank = F.md5(F.concat_ws(":", F.lit(seed), F.col(key), F.col("i"), F.col("j")))
    return edges.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(rank))).filter(F.col("_r") <= most).drop("_r")
