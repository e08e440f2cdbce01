"""Genes, operons, edges and intervals read from the driver's tables, for queries that need genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENES_A_CONTIG = 50
OPERON_GENES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as genes in contig order: contig, gene_idx, strand, label, v."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.expr(f"vec_id div {GENES_A_CONTIG}").alias("contig"), (F.col("vec_id") % GENES_A_CONTIG).alias("gene_idx"), F.when(F.col("label") % 3 == 0, -1).otherwise(1).alias("strand"),
        F.col("label"), F.col("embedding").cast("array<double>").alias("v"),
    )


def operons(g: DataFrame) -> DataFrame:
    """Runs of five genes: contig, operon, members."""
    return g.groupBy("contig", F.expr(f"gene_idx div {OPERON_GENES}").alias("operon")).agg(F.array_sort(F.collect_list("gene_idx")).alias("members"))


def edges(g: DataFrame) -> DataFrame:
    """Pairs of genes no more than three apart with a score of 0 to 999: contig, i, j, score."""
    near = g.select("contig", F.col("gene_idx").alias("i"), F.explode(F.sequence(F.col("gene_idx") + 1, F.col("gene_idx") + 3)).alias("j"))
    there = g.select("contig", F.col("gene_idx").alias("j"))
    return near.join(there, ["contig", "j"]).select("contig", "i", "j", ((F.col("i") * 31 + F.col("j") * 17) % 1000).alias("score"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as genes: contig, start and end in days, strand."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    strand = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig_name"), (day * 10 + 1).alias("start"), (day * 10 + F.col("l_quantity").cast("long")).alias("end"), strand.alias("strand"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as sequences: doc_id, s (letters A to Z only)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("s"))


def wide_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` beside their documents: doc_id, source, lang, n_chars, quality, toxic."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")


# The same in SQL, for oracles.
SQL_GENES = f"g as (select vec_id // {GENES_A_CONTIG} as contig, vec_id % {GENES_A_CONTIG} as gene_idx, case when label % 3 = 0 then -1 else 1 end as strand, label, embedding::double[] as v from embeddings)"
SQL_EDGES = "e as (select a.contig, a.gene_idx as i, b.gene_idx as j, (a.gene_idx * 31 + b.gene_idx * 17) % 1000 as score, a.v as x, b.v as y from g a join g b on a.contig = b.contig and b.gene_idx between a.gene_idx + 1 and a.gene_idx + 3)"
SQL_INTERVALS = "iv as (select l_suppkey as contig_name, date_diff('day', date '1992-01-01', l_shipdate::date) * 10 + 1 as s, date_diff('day', date '1992-01-01', l_shipdate::date) * 10 + l_quantity::bigint as e from lineitem)"
SQL_LETTERS = "d as (select doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') as s from documents)"
