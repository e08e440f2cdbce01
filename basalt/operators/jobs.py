"""Embedding jobs over splits, files, and genes amid their neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators import embed, mixed_context, nested
from basalt.sources.tables import pending, union_splits

#: Where a job's folder keeps the names of its whole files; readers pass over names that begin so.
MANIFEST = "_manifest"


def embed_splits(parts: dict[str, DataFrame], key: str, job: Callable[[DataFrame], DataFrame], start: int = 0, end: int | None = None) -> DataFrame:
    """``job`` on rows [start, end) of every split in the order of ``key``, in one frame with ``split``."""
    whole = start == 0 and end is None
    return union_splits(**{name: job(df if whole else nested.row_slice(df, key, start, end)) for name, df in parts.items()})


def done_files(spark: SparkSession, path: str, file: str) -> DataFrame:
    """The manifest of ``path``: a row (file, rows) for each file whose rows are written. Empty where nothing is."""
    schema = f"{file} string, rows long"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/{MANIFEST}") if there else spark.createDataFrame([], schema)


def run_pending(rows: DataFrame, file: str, done: DataFrame | None, job: Callable[[DataFrame], DataFrame], path: str, start: int = 0, end: int | None = None, workers: int = 4) -> None:
    """``job`` on the rows of each file in the slice that neither ``done`` nor the manifest of ``path`` holds; a folder a file.

    Each file is a job of its own: its folder is overwritten, so what a crash left there goes, and when it is whole
    the file is entered in the manifest. A crash loses the files at work, ``workers`` at most; a job that is started again goes
    on with those that are left. A file that fails does not keep the others from ending; the first failure is raised at the end. Names
    of the slice's files come to the driver.
    """
    spark = rows.sparkSession
    written = done_files(spark, path, file).select(file)
    todo = pending(rows.select(file).distinct(), written if done is None else written.unionByName(done.select(F.col(file).cast("string").alias(file))), file, start, end)
    names = sorted(r[0] for r in todo.collect())

    def one(name: str) -> None:
        folder = f"{path}/{file}={quote(name, safe='')}"
        job(rows.filter(F.col(file) == name)).drop(file).write.mode("overwrite").parquet(folder)
        n = spark.read.parquet(folder).count()
        spark.createDataFrame([(name, n)], f"{file} string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}/{quote(name, safe='')}")

    with ThreadPoolExecutor(workers) as pool:
        running = [pool.submit(one, name) for name in names]
    for ended in running:
        ended.result()


def attach_strand(genes: DataFrame, strands: DataFrame, keys: Sequence[str] = ("genome_name", "start", "protein_id")) -> DataFrame:
    """``strand`` of each gene from ``strands``; 1.0 where there is none. ``strands`` has at most one row a key."""
    return genes.join(strands.select(*keys, F.col("strand").cast("double").alias("strand")), list(keys), "left").fillna(1.0, ["strand"])


def genes_in_dna(contigs: DataFrame, keys: Sequence[str], dna: str, size: int, tokens: embed.TokenEmbedder = embed.letter_vectors) -> DataFrame:
    """(keys, gene_idx, embedding): each gene of a contig row (start, end, strand lists) amid ``size`` bases."""
    return embed.embed_masked(embed.genes_in_context(contigs, keys, dna, size), "sequence", tokens).select(*keys, "gene_idx", "embedding")


def genes_in_mixed(proteins: DataFrame, dna: DataFrame, contig: str, size: int, tokens: embed.TokenEmbedder = embed.letter_vectors) -> DataFrame:
    """(contig, gene_idx, embedding): each protein amid the mixed text of its contig; contigs on one side only are left out."""
    elements = mixed_context.mixed_elements(proteins, dna, contig)
    return embed.embed_masked(mixed_context.genes_in_mixed_context(elements, size, contig), "text", tokens).select(contig, "gene_idx", "embedding")


def by_strain(contigs: DataFrame, vectors: DataFrame, strain: str, contig: str) -> DataFrame:
    """Vectors of genes (contig, gene_idx, embedding) back on their contigs and those in one row a strain: strain, contigs, embeddings."""
    lists = nested.gather(vectors, [contig], "gene_idx", "embedding", "embeddings")
    rows = contigs.select(strain, contig).join(lists, contig).groupBy(strain).agg(F.array_sort(F.collect_list(F.struct(contig, "embeddings"))).alias("_c"))
    return rows.select(strain, F.transform("_c", lambda c: c[contig]).alias("contigs"), F.transform("_c", lambda c: c["embeddings"]).alias("embeddings"))
