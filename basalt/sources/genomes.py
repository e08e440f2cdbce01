"""Genome files as tables: GenBank flat files, GFF and FASTA, plain or gzipped.

A record separator splits files into rows, so that a file is parsed by column expressions; only a file's
pragmas are joined back to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _qualifier(block: Column, name: str) -> Column:
    """First value of a qualifier of a feature block; null without one."""
    value = F.regexp_extract(block, rf'/{name}="([^"]*)"', 1)
    return F.when(block.rlike(rf'/{name}="'), F.trim(F.regexp_replace(value, r"\s+", " ")))


def gbff_cds(spark: SparkSession, path: str) -> DataFrame:
    """``cds_of`` a folder of ``.gbff[.gz]``."""
    return cds_of(spark.read.option("lineSep", "\n//").text(path), "value")


def cds_of(records: DataFrame, column: str = "record") -> DataFrame:
    """One row per CDS with a translation of GenBank records; ``start`` 0-based, ``end`` exclusive, ``start1``/``end1`` 1-based."""
    rows = records.select(F.regexp_replace(column, "\r", "").alias("r")).filter(F.col("r").rlike(r"(?m)^LOCUS"))
    blocks = F.regexp_extract_all("r", F.lit(r"\n     CDS\s+((?:(?!\n     \S|\n\S)[\s\S])*)"), F.lit(1))
    head = rows.select(
        F.trim(F.regexp_extract("r", r"(?m)^\s+ORGANISM\s+(.*)$", 1)).alias("strain_name"), F.nullif(F.regexp_extract("r", r"(?m)^ACCESSION\s+(\S+)", 1), F.lit("")).alias("accession_id"),
        F.regexp_extract("r", r"(?m)^VERSION\s+(\S+)", 1).alias("contig_name"), F.explode(blocks).alias("b"),
    )
    place = F.regexp_replace(F.regexp_extract("b", r"^([^/]*)", 1), r"\s", "")
    own = F.regexp_replace(place, r"[A-Za-z0-9_.]+:[^,()]*", "")  # parts that lie on other records
    numbers = F.transform(F.regexp_extract_all(own, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    strand = F.when(~place.contains("complement"), 1).when(place.startswith("complement(") & ~F.regexp_replace(place, r"^complement\(", "").contains("complement"), -1)
    strand = F.when(place.rlike(r"^(join|order)\((complement\([^()]*\),?)+\)$"), -1).otherwise(strand)
    sequence = F.regexp_replace(F.regexp_extract("b", r'/translation="([^"]*)"', 1), r"\s", "")
    names = {"gene_name": "gene", "locus_tag": "locus_tag", "old_locus_tag": "old_locus_tag", "protein_id": "protein_id"}
    cds = head.filter(F.col("b").rlike('/translation="')).select(
        "strain_name", "accession_id", *(_qualifier(F.col("b"), q).alias(n) for n, q in names.items()), (F.array_min(numbers) - 1).alias("start"), F.array_max(numbers).alias("end"),
        strand.cast("tinyint").alias("strand"), "contig_name", sequence.alias("protein_sequence"),
    )
    return cds.withColumns({"start1": F.col("start") + 1, "end1": F.col("end")})


def gff_cds(spark: SparkSession, path: str) -> DataFrame:
    """CDS rows of ``.gff[.gz]``; positions 1-based inclusive; the accession of a file's pragma goes to all its rows."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    pragma = lines.filter(F.col("line").startswith("#!genome-build-accession")).groupBy("file").agg(F.min(F.substring_index(F.element_at(F.split(F.trim("line"), r"\s+"), -1), ":", -1)).alias("accession_id"))
    parts = lines.filter(~F.col("line").startswith("#")).select("file", F.split("line", "\t").alias("c")).filter(F.size("c") >= 9).filter(F.get("c", F.lit(2)) == "CDS")
    pairs = F.transform(F.filter(F.split(F.get("c", F.lit(8)), ";"), lambda p: p.contains("=")), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v")))
    first = lambda name: F.get(F.transform(F.filter("a", lambda p: p["k"] == name), lambda p: p["v"]), F.lit(0))
    sign = F.get("c", F.lit(6))
    rows = parts.withColumn("a", pairs).select(
        "file", first("gene").alias("gene_name"), first("locus_tag").alias("locus_tag"), first("old_locus_tag").alias("old_locus_tag"), first("product").alias("product"),
        F.get("c", F.lit(3)).cast("long").alias("start"), F.get("c", F.lit(4)).cast("long").alias("end"), F.when(sign == "+", 1).when(sign == "-", -1).cast("tinyint").alias("strand"),
        first("protein_id").alias("protein_id"), F.get("c", F.lit(0)).alias("contig_name"),
    )
    joined = rows.join(pragma, "file", "left").drop("file").withColumns({"start1": F.col("start"), "end1": F.col("end")})
    return joined.select("accession_id", *[c for c in joined.columns if c != "accession_id"])


def fasta_contigs(spark: SparkSession, path: str) -> DataFrame:
    """``contigs_of`` a folder of ``.fna[.gz]``."""
    return contigs_of(spark.read.option("lineSep", "\n>").text(path), "value")


def contigs_of(records: DataFrame, column: str = "record") -> DataFrame:
    """accession_id, contig_name, length and dna_sequence of FASTA records."""
    rows = records.select(F.regexp_replace(column, "^>", "").alias("r")).filter(F.length(F.trim("r")) > 0)
    name = F.regexp_extract("r", r"^(\S*)", 1)
    dna = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select(name.alias("accession_id"), name.alias("contig_name"), F.length(dna).cast("long").alias("length"), dna.alias("dna_sequence"))


READERS = {"gbff": gbff_cds, "gff": gff_cds, "fna": fasta_contigs}


def read_genomes(spark: SparkSession, path: str, file_type: str) -> DataFrame:
    if file_type not in READERS:
        raise ValueError(f"file_type must be one of {', '.join(READERS)}")
    return READERS[file_type](spark, path)


def assembly_url(refseq: Column, genbank: Column | None, file_type: str) -> Column:
    """Download address of an assembly: its RefSeq folder, else its GenBank folder."""
    missing = lambda c: F.when(F.trim(c).isin("", "na"), None).otherwise(F.trim(c))
    folder = F.regexp_replace(F.coalesce(missing(refseq), *([missing(genbank)] if genbank is not None else [])), r"^ftp:", "https:")
    folder = F.regexp_replace(folder, "/$", "")
    return F.concat(folder, F.lit("/"), F.substring_index(folder, "/", -1), F.lit(f"_genomic.{file_type}.gz"))


def newest_files(files: DataFrame, key: str, path: str, modified: str) -> DataFrame:
    """The newest file of each key."""
    return files.groupBy(key).agg(F.max_by(path, F.struct(modified, path)).alias(path))
