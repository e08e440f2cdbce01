from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from basalt.sources import genomes

GBFF = """LOCUS       NC_1 120 bp DNA
ACCESSION   NC_1 REGION
VERSION     NC_1.1
SOURCE      x
  ORGANISM  Testus minor
FEATURES             Location/Qualifiers
     source          1..120
                     /organism="Testus minor"
     gene            3..50
                     /gene="abcA"
     CDS             3..50
                     /gene="abcA"
                     /locus_tag="T_1"
                     /old_locus_tag="OT_1"
                     /protein_id="P1.1"
                     /translation="MKV
                     LLA"
     CDS             complement(join(60..70,
                     80..>100))
                     /locus_tag="T_2"
                     /protein_id="P2.1"
                     /translation="MA"
     CDS             <1..50
                     /locus_tag="T_3"
                     /pseudo
ORIGIN
        1 acgt
//
LOCUS       NC_2 20 bp DNA
ACCESSION   NC_2
VERSION     NC_2.1
  ORGANISM  Testus minor
FEATURES             Location/Qualifiers
     CDS             join(1..5,complement(8..12))
                     /protein_id="P3.1"
                     /translation="MM"
ORIGIN
//
"""
GFF = "##gff-version 3\n#!genome-build-accession NCBI_Assembly:GCF_x\nc1\tr\tgene\t1\t9\t.\t+\t.\tID=g\nc1\tr\tCDS\t1\t9\t.\t+\t0\tgene=a;locus_tag=L1;product=x=y;protein_id=P1\nc1\tr\tCDS\t20\t29\t.\t-\t0\tlocus_tag=L2\nc1\tr\tCDS\t40\t49\t.\t.\t0\tlocus_tag=L3\nshort\tline\n"
FASTA = ">c1 some words\r\nACGT\r\nacgt\r\n>c2\n>c3 x\nNNNN\nAA\n"


def test_gbff(spark, tmp_path):
    (tmp_path / "a.gbff").write_text(GBFF)
    rows = {r["protein_id"]: r for r in genomes.read_genomes(spark, str(tmp_path), "gbff").collect()}
    assert set(rows) == {"P1.1", "P2.1", "P3.1"}
    one = rows["P1.1"]
    assert (one["start"], one["end"], one["start1"], one["strand"], one["gene_name"], one["old_locus_tag"]) == (2, 50, 3, 1, "abcA", "OT_1")
    assert (one["strain_name"], one["accession_id"], one["contig_name"], one["protein_sequence"]) == ("Testus minor", "NC_1", "NC_1.1", "MKVLLA")
    assert (rows["P2.1"]["start"], rows["P2.1"]["end"], rows["P2.1"]["strand"], rows["P2.1"]["gene_name"]) == (59, 100, -1, None)
    assert rows["P3.1"]["strand"] is None and rows["P3.1"]["contig_name"] == "NC_2.1"


def test_gff(spark, tmp_path):
    with gzip.open(tmp_path / "a.gff.gz", "wt") as f:
        f.write(GFF)
    rows = {r["locus_tag"]: r for r in genomes.gff_cds(spark, str(tmp_path)).collect()}
    assert set(rows) == {"L1", "L2", "L3"}
    assert (rows["L1"]["product"], rows["L1"]["accession_id"], rows["L1"]["start"], rows["L1"]["end"]) == ("x=y", "GCF_x", 1, 9)
    assert [rows[k]["strand"] for k in ("L1", "L2", "L3")] == [1, -1, None]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fna").write_bytes(FASTA.encode())
    rows = {r["contig_name"]: (r["length"], r["dna_sequence"]) for r in genomes.fasta_contigs(spark, str(tmp_path)).collect()}
    assert rows == {"c1": (8, "ACGTacgt"), "c2": (0, ""), "c3": (6, "NNNNAA")}


def test_dispatch_and_urls(spark):
    with pytest.raises(ValueError):
        genomes.read_genomes(spark, "/tmp", "txt")
    df = spark.createDataFrame([("ftp://h/a/GCF_1", "ftp://h/a/GCA_1"), ("", "ftp://h/a/GCA_2"), (None, None)], "r string, g string")
    urls = [r[0] for r in df.select(genomes.assembly_url(F.col("r"), F.col("g"), "gff")).collect()]
    assert urls == ["https://h/a/GCF_1/GCF_1_genomic.gff.gz", "https://h/a/GCA_2/GCA_2_genomic.gff.gz", None]


def test_crlf_records_keep_their_contigs(spark, tmp_path):
    def record(n):
        return f'LOCUS       X{n}\nACCESSION   A{n}\nVERSION     A{n}.1\nFEATURES\n     CDS             join({n}..9,J001.1:500..900)\n                     /gene="g{n}"\n                     /translation="MK"\nORIGIN\n//\n'

    (tmp_path / "two.gbff").write_bytes((record(1) + record(2)).replace("\n", "\r\n").encode())
    got = sorted((r["contig_name"], r["gene_name"], r["start1"], r["end1"]) for r in genomes.gbff_cds(spark, str(tmp_path)).collect())
    assert got == [("A1.1", "g1", 1, 9), ("A2.1", "g2", 2, 9)]
