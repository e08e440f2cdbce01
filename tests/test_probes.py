"""Probes on planted signals, result rows, roll-ups and jobs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from basalt.operators import embed, jobs, metrics, nested, probes, splits
from basalt.plans import tasks
from basalt.sources import tables


@pytest.fixture(scope="module")
def genomes(spark):
    v = np.random.default_rng(5).normal(size=(200, 5))
    tables.ensure_checkpoint_dir(spark)
    rows = [(i, f"g{i % 29}", x.tolist(), str(int(x[0] > x[1])), str(i % 3), str(round(x[2], 3))) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id int, genus string, v array<double>, a string, b string, mic string").coalesce(2).checkpoint()


def test_resistance_probe_finds_the_signal(genomes):
    long = splits.to_long(genomes, ["id"], ["a", "b"])
    rows = {r["target"]: r for r in tasks.resistance_probes(genomes.select("id", "genus", "v"), long, "id", "v", "genus", (1,), 100, 20).collect()}
    assert rows["a"]["auroc"] > 0.9 and rows["a"]["skipped"] is None and rows["a"]["seed"] == 1
    assert rows["a"]["n_train"] + rows["a"]["n_val"] + rows["a"]["n_test"] == 200
    assert rows["b"]["skipped"] == "not_binary" and rows["b"]["auroc"] is None


def test_mic_probe_and_targets_without_rows(genomes):
    long = splits.to_long(genomes, ["id"], ["mic", "a"])
    found = tasks.mic_probes(genomes.select("id", "genus", "v"), long, "id", "v", "genus", (2,), 100, most_targets=2).collect()
    assert {r["target"]: r["r2"] > 0.3 for r in found} == {"mic": True, "a": True}
    none = tasks.mic_probes(genomes.select("id", "genus", "v"), long, "id", "v", "genus", (2,), 1000)
    assert none.count() == 0 and {"r2", "n_train", "n_val", "n_test", "skipped", "target", "seed"} <= set(none.columns)


def test_trait_probe_needs_labels_of_every_genome(genomes):
    small = genomes.select("id", "genus", "v")
    with pytest.raises(ValueError):
        tasks.trait_probes(small, genomes.filter("id > 3").select("id", "a"), ["a"], "id", "v", "genus")
    with pytest.raises(ValueError):
        nested.inner_checked(small, genomes.select("id", "a").union(genomes.select("id", "a")), "id")
    row = tasks.trait_probes(small, genomes.select("id", "a"), ["a"], "id", "v", "genus", (1,), 20).first()
    assert row["macro_auroc"] > 0.9 and row["macro_f1"] > 0.7


def test_essential_genes(spark, genomes):
    genes = genomes.withColumn("split", F.when(F.col("id") % 5 < 3, "train").when(F.col("id") % 5 == 3, "validation").otherwise("test")).withColumn("y", F.col("a").cast("int"))
    genes = genes.withColumn("genome", F.col("id") % 4)
    scored = tasks.essential_predictions(genes, "genome", "v", "y")
    assert {"score", "predicted", "class", "id"} <= set(scored.columns) and scored.count() == 200
    found = {r["split"]: r for r in tasks.essential_genes(scored, "genome").collect()}
    assert found["test"]["auroc"] > 0.9 and found["test"]["f1"] > 0.7 and found["test"]["n_genomes"] == 4


def test_reasons_and_rollup(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "split string, class int")
    full = [("train", 0), ("train", 1), ("validation", 0), ("test", 1)]
    assert probes.examine(rows(*full), "class") == ({"n_train": 2, "n_val": 1, "n_test": 1}, None)
    assert probes.examine(rows(*full[:3]), "class")[1] == "empty_split"
    assert probes.examine(rows(full[0], *full[2:]), "class")[1] == "one_class"
    assert probes.examine(rows(*full).limit(0), "class")[1] == "no_data"
    results = spark.createDataFrame([("a", 1, 0.5, None), ("a", 2, 1.0, None), ("b", 1, None, "no_data"), ("c", 1, 0.0, None), ("d", 1, 0.9, "x")], "target string, seed int, auroc double, skipped string")
    assert tuple(probes.rollup(results, "auroc", ["auroc"]).first()) == (0.5, 3)
    groups = spark.createDataFrame([("G", "a"), ("G", "b"), ("H", "c")], "group string, phenotype string")
    assert {tuple(r) for r in probes.group_rollup(results, groups, "auroc", ["auroc"]).collect()} == {("G", 0.75, 2), ("H", 0.0, 1)}


def test_ignored_labels(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (-100, 0.99), (None, 0.5)], "y int, s double")
    assert tuple(metrics.ranking(df, [], "y", "s").first()) == (1.0, 1.0, 2, 1)
    assert metrics.confusion(df, [], "y", "s").first()["accuracy"] == 1.0


def test_splits_by_file_name(spark, tmp_path):
    for i, name in enumerate(("train_0", "val_0", "test_1", "other")):
        pq.write_table(pa.table({"x": [i]}), tmp_path / f"{name}.parquet")
    assert {(r["x"], r["split"]) for r in tables.read_splits(spark, str(tmp_path)).collect()} == {(0, "train"), (1, "validation"), (2, "test")}


def test_jobs(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i % 3}", i, "ACGT" * i) for i in range(9)], "file string, id int, sequence string")
    job = lambda df: embed.embed_texts(df, "sequence")
    both = jobs.embed_splits({"train": rows, "test": rows.filter("id < 4")}, "id", job, 1, 3)
    assert sorted((r["split"], r["id"]) for r in both.collect()) == [("test", 1), ("test", 2), ("train", 1), ("train", 2)]
    out = str(tmp_path / "out")
    none = rows.select("file").limit(0)
    jobs.run_pending(rows, "file", none, job, out, 0, 2)
    jobs.run_pending(rows, "file", spark.read.parquet(out).select("file").distinct(), job, out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(9))


def test_strands(spark):
    genes = spark.createDataFrame([("g", 1, "p"), ("g", 5, "q")], "genome_name string, start int, protein_id string")
    strands = spark.createDataFrame([("g", 1, "p", -1)], "genome_name string, start int, protein_id string, strand int")
    assert {(r["protein_id"], r["strand"]) for r in jobs.attach_strand(genes, strands).collect()} == {("p", -1.0), ("q", 1.0)}


def test_genes_amid_their_neighbours(spark):
    dna = "".join(np.random.default_rng(1).choice(list("ACGT"), 90))
    contigs = spark.createDataFrame([("s", "c1", dna, [5, 40], [20, 60], [1, -1]), ("s", "c2", dna[:30], [3], [9], [1])], "strain string, contig_name string, dna_sequence string, start array<int>, end array<int>, strand array<int>")
    vectors = jobs.genes_in_dna(contigs, ["contig_name"], "dna_sequence", 40)
    first = vectors.filter("contig_name = 'c1' and gene_idx = 0").first()["embedding"]
    assert first == pytest.approx([dna[4:20].count(x) / 40 for x in "ACGT"])
    strain = jobs.by_strain(contigs, vectors, "strain", "contig_name").first()
    assert strain["contigs"] == ["c1", "c2"] and [len(e) for e in strain["embeddings"]] == [2, 1]
    proteins = spark.createDataFrame([("c1", 0, 5, 20, 1, "ACCA"), ("c1", 1, 40, 60, -1, "GT"), ("x", 0, 1, 2, 1, "A")], "contig_name string, gene_idx int, start int, end int, strand int, protein_sequence string")
    mixed = {r["gene_idx"]: r["embedding"] for r in jobs.genes_in_mixed(proteins, contigs, "contig_name", 24).collect()}
    assert mixed == {0: pytest.approx([2 / 24, 2 / 24, 0, 0]), 1: pytest.approx([0, 0, 1 / 24, 1 / 24])}
    assert [len(v) for v in embed.letter_vectors(["<+>AC<->gT"])] == [len(re.findall(r"<[+-]>|.", "<+>AC<->gT"))]
