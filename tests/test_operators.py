from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.functions import sequence as seq
from basalt.functions import vectors as vec
from basalt.operators import community, embed, intervals, knn, metrics, nested, pooling, splits
from basalt.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_chunks_put_together_give_the_text(spark):
    for text, size, overlap, want in (("ABCDEFGHIJ", 4, 1, ["ABCD", "DEFG", "GHIJ"]), ("ABCDEFGHIJK", 4, 1, ["ABCD", "DEFG", "GHIJ", "JK"]), ("AB", 4, 1, ["AB"]), ("", 4, 1, [])):
        assert one(spark, seq.chunk(F.lit(text), size, overlap)) == want
    with pytest.raises(ValueError):
        seq.chunk(F.lit("A"), 4, 4)
    assert one(spark, seq.chunk_genome(F.lit("ABCDE  FG"), 4, 0)) == ["ABCD", "E", "FG"]


def test_promoter_and_reverse(spark):
    dna = F.lit("acgtACGTNN")
    gene = lambda strand: one(spark, seq.gene_with_promoter(dna, F.lit(4), F.lit(6), F.lit(strand).cast("int"), 2))
    assert (gene(1), gene(-1), gene(None)) == ("CGTAC", "TACGT", "CGTACGT")
    assert one(spark, seq.reverse_complement(F.lit("AacGNT"))) == "ANCgtT"


def _context(dna, start, end, strand, size):
    n = len(dna)
    lo, hi = sorted(max(1, min(x, n)) for x in (start, end))
    hi = hi if n else 0
    if hi - lo + 1 > size:
        lo, hi = (lo, lo + size - 1) if strand == 1 else (hi - size + 1, hi)
    room = size - (hi - lo + 1)
    wl, wr = room // 2, room - room // 2
    hl, hr = lo - 1, n - hi
    le, ri = min(hl, wl + max(wr - hr, 0)), min(hr, wr + max(wl - hl, 0))
    body = dna[lo - 1 - le : hi + ri]
    pad = size - len(body)
    return ("N" * (pad // 2) + body + "N" * (pad - pad // 2)).upper(), pad // 2 + le, hi - lo + 1


def test_context_windows(spark):
    dna = "acgtacgtaaccggtt"
    for start, end, strand, size in ((3, 5, 1, 8), (5, 3, -1, 8), (1, 2, 1, 8), (15, 16, -1, 8), (2, 14, 1, 6), (2, 14, -1, 6), (4, 9, 1, 30), (14, 40, -1, 10), (40, 50, 1, 20), (50, 40, -1, 20), (-8, 0, 1, 6)):
        got = one(spark, seq.context_window(F.lit(dna), F.lit(start), F.lit(end), F.lit(strand), size))
        assert tuple(got) == _context(dna, start, end, strand, size)
        assert len(got["sequence"]) == size
    assert tuple(one(spark, seq.context_window(F.lit(""), F.lit(3), F.lit(5), F.lit(1), 4))) == ("NNNN", 2, 0)


def test_strand_marks(spark):
    assert one(spark, seq.last_strand_mark(F.lit("<+>AC<->G"))) == "<->"
    assert one(spark, seq.strip_cut_mark(F.lit("+>AC<-"))) == "AC"
    windows = one(spark, seq.mixed_windows(F.lit("<+>AAAA<->CCCC"), 6, 2))
    assert windows[0].startswith("<+>") and windows[-1].endswith("CCCC") and all(w[:3] in ("<+>", "<->") for w in windows)


def test_vectors(spark):
    x, y, zero = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vec.cosine(x, y)) == pytest.approx(0.96)
    assert one(spark, vec.cosine(x, zero)) == 0 and one(spark, vec.unit(zero)) == [0, 0]
    assert one(spark, vec.softmax(x)) == pytest.approx(list(np.exp([3, 4]) / np.exp([3, 4]).sum()))
    assert one(spark, vec.one_hot(F.lit(1), 3)) == [0, 1, 0]


def _auc(y, s):
    p, n = [a for a, b in zip(s, y, strict=True) if b], [a for a, b in zip(s, y, strict=True) if not b]
    return np.mean([(a > b) + (a == b) / 2 for a in p for b in n])


def test_ranking_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(y), float(s)) for k, y, s in zip(rng.integers(0, 3, 200), rng.integers(0, 2, 200), rng.integers(0, 12, 200), strict=True)] + [(9, 1, 0.5), (9, 1, 0.2)]
    got = {r["k"]: r for r in metrics.ranking(spark.createDataFrame(rows, "k int, y int, s double"), ["k"], "y", "s").collect()}
    for k in range(3):
        own = [(y, s) for kk, y, s in rows if kk == k]
        assert got[k]["auroc"] == pytest.approx(_auc([y for y, _ in own], [s for _, s in own]))
        total, ap, tp = sum(y for y, _ in own), 0.0, 0
        for t in sorted({s for _, s in own}, reverse=True):
            new = sum(y for y, s in own if s == t)
            tp += new
            ap += new * tp / sum(s >= t for _, s in own)
        assert got[k]["auprc"] == pytest.approx(ap / total)
    assert got[9]["auroc"] is None and got[9]["n"] == 2


def test_knn_and_communities(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (25, 4)) for c in ((0, 0, 0, 0), (9, 0, 0, 0), (0, 9, 0, 0))])
    df = spark.createDataFrame([(i, [float(a) for a in v], i // 25) for i, v in enumerate(x)], "id long, v array<double>, truth int")
    near = knn.nearest(df, "id", "v", 6)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in near.collect():
        got.setdefault(r["i"], {})[r["rank"]] = r["j"]
    assert all([got[i][k] for k in range(1, 7)] == list(np.argsort(d[i])[:6]) for i in range(75))
    tables.ensure_checkpoint_dir(spark)
    found = community.communities(community.fuzzy_weights(near, 6), 0.2)
    agreed = metrics.clustering(df.join(found.withColumnRenamed("node", "id"), "id"), [], "truth", "community").first()
    assert agreed["nmi"] > 0.6
    exact = metrics.clustering(df, [], "truth", "truth").first()
    assert exact["ari"] == pytest.approx(1) and exact["nmi"] == pytest.approx(1)


def _modularity(edges, of, resolution=1.0):
    total = 2 * sum(w for _, _, w in edges)
    inside = 2 * sum(w for i, j, w in edges if of[i] == of[j])
    size = {}
    for i, j, w in edges:
        for n in (i, j):
            size[of[n]] = size.get(of[n], 0) + w
    return inside / total - resolution * sum(k * k for k in size.values()) / total**2


def test_communities_end_at_the_best_partition(spark):
    tables.ensure_checkpoint_dir(spark)
    groups, size = 6, 5
    ring = [(size * g + a, size * g + b, 1.0) for g in range(groups) for a in range(size) for b in range(a + 1, size)]
    ring += [(size * g, (size * (g + 1) + 1) % (groups * size), 1.0) for g in range(groups)]
    schema = "i long, j long, w double"
    of = {r["node"]: r["community"] for r in community.communities(spark.createDataFrame(ring, schema)).collect()}
    assert _modularity(ring, of) == pytest.approx(_modularity(ring, {n: n // size for n in range(groups * size)}))
    rng = np.random.default_rng(3)
    mixed = {(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2)) if a < b and (a % 4 == b % 4 or rng.random() < 0.15)}
    mixed = [(a, b, 1.0) for a, b in sorted(mixed)]
    of = {r["node"]: r["community"] for r in community.communities(spark.createDataFrame(mixed, schema)).collect()}
    assert set(of) == {n for i, j, _ in mixed for n in (i, j)}
    assert _modularity(mixed, of) >= _modularity(mixed, {n: n % 4 for n in range(40)}) - 1e-2
    assert community.communities(spark.createDataFrame([], schema)).count() == 0
    one = community.communities(spark.createDataFrame([(1, 2, 1.0)], schema)).collect()
    assert len({r["community"] for r in one}) == 1


def test_nested(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"])], "g int, x array<int>, y array<string>")
    assert [tuple(r) for r in nested.explode_aligned(df, ["x", "y"]).collect()] == [(1, 0, 1, "a"), (1, 1, 2, "b")]
    bad = spark.createDataFrame([(1, [1, 2], ["a"])], "g int, x array<int>, y array<string>")
    with pytest.raises(Exception, match="unequal"):
        nested.explode_aligned(bad, ["x", "y"]).collect()
    with pytest.raises(ValueError):
        nested.resolve_column(df, ["nothing"])
    with pytest.raises(ValueError):
        nested.row_slice(df, "g", 3, 3)
    assert one(spark, nested.windows_of(F.array(*(F.lit(i) for i in range(4))), 3)) == [[0, 1, 2], [1, 2, 3]]


def test_pooling(spark):
    tokens = spark.createDataFrame([(0, p, [float(p), 1.0]) for p in range(5)], "b int, p int, v array<double>")
    lengths = spark.createDataFrame([(0, 0, 2), (0, 1, 3)], "b int, seq int, length int")
    got = {r["seq"]: r["v"] for r in pooling.ragged_mean(tokens, lengths, "b", "p", "v").collect()}
    assert got == {0: [0.5, 1.0], 1: [3.0, 1.0]}
    masked = spark.createDataFrame([(0, [2.0], 1, 1), (0, [4.0], 0, 1), (0, [9.0], 0, 0)], "k int, v array<double>, gene int, seen int")
    assert pooling.gene_masked_mean(masked, ["k"], "v", "gene", "seen").first()["v"] == [1.0]


def test_gaps_and_labels(spark):
    genes = spark.createDataFrame([("c", 1, 10, 1), ("c", 4, 6, 1), ("c", 15, 20, -1)], "contig_name string, start long, end long, strand int")
    contigs = spark.createDataFrame([("c", 25, "ACGTACGTACGTACGTACGTACGTA"), ("d", 3, "AAA")], "contig_name string, length long, dna_sequence string")
    gaps = sorted(tuple(r) for r in intervals.intergenic(genes, contigs).collect())
    assert gaps == [("c", 11, 14), ("c", 21, 25), ("d", 1, 3)]
    covered = {p for r in intervals.interval_table(genes, contigs).filter("contig_name = 'c'").collect() for p in range(r["start"], r["end"] + 1)}
    assert covered == set(range(1, 26))
    many = spark.createDataFrame([("c", i) for i in range(7)], "contig string, gene_idx long")
    ops = spark.createDataFrame([("c", [2, 5]), ("c", [0])], "contig string, members array<long>")
    labels = {r["gene_idx"]: r["label"] for r in intervals.adjacency_labels(many, ops, ["contig"], "gene_idx", "members").collect()}
    assert labels == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}


def test_splits(spark):
    df = spark.createDataFrame([(i, f"g{i % 11}", i % 2) for i in range(300)], "id long, g string, y int")
    split = splits.group_split(df, "g", 5)
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert split.count() == 300
    counts = {(r["y"], r["split"]): r["count"] for r in splits.stratified_split(df, "id", "y", 5).groupBy("y", "split").count().collect()}
    assert counts[(0, "train")] == counts[(1, "train")] == 105
    with pytest.raises(ValueError):
        splits.group_split(df, "g", 5, 0.5, 0.1, 0.1)
    words = spark.createDataFrame([("t", "Yes"), ("t", "No"), ("u", "-"), ("u", "+"), ("w", "aerobic"), ("w", "anaerobic")], "target string, value string")
    got = {(r["target"], r["value"]): r["class"] for r in splits.binary_classes(words).collect()}
    assert got == {("t", "Yes"): 1, ("t", "No"): 0, ("u", "-"): 0, ("u", "+"): 1, ("w", "aerobic"): 0, ("w", "anaerobic"): 1}


def test_embedding_jobs(spark):
    df = spark.createDataFrame([("a", ["MKV", "MA", "MKVLL"]), ("b", ["MM"])], "genome string, protein_sequence array<string>")
    lengths = lambda texts: [[float(len(t)), 1.0] for t in texts]
    got = {r["genome"]: r["embedding"] for r in embed.embed_proteins(df, "genome", embedder=lengths).collect()}
    assert got == {"a": [[3.0, 1.0], [2.0, 1.0], [5.0, 1.0]], "b": [[2.0, 1.0]]}
    mean = {r["genome"]: r["embedding"] for r in embed.embed_proteins(df, "genome", embedder=lengths, pooled="mean").collect()}
    assert mean["a"] == pytest.approx([10 / 3, 1.0])
    with pytest.raises(ValueError):
        embed.preparation("nothing")
    dna = spark.createDataFrame([("a", "ACGT" * 50, [1, 100], [60, 110], [1, -1])], "genome string, dna_seq string, start array<int>, end array<int>, strand array<int>")
    genes = {r["gene_idx"]: r["embedding"] for r in embed.embed_dna_genes(dna, "genome", embedder=lengths, promoter=5).collect()}
    assert genes[0] == [60.0, 1.0] and genes[1] is None


def test_sinks(spark, tmp_path):
    df = spark.range(100)
    tables.write_parquet(df.coalesce(1), str(tmp_path / "p"), 30)
    assert len(list((tmp_path / "p").glob("part-*.parquet"))) == 4
    with pytest.raises(ValueError):
        tables.read_one_source(spark)
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "f string")
    done = spark.createDataFrame([("b",)], "f string")
    assert {r["f"] for r in tables.pending(files, done, "f").collect()} == {"a", "c"}


def test_row_slice_and_names(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2).orderBy(F.rand(3))
    assert sorted(r["id"] for r in nested.row_slice(df, "id", 100, 250).collect()) == list(range(100, 250))
    assert nested.row_slice(df, "id", 990).count() == 10
    assert one(spark, nested.contig_names(F.lit(0))) == [] and one(spark, nested.contig_names(F.lit(2))) == ["contig_0", "contig_1"]


def test_drawn_windows_differ(spark):
    operons = spark.createDataFrame([(1, 3, 14), (2, 5, 90), (3, 4, 13)], "operon int, size long, n_genes long")
    rows = intervals.sample_windows(operons, ["operon"], "size", "n_genes", 10).collect()
    for operon, room in ((1, 11), (2, 85)):
        for seed in intervals.SEEDS:
            starts = [r["start"] for r in rows if (r["operon"], r["seed"]) == (operon, seed)]
            assert len(set(starts)) == 10 and min(starts) >= 0 and max(starts) < room
    assert not [r for r in rows if r["operon"] == 3]


def test_mixed_windows_against_a_plain_version(spark):
    import re

    rng = np.random.default_rng(4)
    for _ in range(12):
        text = "".join(rng.choice(["<+>", "<->", "AC", "g", "T"], 30, p=[0.1, 0.1, 0.3, 0.3, 0.2]))
        size, overlap = 11, int(rng.integers(0, 9))
        got = one(spark, seq.mixed_windows(F.lit(text), size, overlap))
        step, n = size - overlap, len(text)
        starts = [max(min(i * step, n - size), 0) for i in range(max(-(-(n - size) // step), 0) + 1)]
        want = []
        for s in starts:
            raw = re.sub(r"<[+-]?$", "", re.sub(r"^(?:[+-]>|>)", "", text[s : s + size]))
            marks = re.findall("<[+-]>", text[: s + 2])
            want.append(raw if re.match("<[+-]>", raw) or not marks else marks[-1] + raw)
        assert got == want
