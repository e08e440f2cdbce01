"""Odd inputs and steps whose work must follow the input."""

from __future__ import annotations

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.functions import vectors as vec
from basalt.operators import cells, embed, knn, metrics, mixed_context


def test_pearson_of_constants_is_null(spark):
    rows = [("guess", 1.0, 2.0), ("guess", 3.0, 2.0), ("truth", 1.0, 2.0), ("truth", 1.0, 3.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", 4.0, 8.0), ("one", 1.0, 1.0)]
    got = {r["k"]: r for r in metrics.regression(spark.createDataFrame(rows, "k string, y double, p double"), ["k"], "y", "p").collect()}
    assert [got[k]["pearson"] for k in ("guess", "truth", "one")] == [None, None, None]
    assert got["line"]["pearson"] == pytest.approx(1.0) and got["guess"]["r2"] == pytest.approx(0.0)


@pytest.mark.parametrize("function", [vec.unit, vec.layer_norm, vec.softmax])
def test_vector_functions_compute_their_sums_once(spark, function):
    """Sums inside the lambda over elements are sums for each element: 2,000 elements then take minutes."""
    df = spark.createDataFrame([([],), (None,), ([0.0, 0.0],), ([1.0, None],), ([3.0, 4.0],), ([float(i % 7) for i in range(2000)],)], "v array<double>")
    got = [r["x"] for r in df.select(function(F.col("v")).alias("x")).collect()]
    assert got[:4] == [[], None, {"softmax": [0.5, 0.5]}.get(function.__name__, [0.0, 0.0]), [None, None]]
    assert len(got[5]) == 2000
    plan = df.select(function(F.col("v")).alias("x"))._jdf.queryExecution().analyzed().toString()
    sums = plan.count("aggregate(")
    nested = plan[plan.rindex("transform(") :].count("aggregate(")
    assert sums and not nested


@pytest.fixture(scope="module")
def copies(spark):
    """Unlike vectors, two of them a hundred times more, one huge, one null."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 8))
    v[600:700], v[700:800], v[899] = v[0], v[1], 1e20
    df = spark.createDataFrame([(i * 3, x.tolist(), [str(i % 5), "one", str(i)]) for i, x in enumerate(v)] + [(9999, None, ["0", "one", "x"])], "id long, v array<double>, c array<string>")
    return v, df


def test_neighbours_of_copies_in_many_blocks(copies, monkeypatch):
    v, df = copies
    monkeypatch.setattr(knn, "LEAST_ROWS", 40)
    monkeypatch.setattr(knn, "BLOCKS", 7)
    got = {}
    for r in knn.nearest(df, "id", "v", 6).collect():
        got.setdefault(r["i"], {})[r["rank"]] = (r["distance"], r["j"])
    for i, x in enumerate(v):
        d = np.sqrt(((v - x) ** 2).sum(1))
        want = sorted((d[j], 3 * j) for j in range(len(v)) if j != i)[:6]
        assert [got[3 * i][k] for k in range(1, 7)] == want, i


def test_silhouettes_in_many_blocks(copies, monkeypatch):
    _, df = copies
    monkeypatch.setattr(knn, "LEAST_ROWS", 40)
    monkeypatch.setattr(knn, "BLOCKS", 7)
    df = df.filter("id < 2690")
    got = {(r["setting"], r["i"]): (r["a"], r["b"]) for r in knn.cluster_nearness(df, "id", "v", "c").collect()}
    rows = df.orderBy("id").collect()
    v, c = np.array([r["v"] for r in rows]), np.array([r["c"] for r in rows])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    for n in (0, 5, 650, 701):
        own = c[n, 0]
        a = d[n, c[:, 0] == own].sum() / ((c[:, 0] == own).sum() - 1)
        b = min(d[n, c[:, 0] == other].mean() for other in "01234" if other != own)
        assert got[0, 3 * n] == pytest.approx((a, b))
        assert got[1, 3 * n] == (pytest.approx(d[n].sum() / (len(v) - 1)), None)
        assert got[2, 3 * n] == (None, pytest.approx(np.delete(d[n], n).min()))


def test_kmers_of_a_long_text(spark):
    """Fourteen million letters: hashing each k-mer once for each dimension, in interpreted lambdas, took minutes."""
    texts = ["ACGTTGCA" * 1_800_000, "", None, "ab", "äöüabcé", "abc"]
    began = time.perf_counter()
    got = [list(r["x"]) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(embed.kmer_vector(F.col("text")).alias("x")).collect()]
    assert time.perf_counter() - began < 60
    for text, x in zip(texts, got, strict=True):
        data = (text or "").encode()
        n = len(text or "") - 2
        kmers = [zlib.crc32(data[i : i + 3]) % 16 for i in range(min(max(n, 0), 800))]
        want = np.bincount(kmers, minlength=16) / max(len(kmers), 1) if kmers else np.zeros(16)
        assert x == pytest.approx(want.tolist(), abs=1e-3 if n > 800 else 1e-12)


def test_windows_of_contigs_in_short_batches(spark):
    """Contigs that go over several Arrow batches, many of them, give the windows of each alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        genes = [(f"c{c}", 11 + 40 * i, 35 + 40 * i, i, 1 if i % 2 else -1, "MKVLAA"[i % 3 :]) for c in range(9) for i in range(c)]
        contigs = [(f"c{c}", "ACGT" * (5 + 10 * c)) for c in range(9)]
        g = spark.createDataFrame(genes, "contig_name string, start long, end long, gene_idx long, strand int, protein_sequence string")
        elements = mixed_context.mixed_elements(g, spark.createDataFrame(contigs, "contig_name string, dna_sequence string"))
        got = {(r["contig_name"], r["gene_idx"]): r for r in mixed_context.genes_in_mixed_context(elements, 40).collect()}
        assert len(got) == len(genes)
        rows = elements.collect()
        for c in range(1, 9):
            own = sorted((r for r in rows if r["contig_name"] == f"c{c}"), key=lambda r: r["element_idx"])
            for idx, text, start, length in mixed_context._windows([r["mark"] for r in own], [r["seq"] for r in own], [r["gene_idx"] for r in own], 40):
                r = got[f"c{c}", idx]
                assert (r["text"], r["mask_start"], r["mask_length"]) == (text, start, length)
                assert len(text.replace("<+>", "+").replace("<->", "-")) == 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lists_of_cells_are_completed(spark):
    """Unclustered vectors: small cells alone miss neighbours."""
    v = np.random.default_rng(6).normal(size=(1500, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    found = cells.nearest_in_cells(df, "id", "v", 5, trees=1, rounds=0, cell_rows=64)
    want = {(r["i"], r["j"], r["rank"]) for r in knn.nearest(df, "id", "v", 5).collect()}
    assert {(r["i"], r["j"], r["rank"]) for r in found.collect()} != want
    assert {(r["i"], r["j"], r["rank"]) for r in cells.completed(df, found, "id", "v", 5).collect()} == want


def test_sums_take_room_for_the_clusters_there_are():
    """Once a cluster came in a later pack, each further pack took half as much room again: a worker was out of memory at 48 packs."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(40, 6, 3))

    def pack(p):
        names = [["a", f"b{p // 8}"], [f"c{p}"]]
        codes = np.array([[0, 1, 0, 1, 0, 1], [0] * 6], np.int32)
        ids = np.arange(6, dtype=np.int64) + 6 * p
        return knn._Pack({"ids": ids.tobytes(), "v": v[p].tobytes(), "single": False, "names": names, "codes": codes.tobytes(), "most": np.full(6, np.inf).tobytes(), "own": p == 0})

    packs = [pack(p) for p in range(40)]
    sums = knn._Sums(packs[:1])
    for p in packs:
        sums.meet(p)
    assert [len(p) for p in sums.place] == [6, 40] and all(len(t) <= 2 * len(p) for t, p in zip(sums.total, sums.place, strict=True))
    d = np.sqrt(((v.reshape(-1, 1, 3) - v[0][None]) ** 2).sum(-1))
    assert sums.total[0][sums.place[0]["b2"]] == pytest.approx(d.reshape(40, 6, 6)[16:24, 1::2].sum((0, 1)))
    assert sums.total[1][sums.place[1]["c39"]] == pytest.approx(d[-6:].sum(0))


def test_sums_of_many_clusterings(copies):
    """Clusterings of few clusters are summed side by side, those of many in runs: all give each row's sums."""
    _, df = copies
    rows = df.filter("id < 2690").orderBy("id").select("id", "v").collect()
    counts = [1, 47, 48, 49, 48, 48, 48, 48, 100, 2]
    own = [[str(n % c) for c in counts] for n in range(len(rows))]
    wide = df.sparkSession.createDataFrame([(r["id"], r["v"], c) for r, c in zip(rows, own, strict=True)], "id long, v array<double>, c array<string>")
    got = {(r["setting"], r["i"], r["cj"]): r["total"] for r in knn.distances_by_clustering(wide, "id", "v", "c").collect()}
    assert len(got) == len(rows) * sum(counts)
    v = np.array([r["v"] for r in rows])
    for n in (0, 333, 895):
        d = np.sqrt(((v - v[n]) ** 2).sum(1))
        for s in range(len(counts)):
            for name in {own[0][s], own[n][s], own[500][s]}:
                assert got[s, rows[n]["id"], name] == pytest.approx(d[[c[s] == name for c in own]].sum()), (n, s, name)


def test_blocks_do_not_hang_on_the_number_of_partitions(copies, monkeypatch):
    """Where a session deals rows into more partitions than asked for, rows of those behind were in no block."""
    v, df = copies
    monkeypatch.setattr(knn, "LEAST_ROWS", 200)
    kind = type(df)
    monkeypatch.setattr(kind, "repartition", lambda self, n, *keys, f=kind.repartition: f(self, max(n, 31), *keys))
    got = knn.nearest(df, "id", "v", 2).collect()
    assert {r["i"] for r in got} == {3 * i for i in range(len(v))} and len(got) == 2 * len(v)
    cut = df.filter("id < 2690")
    assert knn.cluster_nearness(cut, "id", "v", "c").count() == 3 * cut.count()
