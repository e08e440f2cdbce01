from __future__ import annotations

import re

from basalt.operators import mixed_context as mixed

GENES = [("c", 0, 5, 10, 1, "MKV"), ("c", 1, 8, 20, -1, "ma"), ("c", 2, 25, 26, None, None), ("d", 0, 1, 4, 1, "MMMMMMMMMMMM")]
CONTIGS = [("c", "ACGTACGTACGTACGTACGTACGTACGTAC"), ("d", "ACGT")]


def _tokens(text):
    return re.findall(r"<[+-]>|.", text)


def test_elements_texts_and_windows(spark):
    genes = spark.createDataFrame(GENES, "contig_name string, gene_idx int, start int, end int, strand int, protein_sequence string")
    contigs = spark.createDataFrame(CONTIGS, "contig_name string, dna_sequence string")
    elements = mixed.mixed_elements(genes, contigs)
    rows = [(r["gene_idx"], r["mark"], r["seq"]) for r in elements.filter("contig_name = 'c'").orderBy("element_idx").collect()]
    assert rows == [(None, "<+>", "acgt"), (0, "<+>", "MKV"), (1, "<->", "MA"), (None, "<+>", "acgt"), (2, "<+>", ""), (None, "<+>", "gtac")]
    texts = {r["contig_name"]: r["text"] for r in mixed.contig_texts(elements).collect()}
    assert texts == {"c": "<+>acgt<+>MKV<->MA<+>acgt<+><+>gtac", "d": "<+>MMMMMMMMMMMM"}
    for size in (3, 4, 7, 11, 30):
        for r in mixed.genes_in_mixed_context(elements, size).collect():
            tokens = _tokens(r["text"])
            assert len(tokens) == size
            protein = next((g[5] or "").upper() for g in GENES if g[0] == r["contig_name"] and g[1] == r["gene_idx"])
            masked = "".join(tokens[r["mask_start"] : r["mask_start"] + r["mask_length"]])
            assert masked == protein[: size - 1] and tokens[r["mask_start"] - 1] in ("<+>", "<->")
    one = {r["gene_idx"]: r["text"] for r in mixed.genes_in_mixed_context(elements.filter("contig_name = 'c'"), 11).collect()}
    assert "<->MA" in one[1]
    assert mixed.contig_windows(elements, 8, 2).count() > 2


def test_balanced_range():
    import numpy as np

    assert mixed.balanced_range(np.array([5, 4, 3, 5, 1, 5]), 2, 11) == (1, 0, 0, 4)
    assert mixed.balanced_range(np.array([5, 4, 3]), 0, 30) == (0, 2, 0, 0)
    assert mixed.balanced_range(np.array([9]), 0, 4) == (0, 0, 0, 0)
