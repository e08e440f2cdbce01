"""Batch embedding: text preparation, a pluggable embedder, pooling.

An embedder is a function from a list of texts to a list of float vectors; it runs in Arrow batches of texts
sorted by length within a partition. The default needs no weights: hashed k-mer frequencies.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import sequence as seq
from basalt.operators import models, nested, pooling

Embedder = Callable[[list[str]], list[list[float]]]

#: How a model's texts are prepared, by a part of its name.
PREPARE: dict[str, Callable[[Column], Column]] = {"prot_bert": seq.spaced_residues, "progen2": seq.prefixed}
#: Models that take texts as they are.
PREPARE |= dict.fromkeys(("facebook/esm2", "esmc", "nucleotide-transformer", "dnabert-2", "mistral-dna", "prokbert", "glm2", "evo", "kmer"), lambda c: c)


def preparation(model: str) -> Callable[[Column], Column]:
    for part, prepare in PREPARE.items():
        if part in model.lower():
            return prepare
    raise ValueError(f"no embedder is known for {model}")


def kmer_vector(text: Column, k: int = 3, dimension: int = 16) -> Column:
    """Frequencies of hashed k-mers (crc32 of ``k`` bytes); a zero vector for a text shorter than ``k``. A text has as many k-mers as characters
    allow. For ``k`` bytes a crc32 is a constant and a term of each byte, so all k-mers of a text are hashed by ``k`` look-ups."""
    none = zlib.crc32(bytes(k))
    terms = [np.array([zlib.crc32(bytes(i) + bytes([b]) + bytes(k - 1 - i)) ^ none for b in range(256)], np.uint32) for i in range(k)]

    def frequencies(value: str | None) -> np.ndarray:
        data = np.frombuffer((value or "").encode(), np.uint8)
        n = int(np.count_nonzero((data & 0xC0) != 0x80)) - k + 1
        if n < 1:
            return np.zeros(dimension)
        hashed = np.full(n, none, np.uint32)
        for i, term in enumerate(terms):
            hashed ^= term[data[i : i + n]]
        return np.bincount(hashed % np.uint32(dimension), minlength=dimension) / n

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([frequencies(t) for t in texts], dtype=object)

    return run(text)


def embed_texts(df: DataFrame, text: str, embedder: Embedder | None = None, name: str = "embedding", batch: int = 64) -> DataFrame:
    """``df`` with a vector per text."""
    if embedder is None:
        return df.withColumn(name, kmer_vector(F.col(text)))

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list[list[float]] = []
            for lo in range(0, len(s), batch):
                out.extend(embedder(s.iloc[lo : lo + batch].tolist()))
            yield pd.Series(out)

    return df.sortWithinPartitions(F.length(text)).withColumn(name, run(text))


#: From a list of texts to a matrix of token vectors for each.
TokenEmbedder = Callable[[list[str]], list[np.ndarray]]


def letter_vectors(texts: list[str], alphabet: str = "ACGT") -> list[np.ndarray]:
    """Token vectors without a model: a place for each letter of ``alphabet``; other letters are zero. Strand marks are one token."""
    known = np.frombuffer(alphabet.encode(), np.uint8)
    marked = [text.replace("<+>", "+").replace("<->", "-") for text in texts]
    tokens = np.frombuffer("".join(marked).encode("ascii", "replace"), np.uint8)  # a byte a character
    found = (tokens[:, None] == known).astype(np.float64)
    ends = list(accumulate(map(len, marked), initial=0))
    return [found[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def embed_masked(df: DataFrame, text: str, tokens: TokenEmbedder = letter_vectors, name: str = "embedding", batch: int = 64) -> DataFrame:
    """``df`` with a vector per row: the sum over the tokens [mask_start, mask_start + mask_length) divided by the number of all tokens."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, start, length in parts:
            out: list[list[float]] = []
            for lo in range(0, len(s), batch):
                rows = zip(tokens(s.iloc[lo : lo + batch].tolist()), start.iloc[lo : lo + batch], length.iloc[lo : lo + batch])
                out.extend((v[a : a + n].sum(0) / max(len(v), 1)).tolist() for v, a, n in rows)
            yield pd.Series(out)

    return df.withColumn(name, run(text, "mask_start", "mask_length"))


def embed_proteins(genomes: DataFrame, genome: str, column: str | None = None, model: str = "kmer", embedder: Embedder | None = None, pooled: str | None = None) -> DataFrame:
    """Vectors of a genome's proteins in their order, or with ``pooled`` (mean or max) one per genome."""
    column = column or nested.resolve_column(genomes, nested.PROTEIN_COLUMNS)
    genes = nested.explode_aligned(genomes.select(genome, column), [column]).withColumn("_text", preparation(model)(F.col(column)))
    vectors = embed_texts(genes.select(genome, "gene_idx", "_text"), "_text", embedder)
    return pooling.pool(vectors, [genome], "embedding", pooled) if pooled else nested.gather(vectors, [genome], "gene_idx", "embedding")


def gene_chunks(genomes: DataFrame, keys: Sequence[str], dna: str, size: int = 512, promoter: int = 128, overlap: int = 32, least: int = 32) -> DataFrame:
    """Chunks of each gene with its promoter: keys, gene_idx, chunk_idx, text. Genes are cut at the genome row: its text is never copied to them."""
    spans = F.arrays_zip(F.col("start"), F.col("end"), F.col("strand"))
    texts = F.transform(spans, lambda g: seq.gene_with_promoter(F.col(dna), g["start"], g["end"], g["strand"], promoter))
    genes = genomes.select(*keys, F.posexplode(texts).alias("gene_idx", "_t"))
    chunks = genes.select(*keys, "gene_idx", F.posexplode(seq.chunk(F.col("_t"), size, overlap)).alias("chunk_idx", "text"))
    return chunks.filter(F.length("text") >= least)


def embed_dna_genes(genomes: DataFrame, genome: str, dna: str | None = None, embedder: Embedder | None = None, **cut: int) -> DataFrame:
    """One mean vector per gene; a gene without a chunk long enough keeps its place with a null vector."""
    dna = dna or nested.resolve_column(genomes, nested.DNA_COLUMNS)
    vectors = embed_texts(gene_chunks(genomes, [genome], dna, **cut), "text", embedder)
    pooled = pooling.pool(vectors, [genome, "gene_idx"], "embedding")
    every = genomes.select(genome, F.posexplode("start").alias("gene_idx", "_start")).drop("_start")
    return every.join(pooled, [genome, "gene_idx"], "left")


def embed_whole_genome(genomes: DataFrame, genome: str, dna: str, pooled: str, model: models.Model, size: int = 512, overlap: int = 32) -> DataFrame:
    """One vector per genome from the chunks of all its contigs; a pooling must be named. Chunks that the model fails on are left out."""
    chunks = genomes.select(genome, F.posexplode(seq.chunk_genome(F.col(dna), size, overlap)).alias("chunk_idx", "text"))
    return pooling.pool(models.embed(chunks, "text", model).filter("skipped is null"), [genome], "embedding", pooled)


def genes_in_context(genomes: DataFrame, keys: Sequence[str], dna: str, size: int) -> DataFrame:
    """Each gene in a window of ``size`` bases with the place of its mask: keys, gene_idx, sequence, mask_start, mask_length."""
    spans = F.arrays_zip(F.col("start"), F.col("end"), F.col("strand"))
    windows = F.transform(spans, lambda g: seq.context_window(F.col(dna), g["start"], g["end"], g["strand"], size))
    return genomes.select(*keys, F.posexplode(windows).alias("gene_idx", "_w")).select(*keys, "gene_idx", "_w.*")
