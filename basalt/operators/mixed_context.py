"""Contigs as mixed text: proteins in upper case, the DNA between them in lower case, a strand mark before each.

A mark and a letter are a token each. Elements are cut once per contig, at the contig's row; every gene's window
is then a range of elements, found from their lengths alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.sequence import BACKWARD, FORWARD, mixed_windows, sanitize_dna, sanitize_protein, slice_dna
from basalt.functions.vectors import bound

DEFAULT_SIZE = 4096


def _mark(strand: Column) -> Column:
    return F.when(F.coalesce(strand, F.lit(1)) >= 0, FORWARD).otherwise(BACKWARD)


def mixed_elements(genes: DataFrame, contigs: DataFrame, contig: str = "contig_name") -> DataFrame:
    """(contig, element_idx, gene_idx, mark, seq): genes and the DNA between them, by the previous gene's end, flanks included.

    ``genes``: contig, gene_idx, start, end (1-based inclusive), strand, protein_sequence; ``contigs``: contig, dna_sequence.
    """
    order = Window.partitionBy(contig).orderBy("start", "gene_idx")
    placed = genes.select(contig, "start", "end", F.col("gene_idx").cast("long").alias("gene_idx"), _mark(F.col("strand")).alias("mark"), F.upper(F.coalesce("protein_sequence", F.lit(""))).alias("protein"))
    placed = placed.withColumn("place", F.row_number().over(order)).withColumn("from", F.coalesce(F.lag("end").over(order), F.lit(0)) + 1)
    listed = placed.groupBy(contig).agg(F.array_sort(F.collect_list(F.struct("place", "from", "start", "end", "gene_idx", "mark", "protein"))).alias("genes"))
    cut = lambda dna, a, b: F.lower(slice_dna(dna, a, b - a + 1))

    def element(gene_idx: Column, mark: Column, text: Column) -> Column:
        return F.struct(gene_idx.alias("gene_idx"), mark.alias("mark"), text.alias("seq"))

    none, plus = F.lit(None).cast("long"), F.lit(FORWARD)
    before = lambda dna, g: F.when(g["from"] < g["start"], F.array(element(none, plus, cut(dna, g["from"], g["start"] - 1)))).otherwise(F.array().cast("array<struct<gene_idx:bigint,mark:string,seq:string>>"))
    # the contig's bytes are bound: a cast inside the lambda copies the contig for each gene
    parts = lambda dna: F.transform("genes", lambda g: F.concat(before(dna, g), F.array(element(g["gene_idx"], g["mark"], g["protein"]))))
    body = F.flatten(bound(F.col("dna_sequence").cast("binary"), parts))
    last = F.element_at("genes", -1)["end"]
    tail = F.when(last < F.length("dna_sequence"), F.array(element(none, plus, cut(F.col("dna_sequence"), last + 1, F.length("dna_sequence"))))).otherwise(F.array().cast("array<struct<gene_idx:bigint,mark:string,seq:string>>"))
    return contigs.select(contig, "dna_sequence").join(listed, contig).select(contig, F.posexplode(F.concat(body, tail)).alias("element_idx", "e")).select(contig, "element_idx", "e.*")


def contig_texts(elements: DataFrame, contig: str = "contig_name") -> DataFrame:
    """(contig, text): all elements of a contig in order, letters sanitised."""
    clean = F.when(F.col("gene_idx").isNotNull(), sanitize_protein(F.col("seq"))).otherwise(sanitize_dna(F.col("seq")))
    part = elements.select(contig, "element_idx", F.concat("mark", clean).alias("part"))
    return part.groupBy(contig).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_idx", "part"))), lambda s: s["part"]), "").alias("text"))


def contig_windows(elements: DataFrame, size: int, overlap: int, contig: str = "contig_name") -> DataFrame:
    """Windows over contig texts: contig, window_idx, text."""
    return contig_texts(elements, contig).select(contig, F.posexplode(mixed_windows(F.col("text"), size, overlap)).alias("window_idx", "text"))


def balanced_range(lengths: Sequence[int] | np.ndarray, focus: int, size: int) -> tuple[int, int, int, int]:
    """The tokens that elements left and right of ``focus`` give to its window: whole elements (left, right), then tokens of the next one (left, right).

    Elements are added on the side that has given fewer tokens so far, left first among equals, until the window is full.
    """
    room = size - int(lengths[focus])
    given, whole, part, ends = [0, 0], [0, 0], [0, 0], [focus, len(lengths) - focus - 1]
    while room > 0 and (whole[0] < ends[0] or whole[1] < ends[1]):
        side = 0 if given[0] <= given[1] else 1
        if whole[side] == ends[side]:
            side = 1 - side
        n = int(lengths[focus - whole[0] - 1] if side == 0 else lengths[focus + whole[1] + 1])
        if n > room:
            part[side] = room
            break
        whole[side] += 1
        given[side] += n
        room -= n
    return whole[0], whole[1], part[0], part[1]


def _windows(marks: list[str], seqs: list[str], genes: list[int | None], size: int) -> Iterator[tuple[int, str, int, int]]:
    """gene_idx, text, mask_start and mask_length of each gene among the elements of one contig, in their order."""
    lengths = [1 + len(s) for s in seqs]
    upto = list(accumulate(lengths, initial=0))
    for at, gene in enumerate(genes):
        if gene is None:
            continue
        left, right, some_left, some_right = balanced_range(lengths, at, size)
        lo, hi = at - left, at + right
        text = "".join(marks[i] + seqs[i] for i in range(lo, hi + 1))
        before = upto[at] - upto[lo]
        if some_left:
            text = marks[lo - 1] + (seqs[lo - 1][-(some_left - 1) :] if some_left > 1 else "") + text
            before += some_left
        if some_right:
            text += marks[hi + 1] + seqs[hi + 1][: some_right - 1]
        missing = size - (upto[hi + 1] - upto[lo]) - some_left - some_right
        if missing > 0:
            text += FORWARD + "n" * (missing - 1)
        elif missing < 0:  # the gene alone is longer than the window
            text = text[: size - 1 + len(FORWARD)]
        yield gene, text, before + 1, min(lengths[at], size - before) - 1


#: Windows in one batch.
_AT_ONCE = 1000
_NAMES = ["gene_idx", "text", "mask_start", "mask_length"]


def _by_contig(size: int, contig: str):
    """Elements come contig by contig in their order; a task holds one contig and one batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, of, held = None, None, ([], [], [])

        def ended() -> Iterator[pa.RecordBatch]:
            rows = list(_windows(*held, size))
            for lo in range(0, len(rows), _AT_ONCE):
                some = list(zip(*rows[lo : lo + _AT_ONCE], strict=True))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(some[0]), kind), *(pa.array(c, t) for c, t in zip(some, types, strict=True))], names=[contig, *_NAMES])

        for batch in batches:
            kind = batch.schema.field(contig).type
            columns = [batch.column(c).to_pylist() for c in (contig, "mark", "seq", "gene_idx")]
            names = columns[0]
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held[0] and names[lo] != of:
                    yield from ended()
                    held = ([], [], [])
                of = names[lo]
                for mine, column in zip(held, columns[1:], strict=True):
                    mine.extend(column[lo:hi])
        if held[0]:
            yield from ended()

    return task


def genes_in_mixed_context(elements: DataFrame, size: int = DEFAULT_SIZE, contig: str = "contig_name") -> DataFrame:
    """(contig, gene_idx, text, mask_start, mask_length): each gene amid its neighbours in exactly ``size`` tokens.

    A cut element keeps its mark and the letters nearest to the gene; n pads the end. The mask covers the gene's
    residues, in tokens from 0. A task holds one contig's elements.
    """
    kind = elements.schema[contig].dataType.simpleString()
    ordered = elements.select(contig, "element_idx", "mark", "seq", "gene_idx").repartition(contig).sortWithinPartitions(contig, "element_idx")
    return ordered.mapInArrow(_by_contig(size, contig), f"{contig} {kind}, gene_idx long, text string, mask_start long, mask_length long")
