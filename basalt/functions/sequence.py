"""DNA and protein text as column expressions.

Positions are 1-based and inclusive unless said otherwise. DNA is sliced as binary, which finds a position in
constant time; that holds for ASCII text only, which sequences are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strand marks of mixed protein and DNA text.
FORWARD, BACKWARD = "<+>", "<->"


def slice_dna(dna: Column, start: Column, length: Column) -> Column:
    """``length`` characters from 1-based ``start``; shorter at the end, empty for a length below 1."""
    length = F.greatest(length, F.lit(0)).cast("int")
    return F.substring(dna.cast("binary"), start.cast("int"), length).cast("string")


def gene_with_promoter(dna: Column, start: Column, end: Column, strand: Column, promoter: int = 128) -> Column:
    """A gene with what lies before it: left of it on the forward strand, right on the other, both sides without a strand. Upper case."""
    n = F.length(dna)
    left = F.when(strand.isNull() | (strand > 0), promoter).otherwise(0)
    right = F.when(strand.isNull() | ~(strand > 0), promoter).otherwise(0)
    first = F.greatest(start - left, F.lit(1))
    last = F.least(end + right, n)
    return F.upper(slice_dna(dna, first, last - first + 1))


def chunk(sequence: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of ``size`` characters, each sharing ``overlap`` with the one before; the last may be short; none for an empty text."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    step = size - overlap
    n = F.length(sequence)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)) * step
    starts = F.sequence(F.lit(0), last.cast("int"), F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda i: slice_dna(sequence, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunk_genome(dna: Column, size: int, overlap: int = 0) -> Column:
    """Chunks of every contig of a text in which white space parts the contigs."""
    return F.flatten(F.transform(F.filter(F.split(dna, r"\s+"), lambda c: c != ""), lambda c: chunk(c, size, overlap)))


def reverse_complement(dna: Column) -> Column:
    """Bases ACGT in either case are complemented; other letters stay."""
    return F.reverse(F.translate(dna, "ACGTacgt", "TGCAtgca"))


def promoter_and_protein(dna: Column, protein: Column, start0: Column, end0: Column, strand: Column, promoter: int, most: int) -> Column:
    """Promoter in lower case, strand mark, protein; positions 0-based, half open; cut to ``most`` characters."""
    forward = F.coalesce(strand, F.lit(1)) > 0
    before = F.greatest(start0 - promoter, F.lit(0))
    left = slice_dna(dna, before + 1, start0 - before)
    right = reverse_complement(slice_dna(dna, end0 + 1, F.lit(promoter)))
    text = F.concat(F.lower(F.when(forward, left).otherwise(right)), F.when(forward, FORWARD).otherwise(BACKWARD), protein)
    return F.substring(text, 1, most)


def spaced_residues(protein: Column) -> Column:
    """Rare residues U, Z, O, B become X; a space between residues."""
    return F.trim(F.regexp_replace(F.regexp_replace(protein, "[UZOB]", "X"), "(.)", "$1 "))


def prefixed(protein: Column, prefix: str = "1") -> Column:
    return F.concat(F.lit(prefix), protein)


def sanitize_protein(protein: Column) -> Column:
    """Null is empty; upper case; letters that are no residue become X."""
    return F.regexp_replace(F.upper(F.coalesce(protein, F.lit(""))), "[^ACDEFGHIKLMNPQRSTVWYXBZUO]", "X")


def sanitize_dna(dna: Column, replace: bool = True) -> Column:
    """Null is empty; lower case; what is no base becomes a."""
    lowered = F.lower(F.coalesce(dna, F.lit("")))
    return F.regexp_replace(lowered, "[^acgt]", "a") if replace else lowered


def last_strand_mark(text: Column) -> Column:
    """The last strand mark of a mixed text; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit("(<[+-]>)"), F.lit(1)), F.lit(-1))


def strip_cut_mark(text: Column) -> Column:
    """Without a strand mark that a window's border has cut: at its beginning or its end."""
    return F.regexp_replace(F.regexp_replace(text, r"^(?:[+-]>|>)", ""), r"<[+-]?$", "")


def mixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of a mixed text: equally long, the last ends with the text; each begins with the strand mark that holds there."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    n = F.length(text)
    count = F.greatest(F.ceil((n - size) / step), F.lit(0)) + 1
    starts = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.greatest(F.least(i * step, n - size), F.lit(0)))

    def window(state: Column, start: Column) -> Column:
        raw = strip_cut_mark(slice_dna(text, start + 1, F.lit(size)))
        # the mark that holds is carried on: only what lies between two windows' beginnings is searched for marks
        since = F.greatest(state["at"] - 2, F.lit(0))
        mark = F.coalesce(last_strand_mark(slice_dna(text, since + 1, start + 2 - since)), state["mark"])  # one that the border cuts counts
        out = F.when(raw.rlike(r"^<[+-]>") | mark.isNull(), raw).otherwise(F.concat(mark, raw))
        return F.struct(start.cast("int").alias("at"), mark.alias("mark"), F.concat(state["out"], F.array(out)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("mark"), F.array().cast("array<string>").alias("out"))
    return F.when(n > 0, F.aggregate(starts, begin, window, lambda s: s["out"])).otherwise(F.array().cast("array<string>"))


def context_window(dna: Column, start: Column, end: Column, strand: Column, size: int) -> Column:
    """A gene in a window of exactly ``size`` bases: (sequence, mask_start, mask_length), the mask 0-based.

    Both coordinates are clamped to the contig and swapped if reversed, so a gene beyond its contig's end is its last base;
    an empty contig gives N alone and an empty mask. A gene longer than the window keeps its head
    on strand 1, else its tail. Context is half before, half after; what one side lacks the other lends; N pads
    the rest, half on each side.
    """
    n = F.length(dna)
    inside = lambda x: F.greatest(F.least(x, n), F.lit(1))
    low = F.least(inside(start), inside(end))
    high = F.when(n == 0, 0).otherwise(F.greatest(inside(start), inside(end)))
    long = high - low + 1 > size
    first = F.when(long & ~(F.coalesce(strand, F.lit(0)) == 1), high - size + 1).otherwise(low)
    last = F.when(long & (F.coalesce(strand, F.lit(0)) == 1), low + size - 1).otherwise(high)
    room = size - (last - first + 1)
    want_left = F.floor(room / 2)
    want_right = room - want_left
    have_left, have_right = first - 1, n - last
    left = F.least(have_left, want_left + F.greatest(want_right - have_right, F.lit(0)))
    right = F.least(have_right, want_right + F.greatest(want_left - have_left, F.lit(0)))
    body = slice_dna(dna, first - left, (last - first + 1) + left + right)
    missing = size - (last - first + 1) - left - right
    pad_left = F.floor(missing / 2)
    sequence = F.concat(F.repeat(F.lit("N"), pad_left.cast("int")), body, F.repeat(F.lit("N"), (missing - pad_left).cast("int")))
    return F.struct(F.upper(sequence).alias("sequence"), (pad_left + left).cast("int").alias("mask_start"), (last - first + 1).cast("int").alias("mask_length"))
