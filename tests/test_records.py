from __future__ import annotations

import gzip
import io
import random
import re

import pytest

from basalt.sources import genomes, records


GFF = "c3\tx\tCDS\t1\t9\t.\t+\t0\tlocus_tag=L\n"


def _fasta(rng: random.Random, n: int, newline: str = "\n") -> str:
    """Records of very unlike lengths, with > within headers and letters."""
    lines = []
    for i in range(n):
        lines.append(f">c{i} a>b")
        lines += ["".join(rng.choices("ACGT", k=rng.randint(1, 60))) for _ in range(rng.choice((0, 1, 2, 9)))]
    return newline.join(lines) + rng.choice(("", newline))


def _genbank(i: int, filler: int) -> str:
    cds = f'     CDS             complement({i + 1}..{i + 9})\n                     /protein_id="P{i}"\n                     /translation="MK"\n'
    return f"LOCUS       X{i}\nDEFINITION  LOCUS of\n            LOCUS\nACCESSION   X{i}\nVERSION     X{i}.1\n  ORGANISM  Testus\nFEATURES             x\n{cds}ORIGIN\n{'        1 acgt' * filler}\n//\n"


def _plain(text: bytes, kind: str) -> list[tuple[int, bytes]]:
    """Places and bytes of records by a cut at each mark that begins a line."""
    starts = [m.start() for m in re.finditer(rb"^" + records.MARKS[kind], text, re.MULTILINE)]
    return [(a, text[a:b]) for a, b in zip(starts, [*starts, len(text)][1:], strict=True)]


@pytest.mark.parametrize("kind", ["fna", "gbff"])
def test_ranges_cut_and_join_to_all_records(kind):
    rng = random.Random(1)
    for trial in range(120):
        text = (_fasta(rng, rng.randint(0, 9), rng.choice(("\n", "\r\n"))) if kind == "fna" else "".join(_genbank(i, rng.randint(0, 5)) for i in range(rng.randint(0, 4)))).encode()
        text = rng.choice((b"", b"; words before\n")) + text
        step, block = rng.randint(1, 200), rng.randint(1, 90)
        got = [r for lo in range(0, len(text), step) for r in records.records_of(io.BytesIO(text), kind, lo, min(len(text), lo + step), block=block)]
        assert [(o, r) for o, _, r in got] == _plain(text, kind), trial
        assert [n for _, n, _ in got] == [records.name_of(r, kind) for _, _, r in got]
        some = [(o, r) for lo in range(0, len(text), step) for o, _, r in records.records_of(io.BytesIO(text), kind, lo, lo + step, lambda n: n in ("c1", "c4", "X2.1"), block)]
        assert some == [(o, r) for o, n, r in got if n in ("c1", "c4", "X2.1")]


def test_unwanted_records_are_not_held():
    """A long record that nobody asks for is read past in blocks."""
    text = b">long\n" + b"ACGT" * 500_000 + b"\n>short\nAC\n"
    calls = []
    got = list(records.records_of(io.BytesIO(text), "fna", 0, len(text), lambda n: calls.append(n) or n == "short", 1_000))
    assert [(n, r) for _, n, r in got] == [("short", b">short\nAC\n")] and calls == ["long", "short"]


def test_ranges_pack_small_files_and_cut_large_ones():
    got = records.ranges_of([("a.fna", 250), ("b.fna", 10), ("c.fna", 10), ("d.fna.gz", 500), ("e.fna", 0)], 100)
    assert [[(p, lo) for p, lo, _ in r] for r in got] == [[("a.fna", 0)], [("a.fna", 100)], [("a.fna", 200), ("b.fna", 0), ("c.fna", 0)], [("d.fna.gz", 0)]]
    assert got[-1][0][2] == float("inf") and got[0][0][2] == 100


def test_source_reads_what_the_readers_read(spark, tmp_path):
    rng = random.Random(2)
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.fna").write_text(_fasta(rng, 400))
    with gzip.open(tmp_path / "deep" / "b.fna.gz", "wt") as f:
        f.write(_fasta(rng, 30, "\r\n"))
    (tmp_path / "c.gbff").write_text("".join(_genbank(i, i % 7) for i in range(60)))
    (tmp_path / "_hidden.fna").write_text(">no\nAC\n")
    (tmp_path / "notes.txt").write_text(">no\nAC\n")
    df = records.genome_records(spark, str(tmp_path), 4_000)
    assert df.rdd.getNumPartitions() > 5
    key = lambda rows: sorted(map(str, rows))
    fna = genomes.contigs_of(df.filter("file_type = 'fna'"))
    plain = genomes.fasta_contigs(spark, str(tmp_path / "a.fna")).unionByName(genomes.fasta_contigs(spark, str(tmp_path / "deep")))
    assert fna.count() == 430 and key(fna.collect()) == key(plain.collect())
    cds = genomes.cds_of(df.filter("file_type = 'gbff'"))
    assert cds.count() == 60 and key(cds.collect()) == key(genomes.gbff_cds(spark, str(tmp_path / "c.gbff")).collect())


def test_types_and_contigs_are_chosen_where_they_are_read(spark, tmp_path):
    (tmp_path / "a.fna").write_text(_fasta(random.Random(3), 200))
    (tmp_path / "c.gbff").write_text("".join(_genbank(i, 1) for i in range(20)))
    (tmp_path / "d.gff").write_text(GFF)
    every = records.genome_records(spark, str(tmp_path), 2_000)
    only = records.genome_records(spark, str(tmp_path), 2_000, file_type="gbff")
    assert only.count() == 20 and only.rdd.getNumPartitions() < every.rdd.getNumPartitions()
    names = lambda **which: sorted(r["contig_name"] for r in records.genome_records(spark, str(tmp_path), 2_000, **which).collect())
    assert names(contigs=["c3", "c150", "X4.1", "none"]) == ["X4.1", "c150", "c3"]
    assert names(contigs=["c3", "X4.1"], file_type="gbff") == ["X4.1"]
    assert names(contigs=[]) == []


def test_one_frame_in_several_queries(spark, tmp_path):
    """Filters of one query don't reach another query of the same frame, nor the other side of a join."""
    (tmp_path / "a.fna").write_text(_fasta(random.Random(4), 50))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = records.genome_records(spark, str(tmp_path), 500)
        assert df.filter("contig_name = 'c3'").count() == 1 and df.count() == 50
        assert df.filter("contig_name <> 'c3'").join(df.filter("contig_name = 'c3'").select("file"), "file").count() == 49
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_type_for_files_of_any_name(spark, tmp_path):
    (tmp_path / "part-0.txt").write_text(">c1 x\nAC\n>\nGG\n")
    assert records.genome_records(spark, str(tmp_path)).count() == 0
    got = records.genome_records(spark, str(tmp_path), file_type="fna").collect()
    assert [(r["file_type"], r["offset"], r["contig_name"], r["record"]) for r in got] == [("fna", 0, "c1", ">c1 x\nAC\n"), ("fna", 9, "", ">\nGG\n")]
    with pytest.raises(Exception, match="file_type"):
        records.genome_records(spark, str(tmp_path), file_type="gff").count()


def test_empty_folder(spark, tmp_path):
    assert records.genome_records(spark, str(tmp_path)).count() == 0
    (tmp_path / "a.fna").write_text("")
    (tmp_path / "b.fna").write_text("nothing here\n")
    assert records.genome_records(spark, str(tmp_path)).count() == 0
