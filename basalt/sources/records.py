"""A data source of genome records: plain files are cut into byte ranges, and contigs are chosen where they are read.

A partition is a list of ranges of about ``range_bytes`` in all: a large file is read by many tasks, many small files by one.
A record belongs to the range in which its first line begins, and is read on past the range's end. Gzipped files can't
be cut and are one range each. The option ``file_type`` drops files before anything is read; ``contigs`` drops a record
at its head, so its letters are neither held nor sent to the JVM. Both are options, and filters of a DataFrame stay with
Spark: a Python source keeps what was last pushed to it for all queries of one frame, which would lose their rows.

Defined cases: text before a file's first record belongs to none; a record without a name has the name ``""``; a file
without records and a folder without genome files give no rows; bytes that aren't UTF-8 become U+FFFD; a record of 2 GB
or more raises an error that names its place. Hidden files (``_`` and ``.`` first) are left out.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, file_type string, offset long, contig_name string, record string"
RANGE_BYTES = 64 << 20
BLOCK = 1 << 20
#: Bytes of records in a batch, and what one string may hold.
BATCH_BYTES, MOST_BYTES = 8 << 20, (1 << 31) - 1
#: How the first line of a record begins; what ends the head in which its name stands; the name.
MARKS = {"fna": b">", "gbff": b"LOCUS"}
HEADS = {"fna": b"\n", "gbff": b"\nFEATURES"}
NAMES = {"fna": re.compile(rb"^>(\S*)"), "gbff": re.compile(rb"^VERSION[ \t]+(\S+)", re.MULTILINE)}


def file_type_of(path: str) -> str | None:
    """``fna``, ``gbff`` or ``gff``, by the end of a file's name; none for other files."""
    found = re.search(r"\.(fna|gbff|gff)(\.gz)?$", path)
    return found and found.group(1)


def name_of(head: bytes, file_type: str) -> str:
    found = NAMES[file_type].search(head)
    return found.group(1).decode("utf-8", "replace") if found else ""


def records_of(stream: BinaryIO, file_type: str, start: int, end: float, wanted: Callable[[str], bool] = lambda _: True, block: int = BLOCK) -> Iterator[tuple[int, str, bytes]]:
    """Place, name and bytes of each wanted record whose first line begins in ``[start, end)``. Holds one record at a time,
    and of an unwanted one no more than its head."""
    mark, closing = b"\n" + MARKS[file_type], HEADS[file_type]
    if start:
        stream.seek(start - 1)
        held, base = bytearray(), start - 1
    else:
        held, base = bytearray(b"\n"), -1  # as if a line ended before the file
    looked = head = 0  # where to search on for the next record, for the end of the head
    inside, name = False, None

    while True:
        at = held.find(mark, looked)
        if inside and name is None:  # judged as soon as the head is whole
            stop = held.find(closing, head, at if at >= 0 else len(held))
            head = max(0, (at if at >= 0 else len(held)) - len(closing))
            if stop >= 0 or at >= 0:
                name = name_of(bytes(held[: stop if stop >= 0 else at]), file_type)
                inside = wanted(name)
        if at >= 0:
            if inside:
                yield base, name, bytes(held[: at + 1])
            if base + at + 1 >= end:
                return
            base += at + 1
            del held[: at + 1]
            looked = head = 0
            inside, name = True, None
            continue
        looked = max(0, len(held) - len(mark) + 1)
        if not inside:
            if base + looked + 1 >= end:
                return
            base += looked
            del held[:looked]
            looked = 0
        elif len(held) > MOST_BYTES:
            raise ValueError(f"the record at byte {base} has 2 GB or more")
        more = stream.read(block)
        if not more:
            if inside and name is None:
                name = name_of(bytes(held), file_type)
                inside = wanted(name)
            if inside:
                yield base, name, bytes(held)
            return
        held += more


def ranges_of(files: list[tuple[str, int]], range_bytes: int) -> list[list[tuple[str, int, float]]]:
    """Files cut and packed into lists of about ``range_bytes``; a gzipped file ends where its stream does."""
    out: list[list[tuple[str, int, float]]] = []
    room = 0
    for path, size in sorted(files):
        step = size if path.endswith(".gz") else range_bytes
        for lo in range(0, size, max(1, step)):
            n = min(step, size - lo)
            if n > room or not out:
                out.append([])
                room = range_bytes
            out[-1].append((path, lo, float("inf") if path.endswith(".gz") else lo + n))
            room -= n
    return out


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, float]]) -> None:
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, file_type: str | None, contigs: list[str] | None) -> None:
        if file_type is not None and file_type not in MARKS:
            raise ValueError(f"file_type must be one of {', '.join(MARKS)}")
        self.path, self.range_bytes, self.file_type = path, range_bytes, file_type
        self.contigs = None if contigs is None else frozenset(contigs)

    def _kind(self, path: str) -> str | None:
        """The type of a file that is to be read."""
        kind = file_type_of(path) or self.file_type
        return kind if kind in MARKS and self.file_type in (None, kind) else None

    def _wanted(self, contig: str) -> bool:
        return self.contigs is None or contig in self.contigs

    def partitions(self) -> list[InputPartition]:
        where, folder = _opened(self.path)
        info = where.get_file_info(folder)
        found = [info] if info.is_file else where.get_file_info(fs.FileSelector(folder, recursive=True))
        files = [(f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "_." and self._kind(f.base_name)]
        return [_Ranges(r) for r in ranges_of(files, self.range_bytes)] or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        where, _ = _opened(self.path)
        rows: list[tuple] = []
        held = 0
        for path, lo, hi in partition.ranges:
            kind = self._kind(path)
            with where.open_input_file(path) as file:
                stream = gzip.GzipFile(fileobj=file) if path.endswith(".gz") else file
                for offset, name, record in records_of(stream, kind, lo, hi, self._wanted):
                    if rows and held + len(record) > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                    rows.append((path, kind, offset, name, record.decode("utf-8", "replace")))
                    held += len(record)
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([("file", pa.string()), ("file_type", pa.string()), ("offset", pa.int64()), ("contig_name", pa.string()), ("record", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class GenomeRecords(DataSource):
    """``spark.read.format("genome_records").option("range_bytes", n).load(path)``; ``contigs`` is a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "genome_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        contigs = self.options.get("contigs")
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), self.options.get("file_type"), None if contigs is None else json.loads(contigs))


def genome_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, file_type: str | None = None, contigs: list[str] | None = None) -> DataFrame:
    """Records of the ``.fna[.gz]`` and ``.gbff[.gz]`` files below ``path``: file, file_type, offset (of the first byte, in a
    gzipped file of the unpacked text), contig_name, record. With a ``file_type`` only files of that type, to which files
    count whose name tells none; with ``contigs`` only theirs."""
    spark.dataSource.register(GenomeRecords)
    options = {"range_bytes": str(range_bytes)} | ({"file_type": file_type} if file_type else {}) | ({"contigs": json.dumps(contigs)} if contigs is not None else {})
    return spark.read.format("genome_records").options(**options).load(path)
