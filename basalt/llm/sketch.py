"""Count-min sketches of 64-bit keys: one per partition, merged slice by slice into what later passes look up.

The number of cells follows the amount of text, so that a cell's load is the same at every size. Cells are cut
into slices by a hash of the key; a slice has ``SLICE_BITS`` bits of cells in each row of the sketch, so a task
that merges or reads a slice holds a fixed amount, and more data mean more slices. A partition emits its sketch
sparsely (sorted cells, delta-coded), about a byte or two a key and row. Counts are 64 bits wide.

Looking up: while all slices together have ``MAX_BITS`` bits of cells at most, their bitmaps are broadcast
(64 MB a row). Beyond that keys go to their slices in a shuffle (``probe``) and those estimated to occur twice
or more come back; keys so frequent that they would pile up in one slice are listed and need no look-up. Both
ways read the same cells, so they give the same answers. An estimate is never below the true count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textkernel import mix

#: Cells of a row in one slice, as a power of two.
SLICE_BITS = 22
#: Most cells of a row that are broadcast, as a power of two; more are looked up in a shuffle.
MAX_BITS = 29
CELLS_A_KEY = 4
FLUSH_KEYS = 1 << 22
#: Keys that make up such a part of all keys are listed, at most so many of them (and a few that share their cells).
HOT_PART = 4096
HOT_LEAST = 1 << 12
_SLICE_SALT = np.uint64(0x8CB92BA72F3D8DD7)
_SALTS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03)
_PART_SCHEMA = "slice long, row int, cells binary, extra binary"
_PART = pa.schema([("slice", pa.int64()), ("row", pa.int32()), ("cells", pa.binary()), ("extra", pa.binary())])
_SLICES_SCHEMA = "slice long, row int, bitmap binary, often binary, hot binary"
_SLICES = pa.schema([("slice", pa.int64()), ("row", pa.int32()), ("bitmap", pa.binary()), ("often", pa.binary()), ("hot", pa.binary())])
PROBE_SCHEMA = "slice long, doc_id long, d1 long, d2 long, keys binary, extra binary"
_PROBE = pa.schema([("slice", pa.int64()), ("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])


@dataclass
class Layout:
    """How keys fall into cells: ``bits`` bits of cells a row, in slices."""

    bits: int
    slice_bits: int = field(default_factory=lambda: SLICE_BITS)

    @property
    def shift(self) -> int:
        return max(0, self.bits - self.slice_bits)

    def slices(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys ^ _SLICE_SALT) >> np.uint64(64 - self.shift) if self.shift else np.zeros(len(keys), np.uint64)

    def cells(self, keys: np.ndarray, row: int, slices: np.ndarray | None = None) -> np.ndarray:
        """Numbers of cells over all slices."""
        local = self.bits - self.shift
        within = mix(keys ^ np.uint64(_SALTS[row])) >> np.uint64(64 - local)
        return ((self.slices(keys) if slices is None else slices) << np.uint64(local)) | within


def layout(texts: DataFrame, bytes_a_key: float) -> tuple[Layout, int]:
    """A layout with ``CELLS_A_KEY`` cells or more for each of the keys that so many bytes of ``text`` hold, and that number of keys."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    keys = int(size / bytes_a_key) + 1
    return Layout(max(16, (keys * CELLS_A_KEY - 1).bit_length())), keys


def _pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _part(keys: list[np.ndarray], depth: int, at: Layout) -> Iterator[pa.RecordBatch]:
    every = np.concatenate(keys)
    slices = at.slices(every)
    local = np.uint64(at.bits - at.shift)
    for row in range(depth):
        cells, counts = np.unique(at.cells(every, row, slices), return_counts=True)
        which = cells >> local
        cuts = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(cells))
        out: dict[str, list] = {n: [] for n in _PART.names}
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            c, n = cells[lo:hi] - (which[lo] << local), counts[lo:hi]
            more = np.flatnonzero(n > 1)
            out["slice"].append(int(which[lo]))
            out["row"].append(row)
            out["cells"].append(_pack(np.diff(c, prepend=np.uint64(0))))
            out["extra"].append(_pack(np.concatenate([more, np.minimum(n[more] - 1, (1 << 32) - 1)])) if len(more) else b"")
        yield pa.RecordBatch.from_pydict(out, schema=_PART)


def part_sketch(keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], depth: int, at: Layout) -> Callable:
    """A ``mapInArrow`` function that sketches the keys of its partition."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for x in keys(batch):
                held.append(x)
                n += len(x)
                if n >= FLUSH_KEYS:
                    yield from _part(held, depth, at)
                    held, n = [], 0
        if n:
            yield from _part(held, depth, at)

    return task


@dataclass
class Lookup:
    """Cells [first, first + cells held) of a merged sketch: bitmaps of what was counted twice, and levels of frequent cells."""

    at: Layout
    first: int
    repeated: list[np.ndarray]
    frequent: np.ndarray
    levels: np.ndarray

    def seen(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key may have been counted twice (false only where it was not), and the level of its count:
        the whole base-2 logarithm, 0 below the least listed."""
        ok, level = np.ones(len(keys), bool), np.zeros(len(keys), np.uint8)
        slices = self.at.slices(keys)
        for row in range(max(1, len(self.repeated))):
            cells = self.at.cells(keys, row, slices) - np.uint64(self.first)
            if self.repeated:
                bitmap = self.repeated[row]
                ok &= (bitmap[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 != 0
            if row == 0 and len(self.frequent):
                place = np.minimum(np.searchsorted(self.frequent, cells), len(self.frequent) - 1)
                level = np.where(self.frequent[place] == cells, self.levels[place], 0).astype(np.uint8)
        return ok, level


def _counted(rows: Iterator[tuple[bytes, bytes]], cells: int) -> np.ndarray:
    """Counts of a slice's cells, added up over partitions; 64 bits wide."""
    counts = np.zeros(cells, np.int64)
    for packed, extra in rows:
        at = np.cumsum(_unpack(packed), dtype=np.int64)
        counts[at] += 1
        if extra:
            more = _unpack(extra)
            half = len(more) // 2
            counts[at[more[:half]]] += more[half:].astype(np.int64)
    return counts


def _merge(at: Layout, least: int, hot: int) -> Callable:
    size = 1 << (at.bits - at.shift)

    def listed(counts: np.ndarray, threshold: int) -> bytes:
        some = np.flatnonzero(counts >= threshold)
        return some.astype("<u4").tobytes() + np.log2(counts[some]).astype(np.uint8).tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in _PART.names), strict=True)

        every, ahead = rows(), None
        ahead = next(every, None)
        while ahead is not None:
            key = ahead[:2]

            def own() -> Iterator[tuple[bytes, bytes]]:
                nonlocal ahead
                while ahead is not None and ahead[:2] == key:  # noqa: B023  used up before the key changes
                    yield ahead[2:]
                    ahead = next(every, None)

            counts = _counted(own(), size)
            bitmap = zstandard.compress(np.packbits(counts > 1, bitorder="little").tobytes(), 1)
            first = key[1] == 0
            yield pa.RecordBatch.from_pydict({"slice": [key[0]], "row": [key[1]], "bitmap": [bitmap], "often": [listed(counts, least) if first else b""], "hot": [listed(counts, hot) if first else b""]}, schema=_SLICES)

    return task


def _listed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n), np.frombuffer(data, np.uint8, n, 4 * n)


@dataclass
class Sketch:
    """A merged sketch, one row a slice and row of it, in the shared folder."""

    at: Layout
    depth: int
    slices: DataFrame

    @property
    def broadcast(self) -> bool:
        """Whether its bitmaps are small enough for every task."""
        return self.at.bits <= MAX_BITS

    def lookup(self, what: str = "all") -> Lookup:
        """``all``: all bitmaps and frequent cells. ``hot``: only the hottest cells, bounded by ``HOT_PART``. ``both``: bitmaps and
        the hottest cells."""
        local = self.at.bits - self.at.shift
        bitmaps = [np.zeros(1 << (self.at.bits - 3), np.uint8) for _ in range(self.depth)] if what != "hot" else []
        often, levels = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        cells = F.col("often" if what == "all" else "hot").alias("often")
        wanted = self.slices.select("slice", "row", "bitmap", cells) if what != "hot" else self.slices.select("slice", cells).filter(F.octet_length("often") > 0)
        for row in wanted.toLocalIterator():
            if what != "hot":
                part = np.frombuffer(zstandard.decompress(bytes(row["bitmap"])), np.uint8)
                bitmaps[row["row"]][row["slice"] << (local - 3) : (row["slice"] + 1) << (local - 3)] = part
            c, n = _listed(bytes(row["often"]))
            often.append(c.astype(np.uint64) + np.uint64(row["slice"] << local))
            levels.append(n)
        cells = np.concatenate(often)
        order = np.argsort(cells)
        return Lookup(self.at, 0, bitmaps, cells[order], np.concatenate(levels)[order])


def build(texts: DataFrame, keys: Callable, depth: int, bytes_a_key: float, least: int = 1 << 62, most_bits: int = 64) -> Sketch:
    """Sketch the ``keys`` of all ``texts`` (a column ``text``). Cells of ``least`` keys or more are listed with their level.
    A sketch of ``most_bits`` bits of cells gets no larger; beyond that its cells hold more keys."""
    at, expected = layout(texts, bytes_a_key)
    at = Layout(min(at.bits, most_bits))
    parts = texts.select("text").mapInArrow(part_sketch(keys, depth, at), _PART_SCHEMA)
    merged = parts.repartition("slice", "row").sortWithinPartitions("slice", "row").mapInArrow(_merge(at, least, max(HOT_LEAST, expected // HOT_PART)), _SLICES_SCHEMA)
    return Sketch(at, depth, materialize(merged, "sketch"))


def probe_rows(at: Layout, hot: Lookup, owner: np.ndarray, keys: np.ndarray, extra: np.ndarray | None, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """Keys packed by their owner (a place in each of ``columns``: doc_id, d1, d2) and slice. ``extra``: 64 bits a key, or none.

    Hot keys get slices below zero, dealt out over many: they are known to be repeated.
    """
    if not len(keys):
        return
    slices = at.slices(keys).astype(np.int64)
    cells = at.cells(keys, 0)
    if len(hot.frequent):
        place = np.minimum(np.searchsorted(hot.frequent, cells), len(hot.frequent) - 1)
        slices = np.where(hot.frequent[place] == cells, -1 - (mix(owner.astype(np.uint64) ^ keys) >> np.uint64(44)).astype(np.int64), slices)
    order = np.lexsort((slices, owner))
    owner, slices, keys = owner[order], slices[order], keys[order]
    parts = [keys, keys[:0] if extra is None else extra[order]]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (slices[1:] != slices[:-1])))
    cuts = np.append(new, len(keys)) * 8
    packed = [pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(np.minimum(cuts, 8 * len(x)).astype("<i4").tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())]) for x in parts]
    yield pa.RecordBatch.from_arrays([pa.array(slices[new]), *(c.take(pa.array(owner[new])) for c in columns), *packed], schema=_PROBE)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive ``sizes`` of values as one binary value each."""
    offsets = np.append(0, np.cumsum(sizes)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _answer(at: Layout, hot_level: int) -> Callable:
    local = at.bits - at.shift
    schema = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.binary()), ("levels", pa.binary()), ("extra", pa.binary())])

    def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All 64-bit values of a binary column, and how many each row has."""
        sizes = np.diff(np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]) // 8
        return np.frombuffer(b"".join(x for x in column.to_pylist() if x), "<u8"), sizes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, None
        for batch in batches:
            slices, kinds = (batch.column(n).to_numpy() for n in ("slice", "kind"))
            cuts = np.flatnonzero(np.append(True, (slices[1:] != slices[:-1]) | (kinds[1:] != kinds[:-1]))).tolist() + [len(slices)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                s = int(slices[lo])
                if kinds[lo] < 0:  # a row of the slice's sketch
                    if s != number:
                        held, number = Lookup(at, s << local, [], np.zeros(0, np.uint64), np.zeros(0, np.uint8)), s
                    held.repeated.append(np.frombuffer(zstandard.decompress(part.column("keys")[0].as_py()), np.uint8))
                    c, n = _listed(part.column("extra")[0].as_py())
                    if len(c):
                        held.frequent, held.levels = c.astype(np.uint64), n
                    continue
                keys, sizes = whole(part.column("keys"))
                extra, _ = whole(part.column("extra"))
                ok, level = held.seen(keys) if s >= 0 else (np.ones(len(keys), bool), np.full(len(keys), hot_level, np.uint8))
                kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes), ok, len(sizes)).astype(np.int64)
                some = kept > 0
                packed = [_binary(keys[ok], kept[some]), _binary(level[ok], kept[some]), _binary(extra[ok], kept[some]) if len(extra) else pa.array([b""] * int(some.sum()), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(n).filter(pa.array(some)) for n in ("doc_id", "d1", "d2")), *packed], schema=schema)

    return task


def probe(sketch: Sketch, rows: DataFrame, hot_level: int) -> DataFrame:
    """Answers to ``rows`` of ``PROBE_SCHEMA``: (doc_id, d1, d2, answers), the keys that may be repeated with their levels and
    extras, as lists of packed rows. Each slice's sketch goes before its keys; a task holds one slice at a time."""
    none = F.lit(None).cast("long")
    sketches = sketch.slices.select("slice", (F.col("row") - 100).alias("kind"), none.alias("doc_id"), none.alias("d1"), none.alias("d2"), F.col("bitmap").alias("keys"), F.col("often").alias("extra"))
    asked = rows.select("slice", F.lit(0).alias("kind"), "doc_id", "d1", "d2", "keys", "extra")
    answers = sketches.unionByName(asked).repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(_answer(sketch.at, hot_level), "doc_id long, d1 long, d2 long, keys binary, levels binary, extra binary")
    return answers.groupBy("doc_id", "d1", "d2").agg(F.collect_set(F.struct("keys", "levels", "extra")).alias("answers"))
