"""Media columns: TIFF files in a binary column, one row per page, and texts stored as such files.

Defined cases: a null file, or one that is no TIFF, gives one row with ``page`` null and the ``error``; a page that can't be
read gives a row with its number and the ``error``, beside the file's other pages; pages of several samples or of 16 bits
have their ``pixels`` in rows of pixels, 16 bits little-endian; a null text counts as empty; an empty table gives an empty
result; equal texts give equal files; rows may repeat; other columns are kept by ``read_pages`` if named.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiff
from .common import read_table, tune
from .textkernel import as_string

WIDTH = 192
#: Rows of pixels on a page of ``store_texts``.
PAGE_ROWS = 512
#: How a text is stored, chosen by its checksum: compression, predictor, tile size (0: strips).
LAYOUTS = [
    *((c, p, 0) for c, p in ((tiff.NONE, 1), (tiff.PACKBITS, 1), (tiff.PACKBITS, 2), (tiff.LZW, 1), (tiff.DEFLATE, 1), (tiff.DEFLATE, 2))),
    *((c, p, 64) for c, p in ((tiff.NONE, 1), (tiff.PACKBITS, 1), (tiff.DEFLATE, 2), (tiff.LZW, 1), (tiff.DEFLATE, 1), (tiff.NONE, 2))),
]
_PAGES = "row long, doc_id long, n_bytes long, media_bytes long, media_sha256 string, page int, n_pages int, width int, length int, compression int, predictor int, tiled boolean, bits int, samples int, pixels binary, error string"
_PAGES_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("page", pa.int32()), ("n_pages", pa.int32()), ("width", pa.int32()), ("length", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("bits", pa.int32()), ("samples", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])
_STORED = "row long, doc_id long, n_bytes long, media binary"
#: Bytes of pixels after which a batch of pages is handed on.
_HAND_ON = 4 << 20


def payload(text: bytes) -> bytes:
    """The text's bytes, filled up with spaces to a positive multiple of ``WIDTH``."""
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    for batch in batches:
        sizes, files = [], []
        for text in as_string(batch.column("text")).cast(pa.large_binary()):
            text = text.as_py()
            data = payload(text)
            image = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
            compression, predictor, tile = LAYOUTS[zlib.crc32(data) % len(LAYOUTS)]
            sizes.append(len(text))
            files.append(tiff.write([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], compression, predictor, tile))
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_bytes": sizes, "media": files}, schema=schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text of ``docs`` (doc_id, text) as a TIFF file: row, doc_id, n_bytes, media."""
    tune(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_store, _STORED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {n: [] for n in _PAGES_ARROW.names}
    held = 0

    def put(**row) -> None:
        for n, values in out.items():
            values.append(row.get(n))

    for batch in batches:
        for row, doc, size, media in zip(*(batch.column(n).to_pylist() for n in ("row", "doc_id", "n_bytes", "media")), strict=True):
            same = {"row": row, "doc_id": doc, "n_bytes": size}
            try:
                if media is None:
                    raise ValueError("no file")
                same |= {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
                pages = list(tiff.read_all(media))
            except tiff.BROKEN as error:
                put(**same, error=str(error))
                continue
            for i, p in enumerate(pages):
                if isinstance(p, str):
                    put(**same, page=i, n_pages=len(pages), error=p)
                    continue
                pixels = p.pixels.astype("<u2").tobytes() if p.bits == 16 else p.pixels.tobytes()
                put(**same, page=i, n_pages=len(pages), width=p.width, length=p.length, compression=p.compression, predictor=p.predictor, tiled=p.tiled, bits=p.bits, samples=p.samples, pixels=pixels)
                held += len(pixels)
            if held >= _HAND_ON:
                yield pa.RecordBatch.from_pydict(out, schema=_PAGES_ARROW)
                out, held = {n: [] for n in _PAGES_ARROW.names}, 0
    if out["row"]:
        yield pa.RecordBatch.from_pydict(out, schema=_PAGES_ARROW)


def read_pages(stored: DataFrame) -> DataFrame:
    """One row per page of each file of ``stored`` (row, doc_id, n_bytes, media), in the order of its pages."""
    return stored.select("row", "doc_id", "n_bytes", "media").mapInArrow(_read, _PAGES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of one file follow each other within a task; fold them to one row. A file that can't be read whole has no row of
    this digest: its error stands in ``read_pages``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    for batch in batches:  # a file's pages may go over several batches
        out: dict[str, list] = {n: [] for n in schema.names}
        for r in batch.to_pylist():
            if r["page"] is None:
                continue
            if r["page"] == 0:
                whole = True
                sha, size, histogram = hashlib.sha256(), 0, np.zeros(256, np.int64)
            whole &= r["error"] is None
            if not whole:
                continue
            pixels = r["pixels"]
            sha.update(pixels)
            size += len(pixels)
            grey = np.frombuffer(pixels, np.uint8)
            histogram += np.bincount(grey, minlength=256)
            if r["page"] == r["n_pages"] - 1:
                total = int(histogram @ np.arange(256))
                used = np.flatnonzero(histogram)
                out["doc_id"].append(r["doc_id"])
                out["n_bytes"].append(r["n_bytes"])
                out["payload_bytes"].append(size)
                out["payload_sha256"].append(sha.hexdigest())
                out["tail_crc32"].append(zlib.crc32(pixels[-16:]))
                out["media_bytes"].append(r["media_bytes"])
                out["media_sha256"].append(r["media_sha256"])
                out["feature"].append(f"pages={r['n_pages']} width={r['width']} rows={size // r['width']} compression={r['compression']} predictor={r['predictor']} tiled={int(r['tiled'])} min={used[0]} max={used[-1]} levels={len(used)} sum={total}")
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def op7_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as TIFF, read back page by page and digested."""
    pages = read_pages(store_texts(read_table(spark, sf_dir, "documents")))
    return pages.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
