"""TIFF: writing grey 8-bit pages, and reading pages by walking the image directories.

Read: either byte order, strips or tiles, no compression, PackBits, LZW or deflate, horizontal differencing, any
number of unsigned samples of 1, 2, 4, 8 or 16 bits a pixel, interleaved or in planes, either order of bits. A page of
more than ``MOST_BYTES`` or a block that holds less than it should is an error of that page. Fixed values (public
format): tag and compression numbers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: tags.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, FILL_ORDER, SAMPLE_FORMAT = 284, 266, 339
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
# Fixed values of the format: compressions.
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
_CLEAR, _END, _FIRST, _FULL = 256, 257, 258, 4094
_SIZES = {1: "B", 3: "H", 4: "I"}
#: Largest page, in bytes of its samples, and most directories of a file.
MOST_BYTES = 1 << 28
MOST_PAGES = 1 << 16
_TURNED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1).ravel()


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as such, all else literally."""
    x = np.frombuffer(data, np.uint8)
    out = bytearray()
    if not len(x):
        return b""
    edge = np.flatnonzero(np.diff(x)) + 1
    starts = np.concatenate([[0], edge])
    ends = np.concatenate([edge, [len(x)]])
    long = ends - starts >= 3
    at = 0

    def literal(upto: int) -> None:
        for lo in range(at, upto, 128):
            hi = min(lo + 128, upto)
            out.append(hi - lo - 1)
            out.extend(data[lo:hi])

    for lo, hi in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        literal(lo)
        at = hi
        for n in range(lo, hi, 128):
            n = min(128, hi - n)
            out.append(257 - n if n > 1 else 0)
            out.append(data[lo])
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, n, held = [], 0, len(data), 0
    while at < n and held < size:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            held += head + 1
            at += head + 2
        elif head > 128:
            out.append(data[at + 1 : at + 2] * (257 - head))
            held += 257 - head
            at += 2
        else:
            at += 1
    return b"".join(out)[:size]


def _widths(n: int) -> np.ndarray:
    """Bits of the codes that follow a clear code: a width ends with the code after which the writer's table is one short of full."""
    entries = _FIRST + np.arange(n)
    return np.where(entries <= 511, 9, np.where(entries <= 1023, 10, np.where(entries <= 2047, 11, 12)))


_WIDTHS = _widths(_FULL)
_BEGINS = np.concatenate([[0], np.cumsum(_WIDTHS)])


def lzw_encode(data: bytes) -> bytes:
    codes, widths = [_CLEAR], [9]
    table: dict[int, int] = {}
    segment: list[int] = []
    prefix, following = -1, _FIRST
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        longer = prefix << 8 | byte
        known = table.get(longer)
        if known is not None:
            prefix = known
            continue
        segment.append(prefix)
        table[longer] = following
        following += 1
        prefix = byte
        if following == _FULL:
            segment.append(_CLEAR)
            codes += segment
            widths += _WIDTHS[: len(segment)].tolist()
            segment, following = [], _FIRST
            table.clear()
    if prefix >= 0:
        segment.append(prefix)
    segment.append(_END)
    codes += segment
    widths += _WIDTHS[: len(segment)].tolist()
    code, width = np.array(codes), np.array(widths)
    begin = np.cumsum(width) - width
    bits = np.zeros(int(width.sum()), np.uint8)
    for bit in range(12):  # the bit that stands so far from a code's end
        some = width > bit
        bits[begin[some] + width[some] - 1 - bit] = (code[some] >> bit) & 1
    return np.packbits(bits).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    n_bits = len(data) * 8
    out: list[bytes] = []
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    at = 0
    while at + 9 <= n_bits:
        n = int(np.searchsorted(_BEGINS, n_bits - at, side="right")) - 1
        begin = at + _BEGINS[:n]
        byte = begin >> 3
        word = (padded[byte] << 24) | (padded[byte + 1] << 16) | (padded[byte + 2] << 8) | padded[byte + 3]
        width = _WIDTHS[:n]
        codes = (word >> (32 - width - (begin & 7)).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == _CLEAR) | (codes == _END))
        ended = not len(stop) or codes[stop[0]] == _END
        used = int(stop[0]) if len(stop) else n
        table = list(singles)
        last = b""
        for code in codes[:used].tolist():
            if code < len(table):
                word_bytes = table[code]
            elif code == len(table):
                word_bytes = last + last[:1]
            else:
                raise ValueError("LZW code beyond the table")
            out.append(word_bytes)
            if last:
                table.append(last + word_bytes[:1])
            last = word_bytes
        if ended:
            break
        at += int(_BEGINS[used + 1])
    return b"".join(out)[:size]


def _compress(data: bytes, compression: int) -> bytes:
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 6) if compression == DEFLATE else data


def _expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == PACKBITS:
        return packbits_decode(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, 32946):
        return zlib.decompressobj().decompress(data, size)
    if compression == NONE:
        return data
    raise ValueError(f"compression {compression} is not supported")


def _difference(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def write(pages: list[np.ndarray], compression: int = NONE, predictor: int = 1, tile: int = 0, strip_rows: int = 64) -> bytes:
    """A little-endian file of grey pages; with ``tile``, square tiles of so many pixels instead of strips."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        rows, width = page.shape
        blocks = []
        if tile:
            padded = np.pad(page, ((0, -rows % tile), (0, -width % tile)))
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, rows, tile) for x in range(0, width, tile)]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, rows, strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            data = _compress((_difference(block) if predictor == 2 else block).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        tags = {WIDTH: (4, [width]), LENGTH: (4, [rows]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1])}
        if predictor != 1:
            tags[PREDICTOR] = 3, [predictor]
        if tile:
            tags |= {TILE_WIDTH: (4, [tile]), TILE_LENGTH: (4, [tile]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)}
        else:
            tags |= {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [strip_rows]), STRIP_COUNTS: (4, counts)}
        out += b"\0" * (len(out) % 2)
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            data = struct.pack(f"<{len(values)}{_SIZES[kind]}", *values)
            if len(data) > 4:
                at = len(out)
                out += data
                data = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


@dataclass
class Page:
    """``pixels``: length x width for one sample a pixel, else length x width x samples; 16-bit samples as such, all others as bytes."""

    width: int
    length: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray
    bits: int = 8
    samples: int = 1


def _directories(data: bytes, end: str) -> Iterator[dict[int, tuple[int, ...]]]:
    (at,) = struct.unpack_from(end + "I", data, 4)
    walked: set[int] = set()
    while at and at not in walked and len(walked) < MOST_PAGES:
        walked.add(at)
        (n,) = struct.unpack_from(end + "H", data, at)
        tags: dict[int, tuple[int, ...]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(end + "HHI", data, at + 2 + 12 * i)
            if kind not in _SIZES or count > len(data):
                continue
            form = f"{end}{count}{_SIZES[kind]}"
            place = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(end + "I", data, place)
            tags[tag] = struct.unpack_from(form, data, place)
        yield tags
        (at,) = struct.unpack_from(end + "I", data, at + 2 + 12 * n)


#: What a broken file or page may raise.
BROKEN = (ValueError, IndexError, KeyError, zlib.error, OverflowError, MemoryError, struct.error)


def read_all(data: bytes) -> Iterator[Page | str]:
    """Pages in the order of the directories; for a page that can't be read its error. Raises ``ValueError`` on what is no TIFF file."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    end = "<" if data[:2] == b"II" else ">"
    directories = _directories(data, end)
    while True:
        try:
            tags = next(directories, None)
        except BROKEN as error:
            yield f"broken directory: {error}"
            return
        if tags is None:
            return
        try:
            page = _page(data, tags, end)
        except BROKEN as error:
            page = str(error) or type(error).__name__
        yield page


def read(data: bytes) -> Iterator[Page]:
    """Pages in the order of the directories. Raises ``ValueError`` at a page that can't be read."""
    for page in read_all(data):
        if isinstance(page, str):
            raise ValueError(page)
        yield page


def _samples(raw: bytes, rows: int, width: int, bits: int, end: str) -> np.ndarray:
    """Rows of samples of a decompressed block; rows begin with a byte of their own."""
    stride = -(-width * bits // 8)
    if len(raw) < rows * stride:
        raise ValueError("a block is too short")
    packed = np.frombuffer(raw, np.uint8, rows * stride).reshape(rows, stride)
    if bits == 8:
        return packed
    if bits == 16:
        return packed.view(end + "u2").astype(np.uint16)
    each = 8 // bits
    parts = np.stack([(packed >> np.uint8(8 - bits * (i + 1))) & np.uint8((1 << bits) - 1) for i in range(each)], 2)
    return parts.reshape(rows, stride * each)[:, :width]


def _page(data: bytes, tags: dict[int, tuple[int, ...]], end: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, length, compression, predictor, samples = one(WIDTH, 0), one(LENGTH, 0), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(SAMPLES, 1)
    bits = one(BITS, 1)
    if bits not in (1, 2, 4, 8, 16) or len(set(tags.get(BITS, (1,)))) > 1 or one(SAMPLE_FORMAT, 1) != 1:
        raise ValueError("only unsigned samples of 1, 2, 4, 8 or 16 bits are supported")
    if predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise ValueError(f"predictor {predictor} is not supported for samples of {bits} bits")
    if samples < 1 or width * length * samples * (2 if bits == 16 else 1) > MOST_BYTES:
        raise ValueError("the page is too large")
    planes = samples if one(PLANAR, 1) == 2 and samples > 1 else 1
    each = samples // planes  # samples that stand side by side in a block
    tiled = TILE_OFFSETS in tags
    if tiled:
        bw, bh = one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)
        if bw < 1 or bh < 1 or bw * bh * each * 2 > MOST_BYTES:
            raise ValueError("tiles of no size, or too large")
        places = [(p, y, x, bh, bw) for p in range(planes) for y in range(0, length, bh) for x in range(0, width, bw)]
        offsets, counts = tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        bh = min(one(ROWS_PER_STRIP, length), length) or 1
        places = [(p, y, 0, min(bh, length - y), width) for p in range(planes) for y in range(0, length, bh)]
        offsets = tags[STRIP_OFFSETS]
        counts = tags[STRIP_COUNTS] if STRIP_COUNTS in tags or compression != NONE else (len(data),) * len(offsets)
    if len(places) != len(offsets) or len(places) != len(counts):
        raise ValueError("another number of blocks than the page needs")
    pixels = np.zeros((length, width, samples), np.uint16 if bits == 16 else np.uint8)
    for (plane, y, x, h, w), offset, count in zip(places, offsets, counts, strict=True):
        raw = data[offset : offset + count]
        if one(FILL_ORDER, 1) == 2:
            raw = _TURNED[np.frombuffer(raw, np.uint8)].tobytes()
        block = _samples(_expand(raw, compression, h * -(-w * each * bits // 8)), h, w * each, bits, end).reshape(h, w, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        pixels[y : y + h, x : x + w, plane * each : (plane + 1) * each] = block[: length - y, : width - x]
    return Page(width, length, compression, predictor, tiled, pixels[:, :, 0] if samples == 1 else pixels, bits, samples)
