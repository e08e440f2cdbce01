"""Numpy helpers shared by the Arrow operators: whole texts to words, word hashes and window hashes.

Everything works on the UTF-8 bytes of an Arrow string column, a bounded number of bytes at a time
(one text is never cut). White space is ``[\\x20\\x09-\\x0D]``; all of it is ASCII, so bytes suffice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of a public 64-bit generator)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256
_WORD_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD_STEPS = (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)
_TAILS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
WINDOW_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


@lru_cache(maxsize=16)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n`` of each."""
    size = 1 << max(16, (n - 1).bit_length())
    if size > 1 << 23:  # one very long text: not worth keeping
        return _powers.__wrapped__(base, size), _powers.__wrapped__(pow(base, -1, 1 << 64), size)
    return _powers(base, size), _powers(pow(base, -1, 1 << 64), size)


def as_string(array: pa.Array) -> pa.Array:
    """Nulls become empty texts; the offsets are 64 bits wide."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    return array.fill_null("") if array.null_count else array


def chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of about ``limit`` bytes."""
    array = as_string(array)
    n = len(array)
    if not n:
        return
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    return solid_spans(~_WHITE[data], offsets)


def solid_spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for words that are the runs of ``solid`` bytes within a text."""
    n = len(solid)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_dictionary(data: np.ndarray, solid: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each word the place of its text in the array of distinct words. Words are told apart by their bytes."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[solid]))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def regroup(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``text``; a text is never cut."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= limit:
            yield from _joined(held)
            held, size = [], 0
    if held:
        yield from _joined(held)


def _joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    columns = [pa.concat_arrays(c.chunks) if c.num_chunks != 1 else c.chunk(0) for c in (x.cast(pa.large_string()) if x.type == pa.string() else x for x in table.columns)]
    yield pa.RecordBatch.from_arrays(columns, names=table.column_names)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hashes of words, equal for equal bytes wherever they stand. ``kind`` 0 and 1 are two unlike hashes.

    Eight bytes at a time are folded into a scrambled state, so that no pattern of letters cancels itself out;
    words of more than ``LONG_WORD`` bytes get a keyed cryptographic hash.
    """
    sizes = ends - starts
    h = mix(sizes.astype(np.uint64) + np.uint64(_WORD_SEEDS[kind]))
    if not len(sizes):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, 0, (1,))
    step = np.uint64(_WORD_STEPS[kind])
    short = np.flatnonzero(sizes <= LONG_WORD) if sizes.max() > LONG_WORD else np.arange(len(sizes))
    at, left, state = starts[short], sizes[short], h[short]
    now = np.flatnonzero(left > 0)
    while len(now):
        rest = left[now]
        lane = eight[at[now]] & _TAILS[np.minimum(rest, 8)]
        state[now] = mix((state[now] ^ lane) * step)
        at[now] += 8
        left[now] = rest - 8
        now = now[rest > 8]
    h[short] = state
    if len(short) < len(sizes):
        key = _WORD_SEEDS[kind].to_bytes(8, "little")
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return h


def window_hashes(words: np.ndarray, k: int, base: int = WINDOW_BASES[0]) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words; windows may cross texts, see ``window_mask``."""
    n = len(words)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power_table(base, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def window_mask(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of the windows of ``window_hashes`` lie within one text."""
    ok = np.ones(max(0, n_words - k + 1), dtype=bool)
    for step in range(1, k):
        at = first[1:-1] - step  # windows that start fewer than k words before a text's end
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
