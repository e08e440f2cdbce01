"""Encoding words into sentence pieces over a trie of sorted words.

Distinct marked words are sorted, so that each word's trie path starts with what it shares with the word
before it; the traversal is depth-first and keeps the forward state of every character of the current path.
Only characters beyond the shared prefix are computed.

Forward states: for a unigram model the best score of the prefix and its last piece (Viterbi). For a byte-pair
model, whose scores are ranks of merges and not probabilities, a state is the last piece of the prefix's
encoding: a piece may follow another if encoding both together leaves them apart, and exactly one piece that
ends at a character may follow the encoding before it. Both follow the state back to read off the pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

MARK = "▁"


class Vocabulary:
    """Pieces of a model. ``kind``: "bpe" or "unigram". ``byte_ids``: ids of the 256 byte pieces, or None."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int, kind: str):
        self.kind, self.byte_ids, self.unknown = kind, byte_ids, unknown
        self.score = dict(pieces.values())
        self.text = {i: p for p, (i, _) in pieces.items()}
        self.id = {p: i for p, (i, _) in pieces.items()}
        if kind == "bpe":  # a piece that its own merges don't yield is never the outcome of encoding
            self.id = {p: i for p, i in self.id.items() if len(p) == 1 or self.merge(p) == [i]}
        ends: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        #: lengths of the pieces that end in two given characters, longest first
        self.lengths = {e: tuple(sorted(x, reverse=True)) for e, x in ends.items()}
        self._merges: dict[int, list[tuple[float, int, int]]] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._all = {p: i for p, (i, _) in pieces.items()}

    def merge(self, word: str) -> list[int]:
        """Byte-pair merges by score, leftmost first among equals: of words whose states don't suffice, and of pieces."""
        return [i for i, _ in self._merged(word)]

    def _merged(self, word: str, log: list | None = None) -> list[tuple[int, str]]:
        table = getattr(self, "_all", self.id)
        parts: list[str | None] = list(word)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                got = table.get(parts[i] + parts[j])
                if got is not None:
                    heapq.heappush(queue, (-self.score[got], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            negative, i, a, b = heapq.heappop(queue)
            j = after[i] if parts[i] == a else len(parts)
            if j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if log is not None:
                first, last = parts[0], next(p for p in reversed(parts) if p is not None)
                log.append((-negative, table.get(first, -1), table.get(last, -1)))
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [(table.get(p, -1), p) for p in parts if p is not None]

    def _history(self, piece: int) -> list[tuple[float, int, int]]:
        """The merges that make a piece: score, then its first and last part."""
        log = self._merges.get(piece)
        if log is None:
            text = self.text[piece]
            log = [(0.0, self._all.get(text[0], -1), self._all.get(text[-1], -1))]
            self._merged(text, log)
            self._merges[piece] = log
        return log

    def apart(self, a: int, b: int) -> bool:
        """Whether the pieces ``a`` and ``b`` side by side stay two pieces: both are remade by their merges, best
        score first, and no merge over their border may come before the next of these."""
        key = (a, b)
        known = self._apart.get(key)
        if known is None:
            known = self._apart[key] = self._stay_apart(self._history(a), self._history(b))
        return known

    def _stay_apart(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            x, y = left[i][2], right[j][1]
            over = self._all.get(self.text[x] + self.text[y]) if x >= 0 and y >= 0 else None
            next_left = left[i + 1][0] if i + 1 < len(left) else None
            next_right = right[j + 1][0] if j + 1 < len(right) else None
            if over is not None:
                s = self.score[over]
                if (next_left is None or s > next_left) and (next_right is None or s >= next_right):
                    return False
            if next_left is None and next_right is None:
                return True
            if next_right is None or (next_left is not None and next_left >= next_right):
                i += 1
            else:
                j += 1

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8")] if self.byte_ids else [self.unknown]


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def encode_sorted(vocabulary: Vocabulary, words: Iterable[str]) -> Iterator[list[int]]:
    """Piece ids of each of the sorted ``words``."""
    step = _bpe_step if vocabulary.kind == "bpe" else _unigram_step
    last: list[int] = [0]
    start: list[int] = [0]
    score: list[float] = [0.0]
    previous = ""
    for word in words:
        if vocabulary.kind == "bpe" and word.startswith(MARK + MARK):  # runs of marks have equal scores
            yield [x for i, p in vocabulary._merged(word) for x in ([i] if i >= 0 else vocabulary.bytes_of(p))]
            continue
        n = len(word)
        begin = _shared(previous, word)
        if n + 1 > len(last):
            more = n + 1 - len(last)
            last += [0] * more
            start += [0] * more
            score += [0.0] * more
        step(vocabulary, word, begin, last, start, score)
        previous = word
        ids: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                ids.append(last[at])
            else:
                ids.extend(reversed(vocabulary.bytes_of(word[at - 1])))
            at = start[at]
        ids.reverse()
        yield ids


def _bpe_step(v: Vocabulary, word: str, begin: int, last: list[int], start: list[int], _: list[float]) -> None:
    find, lengths, known, apart = v.id.get, v.lengths.get, v._apart.get, v.apart
    for i in range(begin + 1, len(word) + 1):
        piece = at = -1
        for length in lengths(word[i - 2 : i], ()) if i > 1 else ():
            if length > i:
                continue
            p = find(word[i - length : i])
            if p is None:
                continue
            j = i - length
            if j == 0 or last[j] < 0:
                piece, at = p, j
                break
            ok = known((last[j], p))
            if ok or (ok is None and apart(last[j], p)):
                piece, at = p, j
                break
        if piece < 0:
            at = i - 1
            piece = find(word[i - 1], -1)
        last[i], start[i] = piece, at


def _unigram_step(v: Vocabulary, word: str, begin: int, last: list[int], start: list[int], score: list[float]) -> None:
    poor = min(v.score.values(), default=0.0) - 10.0  # what an unknown character costs
    for i in range(begin + 1, len(word) + 1):
        single = v.id.get(word[i - 1])
        best, piece, at = score[i - 1] + (v.score[single] if single is not None else poor), (-1 if single is None else single), i - 1
        for length in v.lengths.get(word[i - 2 : i], ()) if i > 1 else ():
            p = v.id.get(word[i - length : i]) if length <= i else None
            if p is not None and score[i - length] + v.score[p] > best:
                best, piece, at = score[i - length] + v.score[p], p, i - length
        last[i], start[i], score[i] = piece, at, best
