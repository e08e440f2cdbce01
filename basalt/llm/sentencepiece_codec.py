"""SentencePiece encoding and decoding of whole texts, by shared-prefix traversal of sorted words.

The model file is read for its pieces only; texts are encoded here. A text gets a space in front, spaces become
marks, and it is cut before each run of marks and around control characters, over which no piece reaches. The
distinct words of a batch that the worker has not met are sorted and encoded depth-first (see ``pieces``); a
worker keeps what it has encoded, up to ``KEPT_WORDS`` words, in flat arrays. Texts are put together by
gathering from those arrays; nothing is shuffled and nothing grows with the table.

The model that comes with the box is a byte-pair model, so its scores are merge ranks: the forward state is the
last piece of the prefix's encoding instead of the best sum of scores, which gives the encodings that such a
model defines. Unigram models get the Viterbi recursion.

Defined cases: null and empty texts have no ids and decode to an empty text; a mark that stands in a text is
taken for a space; rows may repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, tune
from .pieces import MARK, Vocabulary, encode_sorted
from .textkernel import as_string, chunks, word_hashes

MODEL = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
KEPT_WORDS = 1 << 21
_MARK_BYTES = MARK.encode()


def load(path: str = MODEL) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file (its own encoder is not used)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = {}, {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = (i, model.get_score(i))
    ranked = sorted((-s, i) for i, s in pieces.values() if s > -1e8)
    bpe = all(float(s).is_integer() for s, _ in ranked)  # merge ranks are whole numbers, log-probabilities are not
    return Vocabulary(pieces, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None, model.unk_id(), "bpe" if bpe else "unigram")


class _Known:
    """Words that a worker has encoded: sorted hashes, and where their ids lie in one array."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.second = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def confuses(self, hashes: np.ndarray, second: np.ndarray) -> bool:
        """Whether a word has the hash of a kept one, but not its second, unlike hash."""
        at, held = self.places(hashes)
        return bool((held & (self.second[at] != second)).any()) if len(self.hashes) else False

    def add(self, hashes: np.ndarray, second: np.ndarray, encoded: list[list[int]]) -> None:
        counts = np.array([len(x) for x in encoded], np.int64)
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in encoded for i in x), np.int32, int(counts.sum()))])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.second = np.concatenate([self.second, second])[order]
        self.hashes, self.starts, self.counts = every[order], np.concatenate([self.starts, starts])[order], np.concatenate([self.counts, counts])[order]


_KNOWN: dict[str, _Known] = {}


def _alone(vocabulary: Vocabulary) -> np.ndarray:
    """Control characters that no longer piece holds, by byte."""
    held = {c for p in vocabulary.id if len(p) > 1 for c in p}
    return np.array([b < 32 and chr(b) not in held for b in range(256)])


def _units(data: np.ndarray, offsets: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the marked words of texts that begin with a space each, and each text's first word."""
    n = len(data)
    space, control = data == 32, alone[data]
    begin = np.zeros(n, bool)
    begin[1:] = (space[1:] & ~space[:-1]) | control[1:] | control[:-1]
    begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, offsets)


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[s : s + c] of all pairs, one after another."""
    total = int(counts.sum())
    if not total:
        return values[:0]
    begin = np.cumsum(counts) - counts
    return values[np.repeat(starts - begin, counts) + np.arange(total)]


def encode_column(vocabulary: Vocabulary, known: _Known, column: pa.Array) -> Iterator[list[np.ndarray]]:
    """Piece ids of each text, a list for each chunk of texts."""
    alone = _alone(vocabulary)
    texts = as_string(column)
    marked = [b" " + t.replace(_MARK_BYTES, b" ") if t else b"" for t in (x.as_py() for x in texts.cast(pa.large_binary()))]
    for lo, hi, data, offsets in chunks(pa.array(marked, pa.large_binary()).cast(pa.large_string())):
        if not len(data):
            yield [np.zeros(0, np.int32)] * (hi - lo)
            continue
        starts, ends, first = _units(data, offsets, alone)
        hashes = word_hashes(data, starts, ends)
        twice = word_hashes(data, starts, ends, 1)
        distinct, at = np.unique(hashes, return_index=True)
        other = twice != twice[at[np.searchsorted(distinct, hashes)]]
        if other.any():  # two words of one hash: give the others a hash of both kinds
            hashes = np.where(other, twice ^ np.uint64(1), hashes)
            distinct, at = np.unique(hashes, return_index=True)
        if len(known.hashes) + len(distinct) > KEPT_WORDS or known.confuses(distinct, twice[at]):
            known.__init__()
        new = ~known.places(distinct)[1]
        if new.any():
            raw = data.tobytes()
            words = [(raw[starts[i] : ends[i]].decode("utf-8").replace(" ", MARK), h) for i, h in zip(at[new].tolist(), distinct[new].tolist(), strict=True)]
            words.sort()
            second = dict(zip(distinct[new].tolist(), twice[at[new]].tolist(), strict=True))
            known.add(np.array([h for _, h in words], np.uint64), np.array([second[h] for _, h in words], np.uint64), list(encode_sorted(vocabulary, (w for w, _ in words))))
        place = known.places(hashes)[0]
        counts = known.counts[place]
        ids = gather(known.ids, known.starts[place], counts)
        cuts = np.concatenate([[0], np.cumsum(counts)])[first]
        yield [ids[cuts[i] : cuts[i + 1]] for i in range(hi - lo)]


class Decoder:
    """Piece ids to bytes, by gathering the pieces' bytes."""

    def __init__(self, vocabulary: Vocabulary):
        size = 1 + max([*vocabulary.text, *(vocabulary.byte_ids or []), vocabulary.unknown])
        parts = [b""] * size
        for i, p in vocabulary.text.items():
            parts[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(vocabulary.byte_ids or []):
            parts[i] = bytes([b])
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.pool = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        data = gather(self.pool, self.starts[ids], self.counts[ids]).tobytes()
        return data[1:] if data[:1] == b" " else data


def _with_vocabulary(vocabulary, task, key: str = MODEL):
    """A worker keeps what it encoded from task to task; ``key`` tells vocabularies apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _KNOWN.setdefault(key, _Known())
        yield from task(vocabulary.value, known, batches)

    return run


def _encode(vocabulary: Vocabulary, known: _Known, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [x for part in encode_column(vocabulary, known, batch.column("text")) for x in part]
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and the piece ``ids``."""
    tune(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_with_vocabulary(vocabulary, _encode, path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids): doc_id and the ``text``; null ids give an empty text."""
    tune(encoded.sparkSession)
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary.value)
        for batch in batches:
            texts = [decoder.decode(np.asarray(x.values.to_numpy() if x.is_valid else [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


def _digest(vocabulary: Vocabulary, known: _Known, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])
    for batch in batches:
        out: dict[str, list] = {n: [] for n in schema.names}
        texts = iter(as_string(batch.column("text")).cast(pa.large_binary()))
        for part in encode_column(vocabulary, known, batch.column("text")):
            for ids in part:
                text, decoded = next(texts).as_py(), decoder.decode(ids)
                out["n_bytes"].append(len(text))
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                out["round_trip"].append(decoded == text)
        out["doc_id"] = batch.column("doc_id")
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Encode and decode each text in one pass: n_bytes, n_tokens, digests of ids and of the decoded text, and whether it came back."""
    tune(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_with_vocabulary(vocabulary, _digest, path), "doc_id long, n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``digest`` over the whole of ``documents``."""
    return digest(read_table(spark, sf_dir, "documents"))
