"""Benchmark decontamination: a distributed positional inverted index of training documents, searched for test phrases.

``build_index`` stores the token postings of all documents as a table in the shared folder. Each row is the index of a
segment, documents of about ``SEGMENT_BYTES`` of text: its distinct terms, how often each occurs, and the places of
each, delta-coded. A document lies in one segment, so a search needs no shuffle and more text means more rows.

``phrases`` intersects, for each window of test words and in each segment that holds all of its terms, the lists of
places from the segment's rarest term on: a place q of the term at offset o speaks for a start q - o, and what is left
after the last list are the exact occurrences. ``near`` returns proximity matches: runs of ``within`` words of a
document that hold all words of an item in any order. Test items are broadcast in blocks of ``BLOCK_BYTES`` of text;
a larger benchmark takes more blocks, whose matches are put together by document.

Words are compared by their bytes, not by hashes.

Defined cases: a null text has no words; documents without words are rows with no hits; repeated rows and rows with
a null or repeated doc_id are each a row of the result; an item without words is never found; items with a null item_id
mark words but are not listed or counted; items that share an id are one item; further columns are ignored; an empty table of documents gives an
empty result, an empty benchmark gives documents without hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, tune
from .textkernel import chunks, lower_ascii, regroup, solid_spans, word_dictionary

WINDOW = 10
SEGMENT_BYTES = 8 << 20
#: Text of test items that is broadcast at once.
BLOCK_BYTES = 4 << 20
#: Candidates that a task holds at once.
CANDIDATES = 1 << 20

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_INDEX = pa.schema([("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("counts", pa.binary()), ("places", pa.binary())])
_INDEX_SCHEMA = "doc_id array<bigint>, n_words array<int>, terms array<string>, counts binary, places binary"
_RUN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.schema([("segment", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_RUN)), ("items", pa.list_(pa.string()))])
_FOUND_SCHEMA = "segment bigint, ordinal int, doc_id bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def _pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For all texts: first word of each (one more at the end), number of each word's term, terms."""
    low = lower_ascii(data)
    solid = _IN_WORD[low]
    starts, ends, first = solid_spans(solid, offsets)
    which, terms = word_dictionary(low, solid, starts, ends)
    return first, which, terms


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in regroup(batches, "text", SEGMENT_BYTES):
        ids = batch.column("doc_id")
        for lo, hi, data, offsets in chunks(batch.column("text"), SEGMENT_BYTES):
            first, which, terms = _terms(data, offsets)
            order = np.argsort(which, kind="stable")
            counts = np.bincount(which, minlength=len(terms))
            deltas = np.diff(order, prepend=0)
            heads = np.cumsum(counts)[:-1]
            deltas[heads] = order[heads]  # each term's list starts anew
            columns = [[ids.slice(lo, hi - lo).to_pylist()], [np.diff(first)], [terms.cast(pa.string())], [_pack(counts)], [_pack(deltas)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _INDEX, strict=True)], schema=_INDEX)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to the shared folder: a row a segment."""
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(texts.mapInArrow(_index, _INDEX_SCHEMA).withColumn("segment", F.monotonically_increasing_id()), "index")


class Segment:
    """Postings of a segment: ``keys`` are term * ``span`` + place, in order."""

    def __init__(self, row: dict):
        self.ids, self.terms = row["doc_id"], row["terms"]
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(row["n_words"], dtype=np.int64)])
        self.counts = _unpack(row["counts"])
        self.heads = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.counts)])
        deltas = _unpack(row["places"])
        run = np.cumsum(deltas)
        full = self.counts > 0
        before = run[self.heads[:-1][full]] - deltas[self.heads[:-1][full]]
        self.places = run - np.repeat(before, self.counts[full])
        self.span = int(self.first[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.span + self.places

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of each term, and for each the number of the question it answers."""
        sizes = self.counts[terms]
        total = np.cumsum(sizes)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(self.heads[terms] - (total - sizes), sizes)
        return self.places[at], np.repeat(np.arange(len(terms)), sizes)

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = terms * self.span + places
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted

    def owners(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1


@dataclass
class Items:
    """Test items of a block: their terms; for each length the distinct windows as numbers of terms; the items of each window."""

    terms: pa.Array
    names: list[str]
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # terms (a row a window), heads into items, items (-1: no name)

    @classmethod
    def of(cls, rows: list[tuple], window: int | None) -> Items:
        """``window``: words of a window; none: an item is one window, its distinct words."""
        names = sorted({str(i) for i, _ in rows if i is not None})  # by code point
        place = {n: k for k, n in enumerate(names)}
        text = pa.array([t or "" for _, t in rows], pa.large_string())
        known: dict[str, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        own = [place[str(i)] if i is not None else -1 for i, _ in rows]
        for lo, hi, data, offsets in chunks(text, 1 << 30):
            first, which, terms = _terms(data, offsets)
            number = np.array([known.setdefault(t, len(known)) for t in terms.to_pylist()], np.int64)
            for i in range(lo, hi):
                words = number[which[first[i - lo] : first[i - lo + 1]]].tolist()
                if window is None:
                    words = sorted(set(words))
                n = min(window or len(words), len(words))
                for p in range(len(words) - n + 1 if n else 0):
                    found.setdefault(n, {}).setdefault(tuple(words[p : p + n]), set()).add(own[i])
        windows = []
        for n, some in sorted(found.items()):
            owners = [sorted(x) for x in some.values()]
            windows.append((np.array(list(some), np.int64).reshape(-1, n), np.concatenate([[0], np.cumsum([len(x) for x in owners])]), np.array([k for x in owners for k in x], np.int64)))
        return cls(pa.array(list(known), pa.string()), names, windows)

    def local(self, segment: Segment) -> np.ndarray:
        """For each term its number in the segment, -1 where it does not occur."""
        out = np.full(len(self.terms) + 1, -1, np.int64)
        at = pc.index_in(segment.terms, value_set=self.terms)
        held = pc.is_valid(at).to_numpy(zero_copy_only=False)
        out[at.drop_null().to_numpy()] = np.flatnonzero(held)
        return out


def _rounds(sizes: np.ndarray) -> Iterator[slice]:
    """Consecutive questions of about ``CANDIDATES`` candidates together."""
    total = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CANDIDATES, "right")))
        yield slice(lo, hi)
        lo = hi


def _present(segment: Segment, local: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows all of whose terms the segment holds: their numbers, terms and the order of these from the rarest."""
    terms = local[windows]
    some = np.flatnonzero((terms >= 0).all(1))
    terms = terms[some]
    return some, terms, np.argsort(segment.counts[terms], axis=1, kind="stable")


def exact_places(segment: Segment, local: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, start) of all occurrences of windows of one length."""
    some, terms, order = _present(segment, local, windows)
    n = windows.shape[1]
    rows = np.arange(len(some))
    found = [(some[:0], some[:0])]
    rarest = terms[rows, order[:, 0]]
    for part in _rounds(segment.counts[rarest]):
        start, who = segment.lists(rarest[part])
        who = rows[part][who]
        start = start - order[who, 0]
        ok = start >= 0
        start, who = start[ok], who[ok]
        for j in range(1, n):
            ok = segment.has(terms[who, order[who, j]], start + order[who, j])
            start, who = start[ok], who[ok]
        ok = segment.first[np.minimum(segment.owners(start) + 1, len(segment.first) - 1)] >= start + n
        found.append((some[who[ok]], start[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_places(segment: Segment, local: np.ndarray, windows: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, start) of all runs of ``within`` words (fewer at a document's end) that hold all terms and start with one of them."""
    some, terms, order = _present(segment, local, windows)
    n = windows.shape[1]
    found = [(some[:0], some[:0])]
    if not len(segment.keys):
        return found[0]
    rows = np.arange(len(some))
    rarest = terms[rows, order[:, 0]]
    for part in _rounds(segment.counts[rarest] * within):
        place, who = segment.lists(rarest[part])
        who = np.repeat(rows[part][who], within)
        low = np.repeat(segment.first[segment.owners(place)], within)
        start = np.repeat(place, within) - np.tile(np.arange(within), len(place))
        ok = start >= low
        both = np.unique(np.stack([who[ok], start[ok]]), axis=1)
        who, start = both
        end = np.minimum(start + within, segment.first[segment.owners(start) + 1])
        first = np.zeros(len(who), bool)
        for j in range(n):
            t = terms[who, order[who, j]]
            at = np.minimum(np.searchsorted(segment.keys, t * segment.span + start), len(segment.keys) - 1)
            ok = (segment.keys[at] >= t * segment.span + start) & (segment.keys[at] < t * segment.span + end)
            first |= segment.keys[at] == t * segment.span + start
            who, start, end, first = who[ok], start[ok], end[ok], first[ok]
        found.append((some[who[first]], start[first]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _by_document(segment: Segment, number: int, items: Items, found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], every: bool) -> pa.RecordBatch:
    """A row for each document (or those with matches): runs of words covered by matches (start, end, items' heads and items)."""
    n, docs = int(segment.first[-1]), len(segment.ids)
    edge = np.zeros(n + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    for start, end, sizes, who in found:
        edge += np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
        pairs.append(np.unique(np.repeat(segment.owners(start), sizes) * (len(items.names) + 1) + who + 1))
    covered = np.cumsum(edge)[:n] > 0
    lo, hi, first = solid_spans(covered, segment.first)
    pair = np.unique(np.concatenate(pairs))
    doc, item = np.divmod(pair, len(items.names) + 1)
    doc, item = doc[item > 0], item[item > 0] - 1
    owner = segment.owners(lo)
    spans = pa.StructArray.from_arrays([pa.array((x - segment.first[owner]).astype(np.int32)) for x in (lo, hi)], fields=list(_RUN))
    kept = np.arange(docs) if every else np.unique(owner)
    columns = [
        np.full(docs, number), np.arange(docs, dtype=np.int32), segment.ids, np.diff(segment.first), _lists(spans, np.diff(first)),
        _lists(pa.array(items.names, pa.string()).take(pa.array(item)), np.bincount(doc, minlength=docs)),
    ]
    batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)
    return batch if every else batch.take(pa.array(kept))


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, Segment]]:
    for i in range(batch.num_rows):
        row = {n: batch.column(n)[i] for n in batch.schema.names}
        yield row["segment"].as_py(), Segment({"doc_id": row["doc_id"].values, "n_words": row["n_words"].values.to_numpy(), "terms": row["terms"].values, "counts": row["counts"].as_py(), "places": row["places"].as_py()})


def _search(items, within: int | None, every: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, segment in _segments(batch):
                local, found = items.value.local(segment), []
                for windows, heads, owners in items.value.windows:
                    if within is None:
                        who, start = exact_places(segment, local, windows)
                        end = start + windows.shape[1]
                    else:
                        who, start = near_places(segment, local, windows, within)
                        end = np.minimum(start + within, segment.first[segment.owners(start) + 1])
                    sizes = np.diff(heads)[who]
                    total = np.cumsum(sizes)
                    at = np.arange(total[-1] if len(total) else 0) + np.repeat(heads[who] - (total - sizes), sizes)
                    found.append((start, end, sizes, owners[at]))
                yield _by_document(segment, number, items.value, found, every)

    return task


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping runs of a document, found with different blocks of items, as one."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            runs = []
            for s in sorted((s["start"], s["end"]) for s in row["spans"]):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            row["spans"] = [{"start": a, "end": b} for a, b in runs]
        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)


def _matches(index: DataFrame, items: DataFrame, window: int | None, within: int | None) -> DataFrame:
    spark = index.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    found = None
    for b in range(blocks):
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]  # about BLOCK_BYTES
        block = spark.sparkContext.broadcast(Items.of(rows, window))
        part = index.mapInArrow(_search(block, within, b == 0), _FOUND_SCHEMA)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        grouped = found.groupBy("segment", "ordinal").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = grouped.mapInArrow(_merged, _FOUND_SCHEMA)
    return found


def phrases(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document of ``index``: doc_id, n_words, the runs of words (spans, end exclusive) inside exact occurrences of
    windows of ``window`` consecutive words of ``items`` (item_id, text; a shorter item is one window), and the items found."""
    return _matches(index, items, window, None).select("doc_id", "n_words", "spans", "items")


def near(index: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """The same for proximity: runs of ``within`` consecutive words of a document that hold each word of an item at least once and
    start with one of them."""
    return _matches(index, items, None, within).select("doc_id", "n_words", "spans", "items")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of ``phrases`` over the whole of ``documents`` and ``benchmark``."""
    found = phrases(build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same rows by a join of all windows.
OP11_SQL = rf"""
with d as (select doc_id, {_WORDS} as ws from documents),
i as (select item_id, {_WORDS} as ws from benchmark),
iw as (
  select distinct item_id, least(len(ws), {WINDOW}) as n, array_to_string(ws[p:p + least(len(ws), {WINDOW}) - 1], ' ') as win
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW}, 0) + 2)) as p from i where len(ws) > 0)),
dw as (
  select doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') as win
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from d, (select distinct n from iw) where len(ws) >= n)),
hit as (select doc_id, item_id, n, p from dw join iw using (n, win)),
covered as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + n)) as q from hit) group by doc_id),
found as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit where item_id is not null) group by doc_id)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(f.n, 0)::bigint as n_items, sha256(coalesce(f.items, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from d left join covered c using (doc_id) left join found f using (doc_id)
"""
