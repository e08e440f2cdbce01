"""Substring dedup: words covered by a window of 50 words that also starts in a document with a smaller id.

Method: a count-min prefilter. A first pass sketches, in each partition, the anchors of all windows (the
smallest hash among the runs of ``ANCHOR`` words in a window; a stretch of windows that share an anchor counts
it once). Equal windows have equal anchors, so the merged sketch overestimates in how many places a window
starts. A second pass keeps the windows estimated to start twice or more and Spark groups exactly those, by
two independent hashes of 96 bits together, to the smallest doc_id. No repeated window is lost. The sketch grows
with the text in slices (see ``sketch``), so it tells as many windows apart at any size.

A window whose anchor is frequent is dealt out over ``2 ** (level - SALT_LEVEL)`` tasks: the smallest doc_id is
first found in each, then among those. Copies of a whole word sequence are recognised by a 128-bit digest and
settled without their windows.

Defined cases: a null or empty text, or one with fewer words than a window, has nothing removed; rows with a
null doc_id are no smaller document to anyone and lose nothing; rows that share a doc_id never remove each
other's words; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sketch
from .common import join_classes, materialize, read_table, tune
from .textkernel import WINDOW_BASES, chunks, mix, window_hashes, window_mask, word_hashes, word_spans

WINDOW = 50
ANCHOR = 40
_EMPTY = hashlib.sha256(b"").hexdigest()
#: Bytes of text for each anchor, at most about so few in prose; the sketch's size follows from it.
BYTES_AN_ANCHOR = 30
#: From anchors counted 2 ** SALT_LEVEL times on, equal windows are dealt out.
SALT_LEVEL = 12
_FOUND = "doc_id long, d1 long, d2 long, n_words long, whole_sha256 string, runs binary, text string"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n_words", pa.int64()), ("whole_sha256", pa.string()), ("runs", pa.binary()), ("text", pa.string())])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _anchors(words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window its anchor; windows may cross texts."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    return _sliding_min(window_hashes(words, anchor, WINDOW_BASES[1]), window - anchor + 1)


def _stretches(anchors: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each stretch within one text whose windows share an anchor."""
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(anchors)))
    inside = ok[starts]
    return starts[inside], np.minimum(lengths, _run_of(ok, starts))[inside]


def _run_of(ok: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many windows from each start on lie within its text."""
    ends = np.append(np.flatnonzero(~ok), len(ok))
    return ends[np.searchsorted(ends, starts)] - starts


def _anchor_keys(window: int, anchor: int):
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in chunks(batch.column("text")):
            starts, ends, first = word_spans(data, offsets)
            a = _anchors(word_hashes(data, starts, ends), window, anchor)
            if len(a):
                yield a[_stretches(a, window_mask(first, len(starts), window))[0]]

    return keys


def _join_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True))


def _packed_runs(starts: np.ndarray, lengths: np.ndarray, levels: np.ndarray) -> bytes:
    return np.stack([starts, lengths, levels], 1).astype("<i4").tobytes()


def _candidates(lookup, window: int, anchor: int):
    """Each text's size and digests and, with a ``lookup``, the runs of windows that may be repeated; the text itself where it has some."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in chunks(batch.column("text")):
                starts, ends, first = word_spans(data, offsets)
                words = word_hashes(data, starts, ends)
                at = length = level = np.zeros(0, np.int64)
                a = _anchors(words, window, anchor) if lookup else words[:0]
                if len(a):
                    at, length = _stretches(a, window_mask(first, len(words), window))
                    ok, level = lookup.value.seen(a[at])
                    at, length, level = at[ok], length[ok], level[ok]
                cut = np.searchsorted(at, first)
                raw = data.tobytes()
                out: dict[str, list] = {n: [] for n in _FOUND_ARROW.names}
                for i in range(hi - lo):
                    w0, w1 = first[i], first[i + 1]
                    mine = slice(cut[i], cut[i + 1])
                    some = cut[i + 1] > cut[i]
                    out["n_words"].append(int(w1 - w0))
                    out["whole_sha256"].append(hashlib.sha256(_join_words(raw, starts[w0:w1], ends[w0:w1])).hexdigest())
                    out["runs"].append(_packed_runs(at[mine] - w0, length[mine], level[mine]) if some else None)
                    out["text"].append(raw[offsets[i] : offsets[i + 1]].decode("utf-8") if some or not lookup else None)
                out["doc_id"] = ids.slice(lo, hi - lo)
                out["d1"], out["d2"] = _digests(data, starts, ends, first)
                yield pa.RecordBatch.from_pydict(out, schema=_FOUND_ARROW)

    return task


def _questions(at: sketch.Layout, hot, window: int, anchor: int):
    """Anchors for a look-up in a shuffle: first window and number of windows are what comes back with each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in chunks(batch.column("text")):
                starts, ends, first = word_spans(data, offsets)
                a = _anchors(word_hashes(data, starts, ends), window, anchor)
                if not len(a):
                    continue
                begin, length = _stretches(a, window_mask(first, len(starts), window))
                owner = np.searchsorted(first, begin, "right") - 1
                extra = (begin - first[owner]).astype(np.uint64) << np.uint64(32) | length.astype(np.uint64)
                columns = [ids.slice(lo, hi - lo), *(pa.array(d) for d in _digests(data, starts, ends, first))]
                yield from sketch.probe_rows(at, hot.value, owner, a[begin], extra, columns)

    return task


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of a text to its runs."""
    schema = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("runs", pa.binary())])
    for batch in batches:
        runs = []
        for answers in batch.column("answers").to_pylist():
            extra = np.concatenate([np.frombuffer(x["extra"], "<u8") for x in answers])
            level = np.concatenate([np.frombuffer(x["levels"], np.uint8) for x in answers])
            order = np.argsort(extra)
            runs.append(_packed_runs((extra >> np.uint64(32))[order], (extra & np.uint64(0xFFFFFFFF))[order], level[order]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "d1": batch.column("d1"), "d2": batch.column("d2"), "runs": runs}, schema=schema)


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each text's word sequence, from two unlike hashes of its words."""
    out = []
    lengths = np.diff(first)
    rank = (np.arange(len(starts)) - np.repeat(first[:-1], lengths)).astype(np.uint64)
    for kind, base in enumerate(WINDOW_BASES):
        salted = mix(word_hashes(data, starts, ends, kind) ^ mix(rank * np.uint64(base)))  # a sum of values bound to their places
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted, dtype=np.uint64)])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + lengths.astype(np.uint64)).view(np.int64))
    return out


_WINDOWS = "h1 long, h2 int, doc_id long, d1 long, at long"


def _windows(window: int):
    """The windows of a text's runs, a row for each that differs from those before it in the text. ``at``: the window's first
    word, and above its 32 bits the salt."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("doc_id", pa.int64()), ("d1", pa.int64()), ("at", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, d1s = (batch.column(n).to_numpy() for n in ("doc_id", "d1"))
            runs = batch.column("runs").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                starts, ends, first = word_spans(data, offsets)
                own = [np.frombuffer(r, "<i4").reshape(-1, 3).astype(np.int64) for r in runs[lo:hi]]
                sizes = [len(r) for r in own]
                run = np.concatenate(own)
                begin = run[:, 0] + np.repeat(first[:-1], sizes)
                total = np.cumsum(run[:, 1])
                place = np.repeat(begin - (total - run[:, 1]), run[:, 1]) + np.arange(total[-1] if len(total) else 0)
                whose = np.repeat(np.repeat(np.arange(hi - lo), sizes), run[:, 1])
                level = np.repeat(run[:, 2], run[:, 1])
                h1 = window_hashes(word_hashes(data, starts, ends), window, WINDOW_BASES[0])[place]
                h2 = window_hashes(word_hashes(data, starts, ends, 1), window, WINDOW_BASES[1])[place] >> np.uint64(32)
                order = np.argsort(h1, kind="stable")
                again = np.zeros(len(order), bool)
                again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]]) & (whose[order[1:]] == whose[order[:-1]])
                h1, h2, place, whose, level = (x[~again] for x in (h1, h2, place, whose, level))
                doc = docs[lo:hi][whose]
                at = place - first[whose]
                spread = np.left_shift(1, np.clip(level - SALT_LEVEL, 0, 20))
                salt = (mix(mix(doc.view(np.uint64)) + at.astype(np.uint64)) % spread.astype(np.uint64)).astype(np.int64)
                salt += spread > 1  # 0 stands for windows that are not dealt out
                columns = [h1.view(np.int64), h2.astype(np.uint32).view(np.int32), doc, d1s[lo:hi][whose], at | salt << 32]
                for p in range(0, len(at), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[p : p + 50_000]) for c in columns], schema=schema)

    return task


def _cut(window: int):
    """Remove the covered words of a text, given the first start of each window to remove; equal windows go with it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in schema.names}
            positions = batch.column("starts").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                starts, ends, first = word_spans(data, offsets)
                raw = data.tobytes()
                h1 = window_hashes(word_hashes(data, starts, ends), window, WINDOW_BASES[0])
                h2 = window_hashes(word_hashes(data, starts, ends, 1), window, WINDOW_BASES[1]) >> np.uint64(32)
                both = mix(h1) ^ h2
                for i in range(hi - lo):
                    w0, w1 = first[i], first[i + 1]
                    n = int(w1 - w0)
                    edge = np.zeros(n + 1, np.int64)
                    own = both[w0 : w1 - window + 1]
                    at = np.flatnonzero(np.isin(own, own[np.asarray(positions[lo + i], np.int64)]))
                    edge[at] += 1
                    np.add.at(edge, at + window, -1)
                    keep = np.cumsum(edge)[:n] == 0
                    kept = _join_words(raw, starts[w0:w1][keep], ends[w0:w1][keep])
                    out["n_words"].append(n)
                    out["n_removed"].append(int(n - keep.sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept_text"].append(kept.decode("utf-8"))
            out["doc_id"] = batch.column("doc_id")
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return task


def _found(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """Every text with its digests and the runs of windows that the sketch estimates to be repeated (``_FOUND``)."""
    context = texts.sparkSession.sparkContext
    merged = sketch.build(texts, _anchor_keys(window, anchor), 2, BYTES_AN_ANCHOR, 1 << SALT_LEVEL)
    if merged.broadcast:
        return materialize(texts.mapInArrow(_candidates(context.broadcast(merged.lookup()), window, anchor), _FOUND), "windows")
    hot = merged.lookup("hot")
    asked = texts.filter("doc_id is not null").mapInArrow(_questions(merged.at, context.broadcast(hot), window, anchor), sketch.PROBE_SCHEMA)
    answers = sketch.probe(merged, asked, int(hot.levels.max(initial=SALT_LEVEL)))
    runs = materialize(answers.mapInArrow(_runs, "doc_id long, d1 long, d2 long, runs binary"), "runs")
    told = texts.mapInArrow(_candidates(None, window, anchor), _FOUND).drop("runs").join(runs, ["doc_id", "d1", "d2"], "left")
    return materialize(told.withColumn("text", F.when(F.col("runs").isNotNull(), F.col("text"))), "windows")


def _gone(windows: DataFrame) -> DataFrame:
    """(doc_id, d1, starts): windows that also start in a document with a smaller id.

    One shuffle deals windows out by hash and salt. The smallest doc_id of a salted window's parts is sought among
    the parts' smallest, a row a part.
    """
    key = ["h1", "h2", "salt"]
    dealt = windows.withColumn("salt", F.shiftright("at", 32).cast("int"))
    dealt = dealt.withColumn("least", F.min("doc_id").over(Window.partitionBy(*key)))
    parts = windows.filter("shiftright(at, 32) > 0").withColumn("salt", F.shiftright("at", 32).cast("int")).groupBy(*key).agg(F.min("doc_id").alias("part"))
    smallest = parts.withColumn("over_all", F.min("part").over(Window.partitionBy("h1", "h2"))).filter("over_all < part").select(*key, "over_all")
    told = dealt.join(smallest, key, "left").filter(F.col("doc_id") > F.coalesce("over_all", "least"))
    return told.groupBy("doc_id", "d1").agg(F.collect_set(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("starts"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256, and kept_text where words were removed."""
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = _found(texts, window, anchor)

    # copies of one word sequence: the smallest doc_id stands for all
    long = found.filter(F.col("runs").isNotNull() & F.col("doc_id").isNotNull())
    eldest = materialize(long.groupBy("d1", "d2").agg(F.min("doc_id").alias("eldest"), F.count("*").alias("copies")), "eldest")
    first = eldest.select(F.col("eldest").alias("doc_id"), "d1", "d2")
    own = long.select("doc_id", "d1", "d2", "runs", "text").join(first, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"])
    gone = materialize(_gone(own.select("doc_id", "d1", "runs", "text").mapInArrow(_windows(window), _WINDOWS)), "gone")

    # what becomes of a text is told from its keys; of the texts only those to be cut are needed
    rows = join_classes(long.select("doc_id", "d1", "d2", "n_words", "whole_sha256"), eldest, ["d1", "d2"], "copies")
    whole = F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text")
    copies = rows.filter("doc_id > eldest").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(_EMPTY).alias("kept_sha256"), F.lit("").alias("kept_text"))
    untouched = rows.filter("doc_id = eldest").join(gone.select("doc_id", "d1"), ["doc_id", "d1"], "left_anti").select("doc_id", "n_words", *whole)
    cut = long.select("doc_id", "d1", "text").join(gone, ["doc_id", "d1"]).select("doc_id", "text", "starts")
    cut = cut.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    rest = found.filter(F.col("runs").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_words", *whole)
    return rest.unionByName(copies).unionByName(untouched).unionByName(cut)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of ``remove_repeats`` over the whole of ``documents``."""
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same rows by grouping every window.
OP9_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
w as (select doc_id, p, array_to_string(list_slice(words, p, p + 49), ' ') as win from d, unnest(range(1, len(words) - 48)) as t(p)),
m as (select win, min(doc_id) as least from w group by win),
gone as (select distinct w.doc_id, w.p + o as p from w join m using (win), range(0, 50) as r(o) where w.doc_id > m.least),
g as (select doc_id, list(p) as ps from gone group by doc_id),
k as (select d.doc_id, words, coalesce(ps, []::bigint[]) as ps from d left join g using (doc_id))
select doc_id, len(words)::bigint as n_words, len(ps)::bigint as n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: not list_contains(ps, i)), lambda i: words[i]), ' ')) as kept_sha256
from k
"""
