"""Spelling variants: words one edit apart, found with an FM-index in each direction over the delimited vocabulary.

Words one insertion, deletion or replacement apart agree exactly in the left or in the right half of either, so a
search scheme of two searches finds every pair: match one half exactly, starting at its delimiter, then extend across
the other half and allow one error there. The halves stand at the word's ends, so each search keeps its direction: the
right half is matched and extended leftwards in the index of the words, the left half rightwards in the index of the
reversed words (the two directions of a bidirectional index, whose intervals need not be kept in step for these
searches). States are suffix-rank intervals; all patterns of a shard advance together as numpy arrays. A state of few
rows is extended by the letters that stand before these rows, one of many rows by every letter of the alphabet.

The vocabulary is spread over shards: a word searches for others where its exact half is at home, and stands as text
at the homes of the halves that a pattern of its own length, one less or one more would have. A shard is bounded by
``SHARD_ROWS``; the texts of one half that are more are split, and its patterns go to every part. Nothing is collected.

Defined cases: a null text has no runs; a null doc_id counts as an empty one; repeated rows count again; further
columns are ignored; empty tables give empty results; words may be of any length; of equal counts the smaller word is the form.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, tune
from .textkernel import chunks, lower_ascii, regroup, solid_spans, word_dictionary

# Fixed values of the contract.
LEAST_LENGTH = 7
LEAST_COUNT = 2
EDITED = 31
FORM_FACTOR = 10

#: Text that a task counts before it passes counts on.
COUNT_BYTES = 8 << 20
#: Rows (texts and patterns) of a shard.
SHARD_ROWS = 200_000
#: Patterns of a shard that are searched at once, and rows up to which an interval is extended by its rows' letters.
PATTERNS = 8_192
FEW_ROWS = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), 0xC3]] = True
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_PAIRS = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def _runs(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts and ends of runs of letters of at least so many code points.

    U+00C0 to U+00FF are the byte C3 and one that follows it.
    """
    low = lower_ascii(data)
    solid = _LETTER[low]
    solid[1:] |= low[:-1] == 0xC3
    starts, ends, _ = solid_spans(solid, offsets)
    doubled = np.concatenate([np.zeros(1, np.int64), np.cumsum(low == 0xC3)])
    long = ends - starts - (doubled[ends] - doubled[starts]) >= least
    return low, starts[long], ends[long]


def _counts(least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches, "text", COUNT_BYTES):
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text"), COUNT_BYTES):
                low, starts, ends = _runs(data, offsets, least)
                edge = np.zeros(len(low) + 1, np.int8)
                edge[starts] += 1
                edge[ends] -= 1
                which, words = word_dictionary(low, np.cumsum(edge[:-1], dtype=np.int8) > 0, starts, ends)
                pair, times = np.unique((np.searchsorted(offsets, starts, "right") - 1) * max(1, len(words)) + which, return_counts=True)
                doc, word = np.divmod(pair, max(1, len(words)))
                names = words.to_pylist()
                raw = [w.encode() for w in names]
                before = [zlib.crc32(b"" if i is None else str(i).encode()) for i in ids[lo:hi]]
                before = [zlib.crc32(b":", x) for x in before]
                h = np.fromiter((zlib.crc32(raw[w], before[d]) for d, w in zip(doc.tolist(), word.tolist(), strict=True)), np.int64, len(pair))
                cut = h % EDITED == 0
                total = np.bincount(word[~cut], times[~cut], len(words)).astype(np.int64)
                edited: Counter = Counter()
                for w, x, n in zip(word[cut].tolist(), h[cut].tolist(), times[cut].tolist(), strict=True):
                    name = names[w]
                    at = x % len(name)
                    if len(name) > least:
                        edited[name[:at] + name[at + 1 :]] += n
                kept = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(kept)).cast(pa.string()), pa.array(total[kept])], schema=_COUNTED)
                yield pa.RecordBatch.from_arrays([pa.array(list(edited), pa.string()), pa.array(list(edited.values()), pa.int64())], schema=_COUNTED)

    return task


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the contract's words of ``docs`` (doc_id, text) with their numbers of occurrences."""
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.mapInArrow(_counts(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)
    return materialize(found, "vocabulary")


class FmIndex:
    """Suffix ranks of words that are each ended by a delimiter (symbol 0); the delimiters sort in the order of the words.

    ``before``: the symbol before the suffix of each rank. ``keys``: symbol * (size + 1) + rank, in order, so that
    the place of (c, i) among them is the first rank of suffixes that start with c, plus the occurrences of c before i.
    """

    def __init__(self, words: list[str]):
        code = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        self.alphabet, symbol = np.unique(code, return_inverse=True)
        self.symbols = symbol.astype(np.int64)  # 0: the delimiter
        self.size = len(code)
        ends = np.flatnonzero(code == 0)
        self.starts = np.concatenate([[0], ends[:-1] + 1])
        self.lengths = ends - self.starts
        ranked = self._ranked()
        self.before = self.symbols[ranked - 1]
        order = np.argsort(self.before, kind="stable")
        self.keys = self.before[order] * (self.size + 1) + order
        self.heads = np.flatnonzero(self.before == 0)  # ranks of suffixes that are whole words
        self.head_word = np.searchsorted(self.starts, ranked[self.heads])

    def _ranked(self) -> np.ndarray:
        """Suffixes in order: several symbols at once, then by doubling."""
        n, bits = self.size, max(1, int(len(self.alphabet) - 1).bit_length())
        per = 62 // bits
        key, done = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(per):
            here = np.zeros(n, np.int64)
            here[: max(0, n - k)] = self.symbols[k:]
            here[done] = 0
            key = key << bits | here
            done |= here == 0  # a suffix that has met its delimiter
        k = per
        while True:
            order = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = (key[order[1:]] != key[order[:-1]]) | done[order[1:]]
            if new.all():
                return order
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            after, over = np.zeros(n, np.int64), np.ones(n, bool)
            after[: max(0, n - k)], over[: max(0, n - k)] = rank[k:], done[k:]
            key = rank * (n + 1) + np.where(done, 0, after)
            done |= over
            k *= 2

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the same strings with a symbol before them."""
        at = symbol * (self.size + 1)
        return np.searchsorted(self.keys, at + lo), np.searchsorted(self.keys, at + hi)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(state, symbol, lo, hi) of all one-symbol extensions that occur."""
        n = hi - lo
        few = np.flatnonzero(n <= FEW_ROWS)
        size = n[few]
        total = np.cumsum(size)
        rows = np.arange(total[-1] if len(total) else 0) + np.repeat(lo[few] - (total - size), size)
        sigma = len(self.alphabet)
        pair = np.unique(np.repeat(few, size) * sigma + self.before[rows])
        many = np.flatnonzero(n > FEW_ROWS)
        pair = np.concatenate([pair, np.repeat(many * sigma, sigma) + np.tile(np.arange(sigma), len(many))])
        state, symbol = np.divmod(pair, sigma)
        state, symbol = state[symbol > 0], symbol[symbol > 0]
        low, high = self.step(symbol, lo[state], hi[state])
        some = high > low
        return state[some], symbol[some], low[some], high[some]

    def words_in(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, word) of the words that are the string of an interval."""
        a, b = np.searchsorted(self.heads, lo), np.searchsorted(self.heads, hi)
        total = np.cumsum(b - a)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(a - (total - (b - a)), b - a)
        return np.repeat(np.arange(len(lo)), b - a), self.head_word[at]


def one_error(index: FmIndex, words: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``words``, word) one edit apart, the last ``exact`` symbols of each pattern being equal.

    ``words``: numbers of words of the index, the patterns.
    """
    length, last = index.lengths[words], index.starts[words] + index.lengths[words] - 1
    own = lambda who, k: index.symbols[last[who] - k]  # noqa: E731  the k-th symbol from the end
    who, k = np.arange(len(words)), np.zeros(len(words), np.int64)
    lo, hi = np.zeros(len(words), np.int64), np.full(len(words), len(index.starts), np.int64)
    out = [(who[:0], who[:0])]
    bad = [x[:0] for x in (who, k, lo, hi)]  # states with one error
    while len(who) or len(bad[0]):
        live = hi - lo > 1  # else only the word itself is left
        who, k, lo, hi = (x[live] for x in (who, k, lo, hi))
        ready = np.flatnonzero(k >= exact[who])
        state, symbol, low, high = index.children(lo[ready], hi[ready])
        state = ready[state]
        w, at = who[state], k[state]
        inside = at < length[w]
        other = np.ones(len(w), bool)
        other[inside] = symbol[inside] != own(w[inside], at[inside])
        added = [x[other] for x in (w, at, low, high)]  # an equal one is added one place on
        changed = [x[other & inside] for x in (w, at + 1, low, high)]
        drop = ready[k[ready] < length[who[ready]]]
        again = np.zeros(len(drop), bool)
        more = np.flatnonzero(k[drop] + 1 < length[who[drop]])
        again[more] = own(who[drop[more]], k[drop[more]]) == own(who[drop[more]], k[drop[more]] + 1)
        drop = drop[~again]  # of equal neighbours the last one is dropped
        gone = (who[drop], k[drop] + 1, lo[drop], hi[drop])
        bad = [np.concatenate(x) for x in zip(bad, added, changed, gone, strict=True)]
        ended = bad[1] == length[bad[0]]
        state, found = index.words_in(bad[2][ended], bad[3][ended])
        out.append((bad[0][ended][state], found))
        bad = [x[~ended] for x in bad]
        low, high = index.step(own(bad[0], bad[1]), bad[2], bad[3])
        some = high > low
        bad = [bad[0][some], bad[1][some] + 1, low[some], high[some]]
        go = k < length[who]
        who, k, lo, hi = (x[go] for x in (who, k, lo, hi))
        lo, hi = index.step(own(who, k), lo, hi)
        k = k + 1
    pair = np.unique(np.concatenate([o[0] for o in out]) * max(1, len(index.starts)) + np.concatenate([o[1] for o in out]))
    return np.divmod(pair, max(1, len(index.starts)))


def near_pairs(words: list[str], pattern: np.ndarray, rightwards: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, other), numbers of distinct ``words``: words marked as ``pattern`` and those one edit apart that share the left half
    (``rightwards``) or the right half."""
    index = FmIndex([w[::-1] for w in words] if rightwards else words)
    asked = np.flatnonzero(pattern)
    half = index.lengths // 2
    exact = half if rightwards else index.lengths - half
    for lo in range(0, len(asked), PATTERNS):
        part = asked[lo : lo + PATTERNS]
        who, other = one_error(index, part, exact[part])
        yield part[who], other


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard and direction stand together."""

    def search(key: tuple, held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        words = list(held)
        for who, other in near_pairs(words, np.array([held[w][1] for w in words]), key[1]):
            names = pa.array(words, pa.string())
            n = pa.array([held[w][0] for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), names.take(pa.array(other)), n.take(pa.array(other))], schema=_PAIRS)

    now, held = None, {}
    for batch in batches:
        for shard, rightwards, word, n, pattern in zip(*(batch.column(c).to_pylist() for c in ("shard", "rightwards", "word", "n", "pattern")), strict=True):
            if (shard, rightwards) != now:
                if held:
                    yield from search(now, held)
                now, held = (shard, rightwards), {}
            if word in held:
                held[word][1] |= pattern
            else:
                held[word] = [n, pattern]
    if held:
        yield from search(now, held)


def _homes(word: Column, length: Column) -> Column:
    """Where a word stands: the halves of patterns of its own length, one less and one more."""

    def home(step: int) -> list[Column]:
        size = length + step
        left = F.floor(size / 2).cast("int")
        key = lambda right, half: F.struct(F.lit(not right).alias("rightwards"), F.xxhash64(F.lit(right), size, half).alias("half"), F.lit(step == 0).alias("pattern"))
        return [key(False, F.substr(word, F.lit(1), left)), key(True, F.right(word, size - left))]

    return F.array(*(h for step in (-1, 0, 1) for h in home(step)))


def near_words(words: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, other, other_n): all pairs of distinct ``words`` (word, n) one edit apart, each in both orders and once."""
    tune(words.sparkSession)
    rows = words.select("word", "n", F.inline(_homes(F.col("word"), F.length("word"))))
    shards = max(1, -(-words.count() * 6 // shard_rows))
    hot = rows.groupBy("half").count().filter(F.col("count") > shard_rows // 4)  # at most four a shard
    parts = hot.select("half", F.ceil(F.col("count") / (shard_rows // 4)).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "half", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    spread = F.when(F.col("pattern"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    dealt = dealt.withColumn("part", F.explode(spread)).withColumn("shard", F.pmod(F.xxhash64("half", "part"), F.lit(shards)))
    sorted_rows = dealt.select("shard", "rightwards", "word", "n", "pattern").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "rightwards")
    return sorted_rows.mapInArrow(_shards, "word string, other string, other_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last. Paths are halved in each round."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onwards = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(state.join(onwards, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not moved.filter("moved").limit(1).count():
            return moved.select("word", "root")
        state = moved.select("word", "root")


def group_variants(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with form, root, n_near and form_n."""
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    follows = F.coalesce(-F.col("best.m") >= FORM_FACTOR * F.col("n"), F.lit(False))
    told = materialize(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("best.word")).alias("form"), F.when(follows, -F.col("best.m")).alias("form_n")), "near")
    ends = roots(told.filter("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``group_variants`` over the vocabulary of the whole of ``documents``."""
    return group_variants(vocabulary(read_table(spark, sf_dir, "documents")))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same rows: crc32 by its table, near words by what is left when one code point goes.
OP12_SQL = rf"""
with recursive b0 as (select i, i as c, 0 as k from range(0, 256) as r(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from b0 where k < 8),
crc as (select list(c order by i) as tab from b0 where k = 8),
r as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') as w from documents),
p as (select doc_id, w, count(*) as n, hex(coalesce(doc_id::varchar, '') || ':' || w) as hx from r where length(w) >= {LEAST_LENGTH} group by doc_id, w),
h as (
  select w, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::bigint)),
    lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295::bigint) as h from p, crc),
e as (select case when h % {EDITED} = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from h),
v as (select word, sum(n)::bigint as n from e where length(word) >= {LEAST_LENGTH} group by word having sum(n) >= {LEAST_COUNT}),
del as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as d from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
pair as (
  select del.word, v.word as other, v.n as other_n from del join v on del.d = v.word
  union select v.word, del.word, del.n from del join v on del.d = v.word
  union select a.word, b.word, b.n from del a join del b on a.i = b.i and a.d = b.d and a.word <> b.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as o, max(other_n) as m from pair group by word),
t as (select v.word, n, coalesce(n_near, 0) as n_near, case when m >= {FORM_FACTOR} * n then o end as form, case when m >= {FORM_FACTOR} * n then m end as form_n from v left join best using (word)),
walk as (select word, form as at from t where form is not null union all select walk.word, t.form from walk join t on walk.at = t.word where t.form is not null),
ends as (select walk.word, walk.at as root from walk join t on walk.at = t.word where t.form is null)
select t.word, form, coalesce(root, t.word) as root, n, n_near::bigint as n_near, form_n::bigint as form_n from t left join ends using (word)
"""
