"""Collocations: phrases of two or three words that occur together more often than their parts let expect.

Method: vertical partitioning of a word suffix tree, depth-truncated at three words. Words are counted first. Each suffix
of a piece (its first three words) belongs to a prefix: its first word; its first two words if the first is frequent (more
than an eighth of the memory budget); all three if the second is frequent too. So no prefix exceeds the budget's eighth
but single leaves, which are counters. Prefixes are dealt out by hash to groups of half a budget each. A task
builds the subtrees of a group on their own, as sorted suffixes, and reads counts from the leaf totals. Suffixes are
counted within some megabytes of text before they are shuffled, so a hot phrase is one row of each. The totals of
phrases of two frequent words come from several groups and are added up by Spark.

A word is known by 64 bits that also cover its language; the first job checks that no two words share them (and
takes another seed if two do), so counts are exact. Scores are exact in decimals of 38 digits for counts below 10^16; beyond that
Spark raises an error.

Defined cases: a null text is empty; a null lang is ``und``; doc_id is not used; repeated rows count again; further columns
are ignored; an empty table gives an empty result; equal scores and counts are ordered by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, tune
from .textkernel import chunks, lower_ascii, mix, regroup, solid_spans, word_dictionary, word_hashes

# Fixed values of the contract.
LEAST = 10
TOP = 2000
NO_LANG = "und"
COVERED = (100, 50)

#: Suffixes that a group of prefixes may hold (some 100 bytes each while they are sorted).
BUDGET = 1 << 20
TEXT_BYTES = 8 << 20
#: Parts that each language's ranking is taken from.
RANK_PARTS = 64
MOST_TASKS = 1 << 14

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_SOLID = ~_BREAK
_SOLID[[9, 32]] = False
_COUNTED = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_PACKED = pa.schema([("group", pa.int64()), ("suffixes", pa.binary())])
_NODES = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("a", pa.int64()), ("l", pa.int64())])


class Tokens:
    """The words of some texts: ``ids`` by word and language (never 0), ``fresh`` where a piece begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str], seed: int):
        low = lower_ascii(data)
        solid = _SOLID[low]
        starts, ends, first = solid_spans(solid, offsets)
        self.which, self.terms = word_dictionary(low, solid, starts, ends)
        names = sorted(set(langs))
        place = {n: i for i, n in enumerate(names)}
        self.names, self.lang = names, np.repeat(np.array([place[x] for x in langs], np.int64), np.diff(first))
        self.term_hash = self._hashes(self.terms, seed)
        self.lang_hash = self._hashes(pa.array(names, pa.large_string()), seed + 1)
        self.ids = self.id_of(self.which, self.lang)
        breaks = np.concatenate([np.zeros(1, np.int64), np.cumsum(_BREAK[low])])
        self.fresh = np.ones(len(starts), bool)
        self.fresh[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
        self.fresh[first[:-1][first[:-1] < len(starts)]] = True

    @staticmethod
    def _hashes(words: pa.Array, seed: int) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.uint64)
        _, _, data, offsets = next(chunks(words, 1 << 62))
        return mix(word_hashes(data, offsets[:-1], offsets[1:]) ^ np.uint64(seed))

    def id_of(self, which: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return np.maximum(mix(self.term_hash[which] + self.lang_hash[lang] * np.uint64(3)), np.uint64(1)) if len(which) else np.zeros(0, np.uint64)


def _tokens(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Tokens]:
    for batch in regroup(batches, "text", TEXT_BYTES):
        langs = batch.column("lang").to_pylist()
        for lo, hi, data, offsets in chunks(batch.column("text"), TEXT_BYTES):
            yield Tokens(data, offsets, langs[lo:hi], seed)


def _count_words(seed: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tokens(batches, seed):
            pair, n = np.unique(t.lang * max(1, len(t.terms)) + t.which, return_counts=True)
            lang, which = np.divmod(pair, max(1, len(t.terms)))
            ids = t.id_of(which, lang).view(np.int64)
            columns = [pa.array(ids), pa.array(t.names, pa.string()).take(pa.array(lang)), t.terms.take(pa.array(which)).cast(pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTED)

    return task


def _words(texts: DataFrame) -> tuple[DataFrame, int]:
    """(id, lang, word, n) of all words, and the seed under which ids tell them apart."""
    seed = 0
    while True:
        own = F.struct("lang", "word")
        counted = texts.mapInArrow(_count_words(seed), "id long, lang string, word string, n long").groupBy("id").agg(F.sum("n").alias("n"), F.min(own).alias("one"), F.max(own).alias("other"))
        words = materialize(counted, "words")
        if not words.filter("one <> other").limit(1).count():
            return words.select("id", "one.lang", "one.word", "n"), seed
        seed += 2


def _pack(suffixes: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(suffixes.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).reshape(4, -1)


def _distinct(suffixes: np.ndarray) -> np.ndarray:
    """Sorted distinct suffixes (rows x, y, z) and how often each occurs (a fourth row)."""
    s = suffixes[:, np.lexsort(suffixes[2::-1])]
    new = np.flatnonzero(np.append(True, (s[:3, 1:] != s[:3, :-1]).any(0)))
    return np.concatenate([s[:3, new], np.add.reduceat(s[3:], new, axis=1)])


def _within(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each of ``ids`` is among the sorted ``some``."""
    return some[np.minimum(np.searchsorted(some, ids), len(some) - 1)] == ids if len(some) else np.zeros(len(ids), bool)


def prefix_groups(x: np.ndarray, y: np.ndarray, z: np.ndarray, frequent: np.ndarray, groups: int) -> np.ndarray:
    """The group of each suffix's prefix. ``frequent``: sorted ids of words whose prefix is extended."""
    one = _within(x, frequent)
    two = one & _within(y, frequent)
    h = mix(x)
    h = np.where(one, mix(h + y), h)
    h = np.where(two, mix(h + z), h)
    return (h % np.uint64(groups)).astype(np.int64)


def _deal(seed: int, frequent, groups: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tokens(batches, seed):
            n = len(t.ids)
            if not n:
                continue
            s = np.zeros((4, n), np.uint64)
            s[0], s[3] = t.ids, 1
            s[1, :-1] = np.where(t.fresh[1:], 0, t.ids[1:])
            s[2, :-2] = np.where(t.fresh[1:-1] | t.fresh[2:], 0, t.ids[2:])
            s = _distinct(s)
            group = prefix_groups(s[0], s[1], s[2], frequent.value[0], groups)
            order = np.argsort(group, kind="stable")
            s, group = s[:, order], group[order]
            cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)).tolist()
            packed = [_pack(np.ascontiguousarray(s[:, a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(group[cuts[:-1]]), pa.array(packed, pa.binary())], schema=_PACKED)

    return task


def subtree_counts(suffixes: np.ndarray, frequent: np.ndarray, totals: np.ndarray, least: int) -> list[np.ndarray]:
    """x, y, z, a, l of a group's nodes of depth two (z = 0) and three. l: occurrences of x.

    Nodes of fewer than ``least`` occurrences are left out, but those of two frequent words, whose totals are partial.
    """
    s = _distinct(suffixes)
    x, y, z, a = s[0], s[1], s[2], s[3].astype(np.int64)
    top = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    own = np.add.reduceat(a, top)
    hot = _within(x[top], frequent)
    if hot.any():  # their subtrees are spread over groups; their totals were counted before
        own[hot] = totals[np.searchsorted(frequent, x[top][hot])]
    own = np.repeat(own, np.diff(np.append(top, len(x))))
    two = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    pair = np.add.reduceat(a, two)
    kept = (y[two] > 0) & ((pair >= least) | (_within(x[two], frequent) & _within(y[two], frequent)))
    three = np.flatnonzero((z > 0) & (a >= least))
    both = np.concatenate([two[kept], three])
    none = np.zeros(int(kept.sum()), np.uint64)
    return [x[both].view(np.int64), y[both].view(np.int64), np.concatenate([none, z[three]]).view(np.int64), np.concatenate([pair[kept], a[three]]), own[both]]


def _subtrees(frequent, least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree() -> Iterator[pa.RecordBatch]:
            nodes = subtree_counts(np.concatenate(held, axis=1), *frequent.value, least)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in nodes], schema=_NODES)

        now, held = None, []
        for batch in batches:
            for group, suffixes in zip(batch.column("group").to_pylist(), batch.column("suffixes").to_pylist(), strict=True):
                if group != now and held:
                    yield from tree()
                    held = []
                now = group
                held.append(_unpack(suffixes))
        if held:
            yield from tree()

    return task


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    wide = lambda c: f"cast({c} as decimal(16,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide(a)} * {wide(a)})) div ({wide(l)} * {wide(r)})")


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (id, lang, word, n), pairs (x, y, a, l) and triples (x, y, z, a) of ``docs`` (lang, text); x, y, z are ids. Pairs and
    triples occur ``least`` times or more."""
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, seed = _words(texts)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-2 * total // budget))
    hot = [tuple(r) for r in words.filter(F.col("n") > max(1, budget // 8)).select("id", "n").collect()]  # at most four a group
    ids = np.array([h[0] for h in hot], np.int64).view(np.uint64)
    order = np.argsort(ids)
    frequent = spark.sparkContext.broadcast((ids[order], np.array([h[1] for h in hot], np.int64)[order]))
    dealt = texts.mapInArrow(_deal(seed, frequent, groups), "group long, suffixes binary")
    tasks = min(groups, MOST_TASKS)
    nodes = dealt.repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int")).sortWithinPartitions("group").mapInArrow(_subtrees(frequent, least), "x long, y long, z long, a long, l long")
    nodes = materialize(nodes, "nodes")
    pairs = nodes.filter("z = 0").groupBy("x", "y").agg(F.sum("a").alias("a"), F.max("l").alias("l")).filter(F.col("a") >= least)
    return words, pairs, nodes.filter("z <> 0").select("x", "y", "z", "a")


def _best(phrases: DataFrame, top: int) -> DataFrame:
    """Rows that may be among a language's first: those of each part's, ties included."""
    parts = phrases.withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), F.lit(RANK_PARTS)))
    order = Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a"))
    return parts.withColumn("place", F.rank().over(order)).filter(F.col("place") <= top).drop("place")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """Each language's ``top`` phrases of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score."""
    words, pairs, triples = phrase_counts(docs, least, budget)
    often = words.filter(F.col("n") >= least)
    pairs = materialize(pairs.join(often.select(F.col("id").alias("y"), "lang", F.col("n").alias("r")), "y"), "pairs")
    first = pairs.select("x", "y", "lang", F.col("a").alias("xy"), F.col("l").alias("x_n"))
    rest = pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("yz"), F.col("r").alias("z_n"))
    cuts = triples.join(first, ["x", "y"]).join(rest, ["y", "z"]).withColumn("s1", _score("a", "x_n", "yz")).withColumn("s2", _score("a", "xy", "z_n"))
    early = F.col("s1") <= F.col("s2")
    three = cuts.select("lang", "x", "y", "z", "a", F.when(early, F.col("x_n")).otherwise(F.col("xy")).alias("l"), F.when(early, F.col("yz")).otherwise(F.col("z_n")).alias("r"), F.least("s1", "s2").alias("score"))
    three = materialize(three, "triples")
    inside = three.select("x", "y", "a").union(three.select("y", "z", "a")).toDF("x", "y", "longer").groupBy("x", "y").agg(F.max("longer").alias("longer"))
    covered = F.coalesce(COVERED[0] * F.col("longer") >= COVERED[1] * F.col("a"), F.lit(False))
    two = pairs.join(inside, ["x", "y"], "left").filter(~covered).select("lang", "x", "y", F.lit(0).cast("long").alias("z"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    found = materialize(_best(two.unionByName(three), top), "best")
    for part in "xyz":
        names = often.select(F.col("id").alias(part), F.col("word").alias(f"{part}_word"))
        found = found.join(names, part, "left" if part == "z" else "inner")
    named = found.withColumn("phrase", F.concat_ws(" ", "x_word", "y_word", "z_word"))
    full = (F.desc("score"), F.desc("a"), "phrase")
    few = named.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*full))).filter(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*full)).cast("long")).filter(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``collocations`` of the whole of ``documents``."""
    return collocations(read_table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same rows by counting all phrases.
OP13_SQL = rf"""
with p as (select coalesce(lang, '{NO_LANG}') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, ws[i:i + k - 1] as parts from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (values (1), (2), (3)) as s(k) where len(ws) >= k)),
f as materialized (select lang, k, phrase, any_value(parts) as parts, count(*)::hugeint as a from g group by lang, k, phrase),
t as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
part as materialized (
  select lang, k, phrase, parts, a, j, array_to_string(parts[1:j], ' ') as head, array_to_string(parts[j + 1:k], ' ') as tail
  from (select *, unnest(range(1, k)) as j from f where k >= 2 and a >= {LEAST})),
cut as materialized (
  select part.*, x.a as l, y.a as r, 1000000 * part.a * part.a // (x.a * y.a) as score
  from part join f x on x.lang = part.lang and x.phrase = part.head join f y on y.lang = part.lang and y.phrase = part.tail),
low as (select * from cut qualify row_number() over (partition by lang, k, phrase order by score, j) = 1),
inner2 as (
  select lang, phrase, max(a) as longer from (
    select lang, array_to_string(parts[1:2], ' ') as phrase, a from low where k = 3
    union all select lang, array_to_string(parts[2:3], ' ') as phrase, a from low where k = 3) group by lang, phrase),
kept as (select low.* from low left join inner2 i on low.k = 2 and i.lang = low.lang and i.phrase = low.phrase where i.longer is null or 100 * i.longer < 50 * low.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join t using (lang) where rank <= {TOP}
"""
