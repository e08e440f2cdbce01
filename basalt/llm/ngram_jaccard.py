"""N-gram Jaccard join: documents whose word shingle sets reach a Jaccard similarity, and their components.

Method: token-combination prefixes. Shingles that occur in one set only are left out: a bounded count-min sketch tells
most of them, and Spark counts the rest exactly. All others stand in one global order, by the level of their count,
rarest first. A document with ``s`` shingles may miss ``t = s - ceil(0.75 s)`` of them in any partner. Of its rare
shingles the first ``t + 1`` (less those left out) are indexed alone. Where it has fewer, linked documents may share
frequent shingles only, and these are indexed in combinations:

- Frequent shingles are dealt into groups of about ``GROUP`` by their hash. If two sets reach a similarity, so do
  their parts in one group at least; for if each group's differences were above its share, so would their sum be.
- Within a group the prefix is extended until losing any ``t`` shingles of the group leaves two of class 2 or three
  of class 3 (those of ``TRIPLES`` occurrences or more), and all combinations of so many are indexed. That is a
  number of combinations in proportion to a document's shingles, however long it is.

Linked documents share an indexed shingle or combination; every candidate is verified.

The sketch is broadcast and never grows beyond ``sketch.MAX_BITS``; with more text its cells hold more keys and more
shingles are left to the exact count, at most all of them: one shuffle of 16 bytes a shingle of distinct sets.
Shingles of a ``sketch.HOT_PART`` of all occurrences are dealt out in that shuffle and keep the level of their cell.

Documents with equal sets are one class, joined by its smallest doc_id. In an index entry, each member is
first verified against one pivot; only members that are then in different components, and that pass the size
and position bounds, are paired. Pairs within a component can't change the components, so no link that
matters is lost and copies are never expanded into all pairs. A pair is made only if its marks allow a link: each
document has ``MARKS`` longs of bits, the parities of the numbers of its shingles in as many buckets. Where two
documents' bits differ, one has a shingle more in that bucket, so the differing bits never outnumber the shingles that
only one of them has: the marks bound the intersection from above, and no link is lost.

Near copies meet in nearly all of their entries. So documents that entries of ``LARGE`` members join are one cluster, and where
a cluster has fewer pairs than its entries together have, its pairs are made once, by tiles of the cluster, and not entry by entry.

Defined cases: null and empty texts have no shingles and link with nothing; a text of fewer words than a
shingle is one shingle of all its words; repeated rows share their component; a null doc_id takes the
component of its class but is never one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sketch
from .common import join_classes, materialize, read_table, tune
from .components import components
from .textkernel import WINDOW_BASES, chunks, lower_ascii, mix, window_hashes, word_hashes, word_spans

WORDS = 5
PERCENT = 75
#: Counts from which shingles are indexed in twos and in threes.
PAIRS, TRIPLES = 1 << 11, 1 << 17
#: Frequent shingles of a document in one group, between this and twice as many on average; fewer are one group.
GROUP = 128
BYTES_A_SHINGLE = 6
#: Parts into which the occurrences of a hot shingle are dealt.
PARTS = 64
#: Members from which an entry is large.
LARGE = 256
#: Documents of a cluster in one tile, and the most tiles of a cluster; with more documents tiles grow.
TILE, TILES = 256, 64
_GROUP_SALT = np.uint64(0x589965CC75374CC3)
#: Longs of a document's marks: 512 parities tell unlike sets of up to some 900 shingles apart; longer ones go on to verification.
MARKS = 8
_MARK_SALT = np.uint64(0x1D8E4E27C47D124F)


def _least_shared(n, percent: int):
    """Shingles that a document of ``n`` must share with any partner."""
    return -(-percent * n // 100)


def _shingle_sets(column: pa.Array, k: int, digests: bool = False) -> Iterator[tuple[np.ndarray, int, int]]:
    """For each text its distinct shingle hashes, sorted, and if asked two digests of the set, from unlike hashes of its words."""
    for lo, hi, data, offsets in chunks(column):
        data = lower_ascii(data)
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        shingles = window_hashes(words, k)
        if digests:
            others = word_hashes(data, starts, ends, 1)
            second = window_hashes(others, k, WINDOW_BASES[1])
        for i in range(hi - lo):
            w0, w1 = first[i], first[i + 1]
            n = int(w1 - w0)
            if n >= k:
                x, at = np.unique(shingles[w0 : w1 - k + 1], return_index=True)
                y = second[w0:][at] if digests else x
            else:
                x = window_hashes(words[w0:w1], n) ^ np.uint64(n) if n else words[:0]
                y = window_hashes(others[w0:w1], n, WINDOW_BASES[1]) ^ np.uint64(n) if n and digests else x
            yield (x, int(mix(x).sum(dtype=np.uint64).view(np.int64)), int(mix(y).sum(dtype=np.uint64).view(np.int64))) if digests else (x, 0, 0)


def _keys(k: int):
    return lambda batch: (x for x, _, _ in _shingle_sets(batch.column("text"), k) if len(x))


def _sets(k: int):
    """Each document's number of shingles and digests of their set."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(x), a, b) for x, a, b in _shingle_sets(batch.column("text"), k, digests=True)]
            columns = [pa.array(c, pa.int64()) for c in zip(*sets, strict=True)] if sets else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], schema=schema)

    return task


def _occurrences(lookup, k: int, percent: int):
    """Shingles that may be in other sets, of documents that may have a partner. ``part``: 0, or for a hot shingle its level and
    one of ``PARTS``."""
    schema = pa.schema([("token", pa.int64()), ("rid", pa.int64()), ("part", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column("rid").to_numpy()
            sets = [x for x, _, _ in _shingle_sets(batch.column("text"), k)]
            sizes = np.array([len(x) for x in sets], np.int64)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), sizes)
            maybe, level = lookup.value.seen(every)
            kept = np.bincount(owner, maybe, len(sets))
            maybe &= (kept >= _least_shared(sizes, percent))[owner]
            token, rid, level = every[maybe].view(np.int64), rids[owner[maybe]], level[maybe].astype(np.int32)
            part = np.where(level > 0, level * PARTS + (mix(rid.view(np.uint64)) % np.uint64(PARTS)).astype(np.int32), 0).astype(np.int32)
            for lo in range(0, len(token), 50_000):
                cut = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(token[cut]), pa.array(rid[cut]), pa.array(part[cut])], schema=schema)

    return task


_SHARED = "rid long, doc_id long, n long, kept int, rare int, twos int, marks array<long>, tokens binary"


def marks_of(tokens: np.ndarray) -> np.ndarray:
    """Parities of the numbers of ``tokens`` in each of ``64 * MARKS`` buckets, as bits of longs."""
    bucket = (mix(tokens ^ _MARK_SALT) % np.uint64(64 * MARKS)).astype(np.int64)
    odd = np.bincount(bucket, minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _ordered(percent: int):
    """Shared shingles of each document in the global order; documents with too few of them go."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("kept", pa.int32()), ("rare", pa.int32()), ("twos", pa.int32()), ("marks", pa.list_(pa.int64())), ("tokens", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            cuts = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            flat = lists.flatten()
            tokens, levels = flat.field("token").to_numpy().view(np.uint64), flat.field("level").to_numpy()
            out: dict[str, list] = {n: [] for n in schema.names}
            for i, (rid, doc, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "n")), strict=True)):
                x, level = tokens[cuts[i] : cuts[i + 1]], levels[cuts[i] : cuts[i + 1]]
                if len(x) < _least_shared(n, percent):
                    continue
                rare, twos = (int((level < c.bit_length() - 1).sum()) for c in (PAIRS, TRIPLES))
                for name, value in zip(schema.names, (rid, doc, n, len(x), rare, twos, marks_of(x), x[np.lexsort((x, level))].tobytes()), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return task


def combinations(owner: np.ndarray, power: np.ndarray, tokens: np.ndarray, three: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of frequent shingles, their owners, the size of their group (0 where it is the only one), and how many
    shingles of the group a partner can share whose first shared ones these are. ``tokens`` of an owner stand in the
    global order, class 2 before class 3 (``three``), and fall into 2 ** ``power`` groups by their hash."""
    scattered = mix(tokens ^ _GROUP_SALT)
    group = np.where(power > 0, scattered >> (np.uint64(64) - np.maximum(power, 1).astype(np.uint64)), np.uint64(0))
    order = np.lexsort((group, owner))  # stable: the global order stays within a group
    owner, power, tokens, three, group = owner[order], power[order], tokens[order], three[order], group[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (group[1:] != group[:-1]))
    starts = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    size = np.diff(np.append(starts, len(tokens)))
    rank = np.arange(len(tokens)) - starts[of]
    twos = size - np.bincount(of, three, len(starts)).astype(np.int64)
    lose = size - _least_shared(size, percent)
    enough = twos >= lose + 2
    rest = lose + 1 - np.maximum(twos - 1, 0)
    short = ~enough & (size - twos < rest + 2)  # too few for combinations alone: all of them, and single shingles
    use2 = np.where(enough, lose + 2, twos)
    use3 = np.where(enough, 0, np.where(short, size - twos, rest + 2))
    label = mix(power.astype(np.uint64) + np.uint64(11))
    found: list[list[np.ndarray]] = [[], [], [], []]

    def emit(i: np.ndarray, value: np.ndarray, last: int, n: int) -> None:
        """Signatures of ``n`` shingles each, the first at the places ``i``, the last so many places later."""
        sizes = size[of[i]]
        for x, y in zip(found, (mix(value ^ label[i]), owner[i], np.where(power[i] > 0, sizes, 0), sizes - rank[i] - last + n - 1), strict=True):
            x.append(y)

    def later(i: np.ndarray, step: int, most: np.ndarray) -> np.ndarray:
        """Which of the places ``i`` have one ``step`` further on that is still used."""
        return rank[i] + step < most[of[i]]

    base = np.uint64(WINDOW_BASES[0])
    single = np.flatnonzero(short[of] & (rank < (lose + 1)[of]))
    emit(single, tokens[single], 0, 1)
    two = np.flatnonzero(rank < use2[of])
    for a in range(1, int(use2.max(initial=0))):
        two = two[later(two, a, use2)]
        emit(two, mix(tokens[two] * base + tokens[two + a]), a, 2)
    three_at = np.flatnonzero((rank >= twos[of]) & (rank < (twos + use3)[of]))
    for b in range(2, int(use3.max(initial=0))):
        three_at = three_at[later(three_at, b, twos + use3)]
        for a in range(1, b):
            emit(three_at, mix(mix(tokens[three_at] * base + tokens[three_at + a]) * base + tokens[three_at + b]), b, 3)
    return tuple(np.concatenate(x) for x in found)


def _powers(frequent: int, percent: int) -> range:
    """Powers of two of groups that a document with so many frequent shingles and any partner of it may use."""
    power = lambda n: max(0, int(n / GROUP).bit_length() - 1)
    return range(power(_least_shared(frequent, percent)), power(frequent * 100 // percent) + 1)


_INDEX = pa.schema([("sig", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("room", pa.int64())])
#: Shingles whose combinations are made at once.
_AT_ONCE = 100_000


def _signatures(percent: int):
    """Index entries of a document. ``room``: the most shingles that a partner can share whose first shared ones are these;
    ``n``: of how many, those of the group where there are several groups."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, rooms, owners = [], [], []
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("n", "kept", "rare", "twos", "tokens")), strict=True))
            rid, n = (batch.column(c).to_numpy() for c in ("rid", "n"))
            waiting: list[tuple] = []
            held = 0

            def batches_of(sig: np.ndarray, owner: np.ndarray, size: np.ndarray, room: np.ndarray) -> Iterator[pa.RecordBatch]:
                for lo in range(0, len(sig), 50_000):
                    cut = slice(lo, lo + 50_000)
                    o = owner[cut]
                    yield pa.RecordBatch.from_arrays([pa.array(sig[cut].view(np.int64)), pa.array(rid[o]), pa.array(size[cut]), pa.array(room[cut])], schema=_INDEX)  # noqa: B023

            def combined() -> Iterator[pa.RecordBatch]:
                sig, owner, size, room = combinations(*(np.concatenate(x) for x in zip(*waiting, strict=True)), percent)  # noqa: B023
                yield from batches_of(sig, owner, np.where(size > 0, size, n[owner]), room)  # noqa: B023

            for row, (size, k, rare, twos, tokens) in enumerate(rows):
                if size < 2:  # one shingle links with equal sets alone
                    continue
                x = np.frombuffer(tokens, np.uint64)
                need = k - _least_shared(size, percent) + 1
                alone = x[: min(need, rare)]
                sigs.append(alone)
                rooms.append(k - np.arange(len(alone)))
                owners.append(np.full(len(alone), row))
                f = x[rare:]
                if need > rare and len(f):
                    for power in _powers(len(f), percent):
                        waiting.append((np.full(len(f), row), np.full(len(f), power), f, np.arange(len(f)) >= twos - rare))
                        held += len(f)
                if held >= _AT_ONCE:
                    yield from combined()
                    waiting, held = [], 0
            if waiting:
                yield from combined()
            if sigs:
                owner = np.concatenate(owners)
                yield from batches_of(np.concatenate(sigs), owner, n[owner], np.concatenate(rooms))

    return task


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("total", pa.int64()), ("shared", pa.int64())])
    for batch in batches:
        shared = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            z = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
            shared.append(int((z[1:] == z[:-1]).sum()))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "total": batch.column("total"), "shared": shared}, schema=schema)


def shared_shingles(texts: DataFrame, eldest: DataFrame, words: int, percent: int) -> DataFrame:
    """For each document of ``eldest`` that may have a partner: the shingles that other sets hold, in the global order (``_SHARED``)."""
    spark = texts.sparkSession
    seen = sketch.build(texts, _keys(words), 1, BYTES_A_SHINGLE, most_bits=sketch.MAX_BITS).lookup("both")
    own = texts.join(eldest.select("doc_id", "text_hash", "rid"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "rid"])
    rows = own.select("rid", "text").mapInArrow(_occurrences(spark.sparkContext.broadcast(seen), words, percent), "token long, rid long, part int")
    counted = rows.withColumn("c", F.count("*").over(Window.partitionBy("token", "part"))).filter("c > 1 or part > 0")
    level = F.when(F.col("part") > 0, F.expr(f"part div {PARTS}")).otherwise(F.floor(F.log2("c"))).cast("int")
    found = counted.select("rid", F.struct("token", level.alias("level")).alias("x")).groupBy("rid").agg(F.collect_list("x").alias("found"))
    return materialize(found.join(eldest.select("rid", "doc_id", "n"), "rid").mapInArrow(_ordered(percent), _SHARED), "shared")


def clusters(index: DataFrame) -> DataFrame:
    """(rid, cluster, tiles) of documents that large entries of ``index`` (rid, p, members) join, of clusters that have no more pairs than
    their entries together."""
    large = index.filter(F.col("members") >= LARGE)
    joined = components(large.filter("rid <> p").select("rid", "p").distinct()).toDF("rid", "cluster")
    held = materialize(large.groupBy("rid").agg(F.sum("members").alias("met")).join(joined, "rid"), "clusters")
    sizes = held.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("met").alias("met")).filter("docs * docs <= met")
    sizes = materialize(sizes.select("cluster", "docs", F.least(F.lit(TILES), F.ceil(F.col("docs") / TILE)).cast("long").alias("tiles")), "sizes")
    return materialize(join_classes(held.drop("met"), sizes, ["cluster"], "docs").drop("docs"), "once")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles and component_id."""
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sets = materialize(texts.mapInArrow(_sets(words), "doc_id long, text_hash long, n long, d1 long, d2 long"), "sets")

    able = sets.filter("n > 0")
    classes = materialize(able.groupBy("d1", "d2").agg(F.min("doc_id").alias("eldest"), F.count("*").alias("copies")), "classes")
    first = classes.select(F.col("eldest").alias("doc_id"), "d1", "d2")
    eldest = able.join(first, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"]).select("doc_id", "text_hash", "n")
    eldest = materialize(eldest.withColumn("rid", F.monotonically_increasing_id()), "eldest")
    shared = shared_shingles(texts, eldest, words, percent)

    index = shared.mapInArrow(_signatures(percent), "sig long, rid long, n long, room long")
    pivot = F.max(F.struct((F.col("room") / F.col("n")).alias("clean"), "n", (-F.col("rid")).alias("minus"), "rid", "room"))
    entries = index.groupBy("sig").agg(F.count("*").alias("members"), pivot.alias("pivot")).filter("members > 1")
    entries = materialize(entries.select("sig", "members", F.col("pivot.rid").alias("p"), F.col("pivot.n").alias("pn"), F.col("pivot.room").alias("proom")), "entries")
    index = materialize(join_classes(index, entries, ["sig"], "members"), "index")

    def fits(n: str, m: str, *most: str) -> str:
        return f"least({', '.join(most)}) * {100 + percent} >= {percent} * ({n} + {m}) and 100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda *names: shared.select("rid", "doc_id", "n", "tokens").toDF(*names)
        both = pairs.join(side("a", "da", "an", "x"), "a").join(side("b", "db", "bn", "y"), "b").select(F.col("da").alias("a"), F.col("db").alias("b"), (F.col("an") + F.col("bn")).alias("total"), "x", "y")
        return both.mapInArrow(_shared, "a long, b long, total long, shared long").filter(f"shared * {100 + percent} >= {percent} * total").select("a", "b")

    star = index.filter("rid <> p").filter(fits("n", "pn", "room", "proom")).select(F.least("rid", "p").alias("a"), F.greatest("rid", "p").alias("b")).distinct()
    star = materialize(star, "pairs")
    links = materialize(verified(star), "links")
    found = materialize(components(links), "components")

    known = shared.select("rid", F.col("doc_id").alias("id"), F.col("n").alias("size"), "kept", "marks").join(found, "id", "left").select("rid", "size", "kept", "marks", F.coalesce("component", "id").alias("component"))
    once = clusters(index)
    large = F.col("members") >= LARGE
    single = index.filter(~large).unionByName(index.filter(large).join(once.select("rid"), "rid", "left_anti"))
    named = single.select("sig", "rid", "n", "room").join(known.select("rid", "component"), "rid")
    split = named.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).filter("lo < hi").select("sig", "members")
    named = materialize(join_classes(named, materialize(split, "split"), ["sig"], "members").drop("members"), "open")
    apart = " + ".join(f"bit_count(marks[{i}] ^ bmarks[{i}])" for i in range(MARKS))
    alike = f"component <> bc and (kept + bkept - ({apart})) * {100 + percent} >= {2 * percent} * (size + bsize)"

    def met(left: DataFrame, right: DataFrame, keys: list[str], condition: str) -> DataFrame:
        """Pairs of rows of equal ``keys`` that may be links; the right side's columns begin with b."""
        other = right.select(*keys, *(F.col(c).alias("b" + c) for c in right.columns if c not in (*keys, "rid", "component")), F.col("rid").alias("b"), F.col("component").alias("bc"))
        return left.join(other, keys).filter(condition).filter(alike).select(F.least("rid", "b").alias("a"), F.greatest("rid", "b").alias("b"))

    named = named.join(known.drop("component"), "rid")
    tiled = once.join(known.drop("id"), "rid").withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles")))
    first = tiled.select("*", F.col("tile").alias("x"), F.explode(F.expr("sequence(tile, tiles - 1)")).alias("y"))
    second = tiled.select("*", F.explode(F.expr("sequence(0L, tile)")).alias("x"), F.col("tile").alias("y"))
    rest = met(named, named, ["sig"], f"rid < b and {fits('n', 'bn', 'room', 'broom')}").unionByName(met(first, second, ["cluster", "x", "y"], "x < y or rid < b")).distinct()
    more = materialize(verified(rest.join(star, ["a", "b"], "left_anti")), "links")
    if not more.isEmpty():
        found = materialize(components(found.select("id", "component").union(more)), "components")
    named = classes.join(found.withColumnRenamed("id", "eldest"), "eldest", "left").select("d1", "d2", "copies", F.coalesce("component", "eldest").alias("component_id"))
    joined = join_classes(able.select("doc_id", "n", "d1", "d2"), named, ["d1", "d2"], "copies")
    alone = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return alone.unionByName(joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``jaccard_components`` over the whole of ``documents``."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


#: The same rows by joining all shingles and walking the links.
OP3_SQL = r"""
with recursive w as materialized (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as materialized (
  select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) end as g from w),
t as materialized (select doc_id, unnest(g) as tok from s),
i as (select x.doc_id as a, y.doc_id as b, count(*) as n from t x join t y on x.tok = y.tok and x.doc_id < y.doc_id group by all),
l as materialized (select a, b from i join s sa on sa.doc_id = a join s sb on sb.doc_id = b where 100 * n >= 75 * (len(sa.g) + len(sb.g) - n)),
e as materialized (select a, b from l union all select b, a from l),
r(id, c) as (select doc_id, doc_id from s union select e.b, r.c from r join e on e.a = r.id where r.c < e.b)
select s.doc_id, len(g)::bigint as n_shingles, c.component_id from s join (select id, min(c) as component_id from r group by id) c on c.id = s.doc_id
"""
