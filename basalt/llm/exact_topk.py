"""Exact top-k search over quantised vectors with vector-approximation files.

Each component x becomes floor(256 * x). Rows are dealt into blocks; a task keeps a block as approximation files of
``FILE_ROWS`` rows: for each component the number of its cell, ``CELLS`` cells a component that hold equally many of the file's
values, with the least and largest value of each cell. Queries are packed into rows of ``QUERY_ROWS`` vectors and meet
every block in a join on the block's number; neither side passes the driver. Two matrix products of a pack with the
cells' middles and half widths bound all scores at once. Exact vectors are then read in the order of their bounds, in
growing steps, until no bound reaches the k-th score, so the result is certain. Tasks return their best k a
query and Spark merges those.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an id take no
part; only vectors of a query's own length are its candidates; rows that carry the query's own id are never
its candidates, and a repeated query id is answered once, by its smallest vector; ties go to the smaller id;
an empty vector scores 0 against empty vectors; any finite components are exact, and a score beyond the range of a
long counts as the nearest long; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, tune

K = 5
EVERY = 50
CELLS = 16
#: Rows of one approximation file, and queries of one pack.
FILE_ROWS = 2048
QUERY_ROWS = 64
#: Components that a task holds at most (8 bytes each), and rows below which a block is not cut smaller.
BLOCK_COMPONENTS, LEAST_ROWS = 1 << 23, 2048
_LARGEST = (1 << 63) - 1
_NO_ID = _LARGEST
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(e: np.ndarray) -> np.ndarray:
    """floor(256 * x): whole numbers, exact as doubles, for components whose product is finite."""
    with np.errstate(over="ignore"):
        return np.floor(e * 256.0)


def _whole(row: np.ndarray) -> list[int]:
    """The same as Python's whole numbers, however large."""
    return [int(x) * 256 if abs(x) >= 2.0**53 else int(np.floor(x * 256.0)) for x in row.tolist()]


def exact_scores(e_left: np.ndarray, e_right: np.ndarray) -> np.ndarray:
    """Inner products of rows, as longs; those beyond a long's range are the nearest long."""
    left, right = quantised(e_left), quantised(e_right)
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.einsum("ij,ij->i", np.abs(left), np.abs(right))
    sure = size < 2.0**53  # sums of whole doubles below this are exact in any order
    out = np.zeros(len(left), np.int64)
    out[sure] = np.einsum("ij,ij->i", left[sure], right[sure]).astype(np.int64)
    for i in np.flatnonzero(~sure).tolist():
        score = sum(a * b for a, b in zip(_whole(e_left[i]), _whole(e_right[i]), strict=True))
        out[i] = max(-_LARGEST - 1, min(_LARGEST, score))
    return out


class File:
    """An approximation file of vectors of one length, beside the vectors."""

    def __init__(self, ids: np.ndarray, e: np.ndarray):
        self.ids, self.e = ids, e
        n, dim = e.shape
        q = np.clip(quantised(e), -1e300, 1e300)
        order = np.sort(q, axis=0)
        places = np.linspace(0, n - 1, CELLS + 1).astype(int)[1:-1]
        self.cells = np.zeros((n, dim), np.uint8)
        self.middle, self.half = np.zeros((CELLS, dim)), np.zeros((CELLS, dim))
        for d in range(dim):
            cell = np.searchsorted(order[places, d], q[:, d], side="left").astype(np.uint8)
            self.cells[:, d] = cell
            low, high = np.full(CELLS, np.inf), np.full(CELLS, -np.inf)
            np.minimum.at(low, cell, q[:, d])
            np.maximum.at(high, cell, q[:, d])
            held = low <= high
            self.middle[held, d] = low[held] / 2 + high[held] / 2
            self.half[held, d] = high[held] / 2 - low[held] / 2

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No score of a query and a row is above its bound."""
        q = np.clip(quantised(queries), -1e300, 1e300)
        at = np.arange(self.e.shape[1])
        with np.errstate(over="ignore", invalid="ignore"):
            middle, half = q @ self.middle[self.cells, at].T, np.abs(q) @ self.half[self.cells, at].T
            size = np.abs(q) @ np.abs(self.middle[self.cells, at]).T + half
            bound = middle + half + size * 1e-12
        return np.where(np.isfinite(size) & (size < 1e300), bound, np.inf)  # too large to bound: it is read


class Best:
    """The best k of each query of a pack so far."""

    def __init__(self, ids: np.ndarray, e: np.ndarray, k: int):
        self.ids, self.e, self.k = ids, e, k
        self.scores = np.full((len(ids), k), -_LARGEST - 1)
        self.found = np.full((len(ids), k), _NO_ID)

    def reach(self) -> np.ndarray:
        """What a bound must reach; anything while there are fewer than k."""
        return np.where(self.found[:, -1] == _NO_ID, -np.inf, self.scores[:, -1].astype(float))

    def offer(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        whose = np.concatenate([query, np.repeat(np.arange(len(self.ids)), self.k)])
        ids = np.concatenate([ids, self.found.ravel()])
        scores = np.concatenate([scores, self.scores.ravel()])
        order = np.lexsort((ids, ~scores, ids == _NO_ID, whose))  # ~ turns the order round without overflow
        whose, ids, scores = whose[order], ids[order], scores[order]
        take = np.searchsorted(whose, np.arange(len(self.ids)))[:, None] + np.arange(self.k)
        self.scores, self.found = scores[take], ids[take]

    def scan(self, file: File) -> None:
        bound = file.bounds(self.e)
        other = self.ids[:, None] != file.ids[None, :]
        q, v = np.nonzero(other & (bound >= self.reach()[:, None]))
        order = np.lexsort((-bound[q, v], q))
        q, v = q[order], v[order]
        step = self.k
        while len(q):
            first = np.append(True, q[1:] != q[:-1])
            rank = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            now = rank < step
            for lo in range(0, int(now.sum()), 1 << 14):
                a, b = q[now][lo : lo + (1 << 14)], v[now][lo : lo + (1 << 14)]
                self.offer(a, file.ids[b], exact_scores(self.e[a], file.e[b]))
            q, v = q[~now], v[~now]
            still = bound[q, v] >= self.reach()[q]
            q, v = q[still], v[still]
            step *= 2


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim) if dim else np.zeros((0, 0))


def _pack(rows: int):
    """Vectors of one partition, packed by length: dim, ids and components."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            return pa.RecordBatch.from_pydict({"dim": [dim], "ids": [b"".join(i for i, _ in parts)], "data": [b"".join(d for _, d in parts)]}, schema=schema)

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            lists = batch.column("e")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for i, dim in enumerate(sizes.tolist()):
                held.setdefault(dim, []).append((ids[i].tobytes(), flat[ends[i] - dim : ends[i]].astype("<f8").tobytes()))
                if len(held[dim]) == rows:
                    yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return task


def _search(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, files = None, []
        for batch in batches:
            for number, kind, dim, ids, data in zip(*(batch.column(n).to_pylist() for n in ("block", "kind", "dim", "ids", "data")), strict=True):
                if number != block:
                    block, files = number, []
                ids = np.frombuffer(ids, "<i8")
                e = _matrix(data, dim) if dim else np.zeros((len(ids), 0))
                if kind == 0:
                    files.append((dim, File(ids, e)))
                    continue
                best = Best(ids, e, k)
                for d, file in files:
                    if d == dim:
                        best.scan(file)
                q, r = np.nonzero(best.found != _NO_ID)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.found[q, r]), pa.array(best.scores[q, r])], schema=_FOUND)

    return task


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The ``k`` best rows for each query of ``vectors`` (vec_id, embedding): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    tune(spark)
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter("vec_id is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    total = usable.agg(F.count("*"), F.coalesce(F.sum(F.size("e")), F.lit(0))).first()
    blocks = max(1, -(-total[1] // BLOCK_COMPONENTS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total[0] // LEAST_ROWS))
    packs = "dim int, ids binary, data binary"
    dealt = usable.withColumn("block", F.pmod(F.xxhash64("vec_id", "e"), F.lit(blocks)).cast("int")).repartition(blocks, "block").sortWithinPartitions("block")
    rows = dealt.mapInArrow(_by_block(FILE_ROWS), f"block int, {packs}").withColumn("kind", F.lit(0))
    asked = usable.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("e").alias("e")).mapInArrow(_pack(QUERY_ROWS), packs)
    queries = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(1))
    met = rows.select("block", "kind", "dim", "ids", "data").unionByName(queries.select("block", "kind", "dim", "ids", "data"))
    found = met.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_block(rows: int):
    """``_pack`` for sorted rows of several blocks, with the block's number."""
    schema = pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
    pack = _pack(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch packs its own rows, so files are as long as batches at most
            numbers = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])).tolist() + [len(numbers)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for packed in pack(iter([batch.slice(lo, hi - lo)])):
                    block = pa.array(np.full(packed.num_rows, numbers[lo], np.int32))
                    yield pa.RecordBatch.from_arrays([block, *packed.columns], schema=schema)

    return task


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search`` over the whole of ``embeddings``."""
    return search(read_table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s) where rank <= 5
"""
