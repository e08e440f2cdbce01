"""Communities of neighbour graphs by modularity: local moves within parts of the graph, refinement, then the same on communities.

Edges of all settings (a graph and a resolution each) are one table, so the number of jobs does not follow the settings. A setting of at most
``WHOLE`` times ``PART_EDGES`` edges is taken through all its levels by one task, and its moves are exact. Of larger settings, in a
round the edges are cut into ranges of (setting, community, node) of about ``PART_EDGES``; a task lets the nodes of its range
move one after the other to the neighbouring community of the largest gain, with the other ranges' nodes as they were. A node whose
edges are cut by a border stays in that round, so no task holds more than its range. Then communities are split
into connected parts. Up to ``ROUNDS`` rounds are made a level, and one that does not raise a setting's modularity is taken back for it. Then
communities become the nodes of a smaller graph. A setting is done when a level does not raise its modularity, and goes to one task as soon as it
fits. Each level halves the nodes or ends, so jobs are bounded by ``ROUNDS`` times the logarithm of the nodes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.sources.tables import scratch

PART_EDGES = 1 << 21
#: So many ranges' edges of one setting are taken through all levels by one task; an edge takes half the room of one in a range.
WHOLE = 2
ROUNDS = 4
SWEEPS = 20
LEAST_GAIN = 1e-7

_MOVES = pa.schema([("setting", pa.int32()), ("node", pa.int64()), ("k", pa.float64()), ("label", pa.int64()), ("split", pa.int64()), ("moved", pa.bool_())])
_MOVES_SCHEMA = "setting int, node long, k double, label long, split long, moved boolean"
_NAMES = pa.schema([("setting", pa.int32()), ("node", pa.int64()), ("community", pa.int64())])
_NAMES_SCHEMA = "setting int, node long, community long"
_OF_NODE, _OF_EDGE = ("i", "ci", "k", "degree", "si"), ("j", "cj", "sj", "w")


def fuzzy_weights(neighbours: DataFrame, k: int) -> DataFrame:
    """Symmetric weights of a neighbour table (i, j, distance, rank): smooth nearest-neighbour bandwidths by bisection, fuzzy union."""
    distances = F.transform(F.array_sort(F.collect_list(F.struct("rank", "distance"))), lambda s: s["distance"])
    per = neighbours.groupBy("i").agg(distances.alias("d"))
    low = F.col("d")[0]
    goal = F.log2(F.lit(float(k)))

    def mass(sigma: Column) -> Column:
        return F.aggregate("d", F.lit(0.0), lambda s, x: s + F.exp(-F.greatest(x - low, F.lit(0.0)) / sigma))

    start = F.struct(F.lit(1e-9).alias("lo"), (F.greatest(F.array_max("d"), F.lit(1e-6)) * 64).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        more = mass(middle) > goal
        return F.struct(F.when(more, s["lo"]).otherwise(middle).alias("lo"), F.when(more, middle).otherwise(s["hi"]).alias("hi"))

    bandwidth = per.select("i", low.alias("low"), F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2).alias("sigma"))
    directed = neighbours.join(bandwidth, "i").select("i", "j", F.exp(-F.greatest(F.col("distance") - F.col("low"), F.lit(0.0)) / F.col("sigma")).alias("w"))
    both = directed.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")
    return both.groupBy("i", "j").agg((F.sum("w") - F.when(F.count("*") > 1, F.product("w")).otherwise(0.0)).alias("w"))


def _table(df: DataFrame) -> DataFrame:
    """``df`` written and read again: a lost executor loses nothing, and plans of later rounds stay small."""
    path = scratch(df.sparkSession, "communities")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _narrow(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Edges, those of a node together, with what belongs to a node once for it; ``edges``: how many it has."""
    first = np.flatnonzero(np.append(True, e["i"][1:] != e["i"][:-1]))
    return {n: e[n][first] for n in _OF_NODE} | {"edges": np.diff(np.append(first, len(e["i"])))} | {n: e[n] for n in _OF_EDGE}


def _whole(pieces: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Pieces one behind the other; a node may go over several. Columns are let go as they are joined."""
    e = {n: np.concatenate([p.pop(n) for p in pieces]) for n in (*_OF_EDGE, *_OF_NODE, "edges")}
    first = np.flatnonzero(np.append(True, e["i"][1:] != e["i"][:-1]))
    return e | {n: e[n][first] for n in _OF_NODE} | {"edges": np.add.reduceat(e["edges"], first)}


def settled(e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one range of one setting after their moves: node, k, label, split (the smallest node of a part that came off, else
    -1), moved. ``e``: edges, those of a node together, with both ends' communities and their sizes."""
    return _settled(_narrow(e), float(e["factor"][0]))


def _stays(names: np.ndarray, turn: int) -> np.ndarray:
    """Half of the communities by a hash; in the next turn the other half, then halves of another hash."""
    mixed = (names.astype(np.uint64) + np.uint64(turn // 2)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) + np.uint64(turn)) % np.uint64(2) == 0


def _settled(e: dict[str, np.ndarray], factor: float, turn: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``settled``. With a ``turn`` half of the communities, and those that go over a border, keep their nodes; a node joins others that are
    not of the range only where they keep theirs. What is joined is then there, and parts that hold on to it stay with it."""
    nodes, k, count = e["i"], e["k"], len(e["i"])
    names, at = np.unique(np.concatenate([e["ci"], e["cj"]]), return_inverse=True)
    size = np.zeros(len(names))
    size[at] = np.concatenate([e["si"], e["sj"]])
    before, other = at[:count], at[count:]
    order = np.argsort(nodes, kind="stable")
    place = np.minimum(np.searchsorted(nodes[order], e["j"]), count - 1)
    target = np.where(nodes[order][place] == e["j"], order[place], -1)
    # the other end: a node of the range, or a place behind them that holds the community of a node elsewhere
    target = np.where(target >= 0, target, count + other)
    whole = e["edges"] == e["degree"]
    free, kept = whole, None
    if turn is not None:
        stays, kept = _stays(names, turn), np.ones(count + len(names), bool)
        kept[count:] = stays
        kept[count + before] = True
        free = whole & ~stays[before] & (np.bincount(before, k, len(names)) >= size * (1 - 1e-9))[before]
    label, part, held = _moved(nodes, k, e["edges"], target, e["w"], before, size, factor, free, kept)
    return nodes, k, names[label], np.where(held, -1, part), label != before


def _moved(nodes: np.ndarray, k: np.ndarray, edges: np.ndarray, target: np.ndarray, w: np.ndarray, label: np.ndarray, size: np.ndarray, factor: float, free: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node its label after the moves, the smallest node of its part of that community, and whether the part may go on
    outside, as that of a node that stays. ``target``: the places of the other ends, behind those of the nodes the communities';
    only ``free`` nodes move, and only along edges to ``kept`` places."""
    count = len(nodes)
    owner = np.repeat(np.arange(count), edges)
    apart = target != owner  # edges of a node to itself hold it nowhere
    if kept is not None:
        apart &= kept[target]
    cuts = np.append(0, np.cumsum(np.bincount(owner[apart], minlength=count))).tolist()
    numbers = np.arange(count + len(size)).astype(object)  # a number is one object, however many edges lead there
    place, weight = numbers[target[apart]].tolist(), w[apart].tolist()
    del owner, apart, target, w
    near = [place[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    weights = [weight[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    del place, weight
    label, size, rates = numbers[label].tolist() + numbers[: len(size)].tolist(), size.tolist(), (factor * k).tolist()
    mass, tied, free = k.tolist(), (~free).tolist(), np.flatnonzero(free).tolist()
    for _ in range(SWEEPS):
        changed = False
        for n in free:
            links: dict[int, float] = {}
            get = links.get
            for t, w in zip(near[n], weights[n]):  # noqa: B905  as long as each other
                c = label[t]
                links[c] = get(c, 0.0) + w
            home, rate = label[n], rates[n]
            size[home] -= mass[n]
            best, top = home, get(home, 0.0) - rate * size[home] + 1e-12
            for c, w in links.items():
                value = w - rate * size[c]
                if value > top or (value == top and best != home and c < best):  # ties go to the smallest
                    best, top = c, value
            size[best] += mass[n]
            if best != home:
                label[n], changed = best, True
        if not changed:
            break
    # parts of a community without an edge to the rest of it come off
    root = list(range(count))

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for n in range(count):
        c = label[n]
        for t in near[n]:
            if label[t] == c:
                if t >= count:
                    tied[n] = True
                else:
                    a, b = find(n), find(t)
                    root[max(a, b)] = min(a, b)
    part = np.array([find(n) for n in range(count)])
    least = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(least, part, nodes)
    held = np.zeros(count, bool)
    np.logical_or.at(held, part, np.array(tied))
    return np.array(label[:count]), least[part], held[part]


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before."""
    return np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))


def levels(i: np.ndarray, j: np.ndarray, w: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of one setting and their communities after all levels. ``i, j, w``: its edges in both directions, by ``i`` and ``j``."""
    nodes = i[_first(i)]
    i, j = np.searchsorted(nodes, i).astype(np.int32), np.searchsorted(nodes, j).astype(np.int32)
    of = least = np.arange(len(nodes))  # the community of each node, the smallest node of each community: both in order
    while True:
        first, here = _first(i), np.arange(len(least))
        k = np.add.reduceat(w, first)
        label, part, _ = _moved(here, k, np.diff(np.append(first, len(i))), j, w, here, k, factor, np.ones(len(here), bool))
        order = np.lexsort((here, part, label))
        first = _first(label[order], part[order])
        smallest = np.empty_like(here)
        smallest[order] = np.repeat(order[first], np.diff(np.append(first, len(order))))
        names, at = np.unique(smallest, return_inverse=True)
        if len(names) == len(here):
            return nodes, nodes[least[of]]
        of, least = at[of], least[names]
        pairs = at[i] * len(names) + at[j]
        order = np.argsort(pairs)
        pairs, w = pairs[order], w[order]
        first = _first(pairs)
        i, j, w = (pairs[first] // len(names)).astype(np.int32), (pairs[first] % len(names)).astype(np.int32), np.add.reduceat(w, first)


def _by_setting(batches: Iterator[pa.RecordBatch], form: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> Iterator[tuple[int, list[dict[str, np.ndarray]]]]:
    """Settings and their rows in pieces, each brought into its ``form`` as it comes."""
    held: list[dict[str, np.ndarray]] = []
    own = None
    for batch in batches:
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        setting = columns.pop("setting")
        cuts = [*_first(setting).tolist(), batch.num_rows] if batch.num_rows else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and own != setting[lo]:
                yield own, held
                held = []
            own = int(setting[lo])
            held.append(form({n: c[lo:hi] for n, c in columns.items()}))
    if held:
        yield own, held


def _moves(factors: dict[int, float], turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for setting, pieces in _by_setting(batches, _narrow):  # a range of edges
            node, k, label, split, moved = _settled(_whole(pieces), factors[setting], turn)
            one = np.full(len(node), setting, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(node), pa.array(k), pa.array(label), pa.array(split), pa.array(moved)], schema=_MOVES)

    return run


def _ended(graph: DataFrame, edges: dict[int, int], factors: dict[int, float]) -> DataFrame:
    """(setting, node, community) of settings that fit into a task each, after all levels. ``edges``: how many each has."""
    load = [0] * min(len(edges), max(graph.sparkSession.sparkContext.defaultParallelism, -(-sum(edges.values()) // PART_EDGES)))
    place = {}
    for setting in sorted(edges, key=lambda s: (-edges[s], s)):  # the largest first, each to the task with the least
        place[setting] = load.index(min(load))
        load[place[setting]] += edges[setting]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for setting, pieces in _by_setting(batches, dict):
            node, community = levels(*(np.concatenate([p.pop(n) for p in pieces]) for n in ("i", "j", "w")), factors[setting])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), setting, np.int32)), pa.array(node), pa.array(community)], schema=_NAMES)

    task = F.element_at(F.create_map(*(F.lit(x) for pair in place.items() for x in pair)), F.col("setting"))
    own = graph.filter(F.col("setting").isin(list(edges))).select("setting", "i", "j", "w")
    return own.repartitionById(len(load), task).sortWithinPartitions("setting", "i", "j").mapInArrow(run, _NAMES_SCHEMA)


def _joined(graph: DataFrame, state: DataFrame) -> DataFrame:
    """Edges with the communities of both ends and their sizes."""
    sizes = state.groupBy("setting", "community").agg(F.sum("k").alias("size"))
    told = state.join(sizes, ["setting", "community"])
    left = told.select("setting", F.col("node").alias("i"), F.col("community").alias("ci"), "k", "degree", F.col("size").alias("si"))
    right = told.select("setting", F.col("node").alias("j"), F.col("community").alias("cj"), F.col("size").alias("sj"))
    return graph.join(left, ["setting", "i"]).join(right, ["setting", "j"])


def _quality(ends: DataFrame, state: DataFrame) -> dict[int, float]:
    """Modularity by setting, of edges with the communities of both ends; 0 without weight."""
    share = lambda x: F.coalesce(F.try_divide(x, F.first("total")), F.lit(0.0))
    inside = ends.groupBy("setting").agg(share(F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0))).alias("inside"), share(F.first("factor")).alias("rate"))
    sizes = state.groupBy("setting", "community").agg(F.sum("k").alias("s")).groupBy("setting").agg(F.sum(F.col("s") * F.col("s")).alias("squares"))
    return {r["setting"]: r["inside"] - r["rate"] * r["squares"] for r in inside.join(sizes, "setting").collect()}  # a row a setting


def _round(ends: DataFrame, state: DataFrame, parts: int, factors: dict[int, float], turn: int) -> DataFrame:
    """The state after a round: setting, node, community (named by its smallest node), k, degree, moved. ``ends``: edges with the
    communities of both ends, written: ranges are drawn from a sample, which reads them twice."""
    ends = ends.select("setting", "ci", "i", "k", "degree", "si", "j", "cj", "sj", "w")
    found = ends.repartitionByRange(parts, "setting", "ci", "i").sortWithinPartitions("setting", "ci", "i", "j").mapInArrow(_moves(factors, turn), _MOVES_SCHEMA)
    found = _table(found.groupBy("setting", "node").agg(F.max("k").alias("k"), F.max("label").alias("label"), F.max("split").alias("split"), F.max("moved").alias("moved")))
    names = found.groupBy("setting", "label", "split").agg(F.min("node").alias("community"))
    return _table(found.join(names, ["setting", "label", "split"]).join(state.select("setting", "node", "degree"), ["setting", "node"]).select("setting", "node", "community", "k", "degree", "moved"))


def communities_of(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """(setting, node, community) of undirected ``edges`` (setting, resolution, i, j, w). A community is named by its smallest node and is
    connected. Without edges there are no nodes; a node with edges of weight 0 alone is a community."""
    key = ["setting", "resolution"]
    both = edges.select(F.col("setting").cast("int").alias("setting"), "resolution", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w"))
    both = _table(both.unionByName(both.select(*key, F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy(*key, "i", "j").agg(F.sum("w").alias("w")))
    totals = both.groupBy(*key).agg(F.sum("w").alias("total")).select("setting", "total", F.try_divide("resolution", F.col("total")).alias("factor"))
    graph = both.drop("resolution").join(F.broadcast(totals.fillna(0.0)), "setting")  # a row a setting
    names = both.select("setting", F.col("i").alias("node"), F.col("i").alias("community")).distinct()
    done, first = [names.limit(0)], True
    while True:
        sizes = graph.groupBy("setting").agg(F.count("*").alias("edges"), F.first("factor").alias("factor")).collect()  # a row a setting
        factors = {r["setting"]: r["factor"] for r in sizes}
        fits = {r["setting"]: r["edges"] for r in sizes if r["edges"] <= WHOLE * part_edges}
        if fits:
            ended = _table(_ended(graph, fits, factors))
            done.append(ended if first else _named(names, ended))
        large = [s for s in factors if s not in fits]
        if not large:
            break
        graph, names, first = graph.filter(F.col("setting").isin(large)), names.filter(F.col("setting").isin(large)), False
        state = _table(graph.groupBy("setting", F.col("i").alias("node")).agg(F.sum("w").alias("k"), F.count("*").alias("degree")).withColumn("community", F.col("node")))
        parts = -(-sum(r["edges"] for r in sizes if r["setting"] in large) // part_edges)
        ends = _table(_joined(graph, state))
        quality = _quality(ends, state)
        rose: set[int] = set()
        still = 0
        for turn in range(ROUNDS):
            after = _round(ends, state, parts, factors, turn)
            met = _table(_joined(graph, after))
            reached = _quality(met, after)
            better = [s for s, q in reached.items() if q > quality[s] + LEAST_GAIN]
            still = 0 if better else still + 1
            if still == 2:  # neither half of the communities has a move that counts
                break
            kept = state.filter(~F.col("setting").isin(better)).select("setting", "node", "community", "k", "degree")
            state = _table(after.filter(F.col("setting").isin(better)).drop("moved").unionByName(kept))
            ends = met.filter(F.col("setting").isin(better)).unionByName(ends.filter(~F.col("setting").isin(better)))
            quality |= {s: reached[s] for s in better}
            rose |= set(better)
        done.append(names.filter(~F.col("setting").isin(list(rose))))
        if not rose:
            break
        names = _table(_named(names.filter(F.col("setting").isin(list(rose))), state.select("setting", "node", "community")))
        ends = ends.filter(F.col("setting").isin(list(rose)))
        graph = _table(ends.groupBy("setting", F.col("ci").alias("i"), F.col("cj").alias("j")).agg(F.sum("w").alias("w"), F.first("total").alias("total"), F.first("factor").alias("factor")))
    return functools.reduce(DataFrame.unionByName, done)


def _named(names: DataFrame, step: DataFrame) -> DataFrame:
    """``names`` a level on; ``step``: the community of each community."""
    told = step.select("setting", F.col("node").alias("old"), F.col("community").alias("new"))
    return names.withColumnRenamed("community", "old").join(told, ["setting", "old"]).select("setting", "node", F.col("new").alias("community"))


def communities(edges: DataFrame, resolution: float = 1.0, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, community) of one graph (i, j, w)."""
    one = edges.select(F.lit(0).alias("setting"), F.lit(float(resolution)).alias("resolution"), "i", "j", "w")
    return communities_of(one, part_edges).drop("setting")
