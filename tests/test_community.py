"""Communities in parts: local moves against brute force, connected parts, settings together."""

from __future__ import annotations

import numpy as np
import pytest

from basalt.operators import community


def _modularity(edges, of, resolution=1.0):
    total = 2 * sum(w for *_, w in edges)
    inside = sum(2 * w for i, j, w in edges if of[i] == of[j])
    size: dict = {}
    for i, j, w in edges:
        size[of[i]] = size.get(of[i], 0) + w
        size[of[j]] = size.get(of[j], 0) + w
    return inside / total - resolution * sum(s * s for s in size.values()) / total**2


def _graph(seed, groups=12, size=15, between=0.03):
    rng = np.random.default_rng(seed)
    n = groups * size
    return [(i, j, float(rng.uniform(0.5, 1.5))) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.6 if i // size == j // size else between)]


def _connected(edges, of):
    near: dict = {}
    for i, j, _ in edges:
        if of[i] == of[j]:
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
    for c in set(of.values()):
        members = {n for n in of if of[n] == c}
        seen, todo = set(), [min(members)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near.get(n, ())
        if seen != members:
            return False
    return True


@pytest.mark.parametrize("part_edges", [1 << 20, 900])
def test_parts_reach_the_planted_groups(spark, part_edges):
    edges = _graph(1)
    of = {r["node"]: r["community"] for r in community.communities(spark.createDataFrame(edges, "i long, j long, w double"), 1.0, part_edges).collect()}
    planted = {n: n // 15 for n in of}
    assert set(of) == set(range(180)) and _modularity(edges, of) >= _modularity(edges, planted) - 0.02
    assert _connected(edges, of) and all(of[c] == c for c in set(of.values()))


def test_settings_are_clustered_together(spark):
    """As many jobs for six settings as for one, with the same communities."""
    rows = [(s, r, *e) for s, (r, edges) in enumerate((r, _graph(g, 6, 10)) for g in (2, 3) for r in (0.1, 1.0, 4.0)) for e in edges]
    every = spark.createDataFrame(rows, "setting int, resolution double, i long, j long, w double")
    together = {(r["setting"], r["node"]): r["community"] for r in community.communities_of(every).collect()}
    for s in range(6):
        alone = {(s, r["node"]): r["community"] for r in community.communities_of(every.filter(f"setting = {s}")).collect()}
        assert alone == {k: v for k, v in together.items() if k[0] == s}
    sizes = [len({v for k, v in together.items() if k[0] == s}) for s in range(3)]
    assert sizes[0] <= sizes[1] <= sizes[2]


def test_a_part_that_came_off_is_a_community():
    """Two pairs of one label without an edge between them: the task splits them."""
    ids = np.array([1, 2, 5, 6])
    other = np.array([2, 1, 6, 5])
    same = np.array([1, 1, 1, 1])
    e = {"i": ids, "j": other, "w": np.ones(4), "ci": same, "cj": same, "k": np.ones(4), "degree": np.ones(4, int), "si": np.full(4, 4.0), "sj": np.full(4, 4.0), "factor": np.full(4, 0.0)}
    _, _, label, split, _ = community.settled(e)
    assert len(set(zip(label.tolist(), split.tolist(), strict=True))) == 2


def test_a_hub_cut_by_a_border_stays(spark):
    """A node of more edges than a range holds: its neighbours move, nothing is lost."""
    star = [(0, i, 1.0) for i in range(1, 400)] + [(i, i + 1, 2.0) for i in range(1, 399)]
    found = community.communities(spark.createDataFrame(star, "i long, j long, w double"), 0.05, 100)
    of = {r["node"]: r["community"] for r in found.collect()}
    assert set(of) == set(range(400)) and _modularity(star, of, 0.05) > 0
    assert found.count() == 400


def test_no_weight(spark):
    schema = "i long, j long, w double"
    assert community.communities(spark.createDataFrame([], schema)).count() == 0
    none = community.communities(spark.createDataFrame([(1, 2, 0.0), (3, 3, 0.0)], schema)).collect()
    assert {(r["node"], r["community"]) for r in none} == {(1, 1), (2, 2), (3, 3)}
    loops = community.communities(spark.createDataFrame([(7, 7, 2.0), (1, 2, 1.0)], schema)).collect()
    assert len({r["community"] for r in loops}) == 2


def test_a_round_joins_the_edges_once(spark, monkeypatch):
    """Edges meet the communities of their ends once a round and once a level; what a round needs and its modularity come from that table."""
    calls = {"_joined": 0, "_round": 0, "_quality": 0}

    def counted(name, f):
        def call(*args):
            calls[name] += 1
            return f(*args)

        return call

    for name in calls:
        monkeypatch.setattr(community, name, counted(name, getattr(community, name)))
    edges = _graph(1)
    of = {r["node"]: r["community"] for r in community.communities(spark.createDataFrame(edges, "i long, j long, w double"), 1.0, 900).collect()}
    assert _modularity(edges, of) >= _modularity(edges, {n: n // 15 for n in of}) - 0.02
    assert calls["_quality"] > 1  # levels of several ranges
    assert calls["_joined"] <= 2 * calls["_round"] and calls["_joined"] < calls["_quality"] + calls["_round"]


def _by_levels(edges, resolution):
    """Level by level with ``settled``: what a task makes of a setting."""
    w = {}
    for i, j, x in edges:
        w[i, j], w[j, i] = w.get((i, j), 0.0) + x, w.get((j, i), 0.0) + x
    factor, of = resolution / sum(w.values()), {i: i for i, _ in w}
    while True:
        rows = sorted((i, j, x) for (i, j), x in w.items())
        k, degree = {}, {}
        for i, _, x in rows:
            k[i], degree[i] = k.get(i, 0.0) + x, degree.get(i, 0) + 1
        i, j, x = (np.array(c) for c in zip(*rows, strict=True))
        e = {"i": i, "j": j, "w": x, "ci": i, "cj": j, "k": np.array([k[n] for n in i]), "degree": np.array([degree[n] for n in i]), "factor": np.full(len(i), factor)}
        node, _, label, split, moved = community.settled(e | {"si": e["k"], "sj": np.array([k[n] for n in j])})
        if not moved.any():
            return of
        least: dict = {}
        for n, *part in zip(node.tolist(), label.tolist(), split.tolist(), strict=True):
            least[tuple(part)] = min(n, least.get(tuple(part), n))
        step = {n: least[tuple(part)] for n, *part in zip(node.tolist(), label.tolist(), split.tolist(), strict=True)}
        of, w = {n: step[c] for n, c in of.items()}, {}
        for a, b, y in rows:
            w[step[a], step[b]] = w.get((step[a], step[b]), 0.0) + y


def test_a_setting_that_fits_is_one_task(spark, monkeypatch):
    """All levels of a small setting in one task: no joins a level; beside a setting in ranges it gets what it gets alone."""
    joined = []
    monkeypatch.setattr(community, "_joined", lambda *args, f=community._joined: joined.append(1) or f(*args))
    small, large = _graph(5, 40, 3, 0.01), [(i * 7, j * 7, w) for i, j, w in _graph(1)]
    assert len(small) * 2 <= 900 < len(large) * 2
    alone = {r["node"]: r["community"] for r in community.communities(spark.createDataFrame(small, "i long, j long, w double")).collect()}
    assert not joined and alone == _by_levels(small, 1.0)
    rows = [(7, 1.0, *e) for e in small] + [(3, 1.0, *e) for e in large]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # nodes and settings go over several batches
    try:
        found = community.communities_of(spark.createDataFrame(rows, "setting int, resolution double, i long, j long, w double"), 900).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert joined and len(found) == len({i for e in small for i in e[:2]}) + 180
    assert {r["node"]: r["community"] for r in found if r["setting"] == 7} == alone
    of = {r["node"]: r["community"] for r in found if r["setting"] == 3}
    assert _modularity(large, of) >= _modularity(large, {n: n // 105 for n in of}) - 0.02 and _connected(large, of)


def test_no_weight_in_ranges(spark):
    none = community.communities(spark.createDataFrame([(i, i + 1, 0.0) for i in range(9)], "i long, j long, w double"), 1.0, 4).collect()
    assert {(r["node"], r["community"]) for r in none} == {(i, i) for i in range(10)}


def test_ends_in_two_ranges_meet(spark, monkeypatch):
    """Pairs whose ends lie in different ranges: both went to the other's place, or what joined came off from what it had joined."""
    rounds = []
    monkeypatch.setattr(community, "_round", lambda *args, f=community._round: rounds.append(1) or f(*args))
    pairs = [(i, i + 200, 1.0) for i in range(200)]
    of = {r["node"]: r["community"] for r in community.communities(spark.createDataFrame(pairs, "i long, j long, w double"), 1.0, 100).collect()}
    assert of == {n: n % 200 for n in range(400)}
    rounds.clear()
    rng = np.random.default_rng(3)
    place = rng.permutation(600)  # a ring, numbers without order
    ring = [(int(place[i]), int(place[(i + d) % 600]), float(rng.uniform(0.5, 1.5))) for i in range(600) for d in (1, 2, 3)]
    frame = spark.createDataFrame(ring, "i long, j long, w double")
    whole, parts = ({r["node"]: r["community"] for r in community.communities(frame, 1.0, n).collect()} for n in (1 << 20, 500))
    assert rounds and _connected(ring, parts) and all(parts[c] == c for c in set(parts.values()))
    assert _modularity(ring, parts) >= _modularity(ring, whole) - 0.05
