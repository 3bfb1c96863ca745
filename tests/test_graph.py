"""Graph operators: groups against plain code, and work across tasks against groups."""

import math
import random

import pytest

from grovespark.operators import graph


def random_edges(pick, n, extra, size=6):
    """A random tree of n voxels, with `extra` further edges; lengths are whole or halves, so that sums are exact."""
    nodes = pick.sample([f"{a}_{b}_{c}" for a in range(-size, size) for b in range(size) for c in range(2)], n)
    pairs = {(min(a, b), max(a, b)) for i, a in enumerate(nodes) if i for b in [nodes[pick.randint(max(0, i - 3), i - 1)]]}
    while len(pairs) < n - 1 + extra:
        a, b = pick.sample(nodes, 2)
        pairs.add((min(a, b), max(a, b)))
    return [(a, b, (pick.randint(1, 8) / 2) ** 2) for a, b in sorted(pairs)]


@pytest.fixture(scope="module")
def trees(spark):
    pick = random.Random(4)
    by_cloud = {c: random_edges(pick, n, 0) for c, n in enumerate([2, 3, 9, 25, 60, 90])}
    by_cloud[10] = random_edges(pick, 12, 0, 6) + [(f"9_{i}_9", f"9_{i + 1}_9", 1.0) for i in range(20)]  # two components, one of them a path
    by_cloud[11] = [("0_0_0", f"{k}_1_1", 1.0) for k in range(1, 5)]  # a star of short branches
    by_cloud[12] = [("10_0_0", "9_0_0", 4.0), ("9_0_0", "2_0_0", 4.0), ("9_0_0", "8_0_0", 1.0), ("8_0_0", "7_0_0", 1.0)]
    return by_cloud, spark.createDataFrame([(c, *e) for c, own in by_cloud.items() for e in own], graph.SCHEMA)


@pytest.fixture(scope="module")
def tangles(spark):
    pick = random.Random(8)
    by_cloud = {c: random_edges(pick, n, n // 3) for c, n in enumerate([9, 25, 60])}
    ring = lambda x, n: [(f"{x}_{i}_0", f"{x}_{(i + 1) % n}_0", 1.0) for i in range(n)]
    by_cloud |= {20: ring(1, 7), 21: ring(1, 5) + ring(2, 6), 22: ring(1, 5) + random_edges(pick, 7, 0), 23: ring(3, 6) + [("3_0_0", "4_0_0", 1.0)]}
    return by_cloud, spark.createDataFrame([(c, *e) for c, own in by_cloud.items() for e in own], graph.SCHEMA)


def by_cloud(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cloud_id"], []).append(tuple(r)[1:4])
    return {c: sorted(e) for c, e in out.items()}


def plain_forest(edges):
    group, kept = {}, []
    for a, b, d in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if group.get(a, {a}) is not group.get(b, {b}) and b not in group.get(a, {a}):
            kept.append((a, b, d))
            both = group.get(a, {a}) | group.get(b, {b})
            group |= dict.fromkeys(both, both)
    return sorted(kept)


def plain_prune(edges, shortest):
    """Leaf after leaf, on lists of living nodes."""
    nodes = sorted({v for e in edges for v in e[:2]}, key=lambda v: tuple(map(int, v.split("_"))))
    beside = {v: [e[1] if e[0] == v else e[0] for e in edges if v in e[:2]] for v in nodes}
    far = {frozenset(e[:2]): math.sqrt(e[2]) for e in edges}
    alive, changed = set(nodes), True
    living = lambda v: [w for w in beside[v] if w in alive]
    while changed:
        changed = False
        for leaf in [v for v in nodes if v in alive and len(living(v)) == 1]:
            if leaf not in alive:
                continue
            path, total = [leaf], 0.0
            while total < shortest or len(path) == 1:
                onward = [w for w in living(path[-1]) if w not in path[-2:-1]]
                if not onward or len(path) > 1 and len(living(path[-1])) != 2:
                    break
                total += far[frozenset((path[-1], onward[0]))]
                path.append(onward[0])
            if total < shortest and len(path) > 1:
                alive -= set(path[:-1])
                changed = True
    return sorted(e for e in edges if e[0] in alive and e[1] in alive)


def plain_simplify(edges, spacing):
    """Pairs of nodes, each way once; chains by a walk from each end or fork."""
    order = lambda v: tuple(map(int, v.split("_")))
    nodes = sorted({v for e in edges for v in e[:2]}, key=order)
    beside = {v: sorted((e[1] if e[0] == v else e[0] for e in edges if v in e[:2]), key=order) for v in nodes}
    far = {frozenset(e[:2]): math.sqrt(e[2]) for e in edges}
    fixed = {v for v in nodes if len(beside[v]) != 2} or {nodes[0]}
    seen, out = set(), set()
    for a in [v for v in nodes if v in fixed]:
        for b in beside[a]:
            if frozenset((a, b)) in seen:
                continue
            chain = [a, b]
            while chain[-1] not in fixed:
                chain.append(next(w for w in beside[chain[-1]] if w != chain[-2]))
            seen |= {frozenset(p) for p in zip(chain, chain[1:])}
            kept, since = [a], 0.0
            for k in range(1, len(chain) - 1):
                since += far[frozenset(chain[k - 1 : k + 1])]
                if since >= spacing:
                    kept.append(chain[k])
                    since = 0.0
            kept.append(chain[-1])
            out |= {tuple(sorted(p, key=order)) for p in zip(kept, kept[1:]) if p[0] != p[1]}
    return sorted(out)


@pytest.mark.parametrize("most", [graph.GROUP_EDGES, 0])
def test_forest(tangles, most):
    edges, df = tangles
    assert by_cloud(graph.spanning_forest(df, most)) == {c: plain_forest(e) for c, e in edges.items()}


def test_rounds_are_logarithmic(spark, tangles):
    path = [(1, f"{i}_0_0", f"{i + 1}_0_0", float(i % 7)) for i in range(300)]
    forest = graph.rounds(spark.createDataFrame(path + [path[4]], graph.SCHEMA))[0].collect()
    assert len(forest) == 300 and max(r["round"] for r in forest) <= math.log2(301)


@pytest.mark.parametrize("most", [graph.GROUP_EDGES, 0])
@pytest.mark.parametrize("shortest", [2.0, 6.5])
def test_prune(trees, shortest, most):
    edges, df = trees
    want = {c: kept for c, e in edges.items() if (kept := plain_prune(e, shortest))}
    assert by_cloud(graph.prune(df, shortest, most)) == want and 0 < len(want)


def test_prune_leaves_rings(tangles):
    edges, df = tangles
    want = {c: kept for c, e in edges.items() if (kept := plain_prune(e, 4.0))}
    assert by_cloud(graph.prune(df, 4.0)) == want == by_cloud(graph.prune(df, 4.0, 0)) and want[20] == sorted(edges[20])


@pytest.mark.parametrize("most", [graph.GROUP_EDGES, 0])
@pytest.mark.parametrize("kind", ["trees", "tangles"])
def test_simplify(spark, request, kind, most):
    edges, df = request.getfixturevalue(kind)
    nodes = {(c, v) for c, own in edges.items() for e in own for v in e[:2]}
    spots = spark.createDataFrame([(c, *k, *(2.0 * x for x in k)) for c, v in nodes for k in [tuple(map(int, v.split("_")))]], "cloud_id long, kx long, ky long, kz long, x double, y double, z double")
    got = by_cloud(graph.simplify(df, spots, 3.0, most))
    assert {c: [e[:2] for e in own] for c, own in got.items()} == {c: kept for c, e in edges.items() if (kept := plain_simplify(e, 3.0))}
    for own in got.values():
        for a, b, d2 in own:
            assert d2 == sum((2 * (p - q)) ** 2 for p, q in zip(*(map(int, v.split("_")) for v in (a, b))))


def test_empty(spark):
    none = spark.createDataFrame([], graph.SCHEMA)
    spots = spark.createDataFrame([], "cloud_id long, kx long, ky long, kz long, x double, y double, z double")
    for most in (0, 10):
        assert graph.spanning_forest(none, most).count() == graph.prune(none, 1.0, most).count() == graph.simplify(none, spots, 1.0, most).count() == 0
    assert graph.rounds(none)[0].count() == graph.rounds(none)[1].count() == 0


def test_groups_share_batches(spark):
    """Groups within an Arrow batch and across batches; no frame is made for each."""
    rows = [(g, i) for g in range(40) for i in range(g % 7)] + [(None, 1), (None, 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = graph.by_group(spark.createDataFrame(rows, "g long, i long"), ["g"], lambda c: {"g": c["g"][:1], "n": [sum(c["i"]) + 100 * len(c["i"])]}, "g long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {g: sum(range(g % 7)) + 100 * (g % 7) for g in range(40) if g % 7} | {None: 203}
    assert len(got) == len(want) and {r["g"]: r["n"] for r in got} == want
    plan = graph.spanning_forest(spark.createDataFrame([(1, "0_0_0", "1_0_0", 1.0)], graph.SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan


def test_edges_without_length_come_last(spark):
    edges = [(1, "a", "b", None), (1, "b", "c", 2.0), (1, "a", "c", float("nan")), (1, "c", "d", 0.0), (1, "b", "d", 3.0)]
    got = [tuple(r)[1:3] for r in graph.spanning_forest(spark.createDataFrame(edges, graph.SCHEMA)).collect()]
    assert sorted(got) == [("a", "b"), ("b", "c"), ("c", "d")]
