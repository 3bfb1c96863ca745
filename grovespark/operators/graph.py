"""Skeleton graphs: spanning forest, pruning and simplification of each cloud's edges (cloud_id, src, dst, d2).

A cloud of few edges is one group. One of more than GROUP_EDGES is worked on across tasks, with the same result: the forest by
rounds in which every component takes its least edge, hooks on and finds its root by pointer jumping; chains by list ranking,
in which each arc doubles its reach in each step. A row there is an edge, a component or a chain, never a cloud.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import removed, written

SCHEMA = "cloud_id long, src string, dst string, d2 double"
#: Edges of a cloud that one task works on at most.
GROUP_EDGES = 1_000_000
#: Rows of an Arrow batch that by_group() sends on, and a group's more.
BATCH_ROWS = 10_000


def place(node: str) -> tuple:
    """The order of nodes: by voxel, where the name holds one; others come after, by name."""
    parts = node.split("_")
    try:
        return 0, tuple(map(int, parts)), ""
    except ValueError:
        return 1, (), node


def by_size(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The edges of clouds with `most` edges at most, and those of larger ones, if there are any."""
    edges = written(edges)
    large = written(edges.groupBy("cloud_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("cloud_id"))
    if large.isEmpty():
        return edges, None
    return edges.join(large, "cloud_id", "left_anti"), edges.join(large, "cloud_id", "left_semi")


def by_group(rows: DataFrame, keys: list[str], run: Callable[[dict[str, list]], dict[str, list]], schema: str, *order: str | Column) -> DataFrame:
    """What `run` makes of the columns of each group, whose rows come in order. Small groups come many to an Arrow batch: applyInPandas takes some milliseconds for the frames of each.

    A group is held as lists of its values, so that a task has one group and a batch at a time.
    """
    names, kinds = rows.columns, to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, made = None, [[] for _ in names], [[] for _ in kinds]

        def flush() -> None:
            if held[0]:
                new = run(dict(zip(names, held)))
                for m, k in zip(made, kinds.names):
                    m.extend(new[k])

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            own = list(zip(*(columns[names.index(k)] for k in keys)))
            cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi and own[lo] != key:
                    flush()
                    key, held = own[lo], [[] for _ in names]
                for h, c in zip(held, columns):
                    h += c[lo:hi]
            if len(made[0]) >= BATCH_ROWS:
                yield pa.record_batch([pa.array(m, k.type) for m, k in zip(made, kinds)], schema=kinds)
                made = [[] for _ in kinds]
        flush()
        yield pa.record_batch([pa.array(m, k.type) for m, k in zip(made, kinds)], schema=kinds)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)


# Spanning forest


def kruskal(g: dict[str, list]) -> dict[str, list]:
    """Edges come in order."""
    root: dict[str, str] = {}

    def find(v: str) -> str:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    keep = []
    for i, (a, b) in enumerate(zip(g["src"], g["dst"])):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
            keep.append(i)
    return {k: [v[i] for i in keep] for k, v in g.items()}


def jumped(hooks: DataFrame) -> DataFrame:
    """(cloud_id, node, root) from (cloud_id, node, up), where a root is its own: each step doubles how far up a node looks."""
    now = written(hooks)
    while True:
        up = now.select("cloud_id", F.col("node").alias("up"), F.col("up").alias("upper"))
        new = written(now.join(up, ["cloud_id", "up"]).select("cloud_id", "node", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")))
        removed(now)
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now.withColumnRenamed("up", "root")


def rounds(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest (cloud_id, src, dst, d2, round), and (cloud_id, node, root) of all nodes that have an edge.

    In a round each component takes its least edge by (d2, src, dst), so that the number of components that have an edge halves at least.
    Parallel edges between two components leave but the least. The first round's components are nodes.
    """
    live = edges.where("src <> dst").select("cloud_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("d2", "src", "dst").alias("e"))
    forest = edges.limit(0).select("cloud_id", "src", "dst", "d2", F.lit(0).alias("round"))
    members, number = None, 0
    while True:
        a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        live = written(live.groupBy("cloud_id", a, b).agg(F.min("e").alias("e")))
        if live.isEmpty():
            return forest, members if members is not None else edges.limit(0).select("cloud_id", F.col("src").alias("node"), F.col("src").alias("root"))
        number += 1
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.struct("e", F.col("b").alias("up")).alias("s")), F.struct(F.col("b").alias("node"), F.struct("e", F.col("a").alias("up")).alias("s"))))
        best = written(live.select("cloud_id", ends.alias("x")).groupBy("cloud_id", "x.node").agg(F.min("x.s").alias("s")).select("cloud_id", "node", "s.e", "s.up"))
        forest = forest.unionByName(best.select("cloud_id", "e.src", "e.dst", "e.d2", F.lit(number).alias("round")).distinct())
        # two components that take the same edge point at each other: the smaller is the root
        other = best.select("cloud_id", F.col("node").alias("up"), F.col("up").alias("back"))
        mine = (F.col("back") == F.col("node")) & (F.col("node") < F.col("up"))
        roots = jumped(best.join(other, ["cloud_id", "up"]).select("cloud_id", "node", F.when(mine, F.col("node")).otherwise(F.col("up")).alias("up")))
        above = roots.select("cloud_id", F.col("node").alias("root"), F.col("root").alias("above"))
        members = roots if members is None else written(members.join(above, ["cloud_id", "root"], "left").select("cloud_id", "node", F.coalesce("above", "root").alias("root")))
        ra, rb = (roots.select("cloud_id", F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        live = live.join(ra, ["cloud_id", "a"]).join(rb, ["cloud_id", "b"]).where("ra <> rb").select("cloud_id", F.col("ra").alias("a"), F.col("rb").alias("b"), "e")


def spanning_forest(edges: DataFrame, most: int = GROUP_EDGES) -> DataFrame:
    """A minimum spanning forest of each cloud, by rising (d2, src, dst). An edge that is listed twice counts once."""
    edges = edges.select("cloud_id", "src", "dst", "d2")
    small, large = by_size(edges, most)
    far = F.when(~F.isnan("d2"), F.col("d2")).asc_nulls_last()  # edges without a length come last
    out = by_group(small, ["cloud_id"], kruskal, SCHEMA, far, "src", "dst")
    return out if large is None else out.unionByName(rounds(large)[0].drop("round"))


# Chains


def arcs(edges: DataFrame) -> DataFrame:
    """(cloud_id, u, v, w): each edge both ways, w its length."""
    w = F.sqrt("d2").alias("w")
    return edges.select("cloud_id", F.col("src").alias("u"), F.col("dst").alias("v"), w).unionByName(edges.select("cloud_id", F.col("dst").alias("u"), F.col("src").alias("v"), w))


def ranked(edges: DataFrame) -> DataFrame:
    """(cloud_id, u, v, w, p, q, length, hops, degree): the last arc p -> q of the chain that each arc u -> v goes along, and how far it is to q.

    A chain goes through nodes of two neighbours, and ends at nodes of another number (q has `degree` of them). Arcs on rings, which have no end, get a null q.
    """
    both = written(arcs(edges))
    degree = both.groupBy("cloud_id", F.col("u").alias("v")).agg(F.count("*").alias("degree"))
    now = both.join(degree, ["cloud_id", "v"]).select("cloud_id", "u", "v", "w", "degree")
    after = now.select("cloud_id", F.col("u").alias("v"), F.col("v").alias("x"))
    # the arc after each one: at a node of two neighbours, the one that doesn't go back
    inner = now.where("degree = 2").join(after, ["cloud_id", "v"]).where("x <> u").select("cloud_id", "u", "v", "w", F.col("v").alias("p"), F.col("x").alias("q"), F.lit(2).cast("long").alias("hops"), F.lit(False).alias("ends"))
    last = now.where("degree <> 2").select("cloud_id", "u", "v", "w", F.col("u").alias("p"), F.col("v").alias("q"), F.lit(1).cast("long").alias("hops"), F.lit(True).alias("ends"))
    # length and hops: of the arcs from this one up to, but without, the arc p -> q
    state = written(inner.unionByName(last).select("cloud_id", "u", "v", "w", "p", "q", F.when(F.col("ends"), 0.0).otherwise(F.col("w")).alias("length"), (F.col("hops") - 1).alias("hops"), "ends"))
    open_ = state.where("not ends").count()
    while open_:
        jump = state.select("cloud_id", F.col("u").alias("p"), F.col("v").alias("q"), F.col("p").alias("pp"), F.col("q").alias("qq"), F.col("length").alias("more"), F.col("hops").alias("further"), F.col("ends").alias("over"))
        moved = state.where("not ends").join(jump, ["cloud_id", "p", "q"]).select("cloud_id", "u", "v", "w", F.col("pp").alias("p"), F.col("qq").alias("q"), (F.col("length") + F.col("more")).alias("length"), (F.col("hops") + F.col("further")).alias("hops"), F.col("over").alias("ends"))
        before, state = state, written(state.where("ends").unionByName(moved))
        removed(before)
        left = state.where("not ends")
        # an arc that is still under way after as many hops as there are arcs is on a ring
        open_now = left.count()
        if open_now == open_:
            n = both.groupBy("cloud_id").agg(F.count("*").alias("n"))
            if left.join(n, "cloud_id").where("hops <= n").isEmpty():
                break
        open_ = open_now
    tail = both.join(degree, ["cloud_id", "v"]).select("cloud_id", F.col("u").alias("p"), F.col("v").alias("q"), F.col("w").alias("tail"), "degree")
    whole = state.where("ends").join(tail, ["cloud_id", "p", "q"]).select("cloud_id", "u", "v", "w", "p", "q", (F.col("length") + F.col("tail")).alias("length"), (F.col("hops") + 1).alias("hops"), "degree")
    rings = state.where("not ends").select("cloud_id", "u", "v", "w", F.lit(None).cast("string").alias("p"), F.lit(None).cast("string").alias("q"), F.lit(None).cast("double").alias("length"), F.lit(None).cast("long").alias("hops"), F.lit(None).cast("long").alias("degree"))
    return written(whole.unionByName(rings))


def order_of(node: str | Column) -> Column:
    """place() as a column."""
    c = F.col(node) if isinstance(node, str) else node
    voxel = c.rlike(r"^-?[0-9]+(_-?[0-9]+)*$")
    return F.struct((~voxel).alias("odd"), F.when(voxel, F.transform(F.split(c, "_"), lambda v: v.cast("long"))).alias("voxel"), c.alias("name"))


def chains(edges: DataFrame) -> DataFrame:
    """(cloud_id, u, v, chain, a, b, left, before, da, db): each edge once, as the arc in the direction of its chain from a to b.

    a is the end that comes first; of a chain that leads back to its own end, its direction is towards the first node after it. left: how far b is from u;
    before: arcs from a to u. chain: the arcs at both ends. da, db: the ends' numbers of neighbours. Rings have no chain.
    """
    r = ranked(edges).where("q is not null")
    back = r.select("cloud_id", F.col("v").alias("u"), F.col("u").alias("v"), F.col("q").alias("a"), F.col("p").alias("first"), F.col("degree").alias("da"), (F.col("hops") - 1).alias("before"))
    start, end = F.struct(order_of("a"), order_of("first")), F.struct(order_of("q"), order_of("p"))
    return r.join(back, ["cloud_id", "u", "v"]).where(start < end).select("cloud_id", "u", "v", F.concat_ws(" ", "a", "first", "q", "p").alias("chain"), "a", F.col("q").alias("b"), F.col("length").alias("left"), "before", "da", F.col("degree").alias("db"))


# Pruning


def neighbours_of(g: pd.DataFrame) -> dict[str, dict[str, float]]:
    near: dict[str, dict[str, float]] = {}
    for a, b, d2 in g[["src", "dst", "d2"]].itertuples(index=False):
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = d2**0.5
    return near


def pruned_group(g: pd.DataFrame, shortest: float) -> pd.DataFrame:
    """The rule of prune() on one cloud, node by node."""
    near = neighbours_of(g)
    while True:
        gone = set()
        for leaf in sorted((v for v, n in near.items() if len(n) == 1), key=place):
            path, length, at, back = [leaf], 0.0, leaf, None
            while leaf not in gone and (step := next((v for v in near[at] if v != back and v not in gone), None)) is not None:
                length, back, at = length + near[at][step], at, step
                path.append(at)
                if sum(v not in gone for v in near[at]) != 2 or length >= shortest:
                    break
            if length < shortest:
                gone.update(path[:-1])
        if not gone:
            return g[[a in near and b in near[a] for a, b in zip(g["src"], g["dst"])]]
        near = {v: {w: d for w, d in n.items() if w not in gone} for v, n in near.items() if v not in gone}


def cut_chains(g: dict[str, list], shortest: float) -> list[str]:
    """The chains that one round takes off among those of one cluster: (chain, a, b, length, da, db). Chains that aren't shorter than `shortest` may lead out of it."""
    at: dict[str, list[tuple[str, str, float]]] = {}
    leaves = {}
    for chain, a, b, length, da, db in zip(*(g[k] for k in ("chain", "a", "b", "length", "da", "db"))):
        at.setdefault(a, []).append((chain, b, length))
        at.setdefault(b, []).append((chain, a, length))
        leaves |= {v: chain for v, d in ((a, da), (b, db)) if d == 1}
    gone: list[str] = []
    off: set[str] = set()
    for leaf in sorted(leaves, key=place):
        path, length, node, back = [], 0.0, leaf, None
        while (step := next((c for c in at[node] if c[0] != back and c[0] not in off), None)) is not None:
            back, node = step[0], step[1]
            length += step[2]
            path.append(back)
            if length >= shortest or sum(c[0] not in off for c in at[node]) != 2:
                break
        if length < shortest:
            off.update(path)
            gone += path
    return gone


def prune_across(edges: DataFrame, shortest: float) -> DataFrame:
    """prune() by chains: in a round, forks that chains shorter than `shortest` join are one cluster, as no removal reaches beyond; a cluster is a group, a row a chain."""
    now = edges
    while True:
        c = written(chains(now))
        summary = written(c.groupBy("cloud_id", "chain").agg(F.max("left").alias("length"), *(F.first(k).alias(k) for k in ("a", "b", "da", "db"))))
        short = F.col("length") < shortest
        if summary.where(short & ((F.col("da") == 1) | (F.col("db") == 1))).isEmpty():
            return now
        inner = summary.where(short & (F.col("da") > 1) & (F.col("db") > 1))
        _, roots = rounds(inner.select("cloud_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("length").alias("d2")))
        ends = summary.select("*", F.explode(F.when((F.col("da") == 1) & (F.col("db") > 1), F.array("b")).when((F.col("db") == 1) | (F.col("a") == F.col("b")), F.array("a")).otherwise(F.array("a", "b"))).alias("node"))
        grouped = ends.join(roots, ["cloud_id", "node"], "left").withColumn("cluster", F.coalesce("root", "node")).drop("node", "root").distinct()
        busy = grouped.where(short & ((F.col("da") == 1) | (F.col("db") == 1))).select("cloud_id", "cluster").distinct()  # others lose nothing

        def run(g: dict[str, list]) -> dict[str, list]:
            gone = cut_chains(g, shortest)
            return {"cloud_id": g["cloud_id"][:1] * len(gone), "chain": gone}

        gone = written(by_group(grouped.join(busy, ["cloud_id", "cluster"], "left_semi"), ["cloud_id", "cluster"], run, "cloud_id long, chain string").distinct())
        if gone.isEmpty():
            return now
        lost = c.join(gone, ["cloud_id", "chain"], "left_semi").select("cloud_id", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
        now = written(now.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(lost, ["cloud_id", "lo", "hi"], "left_anti").select("cloud_id", "src", "dst", "d2"))


def prune(edges: DataFrame, shortest: float, most: int = GROUP_EDGES) -> DataFrame:
    """Takes off short branches of a forest, round after round, until none is left; the rows that stay are the input's.

    In a round the nodes that had one neighbour at its start are taken in order. From each a path is followed while its nodes have two
    neighbours left; if it ends, at a fork or another end, before it is `shortest` long, all its nodes but the last go at once, so that a later
    branch of the same fork may go on through it. A tree shorter than `shortest` goes whole.
    """
    edges = edges.select("cloud_id", "src", "dst", "d2")
    small, large = by_size(edges, most)
    out = small.groupBy("cloud_id").applyInPandas(lambda g: pruned_group(g, shortest), SCHEMA)
    return out if large is None else out.unionByName(prune_across(large, shortest))


# Simplification


def kept_of(chain: list[tuple[str, float]], spacing: float) -> list[str]:
    """The ends of a chain of (node, length of the edge to it), and the nodes between that are `spacing` along it from the one kept before."""
    kept, since = [chain[0][0]], 0.0
    for node, length in chain[1:-1]:
        since += length
        if since >= spacing:
            kept.append(node)
            since = 0.0
    return [*kept, chain[-1][0]]


def simplified_group(g: pd.DataFrame, spacing: float) -> pd.DataFrame:
    near, cloud = neighbours_of(g), int(g["cloud_id"].iloc[0])
    anchors = {v for v, n in near.items() if len(n) != 2} or {min(near, key=place)}
    used, out = set(), []
    for start in sorted(anchors, key=place):
        for first in sorted(near[start], key=place):
            if (start, first) in used:
                continue
            chain, back, at = [(start, 0.0), (first, near[start][first])], start, first
            while at not in anchors:
                step = next(v for v in near[at] if v != back)
                chain.append((step, near[at][step]))
                back, at = at, step
            used.update((b[0], a[0]) for a, b in zip(chain, chain[1:]))
            used.update((a[0], b[0]) for a, b in zip(chain, chain[1:]))
            kept = kept_of(chain, spacing)
            out += [(cloud, a, b) for a, b in zip(kept, kept[1:]) if a != b]
    return pd.DataFrame(out, columns=["cloud_id", "src", "dst"])


def simplify_across(edges: DataFrame, spacing: float) -> DataFrame:
    """simplify() by chains: a row is a chain, with its nodes in an array. A ring is opened at its cloud's first node, if its cloud has nothing but rings."""
    r = written(ranked(edges))
    clouds = r.groupBy("cloud_id").agg(F.count("q").alias("n"), F.min(order_of("u")).alias("first"))
    rings = written(clouds.where("n = 0").select("cloud_id", F.col("first.name").alias("src")))
    lengths = edges.select("cloud_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.sqrt("d2").alias("w"))
    steps = chains(edges).select("cloud_id", "chain", "before", "u", "v", "a").withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")}).join(lengths, ["cloud_id", "lo", "hi"])
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("before", "u", "v", "w"))), lambda s: F.struct(s["v"].alias("node"), s["w"].alias("w")))
    whole = steps.groupBy("cloud_id", "chain").agg(F.first("a").alias("a"), nodes.alias("nodes"))
    state = F.struct(F.lit(0.0).alias("since"), F.array(F.col("a")).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        since = s["since"] + x["w"]
        return F.struct(F.when(since >= spacing, 0.0).otherwise(since).alias("since"), F.when(since >= spacing, F.concat(s["kept"], F.array(x["node"]))).otherwise(s["kept"]).alias("kept"))

    inner, last = F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.element_at("nodes", -1)["node"]
    kept = whole.select("cloud_id", F.concat(F.aggregate(inner, state, step)["kept"], F.array(last)).alias("kept"))
    pairs = kept.select("cloud_id", F.explode(F.zip_with(F.slice("kept", F.lit(1), F.size("kept") - 1), F.slice("kept", F.lit(2), F.size("kept") - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("p"))
    out = pairs.select("cloud_id", "p.src", "p.dst").where("src <> dst")
    if rings.isEmpty():
        return out
    # a cut ring is a chain whose two ends are one node: the node's second arc gets an end of its own, which is named back afterwards
    ring = edges.join(rings.withColumnRenamed("src", "top"), "cloud_id")
    far = F.when(F.col("src") == F.col("top"), F.col("dst")).when(F.col("dst") == F.col("top"), F.col("src"))
    second = ring.where(far.isNotNull()).groupBy("cloud_id").agg(F.max(order_of(far)).alias("m")).select("cloud_id", F.col("m.name").alias("far"))
    mark = lambda c, o: F.when((F.col(c) == F.col("top")) & (F.col(o) == F.col("far")), F.concat(F.lit("~"), "top")).otherwise(F.col(c)).alias(c)
    opened = ring.join(second, "cloud_id").select("cloud_id", mark("src", "dst"), mark("dst", "src"), "d2")
    closed = simplify_across(written(opened), spacing).select("cloud_id", *(F.regexp_replace(c, "^~", "").alias(c) for c in ("src", "dst")))
    top = rings.select("cloud_id", F.col("src").alias("top"))
    return out.unionByName(closed.join(top, "cloud_id").where("src <> dst").select("cloud_id", "src", "dst"))


def simplify(edges: DataFrame, nodes: DataFrame, spacing: float, most: int = GROUP_EDGES) -> DataFrame:
    """Replaces chains of nodes with two neighbours by nodes at least `spacing` apart along the chain; ends and forks stay.

    nodes: cloud_id, kx, ky, kz, x, y, z; an edge's d2 is between them, and src is the smaller voxel. A chain is followed from the end that comes first.
    A cloud's rings go if it has a node of another number of neighbours than two; else that of its first node stays.
    """
    edges = edges.select("cloud_id", "src", "dst", "d2")
    small, large = by_size(edges, most)
    pairs = small.groupBy("cloud_id").applyInPandas(lambda g: simplified_group(g, spacing), "cloud_id long, src string, dst string")
    pairs = pairs if large is None else pairs.unionByName(simplify_across(large, spacing))
    turn = order_of("src") > order_of("dst")
    pairs = pairs.select("cloud_id", F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct()
    spots = nodes.select("cloud_id", F.concat_ws("_", "kx", "ky", "kz").alias("node"), F.struct("x", "y", "z").alias("p"))
    at = lambda c: spots.select("cloud_id", F.col("node").alias(c), F.col("p").alias(f"p{c}"))
    d2 = sum(((F.col(f"pdst.{a}") - F.col(f"psrc.{a}")) * (F.col(f"pdst.{a}") - F.col(f"psrc.{a}")) for a in "xyz"), F.lit(0.0))
    return pairs.join(at("src"), ["cloud_id", "src"]).join(at("dst"), ["cloud_id", "dst"]).select("cloud_id", "src", "dst", d2.alias("d2"))
