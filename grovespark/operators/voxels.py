"""Voxel grouping, overlapping tiles, and the radius join."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform
from .ranks import numbered
from .sampling import farthest


def keys(size: float) -> list[Column]:
    return [F.floor(F.col(a) / size).alias(f"k{a}") for a in "xyz"]


def means(points: DataFrame, size: float) -> DataFrame:
    """(cloud_id, kx, ky, kz, x, y, z, n): the mean point of each voxel."""
    return points.groupBy("cloud_id", *keys(size)).agg(*(F.avg(a).alias(a) for a in "xyz"), F.count("*").alias("n"))


def nearest(points: DataFrame, size: float) -> DataFrame:
    """The point of each voxel that is nearest its middle; of equally near ones the first by id, or by coordinates where points have none.

    A minimum of (distance, id, point): partial results come before the shuffle, and no voxel is sorted.
    """
    d2 = sum(((F.col(a) / size - F.floor(F.col(a) / size) - 0.5) ** 2 for a in "xyz"), F.lit(0.0))
    order = [F.col("point_id")] if "point_id" in points.columns else []
    best = points.groupBy("cloud_id", *keys(size)).agg(F.min(F.struct(F.round(d2, 12).alias("d2"), *order, "x", "y", "z")).alias("p"))
    return best.select("cloud_id", "kx", "ky", "kz", *([F.col("p.point_id")] if order else []), "p.x", "p.y", "p.z")


def in_tiles(points: DataFrame, size: float, overlap: float) -> DataFrame:
    """Points with ix and iy of each tile that holds them, both ends inclusive; tiles start at the cloud's least x and y."""
    stride = size * (1 - overlap)
    box = points.groupBy("cloud_id").agg(*(f(a).alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    p = points.join(box, "cloud_id")

    def candidates(a: str) -> Column:
        at = (F.col(a) - F.col(f"lo{a}")) / stride
        first = F.greatest(F.lit(0), F.floor(at - size / stride).cast("int"))
        last = F.least(F.ceil((F.col(f"hi{a}") - F.col(f"lo{a}")) / stride).cast("int"), F.ceil(at).cast("int"))
        return F.explode(F.sequence(first, F.greatest(first, last)))

    def inside(a: str, k: str) -> Column:
        start = F.col(f"lo{a}") + F.col(k) * stride
        return F.col(a).between(start, start + size)

    p = p.withColumn("ix", candidates("x")).where(inside("x", "ix")).withColumn("iy", candidates("y")).where(inside("y", "iy"))
    return p.select(*points.columns, "ix", "iy")


def tiles(points: DataFrame, size: float, overlap: float) -> DataFrame:
    """(cloud_id, point_id, ix, iy) of all points of each tile."""
    return in_tiles(points, size, overlap).select("cloud_id", "point_id", "ix", "iy")


def tile_samples(points: DataFrame, size: float, overlap: float, n: int) -> DataFrame:
    """(cloud_id, point_id, ix, iy, x, y, z, copy, noise): n points of each tile.

    A tile with fewer than n // 4 points is noise and keeps all; one with fewer than n gets n draws with replacement (copy is the draw);
    of one with more, the farthest points are taken.
    """
    tile = ["cloud_id", "ix", "iy"]
    p = in_tiles(points, size, overlap)
    sizes = p.groupBy(*tile).agg(F.count("*").alias("have"))
    out = [*p.columns, "copy", "noise"]
    p = p.join(sizes, tile)
    whole = p.where((F.col("have") < n // 4) | (F.col("have") == n)).withColumn("copy", F.lit(0)).withColumn("noise", F.col("have") < n // 4)
    few = (F.col("have") >= n // 4) & (F.col("have") < n)
    ranked = p.where(few).drop("have").withColumn("rank", F.row_number().over(Window.partitionBy(*tile).orderBy("point_id")))
    draws = sizes.where(few).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = draws.withColumn("rank", (F.floor(uniform("tile", *tile, "copy") * F.col("have")) + 1).cast("int")).drop("have")
    redrawn = draws.join(ranked, [*tile, "rank"]).withColumn("noise", F.lit(False))
    large = p.where(F.col("have") > n).drop("have").withColumn("of", F.struct(*tile)).withColumn("cloud_id", F.concat_ws("+", *tile))
    spread = farthest(large, n).withColumn("cloud_id", F.col("of.cloud_id")).withColumn("noise", F.lit(False))
    return whole.select(out).unionByName(redrawn.select(out)).unionByName(spread.select(out))


def offsets(size: float, radius: float) -> list[tuple[int, int, int]]:
    """Half of the neighbouring voxels: steps after (0, 0, 0) in order whose length is within the radius."""
    r = int(-(-radius // size))
    steps = range(-r, r + 1)
    return [(a, b, c) for a in steps for b in steps for c in steps if (a, b, c) > (0, 0, 0) and (a * a + b * b + c * c) * size * size <= radius * radius]


def radius_edges(nodes: DataFrame, size: float, radius: float) -> DataFrame:
    """(cloud_id, src, dst, d2): pairs of voxel means within the radius whose voxels are within it too. src has the smaller voxel key.

    The voxel's neighbours become equi-join keys, so that near pairs meet without a cross join. Spark takes the size of nodes from the files
    of their points, a tenth of what rows take, and would send some hundred MB to the driver to broadcast them; so both sides are shuffled.
    """
    steps = F.explode(F.array(*(F.struct(*(F.lit(v).cast("long").alias(f"d{a}") for a, v in zip("xyz", s))) for s in offsets(size, radius))))
    name = F.concat_ws("_", "kx", "ky", "kz")
    left = nodes.select("cloud_id", name.alias("src"), *(F.col(a).alias(f"a{a}") for a in "xyz"), "kx", "ky", "kz", steps.alias("s"))
    left = left.select("cloud_id", "src", "ax", "ay", "az", *((F.col(f"k{a}") + F.col(f"s.d{a}")).alias(f"k{a}") for a in "xyz"))
    right = nodes.select("cloud_id", "kx", "ky", "kz", name.alias("dst"), "x", "y", "z")
    d2 = sum(((F.col(a) - F.col(f"a{a}")) * (F.col(a) - F.col(f"a{a}")) for a in "xyz"), F.lit(0.0))
    return left.join(right.hint("merge"), ["cloud_id", "kx", "ky", "kz"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("cloud_id", "src", "dst", "d2")


def both_ways(edges: DataFrame) -> DataFrame:
    pair = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    return edges.select("cloud_id", pair.alias("p")).select("cloud_id", "p.node", "p.other")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("cloud_id", "node").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(cloud_id, node, neighbours): sorted names, at most twice the number of steps within the radius."""
    return both_ways(edges).groupBy("cloud_id", "node").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))


def alive_edges(edges: DataFrame, alive: DataFrame) -> DataFrame:
    """Edges both ends of which are alive (cloud_id, node). Both sides are shuffled, as in radius_edges()."""
    one = edges.join(alive.withColumnRenamed("node", "src").hint("merge"), ["cloud_id", "src"], "left_semi")
    return one.join(alive.withColumnRenamed("node", "dst").hint("merge"), ["cloud_id", "dst"], "left_semi").select(edges.columns)


def along_edges(edges: DataFrame, nodes: DataFrame, spacing: float) -> DataFrame:
    """(cloud_id, src, dst, step, x, y, z): points along each edge, both ends included, no farther apart than the spacing. Nodes are shuffled, as in radius_edges()."""
    name = F.concat_ws("_", "kx", "ky", "kz")
    ends = nodes.select("cloud_id", name.alias("node"), "x", "y", "z").hint("merge")
    a = ends.select("cloud_id", F.col("node").alias("src"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = ends.select("cloud_id", F.col("node").alias("dst"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    e = edges.join(a, ["cloud_id", "src"]).join(b, ["cloud_id", "dst"])
    length = F.sqrt(sum(((F.col(f"b{c}") - F.col(f"a{c}")) * (F.col(f"b{c}") - F.col(f"a{c}")) for c in "xyz"), F.lit(0.0)))
    e = e.withColumn("n", F.greatest(F.lit(2), F.ceil(length / spacing).cast("int") + 1)).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("step") / (F.col("n") - 1)
    return e.select("cloud_id", "src", "dst", "step", *((F.col(f"a{c}") + t * (F.col(f"b{c}") - F.col(f"a{c}"))).alias(c) for c in "xyz"))


def skeleton(edges: DataFrame, nodes: DataFrame, spacing: float) -> DataFrame:
    """All nodes, as rows with src alone and step -1, and the points along the edges; a node without an edge stays. (cloud_id, src, dst, step, x, y, z)"""
    alone = nodes.select("cloud_id", F.concat_ws("_", "kx", "ky", "kz").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(-1).alias("step"), "x", "y", "z")
    return alone.unionByName(along_edges(edges, nodes, spacing))


def chunk_ids(rows: DataFrame, order: list[str], size: int = 30) -> DataFrame:
    """Numbers rows in chunks of `size` within each split."""
    return numbered(rows, ["split"], order, "_place").withColumn("chunk_id", F.floor((F.col("_place") - 1) / size)).drop("_place")
