"""Resampling of clouds, weighted draws, farthest points, and random augmentations. All draws are hashes of the cloud and the point."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import between, normal, uniform
from ..session import cut
from .clean import packed, per_cloud, safe
from .farthest import across
from .ranks import numbered

SURVIVORS = 64


def exact(points: DataFrame, n: int, seed: str = "resample") -> DataFrame:
    """n points of each cloud: the first n by hash where there are more; all and random copies (copy > 0) where there are fewer."""
    ranked = points.withColumn("rank", F.row_number().over(Window.partitionBy("cloud_id").orderBy(uniform(seed, "cloud_id", "point_id"), "point_id")))
    sizes = points.groupBy("cloud_id").agg(F.count("*").alias("have"))
    kept = ranked.where(F.col("rank") <= n).withColumn("copy", F.lit(0)).drop("rank")
    draws = sizes.where(F.col("have") < n).withColumn("copy", F.explode(F.sequence(F.lit(1), (n - F.col("have")).cast("int"))))
    draws = draws.withColumn("rank", (F.floor(uniform(seed + "+", "cloud_id", "copy") * F.col("have")) + 1).cast("int"))
    extra = draws.join(ranked, ["cloud_id", "rank"]).select(*points.columns, "copy")
    return kept.unionByName(extra)


def farthest(points: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """Farthest-point sampling of clouds with more than n points, from the point farthest from the centroid; smaller clouds as exact() does.

    A cloud is one group; with `most`, one of more points than that is worked on across tasks, where point_id has to be unique in a cloud.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_id")
        p = g[["x", "y", "z"]].to_numpy()
        d = ((p - p.mean(axis=0)) ** 2).sum(axis=1)
        taken, near = [int(d.argmax())], np.full(len(p), np.inf)
        while len(taken) < n:
            near = np.minimum(near, ((p - p[taken[-1]]) ** 2).sum(axis=1))
            taken.append(int(near.argmax()))
        return g.iloc[taken]

    sizes = points.groupBy("cloud_id").agg(F.count("*").alias("_n"))
    both = points.join(sizes, "cloud_id")
    above = F.col("_n") > n
    large = both.where(above if most is None else above & (F.col("_n") <= most)).drop("_n").groupBy("cloud_id").applyInPandas(run, points.schema)
    if most is not None:
        huge = cut(both.where(above & (F.col("_n") > most)).drop("_n"))
        if not huge.isEmpty():
            large = large.unionByName(huge.join(across(huge, n), ["cloud_id", "point_id"]).select(points.columns))
    large = large.withColumn("copy", F.lit(0))
    return large.unionByName(exact(both.where(F.col("_n") <= n).drop("_n"), n))


def class_weights(rows: DataFrame, power: float = 0.45) -> DataFrame:
    """(label, n, weight): (rows / (labels * n)) ^ power, the library's own definition."""
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", F.pow(F.col("total") / (F.col("k") * F.col("n")), F.lit(power)).alias("weight"))


def weighted(rows: DataFrame, draws: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """For each row of draws (draw, u in [0, 1)): an id by its class weight, with replacement.

    A draw first falls on a class by the cumulative weights of all of its rows, which are a row a class, then on a row of it, as rows of a class weigh the same.
    """
    w = class_weights(rows).select("label", "n", F.round(F.col("weight") * scale).cast("long").alias("w"))
    w = w.withColumn("upto", F.sum(F.col("w") * F.col("n")).over(Window.partitionBy(F.lit(0)).orderBy("label")))
    table = w.agg(F.sort_array(F.collect_list(F.struct("upto", "label", "w", "n"))).alias("t"), F.max("upto").alias("total"))
    at = draws.crossJoin(F.broadcast(table)).withColumn("at", F.floor(F.col("u") * F.col("total")))  # one row
    at = at.withColumn("c", F.get(F.filter("t", lambda s: s.upto > F.col("at")), F.lit(0)))
    at = at.select("draw", F.col("c.label").alias("label"), (F.floor((F.col("at") - (F.col("c.upto") - F.col("c.w") * F.col("c.n"))) / F.col("c.w")) + 1).cast("long").alias("rank"))
    ranked = numbered(rows.select("label", "id"), ["label"], ["id"], "rank")
    return at.join(ranked, ["label", "rank"]).select("draw", "id", "label")


def jitter(points: DataFrame, std: float = 0.01) -> DataFrame:
    return points.select("cloud_id", "point_id", *((F.col(a) + std * normal("j" + a, "cloud_id", "point_id")).alias(a) for a in "xyz"))


def yaw(points: DataFrame) -> DataFrame:
    """Turns each cloud about the z axis by a random angle."""
    a = F.radians(between("yaw", 0, 360, "cloud_id"))
    return points.select("cloud_id", "point_id", (F.col("x") * F.cos(a) - F.col("y") * F.sin(a)).alias("x"), (F.col("x") * F.sin(a) + F.col("y") * F.cos(a)).alias("y"), "z")


def tilt(points: DataFrame, most: float = 10) -> DataFrame:
    """Turns each cloud about the x, then the y axis, by up to `most` degrees."""
    a, b = F.radians(between("tiltx", -most, most, "cloud_id")), F.radians(between("tilty", -most, most, "cloud_id"))
    p = points.select("cloud_id", "point_id", "x", (F.col("y") * F.cos(a) - F.col("z") * F.sin(a)).alias("y"), (F.col("y") * F.sin(a) + F.col("z") * F.cos(a)).alias("z"))
    return p.select("cloud_id", "point_id", (F.col("x") * F.cos(b) + F.col("z") * F.sin(b)).alias("x"), "y", (F.col("z") * F.cos(b) - F.col("x") * F.sin(b)).alias("z"))


def scale(points: DataFrame, low: float = 0.9, high: float = 1.1) -> DataFrame:
    return points.select("cloud_id", "point_id", *((F.col(a) * between("s" + a, low, high, "cloud_id")).alias(a) for a in "xyz"))


#: Ranges of the scale by axis.
RANGES = {"x": (0.85, 1.25), "y": (0.85, 1.25), "z": (0.82, 1.32)}


def scale_about_mean(points: DataFrame, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    p = packed(points).join(per_cloud(points).select("cloud_id", "mean_x", "mean_y", "mean_z"), "cloud_id")
    return p.select("cloud_id", "point_id", *((F.col(f"mean_{a}") + (F.col(a) - F.col(f"mean_{a}")) * between("m" + a, *r, "cloud_id")).alias(a) for a, r in ranges.items()))


def clamp(v: Column, low: float = 0, high: float = 1) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))


def radius() -> Column:
    return F.sqrt((F.col("ux") - 0.5) * (F.col("ux") - 0.5) + (F.col("uy") - 0.5) * (F.col("uy") - 0.5))


def thinning(least: float = 0.40) -> Column:
    """The chance to stay: less far from the axis, and in a height band."""
    base, zc, zw = between("tb", least, 0.88, "cloud_id"), between("tc", 0.15, 0.85, "cloud_id"), between("tw", 0.10, 0.30, "cloud_id")
    bump = (F.col("uz") - zc) / zw
    return clamp(base - 0.30 * clamp((radius() - 0.25) / 0.45) - 0.20 * F.exp(-0.5 * bump * bump), 0.12, 1)


def branch_loss() -> Column:
    s = 0.65 * clamp((radius() - 0.15) / 0.45) + 0.35 * clamp((F.col("uz") - 0.25) / 0.70)
    return 0.90 * (1 - s) + 0.45 * s


def cuboids(most: int = 8, least: int = 2) -> Column:
    """`least` to `most` boxes, each of which takes points within it by its own chance."""
    n = least + F.floor(uniform("cn", "cloud_id") * (most - least + 1))
    stay = F.lit(1.0)
    for k in range(most):
        within = F.lit(k) < n
        for a, (low, high) in {"x": (0.07, 0.20), "y": (0.07, 0.20), "z": (0.07, 0.25)}.items():
            within &= F.abs(F.col("u" + a) - uniform(f"cc{k}{a}", "cloud_id")) <= between(f"cs{k}{a}", low, high, "cloud_id") / 2
        stay *= F.when(within, 1 - between(f"cd{k}", 0.45, 0.80, "cloud_id")).otherwise(1.0)
    return stay


def bands() -> Column:
    """1 or 2 height bands."""
    stay = F.lit(1.0)
    for k in range(2):
        within = F.abs(F.col("uz") - between(f"bc{k}", 0.05, 0.95, "cloud_id")) < between(f"bh{k}", 0.06, 0.20, "cloud_id") / 2
        if k:
            within &= uniform("bn", "cloud_id") < 0.5
        stay *= F.when(within, 1 - between(f"bd{k}", 0.35, 0.75, "cloud_id")).otherwise(1.0)
    return stay


def vertical_crop() -> Column:
    low = F.when(uniform("vb", "cloud_id") < 0.60, between("vl", 0, 0.12, "cloud_id")).otherwise(0.0)
    high = F.when(uniform("vt", "cloud_id") < 0.50, between("vh", 0, 0.12, "cloud_id")).otherwise(0.0)
    return ((F.col("uz") >= low) & (F.col("uz") <= 1 - high)).cast("double")


def bottom_crop() -> Column:
    return (F.col("uz") >= between("bb", 0.12, 0.45, "cloud_id")).cast("double")


def keep(points: DataFrame, chance: Column, seed: str, probability: float | None = None, survivors: int = SURVIVORS) -> DataFrame:
    """Keeps points by their chance, a function of the unit coordinates ux, uy, uz; a cloud of which fewer than `survivors` would stay is left whole.

    With a probability, only so many clouds, by a coin of their own, are touched.
    """
    both = packed(points).join(per_cloud(points), "cloud_id").withColumns({"u" + a: (F.col(a) - F.col(f"min_{a}")) / F.greatest(span(a), F.lit(1e-6)) for a in "xyz"})
    stays = uniform(seed, "cloud_id", "point_id") < chance
    if probability is not None:
        stays |= uniform(seed + "?", "cloud_id") >= probability
    marked = both.withColumn("_stays", stays)
    few = marked.groupBy("cloud_id").agg(F.count(F.when(F.col("_stays"), 1)).alias("_left"))
    return marked.join(few, "cloud_id").where((F.col("_stays")) | (F.col("_left") < survivors)).select("_row.*")


def added(points: DataFrame, kind: str, low: float, high: float, least: int) -> DataFrame:
    """(cloud_id, k, box): rows to make for each cloud, between those shares of its points and `least` at least."""
    box = per_cloud(points)
    a, b = F.greatest(F.lit(least), F.floor(low * F.col("n"))), F.greatest(F.lit(least + 1), F.floor(high * F.col("n")))
    n = (a + F.floor(uniform(kind + "n", "cloud_id") * (b - a + 1))).cast("int")
    return box.withColumn("k", F.explode(F.sequence(F.lit(1), n)))


def span(a: str) -> Column:
    return F.col(f"max_{a}") - F.col(f"min_{a}")


def sign(seed: str) -> Column:
    return F.when(uniform(seed, "cloud_id") < 0.5, -1.0).otherwise(1.0)


def stem(points: DataFrame) -> DataFrame:
    """A neighbour's stem: points of a line beside the cloud's mean place. (cloud_id, k, x, y, z)"""
    rows = added(points, "st", 0.02, 0.16, 32)
    x = F.col("mean_x") + sign("sts") * between("stx", 0.30, 0.65, "cloud_id") * span("x") + 0.012 * span("x") * normal("stnx", "cloud_id", "k")
    y = F.col("mean_y") + between("sty", -0.30, 0.30, "cloud_id") * span("y") + 0.012 * span("y") * normal("stny", "cloud_id", "k")
    return rows.select("cloud_id", "k", x.alias("x"), y.alias("y"), (F.col("min_z") + uniform("stz", "cloud_id", "k") * span("z")).alias("z"))


#: Offsets from the box's middle and spreads of outlier clusters, by span.
OUTLIERS = {"x": ((-0.6, 0.6), 0.06), "y": ((-0.6, 0.6), 0.06), "z": ((-0.08, 0.75), 0.09)}


def outliers(points: DataFrame) -> DataFrame:
    """One to three clusters of stray points, each of the same number, 4 at least, about the box's middle. (cloud_id, k, x, y, z)"""
    rows = added(points, "ou", 0.01, 0.09, 16).groupBy("cloud_id", *(f"{m}_{a}" for a in "xyz" for m in ("min", "max"))).agg(F.max("k").alias("total"))
    rows = rows.withColumn("clusters", 1 + F.floor(uniform("ouc", "cloud_id") * 3)).withColumn("each", F.greatest(F.lit(4), F.expr("total div clusters")))
    rows = rows.withColumn("k", F.explode(F.expr("sequence(1, cast(clusters * each as int))"))).withColumn("c", F.expr("cast((k - 1) div each as int)"))
    out = []
    for a, ((low, high), s) in OUTLIERS.items():
        middle = (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2
        out.append((middle + between("ou" + a, low, high, "cloud_id", "c") * span(a) + between("os" + a, 0.01, s, "cloud_id", "c") * span(a) * normal("on" + a, "cloud_id", "k")).alias(a))
    return rows.select("cloud_id", "k", *out)


def crown_leak(points: DataFrame) -> DataFrame:
    """Draws from the crown's points with replacement, beside the cloud, of clouds with 32 such points; (cloud_id, point_id, k, x, y, z) of the draws k that stay."""
    points, box = points.select("cloud_id", "point_id", *"xyz"), per_cloud(points)
    crown = points.join(box, "cloud_id").where((F.col("z") - F.col("min_z")) / F.greatest(span("z"), F.lit(1e-6)) > between("cl", 0.45, 0.70, "cloud_id")).select(points.columns)
    enough = crown.groupBy("cloud_id").agg(F.count("*").alias("c")).where("c >= 32")
    stays = uniform("clk", "cloud_id", "k") < between("clp", 0.20, 0.55, "cloud_id")
    draws = added(points, "cl", 0.03, 0.24, 32).where(stays).join(enough, "cloud_id").withColumn("rank", (F.floor(uniform("cld", "cloud_id", "k") * F.col("c")) + 1).cast("int"))
    ranked = crown.withColumn("rank", F.row_number().over(Window.partitionBy("cloud_id").orderBy("point_id")))
    x = F.col("x") + sign("cls") * between("clx", 0.2, 0.6, "cloud_id") * span("x")
    y, z = F.col("y") + between("cly", -0.3, 0.3, "cloud_id") * span("y"), F.col("z") + between("clz", -0.06, 0.06, "cloud_id") * span("z")
    return draws.join(ranked, ["cloud_id", "rank"]).select("cloud_id", "point_id", "k", x.alias("x"), y.alias("y"), z.alias("z"))


#: The chance of a second copy, and ranges of a copy's scale.
SECOND_COPY = 0.05 / 0.33
COPY_RANGES = {"x": (0.90, 1.15), "y": (0.90, 1.15), "z": (0.88, 1.18)}


def tree_copy(points: DataFrame) -> DataFrame:
    """Neighbours: one copy of the cloud, or two, each changed by its own coins about the cloud's centroid, then shifted. (cloud_id, point_id, copy, x, y, z)

    A copy is a cloud of its own, by the cloud's and the copy's number, so that its draws are too.
    """
    copies = F.explode(F.when(uniform("tc2", "cloud_id") < SECOND_COPY, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    of = per_cloud(points).select("cloud_id", *(F.col(f"mean_{a}").alias(f"c{a}") for a in "xyz")).withColumn("copy", copies).withColumn("key", F.concat_ws("+", "cloud_id", "copy"))
    of = cut(of)
    p = points.join(of, "cloud_id").select(F.col("key").alias("cloud_id"), "point_id", *((F.col(a) - F.col(f"c{a}")).alias(a) for a in "xyz"))
    p = cut(jitter(p, 0.015))
    for step, seed, probability in ((lambda q: scale_about_mean(q, COPY_RANGES), "tcs", 0.65), (yaw, "tcy", 0.55), (lambda q: tilt(q, 6), "tct", 0.35)):
        p = cut(some(p, step, seed, probability))
    for chance, seed, probability in ((bottom_crop(), "tcb", 0.78), (thinning(0.42), "tch", 0.45), (cuboids(5, 1), "tcc", 0.30)):
        p = cut(keep(p, chance, seed, probability))
    r, at = between("tcr", 0.8, 2.4, "key"), F.radians(between("tca", 0, 360, "key"))
    shift = {"x": r * F.cos(at), "y": r * F.sin(at), "z": between("tcz", -0.8, 0.8, "key")}
    back = p.withColumnRenamed("cloud_id", "key").join(of, "key")
    return back.select("cloud_id", "point_id", "copy", *((F.col(a) + F.col(f"c{a}") + shift[a]).alias(a) for a in "xyz"))


def coin(rows: DataFrame, seed: str, probability: float) -> DataFrame:
    return rows.where(uniform(seed, "cloud_id") < probability)


def some(points: DataFrame, step: Callable[[DataFrame], DataFrame], seed: str, probability: float) -> DataFrame:
    """A step on clouds by a coin; the others stay as they are."""
    return step(coin(points, seed, probability)).unionByName(points.where(uniform(seed, "cloud_id") >= probability))


def augment(points: DataFrame, n: int) -> DataFrame:
    """All augmentations in order, each by its coin and from what the one before left; then exactly n points of each cloud.

    Only finite points count, and clouds with fewer than 16 of them go, at first and at the end.
    """
    p = cut(some(cut(safe(points)), scale_about_mean, "g1", 0.45))
    for chance, seed, probability in ((thinning(), "g2", 0.78), (branch_loss(), "g3", 0.68), (cuboids(), "g4", 0.75), (bands(), "g5", 0.20), (vertical_crop(), "g6", 0.05)):
        p = cut(keep(p, chance, seed, probability))  # each step needs its cloud's box and count, so plans would double
    for made, seed, probability, names in ((crown_leak, "g7", 0.60, ["k"]), (stem, "g8", 0.50, ["k"]), (outliers, "g9", 0.55, ["k"]), (tree_copy, "g10", 0.33, ["copy", "point_id"])):
        rows = made(coin(p, seed, probability)).withColumn("point_id", F.xxhash64(F.lit(seed), *names))
        p = cut(p.unionByName(rows.select(p.columns)))
    return exact(safe(p).select("cloud_id", "point_id", "x", "y", "z"), n)
