"""Cleaning: finite points, centring, boxes, heights, background, unit boxes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def finite(column: str) -> Column:
    return ~F.isnan(column) & (F.abs(F.col(column)) != float("inf"))


def per_cloud(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Least and largest coordinates, their means and the count of each cloud; partial sums come before the shuffle."""
    return points.groupBy(key).agg(*(f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))), F.count("*").alias("n"))


def bbox(points: DataFrame, margin: float = 0.05) -> DataFrame:
    """Each cloud's box, and the cube about its centre: half the largest extent, widened by the margin on both sides."""
    extent = F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES))
    out = per_cloud(points).withColumn("half", extent / 2 * (1 + 2 * margin))
    return out.select("cloud_id", *(f"{m}_{a}" for a in AXES for m in ("min", "max")), *(((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).alias(f"mid_{a}") for a in AXES), "half", "n")


def center(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Moves each cloud's (or plot's, by another key) centroid to the origin."""
    mean = per_cloud(points, key).select(key, *(f"mean_{a}" for a in AXES))
    return points.select(*points.columns[:2], *AXES).join(mean, key).select(*points.columns[:2], *((F.col(a) - F.col(f"mean_{a}")).alias(a) for a in AXES))


def packed(points: DataFrame) -> DataFrame:
    """(cloud_id, point_id, x, y, z, _row): what work on points needs, and all columns of any names in one, so that the work's own names can't clash with theirs."""
    return points.select("cloud_id", "point_id", *AXES, F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("_row"))


def safe(points: DataFrame, least: int = 16) -> DataFrame:
    """Finite points of clouds that have at least `least` of them."""
    good = points.where(finite("x") & finite("y") & finite("z"))
    enough = good.groupBy("cloud_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return good.join(enough.select("cloud_id"), "cloud_id", "left_semi")


def heights(points: DataFrame) -> DataFrame:
    return points.groupBy("cloud_id").agg((F.max("z") - F.min("z")).alias("height"))


def tall(points: DataFrame, least: float = 1.5) -> DataFrame:
    """Points of clouds that are at least so high."""
    return points.join(heights(points).where(F.col("height") >= least).select("cloud_id"), "cloud_id", "left_semi")


def short(points: DataFrame, least: float = 1.5) -> DataFrame:
    """The clouds that tall() takes out: a dry run."""
    return heights(points).where(F.col("height") < least)


def drop_background(points: DataFrame) -> DataFrame:
    """Drops tree 0, and trees whose first point has species 0. points: tree_id, point_id, species, x, y, z."""
    trees = points.where("tree_id <> 0")
    first = trees.groupBy("tree_id").agg(F.min_by("species", "point_id").alias("first_species")).where("first_species <> 0")
    return trees.join(first, "tree_id")


def unit(points: DataFrame) -> DataFrame:
    """Scales each cloud into the unit box; a span counts as 1e-6 at least."""
    box = per_cloud(points)
    return points.select(*points.columns[:2], *AXES).join(box, "cloud_id").select(*points.columns[:2], *((((F.col(a) - F.col(f"min_{a}")) / F.greatest(F.col(f"max_{a}") - F.col(f"min_{a}"), F.lit(1e-6))).alias(a)) for a in AXES))


def plot_trees(points: DataFrame, least: float = 1.4) -> DataFrame:
    """(source, tree_id, inside, species, n, height, path): the trees of plots, by their plot and number.

    points: source, tree_id, point_id, species, inside, x, y, z. A tree has the species and the inside mark of its first point. Tree 0, species 0 and trees below `least` are background.
    """
    trees = points.where("tree_id <> 0").groupBy("source", "tree_id")
    first = trees.agg(F.min_by(F.struct("species", "inside"), "point_id").alias("f"), F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("height"))
    path = F.concat(F.concat_ws("_", "source", "tree_id", "f.inside", "f.species"), F.lit(".npy"))
    return first.where((F.col("f.species") != 0) & (F.col("height") >= least)).select("source", "tree_id", "f.inside", "f.species", "n", "height", path.alias("path"))
