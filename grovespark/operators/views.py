"""Depth views of clouds as sparse pixels: (cloud_id, view, row, col, value); pixels without points have no row."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import bbox

VIEWS = ("top", "front", "back", "left", "right")


def grid(v: Column, low: Column, high: Column, size: int) -> Column:
    """The pixel of a coordinate, cut towards zero, and moved into the image."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), ((v - low) / (high - low + 1e-8) * (size - 1)).cast("int")))


def project(points: DataFrame, size: int = 64, reference: DataFrame | None = None, margin: float = 0.05) -> DataFrame:
    """Five views. The cube is that of each cloud, or of the cloud of the same id in `reference`; points beyond it go to the border.

    A point gives five rows in one pass, pixels keep the least distance by partial aggregation, and only then each view is scaled: the
    nearest pixel is about 1, the farthest 1/255.
    """
    cube = bbox(points if reference is None else reference, margin).select("cloud_id", *(f(F.col(f"mid_{a}"), F.col("half")).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", lambda m, h: m - h), ("hi", lambda m, h: m + h))))
    p = points.join(cube, "cloud_id")
    gx, gy, gz = (grid(F.col(a), F.col(f"lo{a}"), F.col(f"hi{a}"), size) for a in "xyz")
    p = p.select("cloud_id", "x", "y", "z", *(f"{n}{a}" for n in ("lo", "hi") for a in "xyz"), gx.alias("gx"), gy.alias("gy"), gz.alias("gz"))
    last, c = size - 1, F.col
    made = [("top", c("gy"), c("gx"), c("hiz") - c("z")), ("front", last - c("gz"), c("gx"), c("hiy") - c("y")), ("back", last - c("gz"), last - c("gx"), c("y") - c("loy")), ("left", last - c("gz"), c("gy"), c("hix") - c("x")), ("right", last - c("gz"), last - c("gy"), c("x") - c("lox"))]
    five = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), r.alias("row"), q.alias("col"), d.alias("d")) for v, r, q, d in made)))
    pixels = p.select("cloud_id", five.alias("s")).groupBy("cloud_id", "s.view", "s.row", "s.col").agg(F.min("s.d").alias("d"))
    ends = pixels.groupBy("cloud_id", "view").agg(F.min("d").alias("near"), F.max("d").alias("far"))
    value = (c("far") - c("d")) / (c("far") - c("near") + 1e-8) * (254.0 / 255.0) + 1.0 / 255.0
    return pixels.join(ends, ["cloud_id", "view"]).select("cloud_id", "view", "row", "col", value.alias("value"))


def kernel(width: int = 5, sigma: float = 1.5) -> list[float]:
    raw = [math.exp(-((i - width // 2) ** 2) / (2 * sigma * sigma)) for i in range(width)]
    return [x / sum(raw) for x in raw]


def blur(pixels: DataFrame, size: int = 64, width: int = 5, sigma: float = 1.5) -> DataFrame:
    """A Gaussian blur of sparse pixels, mirrored at the borders, row by row, then column by column. A cloud's views are one group: five images of size x size."""
    w, r, last = kernel(width, sigma), width // 2, size - 1
    weights = np.zeros((size, size))  # weights[to, from]
    for to in range(size):
        for d in range(-r, r + 1):
            at = to + d
            weights[to, -at if at < 0 else 2 * last - at if at > last else at] += w[d + r]

    def run(group: pa.Table) -> pa.Table:
        image = np.zeros((len(VIEWS), size, size))
        view = pc.index_in(group["view"], pa.array(VIEWS)).to_numpy()
        image[view, group["row"].to_numpy(), group["col"].to_numpy()] = group["value"].to_numpy()
        out = weights @ image @ weights.T
        v, row, col = np.nonzero(out)
        cloud = pa.array(np.full(len(v), group["cloud_id"][0].as_py()))
        return pa.table({"cloud_id": cloud, "view": pa.array(VIEWS).take(pa.array(v)), "row": pa.array(row.astype(np.int32)), "col": pa.array(col.astype(np.int32)), "value": pa.array(out[v, row, col])})

    return pixels.groupBy("cloud_id").applyInArrow(run, "cloud_id long, view string, row int, col int, value double")
