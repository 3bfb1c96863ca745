"""Farthest-point sampling of one cloud across tasks, with the points that plain sampling takes.

Points lie in buckets along a space-filling curve, so that a bucket has a small box. A row is a bucket; no task holds a cloud's
points. In a round, each bucket that might hold the farthest point measures its points against those samples that its box doesn't
rule out, and names its few farthest as candidates, with a bound on the rest. One group a cloud then takes samples among the
candidates for as long as the best of them is farther than every bound: a new sample also lowers the bounds of the buckets
around it, so that a round takes many. What it can't decide is left to the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import removed, written

AXES = "xyz"
#: Points of a bucket, and candidates that it names.
BUCKET_POINTS, CANDIDATES = 4096, 32
#: Buckets are measured anew whose bound is at least this share of their cloud's largest, as squares.
NEAR_LARGEST = 0.25
#: Bits of each coordinate in a place on the curve.
CURVE_BITS = 16
BUCKETS = "cloud_id long, bucket string, ids array<long>, " + ", ".join(f"{a} array<double>" for a in AXES) + ", " + ", ".join(f"{e}_{a} double" for e in ("lo", "hi") for a in AXES)
STATE = "cloud_id long, bucket string, " + ", ".join(f"{e}_{a} double" for e in ("lo", "hi") for a in AXES) + ", bound double, bound_id long, ids array<long>, near array<double>, " + ", ".join(f"c{a} array<double>" for a in AXES)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Integers of CURVE_BITS bits with two zeros between each two bits."""
    out = np.zeros_like(x)
    for b in range(CURVE_BITS):
        out |= (x >> b & 1) << 3 * b
    return out


def buckets(points: DataFrame, size: int) -> DataFrame:
    """Rows of at most `size` points of a cloud that follow each other on the curve. Points are dealt by ranges of (cloud, place on the curve), so that a cloud spans tasks."""
    box = points.groupBy("cloud_id").agg(*(f(a).alias(f"{e}_{a}") for a in AXES for e, f in (("lo", F.min), ("hi", F.max))))

    def curved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.zeros(b.num_rows, np.int64)
            for k, a in enumerate(AXES):
                x, lo, hi = (b[c].to_numpy(zero_copy_only=False) for c in (a, f"lo_{a}", f"hi_{a}"))
                share = np.divide(x - lo, hi - lo, out=np.zeros(len(x)), where=hi > lo)
                code |= spread_bits(np.minimum((share * (1 << CURVE_BITS)).astype(np.int64), (1 << CURVE_BITS) - 1)) << k
            yield pa.record_batch([b["cloud_id"], b["point_id"], *(b[a] for a in AXES), pa.array(code)], ["cloud_id", "point_id", *AXES, "code"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, None
        for b in [*batches, None]:
            frame = held if b is None else b.to_pandas() if held is None else pd.concat([held, b.to_pandas()])
            if frame is None or not len(frame):
                continue
            rows, held = [], None
            for cloud, g in frame.groupby("cloud_id", sort=False):
                last = cloud == frame["cloud_id"].iloc[-1]
                for lo in range(0, len(g), size):
                    some = g.iloc[lo : lo + size]
                    if b is not None and last and lo + size >= len(g):  # it may go on in the next batch
                        held = some
                        continue
                    xyz = {a: some[a].to_numpy() for a in AXES}
                    rows.append({"cloud_id": cloud, "bucket": f"{part}.{number}", "ids": some["point_id"].to_numpy(), **xyz, **{f"lo_{a}": v.min() for a, v in xyz.items()}, **{f"hi_{a}": v.max() for a, v in xyz.items()}})
                    number += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    rows = points.select("cloud_id", "point_id", *AXES).join(box, "cloud_id").mapInArrow(curved, "cloud_id long, point_id long, x double, y double, z double, code long")
    return rows.repartitionByRange("cloud_id", "code", "point_id").sortWithinPartitions("cloud_id", "code", "point_id").mapInArrow(gathered, BUCKETS)


def measured(rows: DataFrame, candidates: int) -> DataFrame:
    """STATE of buckets: their candidates, farthest first and then by id, and as bound the farthest of the rest with its id, below zero if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cloud_id", pa.int64()), ("bucket", pa.string()), *((f"{e}_{a}", pa.float64()) for e in ("lo", "hi") for a in AXES), ("bound", pa.float64()), ("bound_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("near", pa.list_(pa.float64())), *((f"c{a}", pa.list_(pa.float64())) for a in AXES)])
        for b in batches:
            out = []
            for r in b.to_pylist():
                ids, xyz = np.array(r["ids"]), np.stack([r[a] for a in AXES], axis=1)
                near = np.full(len(ids), np.inf)
                for s in r["samples"]:
                    near = np.minimum(near, ((xyz - (s["x"], s["y"], s["z"])) ** 2).sum(axis=1))
                order = np.lexsort((ids, -near))
                top, rest = order[:candidates], order[candidates : candidates + 1]
                own = {k: r[k] for k in ("cloud_id", "bucket", *(f"{e}_{a}" for e in ("lo", "hi") for a in AXES))}
                out.append(own | {"bound": float(near[rest[0]]) if len(rest) else -1.0, "bound_id": int(ids[rest[0]]) if len(rest) else -1, "ids": ids[top].tolist(), "near": near[top].tolist(), **{f"c{a}": xyz[top, k].tolist() for k, a in enumerate(AXES)}})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    return rows.mapInArrow(run, STATE)


def taken(g: pd.DataFrame, want: int) -> tuple[list[tuple[int, float, float, float]], np.ndarray]:
    """The next samples (id, x, y, z) of a cloud, `want` at most, from the states of all its buckets; and what then bounds each bucket's points, candidates included."""
    of = np.repeat(np.arange(len(g)), [len(i) for i in g["ids"]])
    flat = lambda c: np.concatenate([np.asarray(v, float) for v in g[c]]) if len(of) else np.zeros(0)
    ids, near, xyz = np.concatenate([np.asarray(i, np.int64) for i in g["ids"]]), flat("near"), np.stack([flat(f"c{a}") for a in AXES], axis=1)
    bound, bound_id = g["bound"].to_numpy().copy(), g["bound_id"].to_numpy().copy()
    lo, hi = (g[[f"{e}_{a}" for a in AXES]].to_numpy() for e in ("lo", "hi"))
    picked: list[tuple[int, float, float, float]] = []
    while len(picked) < want and len(ids):
        best = np.lexsort((ids, -near))[0] if len(ids) < 64 else min(np.flatnonzero(near == near.max()), key=lambda k: ids[k])
        top = bound.max()
        if near[best] < top or near[best] == top and ids[best] > bound_id[bound == top].min():
            break
        picked.append((int(ids[best]), *xyz[best].tolist()))
        near = np.minimum(near, ((xyz - xyz[best]) ** 2).sum(axis=1))
        reach = (np.maximum(np.abs(lo - xyz[best]), np.abs(hi - xyz[best])) ** 2).sum(axis=1) * (1 + 1e-12)  # no point of the box is farther
        bound_id = np.where(reach < bound, -1, bound_id)  # which point it is isn't known any more
        bound = np.minimum(bound, reach)
    largest = bound.copy()
    np.maximum.at(largest, of, near)
    return picked, largest


def across(points: DataFrame, n: int, size: int = BUCKET_POINTS, candidates: int = CANDIDATES) -> DataFrame:
    """(cloud_id, point_id) of n samples of each cloud, from the point farthest from the centroid on, always the farthest of all samples so far; of equally far ones the smallest id.

    Ids are unique in a cloud, and each cloud has n points at least. A task of a round holds a few buckets at once, or a cloud's candidates, one of 128 of its points by default.
    """
    middle = points.groupBy("cloud_id").agg(*(F.avg(a).alias(f"m{a}") for a in AXES))
    apart = sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in AXES), F.lit(0.0))
    first = points.join(middle, "cloud_id").groupBy("cloud_id").agg(F.min(F.struct((-apart).alias("d"), "point_id", *AXES)).alias("f"))
    samples = written(first.select("cloud_id", F.array(F.struct("f.point_id", *(f"f.{a}" for a in AXES))).alias("samples")))
    dealt = written(buckets(points, size))
    box = [f"{e}_{a}" for e in ("lo", "hi") for a in AXES]
    bounds = written(dealt.select("cloud_id", "bucket", *box, F.lit(float("inf")).alias("largest")))
    outside = lambda s: sum((F.greatest(F.col(f"lo_{a}") - s[a], s[a] - F.col(f"hi_{a}"), F.lit(0.0)) ** 2 for a in AXES), F.lit(0.0))
    while True:
        open_ = samples.where(F.size("samples") < n)
        if open_.isEmpty():
            removed(dealt, bounds)
            return samples.select("cloud_id", F.explode("samples").alias("s")).select("cloud_id", "s.point_id")
        least = bounds.groupBy("cloud_id").agg((F.max("largest") * NEAR_LARGEST).alias("least"))
        known = bounds.join(open_, "cloud_id").join(least, "cloud_id")
        old = known.where(F.col("largest") < F.col("least"))
        new = known.where(F.col("largest") >= F.col("least")).select("cloud_id", "bucket", F.filter("samples", lambda s: outside(s) <= F.col("largest")).alias("samples"))
        state = measured(dealt.join(new, ["cloud_id", "bucket"]), candidates)
        none = [F.array().cast("array<long>").alias("ids"), *(F.array().cast("array<double>").alias(c) for c in ("near", "cx", "cy", "cz"))]
        still = old.select("cloud_id", "bucket", *box, F.col("largest").alias("bound"), F.lit(-1).cast("long").alias("bound_id"), *none)
        have = open_.select("cloud_id", F.size("samples").alias("have"))

        def run(g: pd.DataFrame) -> pd.DataFrame:
            picked, largest = taken(g, n - int(g["have"].iloc[0]))
            rows = g[["cloud_id", "bucket", *box]].assign(largest=largest, picked=None)
            rows["picked"] = [[{"point_id": i, "x": x, "y": y, "z": z} for i, x, y, z in picked] if k == 0 else None for k in range(len(g))]
            return rows

        out = "cloud_id long, bucket string, " + ", ".join(f"{c} double" for c in box) + ", largest double, picked array<struct<point_id:long,x:double,y:double,z:double>>"
        done = written(state.unionByName(still).join(have, "cloud_id").groupBy("cloud_id").applyInPandas(run, out))
        removed(bounds)
        bounds = done.drop("picked")
        more = done.where("picked is not null").select("cloud_id", "picked")
        now = written(samples.join(more, "cloud_id", "left").select("cloud_id", F.concat("samples", F.coalesce("picked", F.array().cast("array<struct<point_id:long,x:double,y:double,z:double>>"))).alias("samples")))
        removed(samples)
        samples = now
