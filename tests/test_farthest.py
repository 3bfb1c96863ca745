"""Farthest points across tasks against plain sampling."""

import numpy as np
import pytest

from grovespark.operators import farthest


def plain(ids, xyz, n):
    order = np.argsort(ids)
    ids, xyz = ids[order], xyz[order]
    got = [int(((xyz - xyz.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    near = np.full(len(xyz), np.inf)
    while len(got) < n:
        near = np.minimum(near, ((xyz - xyz[got[-1]]) ** 2).sum(axis=1))
        got.append(int(near.argmax()))
    return sorted(ids[got].tolist())


@pytest.mark.parametrize(("size", "candidates"), [(40, 4), (500, 32)])
def test_same_points_as_plain_sampling(spark, size, candidates):
    draw = np.random.default_rng(3)
    clouds = {1: draw.uniform(-5, 5, (1500, 3)), 2: draw.normal(0, 1, (700, 3)) * (9, 1, 1), 3: np.repeat(draw.integers(0, 6, (120, 3)).astype(float), 3, axis=0), 4: draw.integers(0, 5, (400, 3)).astype(float), 5: np.zeros((100, 3))}
    ids = {c: draw.permutation(len(p)) * 3 for c, p in clouds.items()}
    rows = [(c, int(i), *map(float, x)) for c, p in clouds.items() for i, x in zip(ids[c], p)]
    df = spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double").repartition(6)
    got = {}
    for r in farthest.across(df, 60, size, candidates).collect():
        got.setdefault(r["cloud_id"], []).append(r["point_id"])
    assert {c: sorted(v) for c, v in got.items()} == {c: plain(ids[c], p, 60) for c, p in clouds.items()}


def test_buckets_hold_each_point_once(spark):
    draw = np.random.default_rng(1)
    rows = [(c, i, *map(float, draw.normal(0, 3, 3))) for c in (1, 2, 3) for i in range(777)]
    b = farthest.buckets(spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double").repartition(5), 100).collect()
    assert max(len(r["ids"]) for r in b) <= 100 and len({r["bucket"] for r in b}) == len(b)
    assert sorted((r["cloud_id"], i, x, y, z) for r in b for i, x, y, z in zip(r["ids"], r["x"], r["y"], r["z"])) == sorted(rows)
    assert all(r[f"lo_{a}"] == min(r[a]) and r[f"hi_{a}"] == max(r[a]) for r in b for a in "xyz")
