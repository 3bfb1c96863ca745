"""Small cases whose results are known by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovespark.functions import rng
from grovespark.functions import tables as T
from grovespark.operators import clean, evaluate, graph, sampling, search, spatial, views, voxels


def points(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], "cloud_id long, point_id long, x double, y double, z double")


def test_views_of_three_points(spark):
    px = {(r["view"], r["row"], r["col"]): r["value"] for r in views.project(points(spark, [(0, 0, 0), (10, 0, 0), (0, 0, 4)]), 12).collect()}
    assert px[("top", 5, 0)] == pytest.approx(1, abs=1e-6) and px[("top", 5, 10)] == pytest.approx(1 / 255)
    assert {k for k in px if k[0] == "front"} == {("front", 8, 0), ("front", 4, 0), ("front", 8, 10)}
    assert {k for k in px if k[0] == "back"} == {("back", 8, 11), ("back", 4, 11), ("back", 8, 1)}
    assert px[("left", 8, 5)] == pytest.approx(1, abs=1e-6) and px[("left", 4, 5)] == pytest.approx(1 / 255)
    assert px[("right", 8, 6)] == pytest.approx(1 / 255) and px[("right", 4, 6)] == pytest.approx(1 / 255)


def test_nearest_in_voxel(spark):
    kept = voxels.nearest(points(spark, [(0.1, 0, 0), (0.4, 0, 0), (-0.5, 0, 0)]), 1.0)
    assert sorted(r["x"] for r in kept.collect()) == [-0.5, 0.4]


def test_chain_and_far_voxels(spark):
    nodes = voxels.means(points(spark, [(0.5, 0, 0), (1.5, 0, 0), (2.5, 0, 0), (3.5, 0, 0)]), 1.0)
    edges = voxels.radius_edges(nodes, 1.0, 1.5)
    assert edges.count() == 3 and graph.spanning_forest(edges).count() == 3
    far = voxels.means(points(spark, [(0.95, 0, 0), (2.05, 0, 0)]), 1.0)
    assert voxels.radius_edges(far, 1.0, 1.5).count() == 0


def test_forest_is_a_forest_and_pruning_keeps_long_branches(spark):
    e = spark.createDataFrame([(1, "a", "b", 9.0), (1, "b", "c", 9.0), (1, "c", "d", 9.0), (1, "b", "e", 1.0), (1, "a", "e", 25.0)], graph.SCHEMA)
    forest = graph.spanning_forest(e)
    assert forest.count() == 4
    pruned = {(r["src"], r["dst"]) for r in graph.prune(forest, 2.0).collect()}
    assert pruned == {("a", "b"), ("b", "c"), ("c", "d")}


def test_farthest_points_are_distinct(spark):
    got = sampling.farthest(points(spark, [(i, i * i % 7, 0) for i in range(40)]), 16).collect()
    assert len(got) == len({r["point_id"] for r in got}) == 16


def test_heights(spark):
    flat = points(spark, [(0, 0, 0), (0, 0, 1.49)])
    assert clean.tall(flat).count() == 0 and clean.short(flat).count() == 1
    assert clean.tall(points(spark, [(0, 0, 0), (0, 0, 1.5)])).count() == 2


@pytest.mark.parametrize(
    ("genus", "counts", "model_based", "birch", "species"),
    [(10, {10: 3, 8: 5}, False, True, 8), (10, {18: 9}, True, True, 8), (10, {18: 9}, False, True, 18), (16, {0: 9}, False, True, 23), (16, {0: 9}, False, False, 0), (15, {0: 9}, False, True, 24), (16, {18: 2, 19: 2}, False, True, 18)],
)
def test_resolve(spark, genus, counts, model_based, birch, species):
    clouds = spark.createDataFrame([(1, 0, 0, genus)], "cloud_id long, ix int, iy int, genus int")
    seen = spark.createDataFrame([(0, 0, s, n, i) for i, (s, n) in enumerate(counts.items())], "ix int, iy int, species int, n long, first_seen long")
    assert spatial.resolve(clouds, seen, model_based, birch).first()["species"] == species


def test_tables_and_lists():
    assert [T.genus_of(n) for n in ("Populus_nigra", "Acer_campestre", "Incorrect segmentation")] == [16, 10, 15]
    assert T.default_species("Quercus") == 2 and T.default_species("Acer") == 8
    assert search.step_list(20, 50, 10) == [20, 30, 40, 50]
    assert search.factor_list(0.01, 1e-5, 0.1) == pytest.approx([0.0001, 0.001, 0.01])
    assert set(search.value_lists({"a": 1, "comment_b": 2, "learning_rate": [0.01, 1e-5, 0.1]})) == {"a", "learning_rate"}


def test_masked_accuracy(spark):
    pred = spark.createDataFrame([(1, 1), (2, 2), (15, 3)], "label int, pred int")
    assert evaluate.accuracy(pred, 15).first()["accuracy"] == 1.0 and evaluate.accuracy(pred, 0).first()["accuracy"] == 0.0


def many(spark, clouds, n):
    """Clouds of n points on a spiral."""
    rows = [(c, i, math.cos(i) * 10, math.sin(i) * 10, i * 20 / n) for c in range(clouds) for i in range(n)]
    return spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double")


def test_crown_is_drawn_with_replacement(spark):
    got = sampling.crown_leak(many(spark, 30, 1000)).toPandas()
    sizes = got.groupby("cloud_id").size()
    assert len(sizes) == 30 and not got.duplicated(["cloud_id", "k"]).any()
    assert got.duplicated(["cloud_id", "point_id"]).any() and got["k"].max() > 33 and got["k"].max() <= 240
    assert sizes.max() <= 0.55 * 240 + 40
    assert sampling.crown_leak(many(spark, 5, 40)).count() == 0


def test_tree_copies_are_cropped_thinned_tilted_and_two(spark):
    got = sampling.tree_copy(many(spark, 150, 200)).toPandas()
    copies = got.groupby(["cloud_id", "copy"]).agg(n=("z", "size"), least=("point_id", "min"), span=("z", lambda z: z.max() - z.min()))
    seconds = (copies.index.get_level_values("copy") == 2).sum()
    assert set(got["copy"]) == {1, 2} and 8 <= seconds <= 45
    assert not got.duplicated(["cloud_id", "copy", "point_id"]).any()
    assert 0.6 < (copies["least"] >= 0.1 * 200).mean() < 0.95  # the bottom is cropped
    whole = copies[copies["least"] < 2]["n"]
    assert (whole < 200).any() and (whole == 200).any() and copies["n"].min() >= 64
    turned = got.merge(many(spark, 1, 200).toPandas().drop(columns="cloud_id"), on="point_id", suffixes=("", "0"))
    fit = turned.groupby(["cloud_id", "copy"]).apply(lambda g: np.linalg.lstsq(np.c_[g["x0"], g["y0"], g["z0"], np.ones(len(g))], g["z"], rcond=None)[0][:2], include_groups=False)
    tilted = fit.map(lambda c: np.hypot(*c) > 0.01)
    assert 0.2 < tilted.mean() < 0.5


def test_augment_grows_from_the_grown_cloud_of_safe_points(spark):
    few = many(spark, 3, 15).withColumn("cloud_id", F.col("cloud_id") + 1000)
    odd = spark.createDataFrame([(0, 5000, float("nan"), 0.0, 0.0), (1, 5001, 0.0, float("inf"), 0.0), (2, 5002, None, 0.0, 0.0)], few.schema)
    got = sampling.augment(many(spark, 20, 200).unionByName(few).unionByName(odd), 100_000).where("copy = 0").toPandas()
    assert set(got["cloud_id"]) == set(range(20)) and np.isfinite(got[["x", "y", "z"]]).all().all()
    assert not got.duplicated(["cloud_id", "point_id"]).any()
    # a copy of the tree has the fragments made before it: copied points of them need ids of both steps
    cloud = many(spark, 60, 200)
    coins = cloud.select("cloud_id").distinct().where((rng.uniform("g8", "cloud_id") < 0.5) & (rng.uniform("g10", "cloud_id") < 0.33))
    got = sampling.augment(cloud.join(coins, "cloud_id"), 100_000).where("copy = 0")
    own = F.transform(F.sequence(F.lit(1), F.lit(33)), lambda k: F.xxhash64(F.lit("g8"), k.cast("int")))
    copied = F.transform(own, lambda i: F.xxhash64(F.lit("g10"), F.lit(1), i))
    assert got.where(F.array_contains(copied, F.col("point_id"))).count() > 0


def test_skeleton_has_all_nodes(spark):
    nodes = voxels.means(points(spark, [(0.5, 0.5, 0.5), (2.5, 0.5, 0.5), (99.5, 0.5, 0.5)]), 1.0)
    edges = voxels.radius_edges(nodes, 1.0, 2.0)
    got = voxels.skeleton(edges, nodes, 0.5).collect()
    assert edges.count() == 1 and sum(r["dst"] is None for r in got) == 3
    assert sorted(r["x"] for r in got) == [0.5, 0.5, 1.0, 1.5, 2.0, 2.5, 2.5, 99.5]  # F15's seven, and the node without an edge


def test_tile_samples(spark):
    rows = [(0, 0, 0)] + [(20 + i / 10, 0, 0) for i in range(3)] + [(40 + i / 10, 0, 0) for i in range(8)] + [(60 + i / 10, 0, 0) for i in range(9)]
    got = voxels.tile_samples(points(spark, rows), 10.0, 0.0, 8).toPandas()
    of = {k: g for k, g in got[got["iy"] == 0].groupby("ix")}
    assert of[0]["noise"].all() and len(of[0]) == 1
    assert not of[2]["noise"].any() and sorted(of[2]["copy"]) == list(range(1, 9)) and set(of[2]["point_id"]) <= {1, 2, 3}
    assert not of[4]["noise"].any() and sorted(of[4]["point_id"]) == list(range(4, 12))
    assert not of[6]["noise"].any() and of[6]["point_id"].nunique() == len(of[6]) == 8 and {12, 20} <= set(of[6]["point_id"])


def test_defaults_of_labels_and_names(spark):
    from grovespark.operators import labels

    clouds = spark.createDataFrame([(1, "a", 3), (2, "b", 4)], "cloud_id long, stem string, label int")
    metadata = spark.createDataFrame([("a", 7, 1), ("a", 8, 2)], "stem string, species_number int, seq long")
    assert {r["cloud_id"]: r["species_number"] for r in labels.labelled(clouds.drop("label"), metadata).collect()} == {1: 8, 2: 15}
    names = spark.createDataFrame([(3, "oak", 2), (3, "ash", 1)], "label int, name string, seq long")
    assert {r["cloud_id"]: r["name"] for r in labels.named(clouds, names).collect()} == {1: "ash", 2: "species_4"}
    with pytest.raises(ValueError, match="species"):
        labels.required(clouds, ["stem", "species"])
    with pytest.raises(Exception, match="one number"):
        spark.createDataFrame([([1, 2],)], "a array<int>").select(labels.coerced(F.col("a"))).collect()


def test_one_cloud_of_a_label_splits_without_regard_to_labels(spark):
    from grovespark.operators import labels

    rows = [(i, 0 if i else 1) for i in range(20)]
    got = labels.split_safe(spark.createDataFrame(rows, "cloud_id long, label int"), "label").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 14, "test": 4, "val": 2}


def test_numbered_matches_a_sort(spark):
    from grovespark.operators import ranks

    rows = [(f"k{i % 3}", f"v{(i * 37) % 101:03d}", i) for i in range(900)] + [("k0", None, 900)]
    got = ranks.numbered(spark.createDataFrame(rows, "k string, v string, i long"), ["k"], ["v", "i"], "n").collect()
    for k in ("k0", "k1", "k2"):
        own = sorted((r for r in got if r["k"] == k), key=lambda r: (r["v"] is not None, r["v"] or "", r["i"]))
        assert [r["n"] for r in own] == list(range(1, len(own) + 1))


def test_a_loss_that_is_not_finite_prunes_its_trial(spark):
    rows = [(1, 0, 0.5, 1.0), (1, 1, 0.7, float("nan")), (2, 0, 0.4, 1.0), (2, 1, 0.3, 3.0)]
    history = spark.createDataFrame(rows, "trial long, step int, acc double, loss double")
    best = evaluate.best_trial(evaluate.objective(history, "trial", "acc", "loss"), "trial").collect()
    assert [(r["trial"], round(r["objective"], 9)) for r in best] == [(2, 0.44)]
    assert {r["trial"]: round(r["score"], 9) for r in evaluate.case_score(history.where("trial = 2"), "trial", "step", "acc", "loss").collect()} == {2: 0.28}


def test_files_without_a_coordinate_system_raise(spark):
    points = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "path string, x double")
    header = spark.createDataFrame([("a", "EPSG:2180")], "path string, crs string")
    assert [r["crs"] for r in spatial.with_crs(points.where("path = 'a'"), header).collect()] == ["EPSG:2180"]
    with pytest.raises(Exception, match="no coordinate system: b"):
        spatial.with_crs(points, header).collect()


def test_forest_has_an_edge_less_than_nodes_a_component_and_the_least_weight(spark):
    import random

    pick = random.Random(5)
    edges = [(1, f"n{a:02d}", f"n{b:02d}", float(pick.randint(1, 40))) for a in range(30) for b in range(a + 1, 30) if pick.random() < 0.12]
    got = graph.spanning_forest(spark.createDataFrame(edges, "cloud_id long, src string, dst string, d2 double")).collect()
    near = {}
    for _, a, b, d in edges:
        near.setdefault(a, []).append((d, b))
        near.setdefault(b, []).append((d, a))
    seen, weight, kept = set(), 0.0, 0
    for start in near:  # Prim's way, by component
        if start in seen:
            continue
        seen.add(start)
        rim = list(near[start])
        while rim := [e for e in rim if e[1] not in seen]:
            d, v = min(rim)
            seen.add(v)
            weight, kept, rim = weight + d, kept + 1, rim + near[v]
    assert (len(got), sum(r["d2"] for r in got)) == (kept, weight)
