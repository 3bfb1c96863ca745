"""Learning from views: held-out accuracy, and features of a cloud known by hand."""

import numpy as np
import pytest

from grovespark.operators import evaluate, learn
from grovespark.plans.catalogue import QUERIES


def test_held_out_accuracy_is_above_the_largest_class(spark):
    rows = QUERIES["learned_views"](spark, "/root/testdata/sf0.01").cache()
    held = rows.where("held_out")
    right = evaluate.accuracy(held, ignore=2).first()
    largest = max(r["count"] for r in held.groupBy("label").count().collect()) / held.count()
    assert right["n"] == held.count() > 20 and right["accuracy"] > largest + 0.2
    assert rows.select("cloud_id").distinct().count() == rows.count() == 200


def test_features_of_a_view(spark):
    pixels = spark.createDataFrame([(1, "top", 0, 0, 1.0), (1, "top", 2, 4, 0.5), (2, "left", 3, 1, 0.25)], "cloud_id long, view string, row int, col int, value double")
    got = {r["cloud_id"]: r["features"] for r in learn.view_features(pixels, 4).collect()}
    assert got[1][:6] == pytest.approx([2 / 16, 0.75, 0.25, 0.5, 0.25, 0.5]) and not any(got[1][6:])
    assert got[2][18:24] == pytest.approx([1 / 16, 0.25, 0.75, 0.25, 0, 0]) and not any(got[2][:18])


def test_null_labels_are_not_learned_from(spark):
    rows = [(i, [float(i % 2), 1.0], i % 2 if i < 30 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    out = learn.score(learn.fit(df), df)
    assert out.columns == ["id", "features", "label", "logits", "pred"] and all(r["pred"] == r["id"] % 2 for r in out.collect())


def test_scorer_gets_batches_of_clouds(spark):
    rows = [(c, v, c % 4, 1, 0.5 + c) for c in range(20) for v in ("top", "right")]
    pixels = spark.createDataFrame(rows, "cloud_id long, view string, row int, col int, value double").repartition(1, "cloud_id")
    clouds = spark.createDataFrame([(c,) for c in range(21)], "cloud_id long")

    def scorer(images):
        assert images.shape[1:] == (5, 4, 4) and len(images) <= 8
        return np.stack([np.full(len(images), float(len(images))), images[:, 0].sum(axis=(1, 2)), images[:, 4].reshape(len(images), -1).argmax(axis=1)], axis=1)

    got = {r["cloud_id"]: r for r in evaluate.classified(clouds, pixels, 4, scorer, batch=8).collect()}
    assert got[20]["logits"] is None and got[20]["pred"] == 15
    assert all(got[c]["logits"][1:] == [0.5 + c, c % 4 * 4 + 1] for c in range(20)) and max(r["logits"][0] for c, r in got.items() if c < 20) == 8
