"""Columns of any name stay apart from those of the work."""

from pyspark.sql import functions as F

from grovespark.operators import clean, sampling


def test_clashing_columns(spark):
    rows = [(c, i, float(i % 7), float(i % 5), float(i), 1, 2, 3, 4.0, 5, 6, {"a": i}) for c in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double, n int, _part int, _n int, min_x double, ux int, _left int, m map<string,int>")
    kept = sampling.keep(df, F.lit(0.7), "k")
    plain = sampling.keep(df.select("cloud_id", "point_id", "x", "y", "z"), F.lit(0.7), "k")
    assert kept.columns == df.columns and 200 < kept.count() == plain.count() < 400
    assert {tuple(r)[5:11] for r in kept.collect()} == {(1, 2, 3, 4.0, 5, 6)}
    for work in (clean.center, clean.unit, sampling.scale_about_mean, sampling.crown_leak):
        assert sorted(map(tuple, work(df).collect())) == sorted(map(tuple, work(df.select("cloud_id", "point_id", "x", "y", "z")).collect()))
