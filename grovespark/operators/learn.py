"""A trained classifier of clouds by their views: features by partial aggregates, logistic regression of MLlib, evaluation on held-out clouds."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import argmax
from .sampling import class_weights
from .views import VIEWS

#: What is known of a view: the share of its pixels that are filled, their mean value, and where they lie on average, and how spread out, by row and column.
MOMENTS = ("filled", "value", "row", "col", "rows", "cols")


def view_features(pixels: DataFrame, size: int) -> DataFrame:
    """(cloud_id, features): the moments of each view of a cloud with pixels (cloud_id, view, row, col, value); a view without any has zeros. A row a cloud and view is all that is gathered."""
    share = lambda c: F.col(c) / size
    spread = lambda c: F.coalesce(F.stddev_pop(share(c)), F.lit(0.0))
    by_view = pixels.groupBy("cloud_id", "view").agg((F.count("*") / (size * size)).alias("filled"), F.avg("value").alias("value"), F.avg(share("row")).alias("row"), F.avg(share("col")).alias("col"), spread("row").alias("rows"), spread("col").alias("cols"))
    of = lambda v, m: F.coalesce(F.max(F.when(F.col("view") == v, F.col(m))), F.lit(0.0))
    return by_view.groupBy("cloud_id").agg(F.array(*(of(v, m) for v in VIEWS for m in MOMENTS)).alias("features"))


def fit(rows: DataFrame, iterations: int = 100, regularisation: float = 1e-3) -> LogisticRegressionModel:
    """Of rows (id, features, label) without null labels, each weighted by its class's weight."""
    known = rows.where("label is not null and features is not null")
    weighted = known.join(F.broadcast(class_weights(known).select("label", "weight")), "label")  # a row a class
    ready = weighted.select(array_to_vector("features").alias("_features"), F.col("label").cast("double").alias("_label"), "weight")
    return LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="weight", maxIter=iterations, regParam=regularisation, family="multinomial").fit(ready)


def score(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """rows with logits and pred; the largest, and of equal ones the first class."""
    columns = rows.columns
    ready = rows.withColumn("_vector", array_to_vector("features"))
    done = model.setFeaturesCol("_vector").setRawPredictionCol("_raw").setProbabilityCol("_probability").setPredictionCol("_prediction").transform(ready)
    return done.select(*columns, vector_to_array("_raw").alias("logits")).withColumn("pred", argmax())
