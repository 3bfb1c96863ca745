"""The training sample: clouds by label, cleaned, augmented while training, and projected."""

from pyspark.sql import DataFrame

from . import clean, sampling, views


def dataset(points: DataFrame, size: int, ignore: int, training: bool = False, n: int = 1024) -> DataFrame:
    """(cloud_id, label, view, row, col, value) of clouds whose label is below `ignore`; points: (cloud_id, point_id, x, y, z, label).

    Only finite points of clouds that have enough of them count. In training, each cloud goes through all augmentations first, and has n points.
    """
    known = points.where(points["label"] < ignore)
    cloud = known.select("cloud_id", "label").distinct()
    p = clean.safe(known.select("cloud_id", "point_id", "x", "y", "z"))
    p = sampling.augment(p, n) if training else p
    return views.project(p, size).join(cloud, "cloud_id").select("cloud_id", "label", "view", "row", "col", "value")
