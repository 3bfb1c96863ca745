"""Hyper-parameter lists and grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def factor_list(start: float, stop: float, factor: float) -> list[float]:
    """start, start * factor, ... while above stop, ascending; rounding decides the last one."""
    out, value = [], start
    while value > stop:
        out.append(value)
        value *= factor
    return sorted(out)


def step_list(start: float, stop: float, step: float) -> list[float]:
    """start to stop by step; with floats the last may lie one step beyond."""
    if all(isinstance(v, int) for v in (start, stop, step)):
        return list(range(start, stop + step, step))
    return [start + i * step for i in range(math.ceil((stop + step - start) / step))]


def value_lists(config: dict) -> dict[str, list]:
    """Lists are ranges, geometric ones for learning rate and weight decay; scalars stay; keys with `comment` are left out."""
    out = {}
    for key, value in config.items():
        if "comment" not in key.lower():
            geometric = any(n in key for n in ("learning_rate", "weight_decay"))
            out[key] = (factor_list if geometric else step_list)(*value) if isinstance(value, list) else [value]
    return out


def grid(spark: SparkSession, config: dict, models: list[str]) -> DataFrame:
    """A row for each combination, as one explode a parameter."""
    rows = spark.createDataFrame([(m,) for m in models], "model string")
    for key, values in value_lists(config).items():
        rows = rows.withColumn(key, F.explode(F.array(*map(F.lit, values))))
    return rows


def within_budget(models: DataFrame, most_gb: float = 20.0) -> DataFrame:
    """Models (name, param_bytes, output_bytes) that fit into memory."""
    return models.where((F.col("param_bytes") + F.col("output_bytes")) / 2**30 <= most_gb)
