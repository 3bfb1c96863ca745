"""Random draws as column expressions: hashes of a seed and keys, so that results don't depend on partitions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *keys: str | Column) -> Column:
    """A uniform draw of [0, 1) for each combination of keys."""
    text = F.concat_ws("|", F.lit(seed), *keys)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def between(seed: str, low: float, high: float, *keys: str | Column) -> Column:
    return F.lit(low) + F.lit(high - low) * uniform(seed, *keys)


def normal(seed: str, *keys: str | Column) -> Column:
    """A standard normal draw, from two uniform ones."""
    return F.sqrt(-2 * F.ln(1 - uniform(seed + "a", *keys))) * F.cos(2 * math.pi * uniform(seed + "b", *keys))
