"""Row numbers within a key, or over a whole table, without one task for the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import free_names

#: Ranges that a key's rows are parted into; a window is over those of a key, or over the rows of one range.
RANGES = 512


def bounds(rows: DataFrame, column: str, n: int = RANGES) -> list:
    """At most n - 1 values of a column in order: those of its distinct values that have the least hashes, so that ranges hold about as many of them."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return sorted(r[0] for r in values.orderBy(F.xxhash64(column), column).limit(n - 1).collect())


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str, part: Column | None = None) -> DataFrame:
    """Adds name: the place of each row within its keys, from 1. Rows are ordered by `order`; nulls come first.

    part: a range number that rises with the order, as of a draw; else ranges are bounded by values of the first column. Ranges are counted; only rows of one are sorted.
    """
    if part is None:
        limits = bounds(rows, order[0])
        part = F.when(F.col(order[0]).isNotNull(), F.size(F.filter(F.array(*map(F.lit, limits)), lambda b: b <= F.col(order[0]))) + 1).otherwise(0) if limits else F.lit(0)
    own, count, of, start = free_names(rows, "part", "n", "of", "before")
    named = free_names(rows, *(f"key{i}" for i in range(len(keys))))
    marked = rows.withColumn(own, part)
    sums = marked.groupBy(*keys, own).agg(F.count("*").alias(count))
    before = F.sum(count).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(own)) - F.col(count)
    sums = sums.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.col(own).alias(of), before.alias(start))
    same = F.col(own) == F.col(of)
    for k, n in zip(keys, named):
        same &= F.col(k).eqNullSafe(F.col(n))
    within = Window.partitionBy(*keys, own).orderBy(*order)
    return marked.join(sums, same).withColumn(name, (F.col(start) + F.row_number().over(within)).cast("long")).select(*rows.columns, name)


def by_draw(draw: Column) -> Column:
    """The range of a uniform draw."""
    return F.floor(draw * RANGES).cast("int")
