"""Predictions and their evaluation; experiment histories."""

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .names import free_names
from .ranks import bounds, numbered
from .views import VIEWS


def argmax(values: str = "logits") -> Column:
    """The place of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: str = "logits") -> Column:
    powers = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def predicted(scores: DataFrame) -> DataFrame:
    return scores.withColumn("pred", argmax())


def classified(clouds: DataFrame, pixels: DataFrame, size: int, scorer: Callable[[np.ndarray], np.ndarray], empty: int = 15, batch: int = 16) -> DataFrame:
    """(cloud_id, logits, pred): each cloud's five views go to `scorer`, which makes class scores of an array (clouds, 5, size, size) of `batch` clouds at most.

    A cloud without pixels has null logits and the class for bad segmentation. Sparse pixels are gathered by cloud: 5 x size x size at most; a task holds a batch of dense ones.
    """
    view = F.array_position(F.array(*map(F.lit, VIEWS)), F.col("view")) - 1
    place = ((view * size + F.col("row")) * size + F.col("col")).cast("int")
    gathered = pixels.groupBy("cloud_id").agg(F.collect_list(F.struct(place.alias("place"), F.col("value").cast("double").alias("value"))).alias("p"))
    sparse = gathered.select("cloud_id", F.col("p.place").alias("place"), F.col("p.value").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                some = b.slice(lo, batch)
                images = np.zeros((some.num_rows, len(VIEWS) * size * size))
                for k, (at, values) in enumerate(zip(some["place"], some["value"])):
                    images[k, at.values.to_numpy()] = values.values.to_numpy()
                scores = np.asarray(scorer(images.reshape(-1, len(VIEWS), size, size)), float)
                yield pa.record_batch([some["cloud_id"], pa.array(scores.tolist(), pa.list_(pa.float64()))], ["cloud_id", "logits"])

    scored = sparse.mapInArrow(run, "cloud_id long, logits array<double>")
    every = clouds.select("cloud_id").distinct().join(scored, "cloud_id", "left")
    return every.withColumn("pred", F.coalesce(argmax(), F.lit(empty)))


def view_means(images: np.ndarray) -> np.ndarray:
    """A scorer without weights: the mean of each view, so that the fullest view is the class."""
    return images.mean(axis=(2, 3)).round(6)


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "pred").agg(F.count("*").alias("n"))


def accuracy(pred: DataFrame, ignore: int | None = None) -> DataFrame:
    """One row: the share of right predictions among labels below `ignore`; 0 where there are none."""
    rows = pred if ignore is None else pred.where(F.col("label") < ignore)
    return rows.agg(F.coalesce(F.avg((F.col("pred") == F.col("label")).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def masked_mean(rows: DataFrame, value: str, weight: str, label: str, ignore: int) -> DataFrame:
    """One row: the weighted mean of a batch's values, labels from `ignore` on left out; 0 where none is left."""
    kept = F.col(label) < ignore
    return rows.agg(F.coalesce(F.sum(F.when(kept, F.col(value) * F.col(weight))) / F.sum(F.when(kept, F.col(weight))), F.lit(0.0)).alias("mean"))


def curve(scores: DataFrame, classes: int) -> DataFrame:
    """(class, threshold, tp, fp, positives, negatives): one-vs-rest counts at or above each distinct score.

    Scores are first summed by distinct (class, threshold), so a window is over those and not over rows.
    """
    rows = scores.select(F.posexplode(F.slice("logits", 1, classes)).alias("class", "threshold"), "label")
    hit = (F.col("label") == F.col("class")).cast("long")
    each = rows.groupBy("class", F.round("threshold", 3).alias("threshold")).agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("q"))
    down = Window.partitionBy("class").orderBy(F.desc("threshold"))
    whole = Window.partitionBy("class")
    return each.select("class", "threshold", F.sum("p").over(down).alias("tp"), F.sum("q").over(down).alias("fp"), F.sum("p").over(whole).alias("positives"), F.sum("q").over(whole).alias("negatives"))


def roc(scores: DataFrame, classes: int) -> DataFrame:
    return curve(scores, classes).select("class", "threshold", F.try_divide("tp", "positives").alias("tpr"), F.try_divide("fp", "negatives").alias("fpr"))


def prc(scores: DataFrame, classes: int) -> DataFrame:
    return curve(scores, classes).select("class", "threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "positives").alias("recall"))


def histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, n): the largest softmax score of each row in equal bins from 0 to 1."""
    top = F.array_max(softmax())
    return scores.select(F.least(F.lit(bins - 1), F.floor(F.round(top, 9) * bins)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def report(pred: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) of each class that is a label or a prediction."""
    c = confusion(pred)
    by_label = c.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    by_pred = c.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("said"))
    both = by_label.join(by_pred, "class", "full").na.fill(0)
    p, r = F.coalesce(F.try_divide("right", "said"), F.lit(0.0)), F.coalesce(F.try_divide("right", "support"), F.lit(0.0))
    return both.select("class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def running_best(history: DataFrame, by: str, order: str, score: str) -> DataFrame:
    """Adds best (before the row, 0 at first) and is_best: strictly better."""
    before = F.coalesce(F.max(score).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return history.withColumn("best", before).withColumn("is_best", F.col(score) > before)


def objective(history: DataFrame, by: str, accuracy_: str, loss: str) -> DataFrame:
    """(trial, objective): 0.6 of the best accuracy and 0.4 / (1 + least loss). A trial with a loss that isn't finite is pruned."""
    odd = F.isnan(loss) | (F.abs(F.col(loss)) == float("inf")) | F.col(loss).isNull()
    rows = history.groupBy(by).agg((0.6 * F.max(accuracy_) + 0.4 / (1 + F.min(loss))).alias("objective"), F.max(odd).alias("_odd"))
    return rows.where("not _odd").drop("_odd")


def best_trial(objectives: DataFrame, by: str) -> DataFrame:
    """One row: the trial of the largest objective, the first of equal ones; none where there are no trials."""
    return objectives.agg(F.max(F.struct("objective", (-F.col(by)).alias("_k"))).alias("b")).where("b is not null").select((-F.col("b._k")).alias(by), "b.objective")


def case_score(history: DataFrame, by: str, step: str, accuracy_: str, loss: str) -> DataFrame:
    """(trial, score): 0.6 of the accuracy and 0.4 / (1 + loss) of the last step."""
    last = history.groupBy(by).agg(F.max_by(F.struct(F.col(accuracy_).alias("a"), F.col(loss).alias("l")), step).alias("e"))
    return last.select(by, (0.6 * F.col("e.a") + 0.4 / (1 + F.col("e.l"))).alias("score"))


def interpolated(low: float, high: float) -> float:
    return 0.5 * low + 0.5 * high


class RunningMedian:
    """The median of all values so far: those that are known to lie below and above are counts, the rest are two heaps."""

    def __init__(self, below: int, values: list[float], total: int):
        """values: those between, in any order; total: of all, with those below and above."""
        half = min(max(0, (total + 1) // 2 - below), len(values))
        values = sorted(values)
        self.low, self.high = [-v for v in reversed(values[:half])], values[half:]
        heapq.heapify(self.low)
        self.below, self.total = below, total

    def median(self) -> float | None:
        if not self.total:
            return None
        return -self.low[0] if self.total % 2 else interpolated(-self.low[0], self.high[0])

    def add(self, value: float) -> None:
        self.total += 1
        heapq.heappush(self.high, -heapq.heappushpop(self.low, -value))
        if self.below + len(self.low) < (self.total + 1) // 2:
            heapq.heappush(self.low, -heapq.heappop(self.high))


#: Rows of a key that one task takes in order at least; of more than BLOCKS times that, a BLOCKS-th.
BLOCK_ROWS, BLOCKS = 4096, 512


def earlier_medians(rows: DataFrame, key: str, order: str, value: str, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds name: the median of the values of the rows before each one, by the order within its key; null where there are none. Null values count as none.

    A key's rows are cut into blocks by their order, which are done apart. A block adds so few values that its medians lie within that many places of the
    middle of what is before it, so that it needs only those values. They are found by counts of earlier blocks' rows in ranges of values: each block reads the
    rows of the few ranges that hold its middle places. All together read each row a few times.
    """
    at, number, n, span, block, of, place = free_names(rows, "at", "number", "n", "span", "block", "of", "place")
    w = F.col(value).cast("double")
    sizes = rows.where(w.isNotNull()).groupBy(key).agg(F.greatest(F.lit(block_rows), F.ceil(F.count("*") / BLOCKS)).cast("long").alias(n))
    placed = numbered(rows, [key], [order], number).withColumn(at, w)
    sized = placed.join(sizes.withColumnRenamed(key, span), F.col(key).eqNullSafe(F.col(span)), "left").drop(span)
    filled = sized.withColumn(n, F.coalesce(n, F.lit(block_rows))).withColumn(block, F.floor((F.col(number) - 1) / F.col(n)).cast("long"))
    limits = bounds(filled, at)
    part = F.size(F.filter(F.array(*map(F.lit, limits)), lambda b: b <= F.col(at))) if limits else F.lit(0)
    whole = written(filled.withColumn(span, F.when(F.col(at).isNotNull(), part)))
    slim = whole.where(F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(block).alias("b"), F.col(span).alias("r"), F.col(at).alias("v"))
    counts = slim.groupBy("k", "b", "r").agg(F.count("*").alias("c"))
    every = whole.select(F.col(key).alias("k"), F.col(block).alias("b"), F.col(n).alias("size")).distinct()
    # of the rows before each block, by range: those of the range, and of the ranges below
    mine = every.alias("e").join(counts.alias("c"), F.expr("e.k <=> c.k and c.b < e.b")).groupBy("e.k", "e.b", "e.size", "c.r").agg(F.sum("c").alias("c"))
    by_value = Window.partitionBy("k", "b").orderBy("r")
    mine = mine.withColumns({"below": F.sum("c").over(by_value) - F.col("c"), "total": F.sum("c").over(Window.partitionBy("k", "b"))})
    near = mine.where((F.col("below") <= F.col("total") / 2 + F.col("size") + 1) & (F.col("below") + F.col("c") >= F.col("total") / 2 - F.col("size") - 1))
    needed = near.select("k", "b", "r", "below", "total")
    seeds = needed.alias("n").join(slim.alias("s"), F.expr("n.k <=> s.k and n.r = s.r and s.b < n.b")).select("n.k", "n.b", "n.below", "n.total", "s.v", F.lit(None).cast("long").alias("i"))
    own = whole.select(F.col(key).alias("k"), F.col(block).alias("b"), F.lit(None).cast("long").alias("below"), F.lit(None).cast("long").alias("total"), F.col(at).alias("v"), F.col(number).alias("i"))
    kind = rows.schema[key].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        before, now = g[g["i"].isna()], g[g["i"].notna()].sort_values("i")
        state = RunningMedian(int(before["below"].min()), before["v"].tolist(), int(before["total"].iloc[0])) if len(before) else RunningMedian(0, [], 0)
        medians = []
        for v in now["v"]:
            medians.append(state.median())
            if not pd.isna(v):
                state.add(v)
        return pd.DataFrame({"k": now["k"], "i": now["i"].astype("int64"), "m": pd.array(medians, dtype="Float64")})

    medians = seeds.unionByName(own).groupBy("k", "b").applyInPandas(run, f"k {kind}, i long, m double").select(F.col("k").alias(of), F.col("i").alias(place), F.col("m").alias(name))
    out = whole.join(medians, F.col(key).eqNullSafe(F.col(of)) & (F.col(number) == F.col(place)))
    return out.select(*rows.columns, name, (F.col(number) - 1).alias(f"{name}_rows"))


def pruned(history: DataFrame, by: str, step: str, value: str, startup: int, warmup: int, interval: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(trial, step): where a trial is below the median of the earlier trials at that step, after the first trials and steps; from then on every `interval` steps are looked at."""
    looked = history.where((F.col(step) >= warmup) & ((F.col(step) - warmup) % interval == 0))
    (median,) = free_names(history, "median")
    rated = earlier_medians(looked, step, by, value, median, block_rows)
    return rated.where((F.col(f"{median}_rows") >= startup) & (F.col(value) < F.col(median))).select(by, step)
