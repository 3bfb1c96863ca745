"""Labels and splits of cloud records: parsing, merging, encoding, stratified splits, rebalancing, metadata tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from .ranks import by_draw, numbered

SPLITS = ("train", "test", "val")


def mapped(column: str, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for p in pairs.items() for v in p)), F.col(column))


def parsed(clouds: DataFrame) -> DataFrame:
    """Adds stem and label: what stands before and after the last underscore of the file's name; an unparsable label is null."""
    stem = F.regexp_extract("path", r"([^/]*)\.npy$", 1)
    return clouds.withColumn("stem", F.regexp_extract(stem, r"^(.*)_[^_]*$", 1)).withColumn("label", F.expr(r"try_cast(nullif(regexp_extract(path, '_([0-9]+)\\.npy$', 1), '') as int)"))


def swapped(clouds: DataFrame, a: int, b: int) -> DataFrame:
    """Exchanges two labels in the path, and leaves the others."""
    label = F.regexp_extract("path", r"_([0-9]+)\.npy$", 1)
    new = F.when(label == str(a), str(b)).when(label == str(b), str(a))
    return clouds.withColumn("path", F.when(new.isNotNull(), F.concat(F.regexp_replace("path", r"[0-9]+\.npy$", ""), new, F.lit(".npy"))).otherwise(F.col("path")))


def merged(clouds: DataFrame, merge: dict[str, str], allowed: list[str]) -> DataFrame:
    """Species become their genus, and those not allowed `others`."""
    name = F.coalesce(mapped("species", merge), F.col("species"))
    return clouds.withColumn("species", F.when(name.isin(allowed), name).otherwise("others"))


def encoded(clouds: DataFrame, column: str = "species", last: str = "others") -> DataFrame:
    """Adds species_number: the rank of the name among those but `last`, which is numbered after all. Few names, so the ranks are a small table."""
    names = clouds.select(column).distinct()
    ranks = names.select(column, (F.row_number().over(Window.orderBy(F.col(column) == last, column)) - 1).alias("species_number"))
    return clouds.join(ranks, column)


def counts(clouds: DataFrame) -> DataFrame:
    return clouds.groupBy("species", "species_number").agg(F.count("*").alias("count"))


def labelled(clouds: DataFrame, metadata: DataFrame, missing: int = 15) -> DataFrame:
    """Clouds with the number of the last metadata row (by its order `seq`) of their stem, or the number for unlabelled ones."""
    last = metadata.groupBy("stem").agg(F.max_by("species_number", "seq").alias("species_number"))
    return clouds.join(last, "stem", "left").withColumn("species_number", F.coalesce("species_number", F.lit(missing)))


def named(clouds: DataFrame, names: DataFrame) -> DataFrame:
    """Clouds with the first name (by `seq`) of their label, or `species_<label>`."""
    first = names.groupBy("label").agg(F.min_by("name", "seq").alias("name"))
    return clouds.join(first, "label", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("species_"), F.col("label"))))


def split(clouds: DataFrame, label: str, seed: str = "split", train: float = 0.7, test: float = 2 / 3) -> DataFrame:
    """Adds split: within each label, by a seeded hash, the first round(n * train) train, then that share of the rest test, the rest val."""
    draw = rng.uniform(seed, "cloud_id")
    placed = numbered(clouds, [label], [draw, F.col("cloud_id")], "_p", by_draw(draw))
    n = clouds.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    first = F.floor(F.col("_n") * train + 0.5)
    n = n.withColumn("_a", first).withColumn("_b", first + F.floor((F.col("_n") - first) * test + 0.5))
    out = placed.join(n, F.col(label).eqNullSafe(F.col("_label")))
    return out.withColumn("split", F.when(F.col("_p") <= F.col("_a"), "train").when(F.col("_p") <= F.col("_b"), "test").otherwise("val")).select(*clouds.columns, "split")


def split_safe(clouds: DataFrame, label: str, seed: str = "split") -> DataFrame:
    """split(), or the same without regard to labels if some label has one cloud only."""
    guard = can_stratify(clouds, label).select("stratify")  # one row
    family = clouds.crossJoin(F.broadcast(guard)).withColumn("_family", F.when(F.col("stratify"), F.col(label).cast("string")).otherwise("all"))
    return split(family.drop("stratify"), "_family", seed).drop("_family")


def can_stratify(clouds: DataFrame, label: str) -> DataFrame:
    """One row: whether every label has two clouds at least."""
    return clouds.groupBy(label).agg(F.count("*").alias("n")).agg((F.min("n") >= 2).alias("stratify"), F.min("n").alias("least"))


def rebalanced(clouds: DataFrame, desired: tuple[float, float, float] = (0.7, 0.2, 0.1), tolerance: float = 0.03, seed: str = "move") -> DataFrame:
    """Moves clouds from splits with too many to those with too few, in the order train, test, val, if a share is off by more than the tolerance.

    Targets are rounded half to even. Of a split with too many, the first by a seeded hash go.
    """
    want = F.create_map(*(F.lit(v) for s, d in zip(SPLITS, desired) for v in (s, d)))
    place = F.create_map(*(F.lit(v) for i, s in enumerate(SPLITS) for v in (s, i)))
    n = clouds.groupBy("split").agg(F.count("*").alias("n"))
    plan = clouds.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string").join(n, "split", "left").na.fill(0)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    plan = plan.withColumn("total", total).withColumn("off", F.max(F.abs(F.col("n") / total - want[F.col("split")])).over(Window.partitionBy(F.lit(0))))
    plan = plan.withColumn("excess", F.when(F.col("off") > tolerance, F.col("n") - F.bround(want[F.col("split")] * F.col("total")).cast("long")).otherwise(F.lit(0)))
    order = Window.partitionBy(F.lit(0)).orderBy(place[F.col("split")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    give, take = F.greatest("excess", F.lit(0)), F.greatest(-F.col("excess"), F.lit(0))
    plan = plan.withColumn("give", give).withColumn("give_to", F.sum(give).over(order)).withColumn("take", take).withColumn("take_to", F.sum(take).over(order))
    givers = plan.where("give > 0").select("split", "give", (F.col("give_to") - F.col("give")).alias("base"))
    takers = plan.where("take > 0").select(F.struct((F.col("take_to") - F.col("take")).alias("lo"), F.col("take_to").alias("hi"), F.col("split").alias("to")).alias("t")).agg(F.collect_list("t").alias("takers"))
    draw = rng.uniform(seed, "cloud_id")
    moved = numbered(clouds, ["split"], [draw, F.col("cloud_id")], "rank", by_draw(draw)).join(givers, "split", "left").withColumn("at", F.when(F.col("rank") <= F.col("give"), F.col("base") + F.col("rank"))).crossJoin(F.broadcast(takers))  # one row
    to = F.get(F.filter("takers", lambda t: (F.col("at") > t.lo) & (F.col("at") <= t.hi)), F.lit(0))
    return moved.withColumn("new_split", F.coalesce(to["to"], F.col("split"))).select(*clouds.columns, "new_split")


def metadata_files(clouds: DataFrame) -> DataFrame:
    """(file_num, file_name, label, species, folder_name), numbered by path from 0 within the whole set."""
    placed = numbered(clouds, [], ["path", "cloud_id"], "_place")
    return placed.select((F.col("_place") - 1).cast("int").alias("file_num"), F.col("path").alias("file_name"), "label", "species", F.col("split").alias("folder_name"))


def metadata_counts(clouds: DataFrame) -> DataFrame:
    """(label, species, count_train, count_test, count_val): a missing split counts 0."""
    return clouds.groupBy("label", "species").agg(*(F.count(F.when(F.col("split") == s, 1)).alias(f"count_{s}") for s in SPLITS))


def of_label(clouds: DataFrame, label: int) -> DataFrame:
    """The clouds whose file's name ends with the label."""
    return clouds.where(F.endswith(F.col("path"), F.lit(f"_{label}.npy")))


def required(table: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself, if it has the columns; else an error that names those missing."""
    if missing := sorted(set(columns) - set(table.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return table


def coerced(label: Column) -> Column:
    """The one number of a list; an error for lists of any other length."""
    return F.when(F.size(label) == 1, F.element_at(label, 1)).otherwise(F.raise_error(F.lit("a label is one number")).cast("int"))
