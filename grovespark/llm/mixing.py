"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

A budget of tokens goes down the tree. Among siblings it is dealt by weight; what one can't take (it has fewer tokens
times epochs) its siblings take, by weight again; only what a whole subtree lacks has already gone to its own siblings above,
as a node's capacity is the sum of its leaves'. With capacities sorted by weight this has a closed form. Siblings are summed by
ranges of their capacity for their weight, and only the range that the level ends in is sorted. Each leaf then takes whole seeded epochs, and of the next
epoch the documents that begin within the rest of its budget, in the order of a seeded hash: a leaf's cut is one row, so that
texts are filtered where they are, and never moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

LEVELS = ("domain", "language", "origin")
#: Weights of the query by level; what isn't listed has weight 1.
WEIGHTS: dict[str, dict[str, float]] = {"domain": {"0": 4.0, "1": 3.0, "2": 2.0, "3": 1.0}, "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, "origin": {}}
#: The budget as a share of all tokens, epochs at most, seed.
SHARE, EPOCHS, SEED = 0.5, 2, 17


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The number at the end of a source (its last nine digits), modulo 4, names its domain; a source without one is of domain `none`."""
    digits = F.regexp_extract(F.right(source, F.lit(9)), r"([0-9]{1,9})$", 1)
    return F.coalesce(F.when(digits != "", (digits.cast("int") % 4).cast("string")), F.lit("none"))


def path_of(prefix: str = "") -> Column:
    """A struct of domain, language and origin; null languages and sources are named `none`."""
    source, lang = F.col(f"{prefix}source").cast("string"), F.col(f"{prefix}lang").cast("string")
    return F.struct(domain_of(source).alias("domain"), F.coalesce(lang, F.lit("none")).alias("language"), F.coalesce(source, F.lit("none")).alias("origin"))


def weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    listed = [F.lit(x) for pair in weights.get(level, {}).items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*listed), F.col(level)), F.lit(1.0)) if listed else F.lit(1.0)


def fill(nodes: DataFrame, level: str, parents: list[str], weights: dict[str, dict[str, float]]) -> DataFrame:
    """Adds got: each node's part of its parent's `budget`. Nodes have `capacity`.

    rate: what a unit of weight gets if all nodes before, in the order of capacity for weight, are full. The first range of ratios that is not filled whole
    is the one that the level ends in; a parent has some thousand ranges at most.
    """
    keys = parents or ["root"]
    rated = nodes.withColumn("w", weight(level, weights)).withColumn("root", F.lit(0)).withColumn("ratio", F.col("capacity") / F.col("w"))
    rated = rated.withColumn("range", F.when(F.col("ratio") > 0, F.floor(F.log2("ratio") * 16).cast("int")).otherwise(-(1 << 30)))
    rated = C.materialise(rated, "nodes")  # read three times
    sums = rated.groupBy(*keys, "range").agg(F.sum("capacity").alias("c"), F.sum("w").alias("v"), F.max("ratio").alias("top"), F.first("budget").alias("budget"))
    order = Window.partitionBy(*keys).orderBy("range")
    before = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.sum("v").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    filled = F.col("budget") - F.col("before") - F.col("c") >= F.col("top") * F.col("after")
    edge = sums.withColumn("before", before).withColumn("after", after).where(~filled).groupBy(*keys).agg(F.min(F.struct("range", "before", "after")).alias("e"))
    edge = edge.select(*keys, F.col("e.range").alias("edge"), F.col("e.before").alias("before"), F.col("e.after").alias("after"))
    both = rated.join(edge, keys, "left")
    inside = both.where("range = edge")
    within = Window.partitionBy(*keys).orderBy("ratio", level)
    upto = F.coalesce(F.sum("capacity").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavier = F.sum("w").over(within.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rate = (F.col("budget") - F.col("before") - upto) / (heavier + F.col("after"))
    # where rounding makes the level seem to pass the last node, it is that node's
    level_of = inside.withColumn("rate", rate).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("ratio") > F.col("rate"), F.col("rate"))), F.max("ratio")).alias("open_rate"))
    got = F.coalesce(F.least(F.col("capacity").cast("double"), F.col("open_rate") * F.col("w")), F.col("capacity").cast("double"))
    out = C.materialise(rated.join(level_of, keys, "left").withColumn("got", got), "levels")  # so that the plans of the levels below don't hold this one
    C.remove(rated)
    return out


def budgets(sizes: DataFrame, weights: dict[str, dict[str, float]], share: float, epochs: int) -> DataFrame:
    """(domain, language, origin, have, budget) of each leaf; sizes has (domain, language, origin, have). A budget is in whole tokens."""
    leaf = sizes.groupBy(*LEVELS).agg(F.sum("have").alias("have")).withColumn("capacity", F.col("have") * epochs)
    plan = leaf.agg(F.least(F.floor(F.sum("have") * share), F.sum("capacity")).cast("double").alias("budget"))
    above: list[str] = []
    for level in LEVELS:
        keys = [*above, level]
        nodes = leaf.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        joined = nodes.join(plan, above) if above else nodes.crossJoin(F.broadcast(plan))  # the plan is one row at first
        plan = fill(joined, level, above, weights).select(*keys, F.col("got").alias("budget"))
        above = keys
    return leaf.join(plan, list(LEVELS)).select(*LEVELS, "have", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (k, path, whole, rest) with last: the (key, n_tokens, th) up to which a leaf's partial epoch goes. rows: (k, id, n_tokens, th).

    A leaf is never sorted whole: twice the next three hex digits of the key part it into 4096 ranges; their sums tell the range that the budget
    ends in, and only what is in that is ordered.
    """
    part = rows.join(plan.where("rest > 0").select("k", "whole", "rest"), "k")
    part = part.select("k", "rest", "n_tokens", "th", key(F.col("whole"), F.col("id")).alias("key")).withColumn("base", F.lit(0).cast("long"))
    for depth in (1, 4):
        sums = part.groupBy("k", "rest", "base", F.substring("key", depth, 3).alias("range")).agg(F.sum("n_tokens").alias("n"))
        begin = F.col("base") + F.sum("n").over(Window.partitionBy("k").orderBy("range")) - F.col("n")
        edge = sums.withColumn("begin", begin).where("begin < rest").groupBy("k").agg(F.max(F.struct("range", "begin")).alias("e"))
        edge = C.materialise(edge.select("k", "e.range", F.col("e.begin").alias("begin")), "edges")  # a row a leaf
        part = part.withColumn("range", F.substring("key", depth, 3)).join(edge, ["k", "range"]).withColumn("base", F.col("begin")).drop("range", "begin")
    order = Window.partitionBy("k").orderBy("key", "n_tokens", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = part.withColumn("at", F.col("base") + F.sum("n_tokens").over(order) - F.col("n_tokens")).where("at < rest")
    last = taken.groupBy("k").agg(F.max(F.struct("key", "n_tokens", "th")).alias("last"))
    return plan.join(last, "k", "left")


def key(epoch: Column, doc_id: Column) -> Column:
    """The place of a document in a leaf's epoch: a seeded hash, as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(SEED), epoch, F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def select(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(doc, path, epoch, n_tokens): a row for each document and epoch that is taken; doc: the row of docs as a struct.

    Empty texts have no tokens and are taken where they fall within a budget. Null languages and sources are leaves of their own.
    A null doc_id hashes as `null`. Of rows that repeat an id, those with fewer tokens come first; rows that repeat in full are taken together as far as one begins within the budget.
    An empty table gives an empty one. Columns of docs may have any names.
    """
    weights = WEIGHTS if weights is None else weights
    th = F.xxhash64(F.col("text").cast("string"))
    narrow = docs.select(path_of().alias("path"), F.col("doc_id").alias("id"), tokens(F.col("text").cast("string")).alias("n_tokens"), th.alias("th"))
    narrow = C.materialise(narrow.select(F.xxhash64("path").alias("k"), "path.*", "id", "n_tokens", "th"), "tokens")
    sizes = narrow.groupBy("k", *LEVELS).agg(F.sum("n_tokens").alias("have"))
    plan = C.materialise(budgets(sizes, weights, share, epochs), "budgets")  # a row a leaf
    plan = plan.where("budget > 0").select(F.xxhash64(F.struct(*LEVELS)).alias("k"), F.struct(*LEVELS).alias("path"), F.expr("cast(budget div have as int)").alias("whole"), F.expr("budget % have").alias("rest"))
    done = C.materialise(cuts(narrow.select("k", "id", "n_tokens", "th"), plan).select(F.struct("path", "whole", "rest", "last").alias("leaf")), "cuts")
    C.remove(narrow)
    # a row a leaf of known size: Spark broadcasts it if it is small
    both = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).withColumn("path", path_of("doc.")).join(done, F.col("path") == F.col("leaf.path"))
    both = both.select("doc", "path", "leaf", F.explode(F.expr("sequence(0, if(leaf.rest > 0, leaf.whole, leaf.whole - 1))")).alias("epoch")).withColumn("key", key(F.col("epoch"), F.col("doc.doc_id")))
    text = F.col("doc.text").cast("string")
    tie = (F.col("key") == F.col("leaf.last.key")) & (F.struct(tokens(text).alias("n_tokens"), F.xxhash64(text).alias("th")) <= F.struct(F.col("leaf.last.n_tokens").alias("n_tokens"), F.col("leaf.last.th").alias("th")))
    taken = both.where((F.col("epoch") < F.col("leaf.whole")) | (F.col("key") < F.col("leaf.last.key")) | tie)
    return taken.select("doc", "path", "epoch", tokens(F.col("doc.text").cast("string")).alias("n_tokens"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and epochs taken of all documents; null, empty, tied and repeated rows and an empty table as in select()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return select(docs).select("doc.doc_id", "epoch", "path.domain", "path.language", "path.origin", "n_tokens")


def _level(name: str, parents: str, weights: str) -> str:
    over = f"PARTITION BY {parents} " if parents else ""
    on = f"USING ({parents})" if parents else "ON true"
    keys = f"{parents}, {name}" if parents else name
    last = parents.split(", ")[-1] if parents else "root"
    return f"""
{name}_nodes AS (SELECT {keys}, capacity, budget, {weights} AS w FROM (SELECT {keys}, sum(capacity) AS capacity FROM leaf GROUP BY ALL) n JOIN {last}_plan {on}),
{name}_rates AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({over}ORDER BY capacity / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER ({over}ORDER BY capacity / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM {name}_nodes),
{name}_open AS (SELECT *, max(CASE WHEN capacity / w > rate THEN rate END) OVER ({over}) AS open_rate FROM {name}_rates),
{name}_plan AS (SELECT {keys}, coalesce(least(capacity, open_rate * w), capacity) AS budget FROM {name}_open),"""


_CASES = {k: "CASE " + k + "".join(f" WHEN '{n}' THEN {w}::DOUBLE" for n, w in v.items()) + " ELSE 1::DOUBLE END" if v else "1::DOUBLE" for k, v in WEIGHTS.items()}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_source_mixing": op7_source_mixing}
SQL: dict[str, str] = {
    "op7_source_mixing": rf"""
WITH d AS (
  SELECT doc_id, coalesce((try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % 4)::VARCHAR, 'none') AS domain,
         coalesce(lang, 'none') AS language, coalesce(source, 'none') AS origin,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
leaf AS (SELECT domain, language, origin, sum(n_tokens)::DOUBLE AS have, sum(n_tokens)::DOUBLE * {EPOCHS} AS capacity FROM d GROUP BY ALL),
root_plan AS (SELECT least(floor(sum(have) * {SHARE}), sum(capacity)) AS budget FROM leaf),
{_level("domain", "", _CASES["domain"])}{_level("language", "domain", _CASES["language"])}{_level("origin", "domain, language", _CASES["origin"])}
plan AS (SELECT domain, language, origin, have::BIGINT AS have, floor(budget + 1e-6)::BIGINT AS budget FROM leaf JOIN origin_plan USING (domain, language, origin)),
e AS (
  SELECT d.*, have, budget, epoch, md5('{SEED}|' || epoch || '|' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM d JOIN plan USING (domain, language, origin), range({EPOCHS} + 1) r(epoch) WHERE budget > 0 AND epoch <= budget // have),
s AS (SELECT *, epoch * have + sum(n_tokens) OVER (PARTITION BY domain, language, origin, epoch ORDER BY k, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS begin_at FROM e)
SELECT doc_id, epoch::INT AS epoch, domain, language, origin, n_tokens FROM s WHERE begin_at < budget AND (epoch < budget // have OR budget % have > 0)""",
}
