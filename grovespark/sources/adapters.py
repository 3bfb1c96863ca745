"""Tables of the test data as point clouds, cloud records, class scores and forest stands."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cloud_id, x, y, z): the large cloud table."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cloud_id"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("z"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cloud_id, point_id, x, y, z): clouds whose points have ids."""
    hours = (F.day("ts") * 24 + F.hour("ts")).cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cloud_id"), F.col("event_id").alias("point_id"), F.col("value").alias("x"), hours.alias("y"), F.get_json_object("props", "$.k").cast("double").alias("z"))


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cloud_id, species, path): a record for each cloud; the label is the last part of the file's stem."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cloud_id"), F.col("p_type").alias("species"), F.concat("p_name", F.lit("_"), "p_size", F.lit(".npy")).alias("path"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, logits, label): ten class scores, each the largest of every tenth part of the vector."""
    logits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.array_max(F.filter("embedding", lambda v, i: i % 10 == k)).cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), logits.alias("logits"), "label")


def stands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stand_id, x, y, code): forest stands with a species code."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stand_id"), (F.col("c_custkey") % 100).cast("double").alias("x"), F.col("c_acctbal").alias("y"), F.col("c_mktsegment").alias("code"))


#: The same in SQL.
LINE_POINTS = "SELECT l_suppkey AS cloud_id, l_extendedprice / 1000 AS x, l_quantity AS y, l_discount * 100 AS z FROM lineitem"
EVENT_POINTS = "SELECT user_id AS cloud_id, event_id AS point_id, value AS x, (day(ts) * 24 + hour(ts))::DOUBLE AS y, json_extract_string(props, '$.k')::DOUBLE AS z FROM events"
CLOUDS = "SELECT p_partkey AS cloud_id, p_type AS species, p_name || '_' || p_size || '.npy' AS path FROM part"
SCORES = "SELECT vec_id AS id, list_transform(range(10), lambda k: list_max(list_filter(embedding, lambda v, i: (i - 1) % 10 = k))::DOUBLE) AS logits, label FROM embeddings"
STANDS = "SELECT c_custkey AS stand_id, (c_custkey % 100)::DOUBLE AS x, c_acctbal AS y, c_mktsegment AS code FROM customer"
