"""Tables as files: CSV metadata, and records laid out by split and chunk."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_csv(table: DataFrame, folder: str) -> None:
    table.write.option("header", "true").csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """With a schema, so that the files needn't be read twice."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(folder)


def lines(spark: SparkSession, path: str, column: str = "species") -> DataFrame:
    """A row for each line that isn't blank."""
    return spark.read.text(path).withColumnRenamed("value", column).where(f"trim({column}) <> ''")


def write_layout(records: DataFrame, folder: str, *by: str) -> None:
    """Parquet in a folder for each value of the columns, so that readers of one split or label list only its files."""
    records.repartition(*by).write.partitionBy(*by).parquet(folder)
