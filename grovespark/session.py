"""The session that queries expect: adaptive execution, ANSI arithmetic, UTC."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; local runs without one use a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder, and goes on from there."""
    sc = df.sparkSession.sparkContext
    base = shared_dir(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table: in loops, where a checkpoint keeps what is known of its rows, and planning would take longer round by round."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, "table"))
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        if df is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(conf).delete(path, True)
