"""Session factory and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under.

    On a cluster the settings come from ``spark-submit``; nothing in the library
    depends on this function.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("splitboard")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; only a local session without the setting gets one of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="splitboard-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def files(spark: SparkSession, path: str, do):
    """What ``do`` returns for the path's file system and path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return do(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/splitboard-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files(spark, path, lambda fs, at: fs.deleteOnExit(at))
    return spark.read.schema(df.schema).parquet(path)
