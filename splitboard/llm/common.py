"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a per-group table may be broadcast; beyond it a salted join is used.
BROADCAST_ROWS = 50_000
#: Rows of an Arrow batch that goes to Python.
BATCH_ROWS = 500
#: Bytes of an Arrow batch that goes to Python: a batch ends with the row that reaches them.
BATCH_BYTES = 16 << 20
#: Bytes of labelled text that a class is learned from: a class ends with the text that reaches them.
SAMPLE_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="splitboard-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Tables written once to the shared folder and read back.

    The lineage ends at the written files, so a lost executor costs only the stage
    that was running, and later passes read narrow columns instead of texts. What was
    not written by ``keep`` is deleted when the block ends; the rest, which results are
    read from, when the application does.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.passing = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.passing:
            discard(self.spark, path)

    def keep(self, df: DataFrame) -> DataFrame:
        return cut(df)

    def __call__(self, df: DataFrame) -> DataFrame:
        return cut(df, self.passing)

    def told(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
        """The table, and figures of it that the same pass gathers."""
        seen = Observation()
        return self(df.observe(seen, *(c.alias(name) for name, c in figures.items()))), seen.get


def _folder(spark: SparkSession, path: str, do) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    do(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def discard(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Delete a folder, now or when the application ends."""
    _folder(spark, path, lambda fs, p: fs.deleteOnExit(p) if at_exit else fs.delete(p, True))


def cut(df: DataFrame, passing: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, see ``Scratch``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/splitboard-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if passing is None:
        discard(spark, path, at_exit=True)
    else:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """How many ``[^\\x20\\x09-\\x0D]+`` the text has; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fitted(
    docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_class: int, fit: Callable[[list[tuple[str, int]]], Any], id_col: str = "doc_id", text: str = "text"
) -> Any:
    """``fit`` of at most ``per_class`` (text, label) rows of each class 0 and 1, run in one task.

    The identifiers are chosen first, by hash, from the narrow label table. Of those,
    in the order of the hash, as many are taken as have ``SAMPLE_BYTES`` of text in
    their class, by the lengths alone; whole texts are then read for these, so what the
    task gets is bounded, and reruns fit the same model. A label is the largest its
    document has, and of several texts under one identifier the least counts (the
    longest for its length); null labels and null identifiers are left out. Only the
    model comes to the driver. ``fit`` is a function of this package.
    """
    own = labels.where(learnable & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    own = own.groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    chosen = None
    for value in (0, 1):
        part = own.where(F.col("label") == value).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    chosen = chosen.select(F.col(id_col).alias("id"), "label")
    # At most 2 * per_class narrow rows, so both broadcasts have a fixed bound.
    bodies = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    lengths = bodies.select("id", F.octet_length("body").cast("long").alias("n")).join(F.broadcast(chosen), "id")
    lengths = lengths.groupBy("id", "label").agg(F.max("n").alias("n"))
    before = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    taken = lengths.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < SAMPLE_BYTES).select("id", "label")
    rows = bodies.join(F.broadcast(taken), "id").groupBy("id", "label").agg(F.min("body").alias("body")).repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = [(body, int(value)) for batch in batches for body, value in zip(batch["body"], batch["label"])]
        yield pd.DataFrame({"model": [pickle.dumps(fit(sample))]})

    ship(docs.sparkSession)
    found = rows.select("body", "label").mapInPandas(learn, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([])


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each Spark application.

    Texts are long, so Arrow batches of the session are held to ``BATCH_ROWS`` rows
    (unless it asks for fewer) and to ``BATCH_BYTES`` bytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_splitboard_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="splitboard-code-")) / "splitboard.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in package.rglob("*.py"):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._splitboard_sent = True
