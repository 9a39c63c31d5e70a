"""Live results: a landing folder polled by Structured Streaming, upserted by key, and windows over event time."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.state import upsert_min
from ..session import files, shared_dir


def landing(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", most: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", most).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    return files(spark, path, lambda fs, at: fs.exists(at))


def _names(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of a folder's parts that are called by the prefix and a number."""
    found = files(spark, path, lambda fs, at: [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else [])
    return sorted(int(n.removeprefix(prefix)) for n in found if n.startswith(prefix))


def _states(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[int]]:
    """Each bucket's whole versions in order: those that were written to their end, of batches ``before`` one."""
    out: dict[int, list[int]] = {}
    for v in _names(spark, target, "v="):
        if (before is None or v < before) and _exists(spark, f"{target}/v={v}/_SUCCESS"):
            for bucket in _names(spark, f"{target}/v={v}", "bucket="):
                out.setdefault(bucket, []).append(v)
    return out


def _read(spark: SparkSession, target: str, at: dict[int, int], schema: StructType) -> DataFrame:
    paths = [f"{target}/v={v}/bucket={b}" for b, v in sorted(at.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_stream(
    stream: DataFrame, target: str, key: Sequence[str], time: str, order: str, checkpoint: str, interval: str | None = None, buckets: int = 64
) -> StreamingQuery:
    """Keep the least time for each key in versions of a Parquet table under ``target``.

    Keys are dealt to ``buckets`` by hash. A batch reads and writes the buckets of its
    own keys only, each whole, as its version; a bucket's newest version is its state. A
    replayed batch starts from the versions before it and overwrites its own, so it is
    idempotent. Of a bucket's older versions the one before is kept, which a replay
    starts from. A target that has versions is refused with a checkpoint that has none
    of its progress, as its batches would count from 0 again; ``buckets`` must stay the
    same. Without an interval what has arrived is processed and the query ends.
    """
    if _exists(stream.sparkSession, target) and not _exists(stream.sparkSession, f"{checkpoint}/offsets"):
        raise ValueError(f"{target} has versions, but {checkpoint} is not their checkpoint")
    schema = stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # as many as buckets at most
        states = _states(spark, target, number)
        old = _read(spark, target, {b: states[b][-1] for b in touched if b in states}, schema)
        merged = upsert_min(old, batch, key, time, order).select("*", bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number}")
        old_versions = {v for b in touched for v in states.get(b, [])[:-1]}
        for b in touched:
            for v in states.get(b, [])[:-1]:
                files(spark, f"{target}/v={v}/bucket={b}", lambda fs, at: fs.delete(at, True))
        # A version without buckets goes, so there are never more versions than twice the buckets.
        for v in old_versions:
            if not _names(spark, f"{target}/v={v}", "bucket="):
                files(spark, f"{target}/v={v}", lambda fs, at: fs.delete(at, True))

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def newest_version(spark: SparkSession, target: str, schema: StructType | None = None) -> DataFrame:
    """The newest state of each bucket that ``upsert_stream`` wrote. Give the schema if there may be no bucket yet."""
    at = {b: v[-1] for b, v in _states(spark, target).items()}
    if schema is None:
        if not at:
            raise ValueError(f"{target} has no version yet; give its schema")
        b, v = next(iter(at.items()))
        schema = spark.read.parquet(f"{target}/v={v}/bucket={b}").schema
    return _read(spark, target, at, schema)


def tumbling_counts(stream: DataFrame, time: str, width: str, late: str, by: Sequence[str], value: str) -> DataFrame:
    """Counts and sums by window; with a watermark, rows that come too late are dropped."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
        .select(F.col("w.start").alias("start"), *by, "n", "total")
    )


def session_counts(stream: DataFrame, time: str, gap: str, late: str, by: Sequence[str], value: str) -> DataFrame:
    """Counts and sums of runs of rows without a longer gap between them; a run comes out once the watermark has passed its end."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")
    )


def started_and_finished(starts: DataFrame, results: DataFrame, key: Sequence[str], time: str, within: str, late: str) -> DataFrame:
    """Every start with its results of the next ``within``, and starts without any once none can come.

    ``time`` is a column of both; the results' comes out as ``finished``, null for a
    start that is still pending when the watermark has passed its time and ``within``.
    Rows that no later row can match leave the state.
    """
    left = starts.withWatermark(time, late)
    names = {c: f"_{c}" for c in key}
    right = results.withColumnsRenamed({**names, time: "finished"}).withWatermark("finished", late)
    on = [F.col(c) == F.col(names[c]) for c in key]
    on += [F.col("finished") >= F.col(time), F.col("finished") <= F.col(time) + F.expr(f"INTERVAL {within}")]
    return left.join(right, on, "left_outer").drop(*names.values())


def run_to_table(df: DataFrame, mode: str = "append", checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Run a streaming query over what has arrived, to its end, and read what it wrote.

    What is appended goes through the file sink, each row once; a complete result is
    written anew by each batch. Nothing passes through the driver. Give ``checkpoint``
    and ``target`` to go on with an earlier run; else both are new folders in the
    shared one.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    checkpoint, target = checkpoint or f"{root}/progress", target or f"{root}/table"
    files(spark, root, lambda fs, at: fs.deleteOnExit(at))
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(target)
    else:
        query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(target)
