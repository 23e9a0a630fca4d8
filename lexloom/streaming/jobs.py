"""Structured Streaming: screening of arriving files with durable progress, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.screen import screened
from lexloom.storage import fresh_path

_STORE = "spark.sql.streaming.stateStore.providerClass"


def screen_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, answer: Callable[[Column], Column]) -> None:
    """Screens all files that arrived under ``source`` and adds a folder ``batch=n`` for each batch to ``target``, each candidate once.

    A second run goes on after the files of the first. The state of the stream knows the candidates of earlier batches,
    so the target is never read; a batch that is repeated after a failure replaces its own folder.
    """
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source).dropDuplicates(["candidate_id"])
        write = lambda batch, n: screened(batch, answer).write.mode("overwrite").parquet(f"{target}/batch={n}")
        rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def screened_by_stream(spark: SparkSession, source: str, answer: Callable[[Column], Column]) -> DataFrame:
    """The result of :func:`screen_stream` into a fresh place in the shared folder."""
    at = fresh_path(spark, "stream")
    rows = spark.read.parquet(source)
    pattern = f"{source[:-1]}[{source[-1]}]"  # a pattern may also name a single file, which a plain path to watch may not
    screen_stream(spark, pattern, rows.schema, f"{at}/out", f"{at}/checkpoint", answer)
    out = screened(rows, answer).schema
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    if not found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found):
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(f"{at}/out").select(*out.names)


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows of a stream or table of events; later events than ``late`` are dropped by a stream."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    by = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")
