"""Structured Streaming over event tables: windows, sessions, the change queue and receipts.

A stream here is read with ``availableNow`` from a folder and written to a folder: the same
plan follows a live source with another trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a table is one file or a folder of files
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/{name}.parquet*")


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream until it has read all there is, and read back what it wrote."""
    spark = stream.sparkSession
    base = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drained_batches(stream: DataFrame, label: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame], base: str | None = None) -> DataFrame | None:
    """Fold micro-batches into a state table: each batch reads the last version and writes the next.

    Versions are numbered by the batch that wrote them and found on disk, so a query that starts
    anew from the checkpoint in ``base`` goes on with the last whole version; a batch that is run
    again reads the version before it and overwrites its own. Only finished versions count.
    """
    spark = stream.sparkSession
    base = base or f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def apply(batch: DataFrame, epoch: int) -> None:
        state = _version(spark, base, below=epoch)
        fold(state, batch).write.mode("overwrite").parquet(f"{base}/version={epoch}")

    query = stream.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(apply).trigger(availableNow=True).start()
    query.awaitTermination()
    return _version(spark, base)


def _version(spark: SparkSession, base: str, below: int | None = None) -> DataFrame | None:
    """The last finished version of a fold's state, or the last before ``below``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    numbers = [int(f.getPath().getParent().getName().split("=")[1]) for f in found or []]
    fit = [n for n in numbers if below is None or n < below]
    return spark.read.parquet(f"{base}/version={max(fit)}") if fit else None


def fold_queue(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The change queue after a batch of (key, received, priority): a revision more for each event,
    the highest priority, and the time of the first event."""
    new = batch.groupBy("key").agg(F.count("*").alias("revision"), F.max("priority").alias("priority"), F.min("received").alias("received"))
    both = new if state is None else state.unionByName(new)
    return both.groupBy("key").agg(F.sum("revision").alias("revision"), F.max("priority").alias("priority"), F.min("received").alias("received"))


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    counted = events.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    counted = events.withWatermark("at", late).groupBy(F.window("at", width, step), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    found = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)
