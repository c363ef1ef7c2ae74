"""Streaming conformance: observed steps against an allowed-transition table.

Every micro-batch is kept as three tables in a folder of its number: its events, the
steps inside it, and the first and last event of each key. A batch that is run again
overwrites its own folder, so a restarted stream counts nothing twice. The steps inside
a batch are found in ranges of equal size (``observed_steps``), whatever share of it one
key holds; between batches only first and last events meet.

Events may come late and batches out of order: where the batches of a key overlap in
time, the steps that late events split are found again from the kept events of that
stretch. Steps are counted by event time, so the result is that of one batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.operators.lifecycle import observed_steps


def keep_batch(batch: DataFrame, number: int, folder: str) -> None:
    """The three tables of one micro-batch of key, event, ts timestamp, event_id."""
    path = lambda name: f"{folder}/{name}/batch={number}"
    batch.select("key", "event", "ts", "event_id").write.mode("overwrite").parquet(path("events"))
    events = batch.sparkSession.read.parquet(path("events"))
    at = F.struct("ts", "event_id")
    events.groupBy("key").agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"),
        F.min_by("event", at).alias("first"), F.max_by("event", at).alias("last")).write.mode("overwrite").parquet(path("ends"))
    observed_steps(events).groupBy("key", "previous", "event").agg(F.count("*").alias("n_steps")).write.mode(
        "overwrite").parquet(path("steps"))


def run(events: DataFrame, folder: str) -> None:
    """Process what is there into ``folder``, then stop."""
    keep_batch(events.sparkSession.createDataFrame([], events.schema), -1, folder)
    events.writeStream.foreachBatch(lambda batch, number: keep_batch(batch, number, folder)).option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stretches(ends: DataFrame) -> DataFrame:
    """Batches of a key with the stretch they belong to: batches that overlap in time share one."""
    in_order = Window.partitionBy("key").orderBy("first_at", "batch")
    reached = F.max("last_at").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reached.isNull() | (F.col("first_at") > reached)).cast("long")
    return ends.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(in_order)).drop("opens")


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """previous, event, n_steps over all batches kept so far."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    batches = stretches(read("ends"))
    spans = batches.groupBy("key", "stretch").agg(
        F.count("*").alias("n_batches"), F.min_by("first", "first_at").alias("event"),
        F.max_by("last", "last_at").alias("last"))
    torn = batches.join(spans.where("n_batches > 1").select("key", "stretch"), ["key", "stretch"]).select("key", "batch", "stretch")
    inside = read("steps").join(torn, ["key", "batch"], "left_anti").select("previous", "event", "n_steps")
    again = read("events").join(torn, ["key", "batch"]).withColumn("key", F.struct("key", "stretch"))
    mended = observed_steps(again).select("previous", "event", F.lit(1).cast("long").alias("n_steps"))
    between = spans.withColumn("previous", F.lag("last").over(Window.partitionBy("key").orderBy("stretch"))).where(
        "previous IS NOT NULL").select("previous", "event", F.lit(1).cast("long").alias("n_steps"))
    return inside.unionByName(mended).unionByName(between).groupBy("previous", "event").agg(F.sum("n_steps").alias("n_steps"))


def result(spark: SparkSession, folder: str, allowed: DataFrame) -> DataFrame:
    ok = allowed.select(F.col("source").alias("previous"), F.col("target").alias("event"), F.lit(True).alias("ok"))
    return steps(spark, folder).join(ok, ["previous", "event"], "left").select(
        "previous", "event", "n_steps", F.coalesce("ok", F.lit(False)).alias("is_allowed"))
