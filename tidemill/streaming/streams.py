"""Structured Streaming forms of the stateful rules, run over what is available."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for the input at hand, by way of Parquet in the shared folder.

    In append mode the sink is the Parquet sink; in complete mode each batch overwrites one
    folder, which a repeated batch leaves as it is.
    """
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{where}/out").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{where}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def first_by_key(stream: DataFrame, key: str, at: str, number: str) -> DataFrame:
    """key and the number of its first row (by at, then number): a running minimum per key."""
    return stream.groupBy(key).agg(F.min(F.struct(at, number)).alias("m")).select(key, F.col(f"m.{number}").alias(number))


def distinct_by_keys(stream: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """One row of each combination of keys within the horizon; older state is dropped."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def hourly(stream: DataFrame) -> DataFrame:
    """Counts and sums per hour and type; an hour is given once the watermark has passed it."""
    hours = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type")
    return hours.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))
