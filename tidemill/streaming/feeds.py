"""Feeds of several micro-batches, and the ways to run a stream over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.published import BatchLog, Outbox
from ..operators.storage import shared_dir


def staged(rows: DataFrame, at: str, bounds: list[str]) -> DataFrame:
    """rows as a stream of micro-batches: those before the first bound of at, those up to the next, and so on.

    Each part is written to a folder of its own in the shared directory, one after the other;
    the stream takes them in that order.
    """
    spark = rows.sparkSession
    where = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    edges = [None, *bounds, None]
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        part = rows if low is None else rows.where(F.col(at) >= F.lit(low).cast("timestamp"))
        part = part if high is None else part.where(F.col(at) < F.lit(high).cast("timestamp"))
        part.coalesce(1).write.parquet(f"{where}/part={k}")  # one file is one micro-batch
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/part=*")


def each_batch(stream: DataFrame, where: str, use: Callable[[DataFrame, int], None]) -> None:
    """Runs use over the micro-batches at hand; a batch that failed runs again with its number when it is called again."""
    writer = stream.writeStream.option("checkpointLocation", f"{where}/progress").trigger(availableNow=True)
    writer.foreachBatch(use).start().awaitTermination()


def notify(stream: DataFrame, where: str, key: str, at: str, schema: str, send: Callable[[DataFrame, int], None]) -> Outbox:
    """Sends the first row of each key that was not sent before."""
    outbox = Outbox(stream.sparkSession, f"{where}/outbox", schema, key, send)
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batch: DataFrame, number: int) -> None:
        rest = [c for c in columns if c != key]
        first = batch.groupBy(key).agg(F.min(F.struct(at, *[c for c in rest if c != at])).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])
        outbox.run(first.select(*columns), number)

    each_batch(stream, where, run)
    return outbox


#: A log of messages, and what they did.
INBOX = "message bigint, at timestamp, kind string, key bigint, confidence double, state string"


def merge_inbox(stream: DataFrame, where: str, least: float, kinds: list[str]) -> BatchLog:
    """Merges messages (message, at, kind, key, confidence) into a log, once each: the first to come counts.

    Within a micro-batch the earliest comes first, ties by kind and key.  A message that was
    stored by an earlier batch changes nothing, however late or often it comes; a batch that
    runs again replaces its own part.  state is applied if the message is sure of an effect
    and of its key, else to_confirm.
    """
    log = BatchLog(stream.sparkSession, f"{where}/inbox", INBOX)
    sure = F.coalesce((F.col("confidence") >= least) & F.col("kind").isin(kinds) & F.col("key").isNotNull(), F.lit(False))

    def run(batch: DataFrame, number: int) -> None:
        first = batch.where("message IS NOT NULL").groupBy("message").agg(F.min(F.struct("at", "kind", "key", "confidence")).alias("m")).select("message", "m.*")
        new = first.join(log.before(number).select("message"), "message", "left_anti")
        log.write(new.withColumn("state", F.when(sure, "applied").otherwise("to_confirm")).select(*[x.split()[0] for x in INBOX.split(", ")]), number)

    each_batch(stream, where, run)
    return log


def statuses(log: DataFrame, status_of: dict[str, str]) -> DataFrame:
    """key, status, message of the applications: what the last applied message of each said."""
    said = F.create_map(*[F.lit(x) for pair in status_of.items() for x in pair])
    last = log.where("state = 'applied'").groupBy("key").agg(F.max(F.struct("at", "message", "kind")).alias("m"))
    return last.select("key", said[F.col("m.kind")].alias("status"), F.col("m.message").alias("message"))
