"""Tables in the shared folder that readers see whole: versions behind a pointer, and logs with a part per micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _path(spark: SparkSession, where: str) -> tuple[JavaObject, JavaObject]:
    """A folder's path and file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, where: str) -> bool:
    path, files = _path(spark, where)
    return files.exists(path)


class Published:
    """A table that is replaced as a whole: each version is a folder of its own, and one small file names the current one.

    The pointer is renamed over the old one in one step, so a reader gets the old table or the
    new one, and a writer that fails leaves the old one.  A reader that has resolved a version
    may go on reading it: versions stay until prune() drops all but the last few.
    """

    def __init__(self, spark: SparkSession, where: str, schema: str | StructType) -> None:
        self.spark, self.where, self.schema = spark, where, schema

    def version(self) -> str | None:
        """The current version, or None before the first."""
        path, files = _path(self.spark, f"{self.where}/CURRENT")
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self) -> DataFrame:
        now = self.version()
        if now is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.where}/{now}")

    def write(self, rows: DataFrame) -> str:
        """A new version with rows, not yet to be seen."""
        name = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.where}/{name}")
        return name

    def point(self, name: str) -> None:
        """From now on readers see the version."""
        jvm = self.spark._jvm
        path, files = _path(self.spark, f"{self.where}/.CURRENT-{name}")
        out = files.create(path, True)
        out.write(bytearray(name.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(path, jvm.org.apache.hadoop.fs.Path(f"{self.where}/CURRENT"), how)

    def replace(self, rows: DataFrame) -> None:
        self.point(self.write(rows))

    def prune(self, keep: int = 2) -> None:
        """Drops all versions but the current one and the keep - 1 written last before it."""
        now = self.version()
        path, files = _path(self.spark, self.where)
        old = [s for s in files.listStatus(path) if s.getPath().getName().startswith("v-") and s.getPath().getName() != now]
        for status in sorted(old, key=lambda s: -s.getModificationTime())[max(keep - 1, 0) :]:
            files.delete(status.getPath(), True)


class BatchLog:
    """A log with one folder per micro-batch, so that a batch that runs again replaces what it wrote and nothing else."""

    def __init__(self, spark: SparkSession, where: str, schema: str) -> None:
        self.spark, self.where, self.schema = spark, where, schema

    def _folder(self, batch: int) -> str:
        return f"{self.where}/batch={batch}"

    def has(self, batch: int) -> bool:
        """Whether the batch was written to the end."""
        return _exists(self.spark, f"{self._folder(batch)}/_SUCCESS")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self._folder(batch))

    def of(self, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._folder(batch))

    def read(self) -> DataFrame:
        """All rows, with batch."""
        if not _exists(self.spark, self.where):
            return self.spark.createDataFrame([], f"{self.schema}, batch bigint")
        return self.spark.read.schema(f"{self.schema}, batch bigint").parquet(self.where)

    def before(self, batch: int) -> DataFrame:
        """The rows of earlier batches; those of the batch itself and of later ones don't count, should it run again."""
        return self.read().where(F.col("batch") < batch).drop("batch")


class Outbox:
    """Sends each key once: what a batch sends is planned, sent, then marked; a batch that runs again goes on where it stopped.

    send gets the planned rows and the batch's id and must be idempotent by that id or by the
    key (a file named by it, an upsert, a message id).  The plan is stored before anything is
    sent, so a repeated batch sends the same rows whatever its input looks like by then; after
    the mark nothing is sent at all.
    """

    def __init__(self, spark: SparkSession, where: str, schema: str, key: str, send: Callable[[DataFrame, int], None]) -> None:
        self.key, self.send = key, send
        self.planned, self.marked = BatchLog(spark, f"{where}/planned", schema), BatchLog(spark, f"{where}/marked", schema)

    def run(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: batch has one row per key at most, and the log's columns."""
        if self.marked.has(number):
            return
        if not self.planned.has(number):
            self.planned.write(batch.join(self.marked.before(number).select(self.key), self.key, "left_anti"), number)
        plan = self.planned.of(number)
        self.send(plan, number)
        self.marked.write(plan, number)
