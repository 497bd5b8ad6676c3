"""Starting streams: triggers, state store, and runs that end when the input is used up."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dimension, run_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MIN_CADENCE = 60


def cadence(seconds: int = 300) -> dict[str, str]:
    """Trigger argument of a refresh cadence; faster than once a minute is refused."""
    if seconds < MIN_CADENCE:
        raise ValueError(f"the refresh cadence must be at least {MIN_CADENCE} seconds")
    return {"processingTime": f"{seconds} seconds"}


@contextmanager
def stateful(spark: SparkSession, partitions: int | None = None, idle_batches: bool = True) -> Iterator[None]:
    """RocksDB state and a state width, which a query keeps for its whole life.

    All are read when a query starts, so they are set around the start and put back. A query on the
    processing clock always has a next batch without data, so one that is to end goes without them.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism),
              "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def folder(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Replay:
    """A bounded table as a stream that arrives in time-ordered slices, one per run of a query.

    The slices are written once, side by side; ``feed`` moves the next one into the folder the
    stream reads, so that no run can see files of two slices.
    """

    def __init__(self, df: DataFrame, label: str, slices: int = 3, order: str = "idx"):
        self.spark, self.slices = df.sparkSession, slices
        self.base = folder(self.spark, label)
        # One row per universe, broadcast: a shuffle by universe would put all rows of one into one task.
        top = dimension(df.groupBy("universe").agg(F.max(order).alias("_top"), F.min(order).alias("_low")), f"{label}-ends")
        share = (F.col(order) - F.col("_low")) * slices / (F.col("_top") - F.col("_low") + 1)
        (df.join(top, "universe").withColumn("_slice", F.floor(share)).drop("_top", "_low")
         .write.partitionBy("_slice").parquet(f"{self.base}/staged"))
        jvm = self.spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.base}/live"))
        self.stream = self.spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(
            f"{self.base}/live")

    def feed(self, i: int) -> None:
        staged = self._path(f"{self.base}/staged/_slice={i}")
        if self._files.exists(staged) and not self._files.rename(staged, self._path(f"{self.base}/live/slice-{i}")):
            raise OSError(f"slice {i} of {self.base} could not be moved")


def drain(stream: DataFrame, label: str, feeds: Sequence[Replay] = (), partitions: int | None = None,
          each_batch: Callable[[DataFrame, int], None] | None = None, clock: str = "event") -> tuple[DataFrame, list[dict]]:
    """Process all available input into Parquet and return the table with the batch reports.

    With ``feeds`` the query runs once per slice and goes on from its checkpoint each time. ``clock`` is
    the one that stateful operators of the query run on, "event" or "processing".
    """
    spark = stream.sparkSession
    base = folder(spark, label)
    writer = (stream.writeStream.outputMode("append").trigger(availableNow=True)
              .option("checkpointLocation", f"{base}/checkpoint"))
    reports = []
    with stateful(spark, partitions, idle_batches=clock == "event"):
        for i in range(max((f.slices for f in feeds), default=1)):
            for replay in feeds:
                replay.feed(i)
            if each_batch is None:
                query = writer.format("parquet").option("path", f"{base}/data").start()
            else:
                query = writer.foreachBatch(each_batch).start()
            query.awaitTermination()
            reports += list(query.recentProgress)
    if each_batch is not None:
        return stream, reports
    return spark.read.schema(stream.schema).parquet(f"{base}/data"), reports
