"""One forecast per window id: the first attempt stands, failed or not, and is never tried again.

Two stages keep the rule for as long as the service lives:

* a keyed claim state refuses repeats at once; claims leave it after ``ttl`` of processing time, so its
  size follows the recent ids;
* every batch is held against the stored claims of its days (``ClaimBook``), which never expire and
  outlive the checkpoint: repeats after the state's expiry, or after a restart from nothing, find the
  kept outcome there.

A batch writes its attempts to a folder of its (run, number), so a repeated batch replaces its own rows
and is not held against them. An attempt more than ``max_age`` after its window's last bar is stale and
claims nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import materialize

TTL_MS = 24 * 3600 * 1000
MAX_AGE_S = 180
ATTEMPT = "universe string, window_id string, as_of timestamp, requested_at timestamp, attempt bigint, status string"
DECIDED = ATTEMPT + ", outcome string, reason string, accepted boolean"


class ClaimProcessor(StatefulProcessor):
    """First attempt of one (universe, window id); the others get its outcome."""

    def __init__(self, ttl_ms: int, max_age_s: int):
        self.ttl_ms, self.max_age_s = ttl_ms, max_age_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claim = handle.getValueState("claim", "outcome string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        new = pd.concat(list(rows), ignore_index=True).sort_values(
            ["requested_at", "attempt", "status"], ignore_index=True, kind="stable")
        fresh = (new["requested_at"] - new["as_of"]).dt.total_seconds() <= self.max_age_s  # unknown times are stale
        known = self.claim.get()[0] if self.claim.exists() else None
        first = None
        if known is None and fresh.any():
            first = int(fresh.to_numpy().argmax())
            known = new["status"].iloc[first]
            self.claim.update((known,))
        decided = new[[c.split()[0] for c in ATTEMPT.split(", ")]].copy()
        decided["accepted"] = [i == first for i in range(len(new))]
        decided["reason"] = [None if i == first else "repeat" if ok else "stale" for i, ok in enumerate(fresh)]
        decided["outcome"] = [known if ok else None for ok in fresh]
        yield decided[[c.split()[0] for c in DECIDED.split(", ")]]

    def close(self) -> None:
        pass


def decided_attempts(attempts: DataFrame, ttl_ms: int = TTL_MS, max_age_s: int = MAX_AGE_S) -> DataFrame:
    """Every attempt with ``accepted``, the ``reason`` if it is not, and the ``outcome`` that stands.

    ``attempts`` has the columns of ATTEMPT. Attempts that arrive together go by request time, then number.
    """
    return attempts.groupBy("universe", "window_id").transformWithStateInPandas(
        ClaimProcessor(ttl_ms, max_age_s), DECIDED, "append", "ProcessingTime")


class ClaimBook:
    """The stored attempts below ``path``; ``run`` names the checkpoint whose batch numbers are used."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.path, self.run = path.rstrip("/"), run
        made = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        made.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(made)

    def attempts(self, spark: SparkSession) -> DataFrame:
        """All decided attempts; run, batch, accepted and day are folders, so claims of a few days are read alone."""
        inside = DECIDED.replace(", accepted boolean", "")
        return spark.read.schema(f"{inside}, run string, batch bigint, accepted boolean, day date").parquet(self.path)

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Hold one batch of decided attempts against the book and enter it (for ``foreachBatch``)."""
        spark = batch.sparkSession
        new = materialize(batch.withColumn("day", F.to_date("as_of")), "claims-batch")
        days = new.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
        own = (F.col("run") == self.run) & (F.col("batch") == number)
        known = self.attempts(spark).filter(F.col("accepted") & ~own & F.col("day").between(days["low"], days["high"])).select(
            "universe", "window_id", "day", F.col("outcome").alias("_kept"))
        standing = F.col("_kept").isNotNull() & (F.col("accepted") | (F.col("reason") == "repeat"))
        (new.join(known, ["universe", "window_id", "day"], "left")
         .withColumn("outcome", F.when(standing, F.col("_kept")).otherwise(F.col("outcome")))
         .withColumn("reason", F.when(standing, "repeat").otherwise(F.col("reason")))
         .withColumn("accepted", F.col("accepted") & ~standing).drop("_kept")
         .write.mode("overwrite").partitionBy("accepted", "day").parquet(f"{self.path}/run={self.run}/batch={number}"))
