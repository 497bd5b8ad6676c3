"""Session defaults and the one place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow).

    On a cluster the master and the shuffle width come from spark-submit; both are only
    set here when passed.
    """
    builder = SparkSession.builder.appName("shockwatch")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one disk, gets a temporary folder
    of its own when the setting is missing; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        made = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", made)
        return made
    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


_run_dirs: dict[tuple[str, str], str] = {}


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the session's JVM ends."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _run_dirs:
        path = f"{key[1]}/shockwatch/{key[0]}-{uuid.uuid4().hex[:8]}"
        made = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = made.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(made)
        files.deleteOnExit(made)
        _run_dirs[key] = path
    return _run_dirs[key]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several branches read, and read it back.

    Cuts the lineage with files that outlive a lost executor.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROWS_PER_TASK = 50_000


@contextmanager
def spread(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of what is written inside have a task per ROWS_PER_TASK of ``rows``, at least one per core.

    AQE merges partitions down to the cores by their compressed bytes; a task of a plan with many
    joins and lists then holds a share of all rows, in several operators at once.
    """
    wanted = {"spark.sql.shuffle.partitions": str(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))),
              "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


MAX_BROADCAST_ROWS = 50_000


def dimension(df: DataFrame, label: str, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A small side table: written once, counted, and broadcast only within the bound.

    Beyond the bound it joins as any other table. Writing first keeps the count from running
    the plan behind it twice.
    """
    stored = materialize(df, label)
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored
