"""Sinks: write-once results, the journal, the event catalog and report extracts.

A folder counts as written when its commit marker is there (Spark's committer writes it after the last
task), so a job that died half-way leaves nothing that is read, and repeating it is safe.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CATALOG = (
    "universe STRING, t0 BIGINT, origin_asset STRING, direction INT, magnitude_sigma DOUBLE, "
    "systemic_flag BOOLEAN, eligible BOOLEAN, exclusion_reasons STRING")


class ResultExists(FileExistsError):
    """A frozen result is there already and holds something else."""


def content_id(df: DataFrame) -> str:
    """Identity of a table's rows whatever their order or partitioning: columns, count and two hash sums."""
    names = sorted(df.columns)
    row = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    digest = F.sha2(row, 256)
    halves = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    found = df.agg(F.count("*").alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(halves)]).first()
    return f"{','.join(names)}/{found.n}/{found.h0}/{found.h1}"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing ``path``."""
    place, files = _folder(spark, path)
    return files.exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS"))


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Frozen result: False if the same rows were committed before, ResultExists if other rows were.

    What an unfinished job left behind is replaced.
    """
    spark = df.sparkSession
    if not committed(spark, path):
        df.write.mode("overwrite").format(fmt).save(path)
        return True
    place, files = _folder(spark, path)
    parts = [f.getPath().getName().split(".") for f in files.listStatus(place) if f.getPath().getName().startswith("part-")]
    if parts and not any(fmt in p for p in parts):
        raise ResultExists(f"{path} exists already, in another format")
    stored = spark.read.format(fmt)
    stored = (stored if fmt in ("parquet", "orc") else stored.schema(df.schema)).load(path)
    if content_id(stored) != content_id(df):
        raise ResultExists(f"{path} exists already and holds other rows")
    return False


def append_journal(df: DataFrame, path: str, entry: str) -> bool:
    """Ledger rows as JSON lines under the name of their entry; False if that entry is committed already.

    ``entry`` names the job (a run id, a window id): a repeat of it adds nothing, another one is appended.
    """
    target = f"{path}/entry={quote(entry, safe='')}"
    if committed(df.sparkSession, target):
        return False
    df.write.mode("overwrite").json(target)
    return True


def read_journal(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All committed entries of a journal; what unfinished jobs left is not read."""
    place, files = _folder(spark, path)
    found = [str(f.getPath()) for f in files.listStatus(place) if f.getPath().getName().startswith("entry=")]
    whole = [f for f in found if committed(spark, f)]
    return spark.read.schema(schema).json(whole) if whole else spark.createDataFrame([], schema)


def write_catalog(events: DataFrame, path: str) -> None:
    """Event catalog as CSV, arrays joined by ``|``."""
    (events.select("universe", "t0", F.array_join("origins", "|").alias("origin_asset"), "direction",
                   F.col("magnitude").alias("magnitude_sigma"), F.col("systemic").alias("systemic_flag"),
                   "eligible", F.array_join("reasons", "|").alias("exclusion_reasons"))
     .write.mode("errorifexists").option("header", "true").csv(path))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog back, with its lists split again (an empty cell is an empty list)."""
    def parts(name: str):
        return F.when(F.coalesce(F.col(name), F.lit("")) == "", F.array().cast("array<string>")) \
            .otherwise(F.split(name, "\\|"))
    return (spark.read.schema(CATALOG).option("header", "true").option("mode", "FAILFAST").csv(path)
            .withColumn("origins", parts("origin_asset")).withColumn("reasons", parts("exclusion_reasons"))
            .drop("origin_asset", "exclusion_reasons"))


def publish_views(tables: dict[str, DataFrame], prefix: str = "shockwatch_") -> list[str]:
    """Register report extracts as views for SQL users; returns the view names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in tables]
