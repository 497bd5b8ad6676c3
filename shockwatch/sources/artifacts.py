"""Manifests, checksums, forecast artifacts and prediction streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_facts(files: DataFrame) -> DataFrame:
    """Name, sha256, byte length and line count of ``binaryFile`` rows."""
    text = F.decode("content", "UTF-8")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"),
                        F.sha2("content", 256).alias("sha256"),
                        F.octet_length("content").cast("long").alias("bytes"),
                        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))
                        .cast("long").alias("rows"))


def verify_files(facts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every file and every manifest entry, with the first fact that disagrees."""
    want = manifest.select("filename", *[F.col(c).alias(f"want_{c}")
                                         for c in ("sha256", "bytes", "rows")])
    return (facts.join(want, "filename", "full_outer")
            .withColumn("status", F.when(F.col("want_sha256").isNull(), "unlisted")
                        .when(F.col("sha256").isNull(), "missing")
                        .when(F.col("bytes") != F.col("want_bytes"), "length_mismatch")
                        .when(F.col("sha256") != F.col("want_sha256"), "hash_mismatch")
                        .when(F.col("rows") != F.col("want_rows"), "row_count_mismatch")
                        .otherwise("verified")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of acquisition manifests: ``{month, status, results: [...]}``."""
    entry = "array<struct<asset: string, filename: string, sha256: string, bytes: bigint, rows: bigint>>"
    schema = f"month string, status string, results {entry}"
    return (spark.read.schema(schema).option("multiLine", "true").json(path)
            .select("month", "status", F.explode("results").alias("_e")).select("month", "status", "_e.*"))


def checksums(lines: DataFrame) -> DataFrame:
    """``filename, sha256`` of checksum lines (64 hex digits, blanks, name)."""
    pattern = r"^([0-9a-f]{64})\s+\*?(\S+)\s*$"
    return lines.select(F.regexp_extract("value", pattern, 2).alias("filename"),
                        F.regexp_extract("value", pattern, 1).alias("sha256")) \
        .filter("filename <> ''")


def scan_artifacts(spark: SparkSession, path: str, schema: str, multi_line: bool = True
                   ) -> DataFrame:
    """One row per JSON artifact; an unreadable one keeps its path and text as ``parse_error``."""
    return (spark.read.schema(f"{schema}, _bad STRING").option("mode", "PERMISSIVE").option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", "_bad").json(path)
            .withColumn("path", F.col("_metadata.file_path"))
            .withColumnRenamed("_bad", "parse_error"))


def align_stream(predictions: DataFrame, origins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A prediction stream against its origin grid: matched, missing, surplus or duplicate."""
    got = predictions.groupBy(*keys).agg(F.count("*").alias("_n"))
    want = origins.select(*keys).distinct().withColumn("_want", F.lit(True))
    return (want.join(got, list(keys), "full_outer")
            .withColumn("status", F.when(F.col("_want").isNull(), "surplus")
                        .when(F.col("_n").isNull(), "missing")
                        .when(F.col("_n") > 1, "duplicate").otherwise("matched"))
            .drop("_n", "_want"))
