"""Exact deduplication by skew-safe combining, DataFrame functions only.

Equal texts meet in three steps, each of which groups by the digest *and* the whole text, so a
digest collision can never merge different texts:

1. inside a map task (the partial aggregate of step 2), before anything is shuffled;
2. within (digest, salt), where the salt spreads the copies of one text over SALTS reducers;
3. the at most SALTS winners of a text meet globally.

Rows find their group again by digest alone; only digests that really stand for several texts
(known from step 3) are joined by text as well.

Defined cases: a null text equals the empty one; a null doc_id never wins against another id, and
a group with null ids only keeps null; repeated rows (equal id and text) count each towards
group_size and are reduced to one by ``deduplicate``; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store, text_of, without

SALTS = 16


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_id"), text_of().alias("_text"),
                       F.sha2(text_of().cast("binary"), 256).alias("text_sha256"))


def winners(rows: DataFrame) -> DataFrame:
    """One row per different text: digest, text, keep_id, group_size."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).groupBy(
        "text_sha256", "_salt", "_text").agg(F.max("_id").alias("_id"), F.count("*").alias("_n"))
    return salted.groupBy("text_sha256", "_text").agg(
        F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = hashed(docs)
    found = store(winners(rows).drop("_text"), "exact-winners")
    shared = store(found.groupBy("text_sha256").agg(F.count("*").alias("_n")).filter("_n > 1").select(
        "text_sha256"), "exact-shared")
    if shared.isEmpty():
        joined = rows.drop("_text").join(found, "text_sha256")
    else:  # several texts behind one digest: there the text decides
        inside = rows.join(shared, "text_sha256", "left_semi")
        outside = rows.drop("_text").join(shared, "text_sha256", "left_anti")
        joined = outside.join(found, "text_sha256").unionByName(
            inside.join(winners(inside), ["text_sha256", "_text"]).drop("_text"))
    return joined.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per different text, the one with the largest doc_id; all columns as they were."""
    report = store(dedup_report(docs), "exact-report")
    dropped = report.filter(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    kept = without(docs, dropped, {"doc_id": F.col("doc_id"),
                                   "text_sha256": F.sha2(text_of().cast("binary"), 256)})
    again = report.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("_n")).filter("_n > 1")
    if again.isEmpty():
        return kept
    # an id stored twice with one text: keep the first of its rows in the order of all columns
    marked = kept.withColumn("_llm_digest", F.sha2(text_of().cast("binary"), 256))
    order = Window.partitionBy("doc_id", "_llm_digest").orderBy(*[c for c in docs.columns if c != "text"])
    return marked.withColumn("_llm_row", F.row_number().over(order)).filter("_llm_row = 1").drop(
        "_llm_row", "_llm_digest")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
