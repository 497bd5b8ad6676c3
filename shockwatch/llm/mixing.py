"""Mixing sources to target weights by entropy balancing, DataFrame functions only.

Each document gets a rate r >= 0, the copies it is taken with on average. The rates minimise the
relative entropy to "every document once", sum(r ln r - r), under one token constraint per source,
sum(r * size) = target, and r <= CAP. The solution is an exponential tilt, r = min(CAP, exp(l * z))
with z the size relative to the source's mean, and one dual variable l per source. Newton steps on
the convex dual (on the log of the constraint, which removes the scale) run for all sources at once:
a step is one join of the current l with the histogram (source, size, documents), which holds
everything the dual needs, and one grouping. A bracket around every l catches steps that overshoot.

Rates become copies by order sampling: every document is taken floor(r) times, and documents with a
fractional part follow in the order of u / fraction (u a hash of the row) until the source's
remaining tokens are used up; the last one is cut to fit. The sum of a source is its rounded target.
Running sums go over hashed buckets first, so a hot source is never one task.

The list of sources (one row each: rank, size, target) is the only thing ordered as a whole.

Defined cases: null or blank texts have size 0, rate 1 and take nothing; a null source is a source
of its own, last in order; repeated rows are documents of their own with equal rates; if all sizes
are 0 all targets are 0; an empty table gives an empty result; columns other than doc_id, text and
source are not read by the report, and are passed on unchanged by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS_PER_BUCKET, store, text_of, uniform

CAP = 3
TOLERANCE = 1e-9
MAX_STEPS = 200
EXACT = "decimal(38,12)"  # sums that decide whole numbers do not depend on the order of their terms


def words(column: str = "text") -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D."""
    return F.regexp_count(text_of(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, rank, source_size and target for a table of (source, size, documents).

    Weights 1, 2, 3 repeat along the sources in code point order. Water filling: sources sorted by
    the level at which they reach their cap fill up one after the other; the first prefix whose
    level leaves everyone behind it below the cap is final.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    ordered = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weighed = ordered.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn(
        "full", F.lit(float(cap)) * F.col("source_size"))
    before = Window.orderBy(F.col("full") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy(F.col("full") / F.col("weight"), "rank").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum(
        "weight").over(behind)
    # the level of a prefix is valid where its next source stays below its cap
    levels = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("full"))
    final = F.min(F.when(F.col("open"), F.struct((F.col("full") / F.col("weight")).alias("at"), "rank", "level"))).over(whole)
    return levels.withColumn("final", final).select(
        "source", "rank", "source_size",
        F.when(F.col("final").isNull(), F.col("full")).otherwise(
            F.least(F.col("full"), F.col("final.level") * F.col("weight"))).alias("target"))


def solve(sizes: DataFrame, aims: DataFrame, cap: int = CAP) -> DataFrame:
    """rank, mean, tilt (null where the target is the cap itself) per source with tokens."""
    histogram = store(
        sizes.filter("size > 0").join(aims.select(F.col("source").alias("_s"), "rank"),
                                      F.col("source").eqNullSafe(F.col("_s"))).select("rank", "size", "documents"),
        "mix-histogram")
    mean = histogram.groupBy("rank").agg((F.sum(F.col("size") * F.col("documents")) / F.sum("documents")).alias("mean"),
                                         F.min("size").alias("smallest"), F.max("size").alias("largest"))
    state = store(aims.filter("source_size > 0").join(mean, "rank").select(
        "rank", "mean", "target", (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("saturated"),
        F.lit(0.0).alias("tilt"), F.lit(1.0).alias("gap"),
        # at the upper end every document is at the cap; at the lower one no token is left
        (F.lit(-800.0) * F.col("mean") / F.col("smallest")).alias("low"),
        (F.log(F.lit(float(cap))) * F.col("mean") / F.col("smallest")).alias("high")), "mix-state")
    for _ in range(MAX_STEPS):
        z = F.col("size") / F.col("mean")
        tilted = F.exp(F.least(F.col("tilt") * z, F.lit(50.0)))
        tokens = F.col("documents") * F.col("size")
        sums = histogram.join(state.filter("not saturated").select("rank", "mean", "tilt"), "rank").groupBy("rank").agg(
            F.sum((tokens * F.least(tilted, F.lit(float(cap)))).cast(EXACT)).cast("double").alias("reached"),
            F.sum(F.when(tilted < cap, tokens * tilted * z).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"))
        moved = state.join(sums, "rank", "left").withColumns({
            "low": F.when(F.col("reached") < F.col("target"), F.col("tilt")).otherwise(F.col("low")),
            "high": F.when(F.col("reached") > F.col("target"), F.col("tilt")).otherwise(F.col("high")),
            "gap": F.coalesce(F.abs(F.col("reached") / F.col("target") - 1), F.lit(0.0)),
            "_step": F.col("tilt") + F.when((F.col("reached") > 0) & (F.col("slope") > 0), F.log(
                F.col("target") / F.col("reached")) * F.col("reached") / F.col("slope"))})
        inside = (F.col("_step") > F.col("low")) & (F.col("_step") < F.col("high"))
        state = store(moved.withColumn(
            "tilt", F.when(F.col("gap") <= TOLERANCE, F.col("tilt")).when(inside, F.col("_step")).otherwise(
                (F.col("low") + F.col("high")) / 2)).select(
            "rank", "mean", "target", "saturated", "tilt", "gap", "low", "high"), "mix-state")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
    else:
        worst = state.orderBy(F.desc("gap")).first()
        raise ArithmeticError(f"source of rank {worst['rank']} is {worst['gap']:.2e} off its target after {MAX_STEPS} steps")
    return state.select("rank", "mean", F.when(~F.col("saturated"), F.col("tilt")).alias("tilt"))


def taken_words(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, text_key (to find a row again), size, source_size, target and taken of every row."""
    rows = store(docs.select("doc_id", "source", words().alias("size"), F.xxhash64(text_of()).alias("text_key")),
                 "mix-rows")
    sizes = store(rows.groupBy("source", "size").agg(F.count("*").alias("documents")), "mix-sizes")
    aims = store(targets(sizes, cap), "mix-targets")
    tilts = store(aims.join(solve(sizes, aims, cap), "rank", "left").select(
        F.col("source").alias("_s"), "rank", "source_size", "target", "mean", "tilt"), "mix-tilts")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), float(cap)).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))
    rated = rows.join(tilts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_rate", rate).withColumns({
        "_whole": F.floor("_rate").cast("long"), "_part": F.col("_rate") - F.floor("_rate"),
        "_u": uniform(F.col("doc_id"), F.col("text_key"), F.col("source"), seed=10)})
    rated = store(rated, "mix-rates")
    # small tables are stored: their size is known then, and rows are dealt by (source, bucket) alone
    per_source = store(rated.groupBy("rank").agg(
        F.sum(F.col("_whole") * F.col("size")).alias("_fixed"), (F.sum(F.col("_part").cast(EXACT)).cast("double") / F.count("*")).alias("_mean_part"),
        F.ceil(F.count("*") / ROWS_PER_BUCKET).alias("_width")), "mix-sources")
    # the order of u / part, mapped to (0, 1) so that buckets of a source hold about as many rows
    scaled = F.col("_u") / F.col("_part") * F.col("_mean_part")
    extras = rated.filter("_part > 0 and size > 0").join(per_source.select("rank", "_mean_part", "_width"), "rank").withColumn(
        "_key", scaled / (1 + scaled)).withColumn("_bucket", F.floor(F.col("_key") * F.col("_width") * 2).cast("int"))
    offsets = store(extras.groupBy("rank", "_bucket").agg(F.sum("size").alias("_n")).select(
        "rank", "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy("rank").orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")), "mix-offsets")
    order = Window.partitionBy("rank", "_bucket").orderBy("_key", "doc_id", "text_key").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = extras.join(offsets, ["rank", "_bucket"]).withColumn(
        "_before", F.col("_offset") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    whole = rated.filter("not (_part > 0 and size > 0)").withColumn("_before", F.lit(None).cast("long"))
    columns = ["doc_id", "text_key", "rank", "size", "source_size", "target", "_whole", "_before"]
    final = placed.select(columns).unionByName(whole.select(columns)).join(per_source.select("rank", "_fixed"), "rank")
    left = F.round("target").cast("long") - F.col("_fixed") - F.col("_before")
    extra = F.when(F.col("_before").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least("size", left)))
    return final.select("doc_id", "text_key", "size", "source_size", "target",
                        (F.col("_whole") * F.col("size") + extra).cast("long").alias("taken"))


def report(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return taken_words(docs, cap).drop("text_key")


def mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The mixture itself: a row per whole copy, and the cut copy that completes a source.

    A document of size 0 stays once (it takes no words). The columns are those of ``docs``; a cut copy
    is the beginning of its text, white space and all, up to its last word, and ``n_chars`` follows where there is one.
    """
    found = store(taken_words(docs, cap).select(
        F.col("doc_id").alias("_m_id"), F.col("text_key").alias("_m_key"), F.col("size").alias("_m_size"),
        F.col("taken").alias("_m_taken")), "mix-report")
    # the same row stored several times: its takes are put together, then dealt to one of them
    once = found.groupBy("_m_id", "_m_key").agg(F.max("_m_size").alias("_m_size"), F.sum("_m_taken").alias("_m_taken"),
                                                F.count("*").alias("_m_rows"))
    keyed = docs.withColumn("_m_text", F.xxhash64(text_of()))
    if not once.filter("_m_rows > 1").isEmpty():
        order = Window.partitionBy("doc_id", "_m_text").orderBy("doc_id")
        keyed = keyed.withColumn("_m_first", F.row_number().over(order)).filter("_m_first = 1").drop("_m_first")
    joined = keyed.join(once.filter("_m_taken > 0 or _m_size = 0"), F.col("doc_id").eqNullSafe(F.col("_m_id")) & (
        F.col("_m_text") == F.col("_m_key")))
    copies = F.when(F.col("_m_size") == 0, F.col("_m_rows")).otherwise(F.ceil(F.col("_m_taken") / F.col("_m_size")))
    each = joined.withColumn("_m_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    left = F.col("_m_taken") - (F.col("_m_copy") - 1) * F.col("_m_size")
    cut = (F.col("_m_size") > 0) & (left < F.col("_m_size"))
    # cut behind words: a part is a word with the white space before it, so parts join to the text as it was
    head = F.array_join(F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, left.cast("int")), "")
    out = each.withColumn("_m_cut", cut).withColumn("text", F.when(F.col("_m_cut"), head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_m_cut"), F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(docs.columns)
