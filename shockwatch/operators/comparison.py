"""Model against baseline over rolling origins, with every planned task in the denominator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import competition_rank

TOP = 2
REL_TOL, ABS_TOL = 1e-10, 1e-12
THRESHOLDS = (0.01, 0.02, 0.03, 0.05)
MIN_SUPPORT = 10


def close_to(a: Column, b: Column) -> Column:
    """Equality up to a relative 1e-10 or an absolute 1e-12."""
    return F.abs(a - b) <= F.greatest(REL_TOL * F.greatest(F.abs(a), F.abs(b)), F.lit(ABS_TOL))


def error_pairs(rolling: DataFrame) -> DataFrame:
    """Model and baseline absolute errors per (origin, asset, metric).

    Terminal return is measured against the naive last price, volatility against the past one.
    """
    rows = F.array(
        F.struct(F.lit("terminal_return").alias("metric"), F.col("m_ret").alias("predicted"),
                 F.lit(0.0).alias("base"), F.col("a_ret").alias("actual")),
        F.struct(F.lit("volatility").alias("metric"), F.col("m_vol").alias("predicted"),
                 F.col("vol30").alias("base"), F.col("a_vol").alias("actual")))
    return (rolling.select("universe", "t0", "asset", "tier", "day", "period",
                           F.explode(rows).alias("_m"))
            .select("universe", "t0", "asset", "tier", "day", "period", "_m.*")
            .withColumn("model_error", F.abs(F.col("predicted") - F.col("actual")))
            .withColumn("baseline_error", F.abs(F.col("base") - F.col("actual"))))


def with_equal_weight(pairs: DataFrame) -> DataFrame:
    """Adds ``equal_weight_assets``: the per-origin mean error over all assets."""
    mean = (pairs.groupBy("universe", "t0", "day", "period", "metric")
            .agg(F.avg("model_error").alias("model_error"),
                 F.avg("baseline_error").alias("baseline_error"))
            .withColumn("asset", F.lit("equal_weight_assets")))
    cols = ["universe", "t0", "day", "period", "metric", "asset", "model_error", "baseline_error"]
    return pairs.select(cols).unionByName(mean.select(cols))


def error_stats(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean errors, skill as a ratio of means, and win/tie/loss per origin."""
    a, b = F.col("model_error"), F.col("baseline_error")
    tie = close_to(a, b)
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(a).alias("model_mae"), F.avg(b).alias("baseline_mae"),
        (1 - F.try_divide(F.avg(a), F.avg(b))).alias("skill"),
        F.count_if((a < b) & ~tie).alias("win"), F.count_if(tie).alias("tie"),
        F.count_if((a >= b) & ~tie).alias("loss"))


def top_sets(values: DataFrame, keys: Sequence[str], value: str, out: str, k: int = TOP
             ) -> DataFrame:
    """Sorted set of assets with competition rank <= k; ties may select more than k."""
    return (values.withColumn("_rank", competition_rank(keys, value)).filter(F.col("_rank") <= k)
            .groupBy(*keys).agg(F.array_sort(F.collect_list("asset")).alias(out)))


def first_origin(rolling: DataFrame) -> DataFrame:
    """Rows of each universe's first origin."""
    first = rolling.groupBy("universe").agg(F.min("t0").alias("t0"))
    return rolling.join(first, ["universe", "t0"])


def strategy_sets(rolling: DataFrame) -> DataFrame:
    """Actual top set next to the sets of the model, the past and the first origin's past."""
    keys = ["universe", "t0"]
    static = top_sets(first_origin(rolling), keys, "vol30", "static").select("universe", "static")
    sets = (top_sets(rolling, keys, "a_vol", "actual")
            .join(top_sets(rolling, keys, "m_vol", "model"), keys)
            .join(top_sets(rolling, keys, "vol30", "past"), keys)
            .join(static, "universe"))
    return sets.select(*keys, "actual", F.explode(F.array(
        F.struct(F.lit("model").alias("strategy"), F.col("model").alias("chosen")),
        F.struct(F.lit("historical_volatility").alias("strategy"), F.col("past").alias("chosen")),
        F.struct(F.lit("constant_initial").alias("strategy"), F.col("static").alias("chosen"))
    )).alias("_s")).select(*keys, "actual", "_s.*")


def set_scores(sets: DataFrame) -> DataFrame:
    """Per origin: exact hit, common, precision, recall, Jaccard and size."""
    common = F.size(F.array_intersect("actual", "chosen"))
    return (sets.withColumn("exact", F.array_sort("actual") == F.array_sort("chosen"))
            .withColumn("common", common)
            .withColumn("precision", common / F.size("chosen"))
            .withColumn("recall", common / F.size("actual"))
            .withColumn("jaccard", common / F.size(F.array_union("actual", "chosen")))
            .withColumn("selected", F.size("chosen"))
            .withColumn("added", F.array_except("chosen", "actual"))
            .withColumn("removed", F.array_except("actual", "chosen")))


def confusion(rows: DataFrame, keys: Sequence[str], predicted: Column, actual: Column
              ) -> DataFrame:
    """Confusion counts with precision and recall, null on an empty denominator."""
    tp, fp = F.count_if(predicted & actual), F.count_if(predicted & ~actual)
    fn, tn = F.count_if(~predicted & actual), F.count_if(~predicted & ~actual)
    return rows.groupBy(*keys).agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))


def threshold_sweep(rows: DataFrame, keys: Sequence[str], predicted: str, actual: str,
                    grid: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Confusion at each threshold, F1, support gate and the recommended threshold.

    F1 ties are decided on cross-multiplied integers, never on rounded quotients.
    """
    keys = list(keys)
    # Counts per threshold in one pass: the grid is columns, not a replication of the rows.
    counts = rows.groupBy(*keys).agg(*[f(t).alias(f"{name}_{i}") for i, t in enumerate(grid)
                                       for name, f in (
        ("tp", lambda t: F.count_if((F.col(predicted) > t) & (F.col(actual) > t))),
        ("fp", lambda t: F.count_if((F.col(predicted) > t) & ~(F.col(actual) > t))),
        ("fn", lambda t: F.count_if(~(F.col(predicted) > t) & (F.col(actual) > t))),
        ("tn", lambda t: F.count_if(~(F.col(predicted) > t) & ~(F.col(actual) > t))))])
    tall = counts.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(t).alias("threshold"), *[F.col(f"{c}_{i}").alias(c) for c in ("tp", "fp", "fn", "tn")])
        for i, t in enumerate(grid)])).alias("_g")).select(*keys, "_g.*")
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    scored = (tall.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
              .withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
              .withColumn("f1", F.try_divide(2 * F.col("tp"), den))
              .withColumn("supported", (F.col("tp") + F.col("fn") >= MIN_SUPPORT)
                          & (F.col("tp") + F.col("fp") >= MIN_SUPPORT)).withColumn("_den", den))
    row = F.struct("threshold", F.col("tp").alias("t"), F.col("_den").alias("d"))
    options = F.array_sort(F.collect_list(F.when(F.col("supported"), row)).over(
        Window.partitionBy(*keys)))
    best = F.aggregate(options, F.expr(
        "cast(null as struct<threshold: double, t: bigint, d: bigint>)"),
        lambda acc, x: F.when(acc.isNull() | (x["t"] * acc["d"] > acc["t"] * x["d"]), x)
        .otherwise(acc))
    return (scored.withColumn("_best", best)
            .withColumn("recommended", F.coalesce(F.col("threshold") == F.col("_best.threshold"),
                                                  F.lit(False))).drop("_best", "_den"))


def ledger(manifest: DataFrame, artifacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per planned task: its single artifact's status, ``missing`` or ``duplicate``."""
    known = ("scored", "failed", "pending_truth", "incomplete_truth", "predicted", "not_run")
    found = artifacts.groupBy(*keys).agg(F.count("*").alias("attempts"),
                                         F.min("status").alias("status"))
    return (manifest.join(found, list(keys), "left")
            .withColumn("attempts", F.coalesce("attempts", F.lit(0)))
            .withColumn("status", F.when(F.col("attempts") == 0, "missing")
                        .when(F.col("attempts") > 1, "duplicate")
                        .when(F.col("status").isin(*known), F.col("status"))
                        .otherwise("invalid_artifact")))


def unassigned(manifest: DataFrame, artifacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Artifacts of no planned task."""
    return artifacts.join(manifest.select(*keys), list(keys), "left_anti")


def first_mismatch(left: str, right: str, fields: Sequence[str], suffix: str = "_mismatch") -> Column:
    """Name of the first field in which two prefixed sets of columns differ (null equals null), or null."""
    return F.coalesce(*[F.when(~F.col(f"{left}{f}").eqNullSafe(F.col(f"{right}{f}")), f"{f}{suffix}") for f in fields])


def compare_reports(left: DataFrame, right: DataFrame, keys: Sequence[str], context: Sequence[str] = ()) -> DataFrame:
    """Full outer pairing of two ledgers with the reason a pair cannot be compared.

    Two scored rows are comparable only if every ``context`` column agrees, in the given order:
    provenance, configuration, revision and the target itself.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("status", "value", *context)])

    differs = first_mismatch("left_", "right_", context) if context else F.lit(None).cast("string")
    return (side(left, "left").join(side(right, "right"), list(keys), "full_outer")
            .withColumn("pairing", F.when(F.col("right_status").isNull(), "only_left")
                        .when(F.col("left_status").isNull(), "only_right")
                        .when((F.col("left_status") != "scored")
                              & (F.col("right_status") != "scored"), "both_unscored")
                        .when(F.col("left_status") != "scored", "left_unscored")
                        .when(F.col("right_status") != "scored", "right_unscored")
                        .otherwise(F.coalesce(differs, F.lit("matched")))))


def match_windows(forecasts: DataFrame, windows: DataFrame, keys: Sequence[str], context: Sequence[str]) -> DataFrame:
    """Forecasts with ``match``: ``no_window``, the first context field that differs, or ``matched``."""
    a = forecasts.select(*keys, *[F.col(c).alias(f"f_{c}") for c in context])
    b = windows.select(*keys, *[F.col(c).alias(f"w_{c}") for c in context], F.lit(True).alias("_there"))
    return a.join(b, list(keys), "left").withColumn("match", F.when(F.col("_there").isNull(), "no_window").otherwise(
        F.coalesce(first_mismatch("f_", "w_", context), F.lit("matched")))).drop("_there")


def merge_batches(left: DataFrame, right: DataFrame, keys: Sequence[str],
                  evidence: Sequence[str]) -> DataFrame:
    """Union of two score batches with ``merge``: ``kept``, ``conflict`` or ``duplicate_in_batch``.

    A key may occur once in a batch and, in both, with the same evidence in every column; any other
    key is reported with its reason and carries no evidence.
    """
    keys = list(keys)

    def counted(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"_n{side}"), *[F.first(c).alias(f"_{side}_{c}") for c in evidence])

    both = counted(left, "a").join(counted(right, "b"), keys, "full_outer")
    differs = F.lit(False)
    for c in evidence:
        differs = differs | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    merge = (F.when(F.greatest(F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))) > 1, "duplicate_in_batch")
             .when(F.col("_na").isNotNull() & F.col("_nb").isNotNull() & differs, "conflict").otherwise("kept"))
    marked = both.withColumn("merge", merge)
    return marked.select(*keys, "merge", *[F.when(F.col("merge") == "kept", F.when(
        F.col("_na").isNotNull(), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}"))).alias(c) for c in evidence])


def deduplicate(runs: DataFrame, keys: Sequence[str], content: Column) -> DataFrame:
    """Equal reruns count once; conflicting reruns are excluded but reported."""
    return (runs.groupBy(*keys).agg(F.count("*").alias("runs"),
                                    F.count_distinct(content).alias("_versions"),
                                    F.min(content).alias("content"))
            .withColumn("status", F.when(F.col("_versions") > 1, "conflicting_rerun")
                        .when(F.col("runs") > 1, "equal_rerun").otherwise("single"))
            .withColumn("content", F.when(F.col("_versions") == 1, F.col("content")))
            .drop("_versions"))


METHODS = ("model", "dynamic_naive", "historical_30")


def tier_scores(rolling: DataFrame, failed: Column | None = None) -> DataFrame:
    """Per (origin, tier, method): set scores against the actual top two, errors and recall.

    Methods are the model, the dynamic naive volatility and the past-30 scalar. Where ``failed``
    holds for an origin there is no model forecast, and no row of it.
    """
    from ..functions.ranking import rank_scores
    keys = ["universe", "t0", "tier"]
    actual = top_sets(rolling, keys, "a_vol", "actual")
    method = F.array(
        F.struct(F.lit("model").alias("method"), F.col("m_vol").alias("p"),
                 F.col("m_mdd").alias("pd")),
        F.struct(F.lit("dynamic_naive").alias("method"), F.col("vol255").alias("p"),
                 F.lit(None).cast("double").alias("pd")),
        F.struct(F.lit("historical_30").alias("method"), F.col("vol30").alias("p"),
                 F.col("mdd30").alias("pd")))
    long = rolling.select(*keys, "asset", "day", F.col("a_vol").alias("a"), "a_mdd",
                          F.explode(method).alias("_m")).select(
        *keys, "asset", "day", "a", "a_mdd", "_m.*")
    if failed is not None:
        long = long.filter(~((F.col("method") == "model") & failed))
    scores = rank_scores(long, [*keys, "method"])
    drawdown = long.groupBy(*keys, "method").agg(
        F.avg(F.abs(F.col("pd") - F.col("a_mdd"))).alias("mdd_mae"), F.max("day").alias("day"))
    chosen = top_sets(long, [*keys, "method"], "p", "chosen")
    return (set_scores(chosen.join(actual, keys))
            .join(scores.select(*keys, "method", F.col("mae").alias("vol_mae"),
                                F.col("recall").alias("top3_recall")), [*keys, "method"])
            .join(drawdown, [*keys, "method"]))


def whole_plan(scores: DataFrame, plan: DataFrame, assets: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Every planned (origin, tier, method) with its scores, or as ``failed`` without any."""
    keys = ["universe", "t0", "tier", "method"]
    tiers = assets.select("universe", "tier").distinct()
    planned = plan.select("universe", "t0").join(tiers, "universe").withColumn(
        "method", F.explode(F.array(*[F.lit(m) for m in methods])))
    return planned.join(scores.withColumn("status", F.lit("scored")), keys, "left").withColumn(
        "status", F.coalesce("status", F.lit("failed")))


def fixed_pair_scores(rolling: DataFrame, tier: str = "small") -> DataFrame:
    """The fixed pair as a method of its tier: its set against the actual top two at every origin."""
    keys = ["universe", "t0", "tier"]
    pair = fixed_pair(rolling, tier).select("universe", F.array("first", "second").alias("chosen"))
    actual = top_sets(rolling.filter(F.col("tier") == tier), keys, "a_vol", "actual")
    return set_scores(actual.join(pair, "universe")).withColumn("method", F.lit("fixed_pair"))


def fixed_pair(rolling: DataFrame, tier: str = "small") -> DataFrame:
    """The pair of tier assets that most often is the exact actual top set; first pair on a tie."""
    keys = ["universe", "t0", "tier"]
    members = rolling.filter(F.col("tier") == tier)
    hits = (top_sets(members, keys, "a_vol", "actual").filter(F.size("actual") == 2)
            .groupBy("universe", "actual").agg(F.count("*").alias("hits"))
            .groupBy("universe").agg(F.min_by(F.struct("actual", "hits"), F.struct(
                (-F.col("hits")).alias("h"), "actual")).alias("_best")))
    # Only pairs that were hit can win; without any, the first pair in name order does.
    names = (members.groupBy("universe").agg(F.array_sort(F.collect_set("asset")).alias("_names"))
             .filter(F.size("_names") >= 2))
    pair = F.coalesce("_best.actual", F.slice("_names", 1, 2))
    return (names.join(hits, "universe", "left")
            .select("universe", pair[0].alias("first"), pair[1].alias("second"),
                    F.coalesce("_best.hits", F.lit(0)).alias("hits")))


def method_summary(scores: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Per (tier, method): coverage against the schedule, hit rates, errors, over-selection."""
    rows = scores.groupBy("universe", "tier", "method").agg(
        F.count("*").alias("n_scored"), F.count_if(F.col("exact")).alias("exact_hits"),
        F.avg(F.col("exact").cast("int")).alias("exact_rate"),
        F.avg("common").alias("mean_hits"), F.avg("vol_mae").alias("vol_mae"),
        F.avg("mdd_mae").alias("mdd_mae"), F.avg("top3_recall").alias("top3_recall"),
        F.count("mdd_mae").alias("n_mdd"), F.count_if(F.col("selected") > 2).alias("over_two"))
    return (rows.join(scheduled, "universe")
            .withColumn("n_failed", F.col("n_scheduled") - F.col("n_scored"))
            .withColumn("coverage", F.try_divide("n_scored", "n_scheduled")))


def paired_differences(scores: DataFrame, candidate: str, fields: Sequence[str]) -> DataFrame:
    """Candidate minus each other method on the origins both scored, in long form."""
    keys = ["universe", "t0", "tier"]
    a = scores.filter(F.col("method") == candidate)
    b = scores.filter(F.col("method") != candidate)

    def values(df: DataFrame, out: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(out))
                          for f in fields])
        extra = ["method"] if out == "reference" else ["day"]
        return df.select(*keys, *extra, F.explode(cells).alias("_c")).select(*keys, *extra, "_c.*")

    return (values(a, "candidate").join(values(b, "reference"), [*keys, "field"])
            .filter("candidate is not null and reference is not null")
            .withColumn("difference", F.col("candidate") - F.col("reference")))


def gates(summary: DataFrame, candidate: str = "model", tolerance: float = 0.02,
          guard: float = 0.2) -> DataFrame:
    """Point-estimate gates on a complete grid.

    The small tier must strictly gain exact hits; the major tier may lose two points; its
    drawdown error may grow by at most a fifth (exactly a fifth passes).
    """
    a = summary.filter(F.col("method") == candidate).select(
        "universe", "tier", F.col("exact_rate").alias("c_rate"), F.col("mdd_mae").alias("c_mdd"),
        (F.col("n_failed") == 0).alias("c_whole"))
    b = summary.filter(F.col("method") != candidate).select(
        "universe", "tier", F.col("method").alias("reference"), F.col("exact_rate").alias("r_rate"),
        F.col("mdd_mae").alias("r_mdd"), (F.col("n_failed") == 0).alias("r_whole"))
    gain = F.col("c_rate") - F.col("r_rate")
    whole = F.col("c_whole") & F.col("r_whole")
    passed = whole & F.when(F.col("tier") == "small", gain > 0).otherwise(gain >= -tolerance)
    change = F.try_divide(F.col("c_mdd") - F.col("r_mdd"), F.col("r_mdd"))
    worse = F.when(F.col("r_mdd") == 0, F.col("c_mdd") > 0) \
        .otherwise(F.col("c_mdd") > F.col("r_mdd") * (1 + guard))
    return (a.join(b, ["universe", "tier"])
            .select("universe", "tier", "reference", gain.alias("gain"),
                    F.coalesce(passed, F.lit(False)).alias("passed"),
                    F.when(~whole, "incomplete paired grid").when(passed, "passed")
                    .otherwise("point estimate does not meet threshold").alias("reason"),
                    change.alias("relative_change"),
                    F.when(worse.isNotNull(), worse).alias("guard_triggered")))
