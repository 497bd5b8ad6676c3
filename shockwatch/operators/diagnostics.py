"""Secondary analyses of scored events: groups, omissions, coverage, tails, failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import declared_rank, rank_scores
from ..session import dimension
from .quantiles import exact_quantiles


def session(ts: Column) -> Column:
    """Trading session by UTC hour."""
    hour = F.hour(ts)
    return F.when(hour < 8, "Asia").when(hour < 16, "Europe").otherwise("Americas")


def strength(z: Column, cut: float = 8) -> Column:
    return F.when(z < cut, "below").otherwise("strong")


def segment_of_month(ts: Column) -> Column:
    """Calendar segment 0..3: seven-day blocks, the last one open-ended."""
    return F.least(F.floor((F.dayofmonth(ts) - 1) / 7), F.lit(3)).cast("int")


def quartile_regimes(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Number of the linear 25/50/75 cutoffs below each value (ties stay below)."""
    cuts = (exact_quantiles(rows, keys, value, [0.25, 0.5, 0.75])
            .groupBy(*keys).agg(F.collect_list("value").alias("_cuts")))
    return (rows.join(dimension(cuts, "quartiles"), list(keys))
            .withColumn("bucket", F.size(F.filter("_cuts", lambda c: F.col(value) > c)))
            .drop("_cuts"))


def group_axes(pairs: DataFrame, events: DataFrame, cut: float) -> DataFrame:
    """Scores on three overlapping axes: tier, shock strength and the systemic flag.

    The tier axis restricts the assets of an event; the other two keep all of them. With fewer
    than three assets the top-3 recall is null, and a group without events still has its row.
    """
    tagged = pairs.join(events.select(
        "universe", "t0", strength(F.col("magnitude"), cut).alias("strength"),
        F.when(F.col("systemic"), "systemic").otherwise("non_systemic").alias("flag")),
        ["universe", "t0"])
    axes = F.array(F.struct(F.lit("tier").alias("axis"), F.col("tier").alias("grp")),
                   F.struct(F.lit("strength").alias("axis"), F.col("strength").alias("grp")),
                   F.struct(F.lit("systemic").alias("axis"), F.col("flag").alias("grp")))
    long = tagged.withColumn("_a", F.explode(axes)).select("*", "_a.*").drop("_a")
    keys = ["universe", "t0", "method", "axis", "grp"]
    vol = rank_scores(long.filter("metric = 'volatility'"), keys)
    mdd = long.filter("metric = 'max_drawdown'").groupBy(*keys).agg(
        F.avg(F.abs(F.col("p") - F.col("a"))).alias("mdd_mae"))
    per_event = vol.join(mdd, keys).withColumn(
        "top3", F.when(F.col("asset_count") >= 3, F.col("recall")))
    labels = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(g).alias("grp")) for a, g in (
        ("tier", "major"), ("tier", "small"), ("strength", "below"), ("strength", "strong"),
        ("systemic", "systemic"), ("systemic", "non_systemic"))])
    grid = (pairs.select("universe", "method").distinct().withColumn("_l", F.explode(labels))
            .select("universe", "method", "_l.*"))
    stats = per_event.groupBy("universe", "method", "axis", "grp").agg(
        F.count("*").alias("events"), F.avg("mdd_mae").alias("mdd_mae"),
        F.count("top3").alias("top3_defined"), F.avg("top3").alias("top3"))
    return (grid.join(stats, ["universe", "method", "axis", "grp"], "left")
            .fillna({"events": 0, "top3_defined": 0}))


def direction_decomposition(scores: DataFrame, events: DataFrame, model: str) -> DataFrame:
    """Baseline minus model drawdown error by shock direction, its share of the total gap."""
    mae = scores.filter("metric = 'max_drawdown'").select("universe", "t0", "method", "mae")
    own = mae.filter(F.col("method") == model).select("universe", "t0", F.col("mae").alias("m"))
    rows = (mae.filter(F.col("method") != model).join(own, ["universe", "t0"])
            .join(events.select("universe", "t0", "direction"), ["universe", "t0"])
            .withColumn("gap", F.col("mae") - F.col("m")))
    whole = rows.groupBy("universe", "method").agg(F.count("*").alias("n_all"),
                                                   F.avg("gap").alias("gap_all"))
    return (rows.groupBy("universe", "method", "direction")
            .agg(F.count("*").alias("n"), F.avg("gap").alias("gap"))
            .join(whole, ["universe", "method"])
            .withColumn("contribution", F.col("n") / F.col("n_all") * F.col("gap"))
            .withColumn("share", F.try_divide("contribution", "gap_all")))


def sign_accuracy(signs: DataFrame, events: DataFrame) -> DataFrame:
    """Terminal-sign accuracy on common binary pairs, with always-continue and always-reverse.

    ``signs`` has ``universe, t0, asset, method, sign, actual``. Common pairs need a known shock
    direction and a realised move.
    """
    known = F.col("direction") != 0
    with_dir = signs.join(events.select("universe", "t0", "direction"), ["universe", "t0"])
    base = with_dir.select("universe", "t0", "asset", "actual", "direction").distinct()
    rules = base.withColumn("_r", F.explode(F.array(
        F.struct(F.lit("always_continue").alias("method"), F.when(known, F.col("direction"))
                 .alias("sign")),
        F.struct(F.lit("always_reverse").alias("method"), F.when(known, -F.col("direction"))
                 .alias("sign"))))).select("universe", "t0", "asset", "actual", "direction", "_r.*")
    every = with_dir.select(*rules.columns).unionByName(rules)
    common = known & (F.col("actual") != 0)
    right = F.col("sign") == F.col("actual")
    return every.groupBy("universe", "method").agg(
        F.count_if(common).alias("common_pairs"), F.count_if(common & right).alias("correct"),
        F.count_if(common & (F.col("sign") == 0)).alias("flat"),
        F.count_if(F.col("sign").isNull()).alias("unavailable"),
        F.try_divide(F.count_if(common & right), F.count_if(common)).alias("accuracy"))


def advantage_radius(segments: DataFrame, model: str, baseline: str) -> DataFrame:
    """Minutes of the unbroken run of segments, from the start, in which the model is better."""
    side = lambda m, out: F.avg(F.when(F.col("method") == m, F.col("mae"))).alias(out)
    per = (segments.groupBy("universe", "metric", "segment")
           .agg(side(model, "m"), side(baseline, "b"))
           .withColumn("better", F.coalesce(F.col("m") < F.col("b"), F.lit(False))))
    joint = (per.groupBy("universe", "segment").agg(F.bool_and("better").alias("better"))
             .withColumn("metric", F.lit("joint")))
    run = Window.partitionBy("universe", "metric").orderBy("segment")
    return (per.select("universe", "metric", "segment", "better").unionByName(joint)
            .withColumn("_prefix", F.bool_and("better").over(run))
            .groupBy("universe", "metric").agg((10 * F.count_if(F.col("_prefix"))).alias("_m"))
            .withColumn("radius", F.when(F.col("_m") > 0, F.col("_m"))).drop("_m"))


def omissions(predicted: DataFrame, actual: DataFrame, assets: DataFrame, limit: int = 3
              ) -> DataFrame:
    """Unselected assets whose realised risk exceeds the weakest selected one, per metric.

    Selection ranks predicted volatility, ties in declared order. ``relative`` is null when the
    weakest selected value is zero.
    """
    keys = ("universe", "t0")
    ranked = (predicted.join(assets.select("universe", "asset", "ordinal"), ["universe", "asset"])
              .withColumn("place", declared_rank(keys, "vol", "ordinal"))
              .select(*keys, "asset", (F.col("place") <= limit).alias("selected")))
    long = (ranked.join(actual, [*keys, "asset"]).select(
        *keys, "asset", "selected", F.explode(F.array(
            F.struct(F.lit("volatility").alias("metric"), F.col("vol").alias("actual")),
            F.struct(F.lit("max_drawdown").alias("metric"), F.col("mdd").alias("actual"))))
        .alias("_m")).select(*keys, "asset", "selected", "_m.*"))
    per = Window.partitionBy(*keys, "metric")
    return (long.withColumn("weakest", F.min(F.when(F.col("selected"), F.col("actual"))).over(per))
            .withColumn("missed", ~F.col("selected") & (F.col("actual") > F.col("weakest")))
            .withColumn("excess_bps", F.when(F.col("missed"),
                                             (F.col("actual") - F.col("weakest")) * 10000))
            .withColumn("relative", F.when(F.col("missed"), F.try_divide(
                F.col("actual") - F.col("weakest"), F.col("weakest")))))


def omission_summary(rows: DataFrame) -> DataFrame:
    """Event omission rates per metric, in either and in both metrics, with missed counts."""
    per = rows.groupBy("universe", "t0", "metric").agg(F.count_if(F.col("missed")).alias("c"))
    union = (rows.groupBy("universe", "t0", "asset").agg(F.bool_or("missed").alias("m"))
             .groupBy("universe", "t0").agg(F.count_if(F.col("m")).alias("c")))
    both = per.groupBy("universe", "t0").agg(F.min("c").alias("c"))
    tall = (per.select("universe", "t0", F.col("metric").alias("scope"), "c")
            .unionByName(union.withColumn("scope", F.lit("either")))
            .unionByName(both.withColumn("scope", F.lit("both"))))
    return tall.groupBy("universe", "scope").agg(
        F.count("*").alias("events"), F.count_if(F.col("c") > 0).alias("omitted"),
        F.avg((F.col("c") > 0).cast("int")).alias("rate"),
        F.sum("c").alias("missed_pairs"), F.avg("c").alias("mean_missed"))


def amplitude_cases(rows: DataFrame, digits: int | None = 9) -> DataFrame:
    """The missed asset closest to the 90 % quantile of relative excess, and the largest one.

    A quantile halfway between two values is as far from both, so distances are equal to ``digits``
    decimals; with None the doubles decide as they are, which is SQL's rule.
    """
    keys = ["universe", "metric"]
    hit = rows.filter("relative is not null")
    p90 = exact_quantiles(hit, keys, "relative", [0.9]).select(*keys, F.col("value").alias("p90"))
    gap = F.abs(F.col("relative") - F.col("p90"))
    near = F.struct((gap if digits is None else F.round(gap, digits)).alias("d"), "t0", "asset")
    big = F.struct((-F.col("relative")).alias("d"), "t0", "asset")
    return (hit.join(dimension(p90, "p90"), keys).groupBy(*keys)
            .agg(F.max("p90").alias("p90"), F.min(near).alias("n"), F.min(big).alias("b"))
            .select(*keys, "p90", F.col("n.t0").alias("near_t0"), F.col("n.asset").alias("near_asset"),
                    F.col("b.t0").alias("max_t0"), F.col("b.asset").alias("max_asset"),
                    (-F.col("b.d")).alias("max_relative")))


def coverage(rows: DataFrame, low: str, high: str, value: str) -> DataFrame:
    """Where the realised value lies against an interval; the bounds are inside."""
    v, a, b = F.col(value), F.col(low), F.col(high)
    return rows.withColumn("position", F.when(a.isNull() | b.isNull() | v.isNull() | (a > b),
                                              "invalid")
                           .when(v < a, "below").when(v > b, "above").otherwise("covered"))


def path_quantiles(rows: DataFrame, keys: Sequence[str], value: str, paths: int) -> DataFrame:
    """Mean, p05, p50 and p95 over the paths of a key, null unless all paths are there.

    A key holds one value per path, a number fixed by the forecast.
    """
    whole = F.count(value) == paths
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n_paths"), F.when(whole, F.avg(value)).alias("mean"),
        *[F.when(whole, F.percentile(value, q)).alias(n)
          for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))])


def tail_flags(rows: DataFrame, keys: Sequence[str], value: str, q: float = 0.9) -> DataFrame:
    """Flags values at or above the key's linear 90 % quantile; null stays null."""
    cut = exact_quantiles(rows, keys, value, [q]).select(*keys, F.col("value").alias("cutoff"))
    return (rows.join(dimension(cut, "tail"), list(keys), "left")
            .withColumn("worst", F.col(value) >= F.col("cutoff")))


def failure_profile(rows: DataFrame, score: str, fields: Sequence[str], top: int = 10
                    ) -> DataFrame:
    """Share of each field value among the ten worst events and in the whole population."""
    place = F.row_number().over(Window.partitionBy("universe").orderBy(F.desc(score), "t0"))
    # row_number with a limit keeps only each task's own top rows before the shuffle.
    first = (rows.select("universe", "t0", score).withColumn("_place", place)
             .filter(F.col("_place") <= top).select("universe", "t0", F.lit(True).alias("_w")))
    ranked = (rows.join(dimension(first, "worst"), ["universe", "t0"], "left")
              .withColumn("_worst", F.coalesce("_w", F.lit(False))))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("label"))
                      for f in fields])
    tall = ranked.withColumn("_c", F.explode(cells)).select("universe", "_worst", "_c.*")
    return (tall.groupBy("universe", "field", "label")
            .agg(F.count_if(F.col("_worst")).alias("worst"), F.count("*").alias("population"))
            .withColumn("worst_share", F.try_divide(F.col("worst"), F.sum("worst").over(
                Window.partitionBy("universe", "field"))))
            .withColumn("population_share", F.col("population") / F.sum("population").over(
                Window.partitionBy("universe", "field"))))
