"""Resampling with a counter hash, so that any engine can repeat every draw."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dimension, materialize, spread
from . import graph, shocks

SEED = 20260926
REPLICATES = 2000
STRATIFIED_REPLICATES = 20_000


def draw(*parts: Column | int | str) -> Column:
    """A 32-bit number from the md5 of its parts."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string")
                              for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _reps(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def day_bootstrap(rows: DataFrame, keys: Sequence[str], top: Column, bottom: Column,
                  reps: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Per key and replicate, ``sum(top) / sum(bottom)`` over days drawn with replacement.

    All rows of a day stay together. Days are summed first; a key then holds one pair of numbers
    per calendar day, and each replicate reads that array without a shuffle. Keys with fewer
    than two days give no replicate.
    """
    days = rows.groupBy(*keys, "day").agg(F.sum(top).alias("a"), F.sum(bottom).alias("b"))
    packed = (days.groupBy(*keys)
              .agg(F.array_sort(F.collect_list(F.struct("day", "a", "b"))).alias("_d"))
              .filter(F.size("_d") >= 2))
    pick = lambda i: F.element_at("_d", (F.pmod(
        draw(seed, F.col("rep"), i), F.size("_d")) + 1).cast("int"))
    zero = F.struct(F.lit(0.0).cast("double").alias("a"), F.lit(0.0).cast("double").alias("b"))

    def add(acc: Column, i: Column) -> Column:
        day = pick(i)
        return F.struct((acc["a"] + day["a"]).alias("a"),
                        (acc["b"] + day["b"]).cast("double").alias("b"))

    drawn = F.aggregate(F.sequence(F.lit(0), F.size("_d") - 1), zero, add)
    # Replicates are spread over tasks in blocks: a handful of keys would be one task's work.
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = -(-reps // width)
    first = F.col("_block") * size
    return (packed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
            .filter(first < reps).repartition(width, *keys, "_block")
            .withColumn("rep", F.explode(F.sequence(
                first, F.least(first + size, F.lit(reps)) - 1)))
            .withColumn("_s", drawn)
            .select(*keys, "rep", F.size("_d").alias("n_days"),
                    F.try_divide("_s.a", "_s.b").alias("value")))


def interval(replicates: DataFrame, keys: Sequence[str], tail: float = 0.025) -> DataFrame:
    """Percentile interval of the defined replicates; their number is fixed by the caller."""
    return replicates.groupBy(*keys).agg(
        F.count("value").alias("replicates"), F.max("n_days").alias("n_days"),
        F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"))


def strata_weights(days: DataFrame, reps: int = STRATIFIED_REPLICATES, seed: int = SEED) -> DataFrame:
    """How often each wanted day is drawn when every stratum redraws all its calendar days.

    ``days`` has ``universe, period, day_no`` (0-based) and ``n_days`` of the stratum. Draws of
    days without data only matter for the count, so they are dropped right after the draw.
    """
    strata = days.select("universe", "period", "n_days").distinct()
    wanted = dimension(days.select("universe", "period", "day_no").distinct(), "days")
    width = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = (strata.withColumn("rep", _reps(reps)).repartition(width, "period", "rep")
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_days") - 1)))
             .withColumn("day_no", F.pmod(draw(seed, F.col("period"), F.col("rep"), F.col("i")),
                                          F.col("n_days")).cast("int")))
    return (draws.join(wanted, ["universe", "period", "day_no"], "left_semi")
            .groupBy("universe", "period", "day_no", "rep").agg(F.count("*").alias("w")))


def calendar_day(ts: Column, universe: Column) -> tuple[Column, Column]:
    """Day number inside its stratum (month of hourly bars, year of daily bars) and its length."""
    hourly = universe == "events"
    month_len = F.dayofmonth(F.last_day(ts))
    year_len = F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31)))
    return (F.when(hourly, F.dayofmonth(ts) - 1).otherwise(F.dayofyear(ts) - 1).cast("int"),
            F.when(hourly, month_len).otherwise(year_len).cast("int"))


def stratified_mean(values: DataFrame, weights: DataFrame, keys: Sequence[str],
                    family: int = 26) -> DataFrame:
    """Mean with a stratified day-bootstrap interval, only where n >= 10 on >= 5 days.

    ``values`` has ``universe, period, day_no, v`` and the keys. ``family`` sets the Bonferroni
    tail. Values are summed per (key, day) before they meet the replicates.
    """
    keys = list(keys)
    per_day = (values.filter("v is not null").groupBy("universe", "period", "day_no", *[
        k for k in keys if k != "universe"]).agg(F.sum("v").alias("s"), F.count("v").alias("c")))
    point = per_day.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.count("*").alias("n_days"),
        (F.sum("s") / F.sum("c")).alias("estimate"))
    stable = point.filter("n >= 10 and n_days >= 5")
    boot = (per_day.join(stable.select(*keys), keys, "left_semi")
            .join(weights, ["universe", "period", "day_no"])
            .groupBy(*keys, "rep")
            .agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("c"))).alias("m")))
    tail = 0.05 / (2 * family)
    bands = boot.groupBy(*keys).agg(
        F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"),
        F.percentile("m", tail).alias("adjusted_low"),
        F.percentile("m", 1 - tail).alias("adjusted_high"))
    return (point.withColumn("stable", F.expr("n >= 10 and n_days >= 5"))
            .join(bands, keys, "left"))


def stratified_contrast(values: DataFrame, weights: DataFrame, keys: Sequence[str],
                        family: int = 26) -> DataFrame:
    """Difference of the means of sides ``a`` and ``b`` under shared day weights.

    ``values`` also has ``side``; both sides need n >= 10 on >= 5 days for an interval.
    """
    keys = list(keys)
    free = [k for k in keys if k != "universe"]
    per_day = (values.filter("v is not null and side in ('a', 'b')")
               .groupBy("universe", "period", "day_no", *free, "side")
               .agg(F.sum("v").alias("s"), F.count("v").alias("c")))

    def on(side: str, col: Column) -> Column:
        return F.sum(F.when(F.col("side") == side, col))

    point = per_day.groupBy(*keys).agg(
        F.coalesce(on("a", F.col("c")), F.lit(0)).alias("n_a"),
        F.coalesce(on("b", F.col("c")), F.lit(0)).alias("n_b"),
        F.count_if(F.col("side") == "a").alias("days_a"),
        F.count_if(F.col("side") == "b").alias("days_b"),
        (F.try_divide(on("a", F.col("s")), on("a", F.col("c")))
         - F.try_divide(on("b", F.col("s")), on("b", F.col("c")))).alias("estimate"))
    fit = "least(n_a, n_b) >= 10 and least(days_a, days_b) >= 5"
    boot = (per_day.join(point.filter(fit).select(*keys), keys, "left_semi")
            .join(weights, ["universe", "period", "day_no"]).groupBy(*keys, "rep")
            .agg((F.try_divide(on("a", F.col("w") * F.col("s")), on("a", F.col("w") * F.col("c")))
                  - F.try_divide(on("b", F.col("w") * F.col("s")),
                                 on("b", F.col("w") * F.col("c")))).alias("m")))
    tail = 0.05 / (2 * family)
    bands = boot.groupBy(*keys).agg(
        F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"),
        F.percentile("m", tail).alias("adjusted_low"),
        F.percentile("m", 1 - tail).alias("adjusted_high"))
    return point.withColumn("stable", F.expr(fit)).join(bands, keys, "left")


REPS_PER_BLOCK = 500
VALUES_PER_SLICE, MOST_SLICES = 1024, 512
VALUES_PER_GROUP = 200_000


def _drawn(pdf: pd.DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Days and their weights, a column per replicate of the block; the last row is a day that was never drawn."""
    place = {d: i for i, d in enumerate(pdf["_day"])}
    matrix = np.zeros((len(place) + 1, REPS_PER_BLOCK), np.int64)
    for i, (at, times) in enumerate(zip(pdf["_at"], pdf["_times"])):
        matrix[i, np.asarray(at, int)] = np.asarray(times, int)
    return place, matrix


def weighted_medians(curves: DataFrame, weights: DataFrame, reps: int) -> DataFrame:
    """Median of event rows repeated by their weights: ``universe, tier, h, rep, value``.

    Both middle values are averaged, as for a plain median of the repeated rows. Equal values of a day
    are merged, and the values of a (tier, step) are cut into slices of about VALUES_PER_SLICE at
    proposed cuts. Weights times counts give the total of every slice in every replicate, the totals
    tell which slice holds a replicate's middle, and only that slice is summed up value by value.
    No row or task holds the events of a tier: a task sees VALUES_PER_GROUP values or so, and the
    weights (days x REPS_PER_BLOCK) of one block of replicates.
    """
    keys = ["universe", "tier", "h"]
    counted = curves.filter("ratio is not null").groupBy(
        *keys, F.col("ratio").cast("double").alias("ratio"), F.concat_ws("|", "period", "day_no").alias("_day")).agg(
        F.count("*").alias("_c"))
    counted = materialize(counted, "median-values")
    step = F.greatest(F.lit(1), F.floor(F.lit(MOST_SLICES * VALUES_PER_SLICE) / F.count("*")))
    cuts = dimension(counted.groupBy(*keys).agg(
        F.percentile_approx("ratio", [i / MOST_SLICES for i in range(1, MOST_SLICES)], 10_000).alias("_all"),
        step.alias("_step")).select(*keys, F.filter("_all", lambda c, i: (i + 1) % F.col("_step") == 0).alias("_cuts")), "cuts")
    packed = materialize(
        counted.join(cuts, keys).withColumn("_s", F.size(F.filter("_cuts", lambda c: c < F.col("ratio"))))
        .groupBy(*keys, "_s").agg(F.array_sort(F.collect_list(F.struct("ratio", "_day", "_c"))).alias("_p"))
        .select(*keys, "_s", *[F.col(f"_p.{c}").alias(c) for c in ("ratio", "_day", "_c")]), "median-slices")
    most = packed.groupBy("universe").agg(F.sum(F.size("ratio")).alias("n")).agg(F.max("n")).first()[0] or 0
    parts, blocks = 1 + most // VALUES_PER_GROUP, -(-reps // REPS_PER_BLOCK)
    part = F.pmod(F.xxhash64("tier", "h", "_s"), F.lit(parts)).cast("int").alias("_part")
    drawn = materialize(weights.filter(F.col("rep") < reps).groupBy(
        "universe", F.floor(F.col("rep") / REPS_PER_BLOCK).cast("int").alias("_block"),
        F.concat_ws("|", "period", "day_no").alias("_day")).agg(
        F.collect_list(F.struct((F.col("rep") % REPS_PER_BLOCK).cast("int").alias("i"), F.col("w").cast("int").alias("w"))).alias("_w"))
        .select("universe", "_block", "_day", F.col("_w.i").alias("_at"), F.col("_w.w").alias("_times")), "median-weights")
    drawn = drawn.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("universe", "_block", "_part")

    def totals(values: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
        place, matrix = _drawn(days)
        out = [np.asarray(r._3, np.int64) @ matrix[[place.get(d, len(place)) for d in r._2]]
               for r in values[["ratio", "_day", "_c"]].itertuples()]
        return values[["universe", "tier", "h", "_s", "_block"]].assign(_totals=out)

    spread = packed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("*", part)
    summed = spread.groupBy("universe", "_block", "_part").cogroup(drawn).applyInPandas(
        totals, "universe string, tier string, h int, _s int, _block int, _totals array<bigint>")
    steps = summed.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("_s", "_totals"))).alias("_t"))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Which slice holds the lower and the upper middle of each replicate, and its rank in there."""
        for pdf in batches:
            found = []
            for universe, tier, h, block, slices in pdf.itertuples(index=False):
                number = np.array([x["_s"] for x in slices])
                upto = np.cumsum([x["_totals"] for x in slices], axis=0)
                total = upto[-1]
                used = np.flatnonzero(total > 0)
                for rank, upper in (((total - 1) // 2, False), (total // 2, True)):
                    at = (upto > rank).argmax(axis=0)
                    local = rank - np.where(at > 0, upto[at - 1, np.arange(len(at))], 0)
                    for k in np.unique(at[used]):
                        mine = used[at[used] == k]
                        found.append((universe, tier, h, int(number[k]), block, upper, mine.tolist(), local[mine].tolist()))
            yield pd.DataFrame(found, columns=["universe", "tier", "h", "_s", "_block", "_upper", "_reps", "_ranks"])

    wanted = steps.select(*keys, "_block", "_t").mapInPandas(
        places, "universe string, tier string, h int, _s int, _block int, _upper boolean, _reps array<int>, _ranks array<bigint>")
    wanted = wanted.groupBy(*keys, "_s", "_block").agg(*[
        F.max(F.when(F.col("_upper") == upper, F.col(c))).alias(c + name)
        for upper, name in ((False, "_low"), (True, "_high")) for c in ("_reps", "_ranks")])

    def middles(values: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
        """Both middle values of a replicate, or the one of them that lies in the slice."""
        place, matrix = _drawn(days)
        out = []
        for row in values.to_dict("records"):
            ratio, count = np.asarray(row["ratio"], float), np.asarray(row["_c"], np.int64)
            upto = (matrix[[place.get(d, len(place)) for d in row["_day"]]] * count[:, None]).cumsum(axis=0)
            halves = {}
            for name in ("_low", "_high"):
                halves[name] = np.full(REPS_PER_BLOCK, np.nan)
                if row["_reps" + name] is not None:
                    rep, rank = np.asarray(row["_reps" + name], int), np.asarray(row["_ranks" + name])
                    halves[name][rep] = ratio[(upto[:, rep] > rank).argmax(axis=0)]
            rep = np.flatnonzero(~(np.isnan(halves["_low"]) & np.isnan(halves["_high"])))
            out.append(pd.DataFrame({"universe": row["universe"], "tier": row["tier"], "h": row["h"],
                                     "rep": row["_block"] * REPS_PER_BLOCK + rep, "low": halves["_low"][rep], "high": halves["_high"][rep]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["universe", "tier", "h", "rep", "low", "high"])

    found = materialize(packed.join(wanted, [*keys, "_s"]).select("*", part).groupBy("universe", "_block", "_part").cogroup(
        drawn).applyInPandas(middles, "universe string, tier string, h int, rep bigint, low double, high double"), "median-halves")
    low, high = F.nanvl("low", F.lit(None)), F.nanvl("high", F.lit(None))
    found = found.select(*keys, "rep", low.alias("low"), high.alias("high"))
    both = F.col("low").isNotNull() & F.col("high").isNotNull()
    value = ((F.col("low") + F.col("high")) / 2).alias("value")
    apart = found.filter(~both).groupBy(*keys, "rep").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    return found.filter(both).select(*keys, "rep", value).unionByName(apart.select(*keys, "rep", value))


def simultaneous_band(replicates: DataFrame, points: DataFrame, keys: Sequence[str],
                      over: str) -> DataFrame:
    """Half-width factor of a band that covers all ``over`` values at once (95 %)."""
    spread = replicates.groupBy(*keys, over).agg(F.stddev_pop("value").alias("sd"))
    score = F.abs(F.col("value") - F.col("estimate")) / F.col("sd")
    worst = (replicates.join(points, [*keys, over]).join(spread, [*keys, over])
             .filter("sd > 0").groupBy(*keys, "rep").agg(F.max(score).alias("m")))
    return worst.groupBy(*keys).agg(F.percentile("m", 0.95).alias("factor"))


def shifted_triggers(triggers: DataFrame, spans: DataFrame, reps: int, seed: int = SEED
                     ) -> DataFrame:
    """Every replicate moves each asset's triggers round the grid by one offset of its own."""
    offset = F.pmod(draw(seed, F.col("rep"), F.col("asset")), F.col("n"))
    return (triggers.join(spans.select("universe", "n"), "universe")
            .withColumn("rep", _reps(reps))
            .withColumn("idx", F.pmod(F.col("idx") + offset, F.col("n"))).drop("n"))


def graph_statistics(triggers: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Event and edge statistics of the merged, eligible events of each key."""
    keys = list(keys)
    events = shocks.merge_events(triggers, spans, keys)
    ready = events.filter("eligible").select(*keys, "t0", "origins")
    follow = graph.follow_ups(ready, triggers, keys)
    obs = graph.observations(ready, follow, keys)
    edges = obs.groupBy(*keys, "source", "target").agg(F.count("*").alias("c"),
                                                       F.sum("delay").alias("d"))
    stats = edges.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.sum("c").alias("observations"),
        (F.sum("d") / F.sum("c")).alias("mean_delay"),
        F.avg(F.col("d") / F.col("c")).alias("edge_mean_delay"))
    counts = events.groupBy(*keys).agg(F.count("*").alias("merged"),
                                       F.count_if("eligible").alias("eligible"))
    return counts.join(stats, keys, "left").fillna({"pairs": 0, "observations": 0})


def null_graphs(triggers: DataFrame, spans: DataFrame, reps: int, seed: int = SEED) -> DataFrame:
    """Graph statistics of every shifted replicate, stored; tasks grow in number with the shifted rows, not in size."""
    with spread(triggers.sparkSession, triggers.count() * reps):
        return materialize(graph_statistics(shifted_triggers(triggers, spans, reps, seed), spans, ["universe", "rep"]),
                           "null-graphs")


TAILS = {"pairs": "upper", "observations": "upper", "mean_delay": "lower",
         "edge_mean_delay": "lower"}


def tall(df: DataFrame, out: str, extra: Sequence[str]) -> DataFrame:
    """One row per statistic, its value in ``out``."""
    cells = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias(out)) for s in TAILS])
    return df.select("universe", *extra, F.explode(cells).alias("_c")).select("universe", *extra, "_c.*")


def null_summary(null: DataFrame) -> DataFrame:
    """Quantiles of each statistic over the replicates that define it, and the count of those that do not."""
    return tall(null, "v", ["rep"]).groupBy("universe", "statistic").agg(
        F.count("*").alias("replicates"), F.count_if(F.col("v").isNull()).alias("empty"),
        *[F.percentile("v", q).alias(name) for name, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))])


def tail_tests(real: DataFrame, null: DataFrame, reps: int) -> DataFrame:
    """Plus-one Monte Carlo p per statistic; an undefined null delay counts as infinite."""
    draws = tall(null, "null_value", ["rep"]).withColumn(
        "null_value", F.coalesce("null_value", F.lit(float("inf"))))
    upper = F.col("statistic").isin("pairs", "observations")
    extreme = F.when(upper, F.col("null_value") >= F.col("real")) \
        .otherwise(F.col("null_value") <= F.col("real"))
    finite = F.when(F.col("null_value") < float("inf"), F.col("null_value"))
    return (tall(real, "real", []).join(draws, ["universe", "statistic"])
            .groupBy("universe", "statistic")
            .agg(F.max("real").alias("real"), F.count_if(extreme).alias("extreme"),
                 F.avg(finite).alias("null_mean"))
            .withColumn("p", (1 + F.col("extreme")) / (1 + reps)))


def holm(rows: DataFrame, keys: Sequence[str], p: str = "p", name: str = "statistic"
         ) -> DataFrame:
    """Holm step-down adjusted p values inside each family."""
    order = Window.partitionBy(*keys).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*keys))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return (rows.withColumn("_step", step)
            .withColumn("p_holm", F.max("_step").over(order)).drop("_step"))


def stable_candidate(combined: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The adjusted interval excludes zero and every stable period agrees in sign."""
    agree = (parts.join(combined.select(*keys, F.col("estimate").alias("_all")), list(keys))
             .groupBy(*keys).agg(F.bool_and(F.coalesce(
                 F.col("stable") & (F.col("estimate") * F.col("_all") > 0), F.lit(False)))
                 .alias("_agree")))
    outside = (F.col("adjusted_low") > 0) | (F.col("adjusted_high") < 0)
    return (combined.join(agree, list(keys), "left")
            .withColumn("candidate", F.coalesce(F.col("stable") & outside & F.col("_agree"),
                                                F.lit(False))).drop("_agree"))
