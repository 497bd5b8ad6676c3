"""Follow-up graph, fingerprints and nearest events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bandjoin import band_join
from .quantiles import exact_quantiles

FOLLOW = 30
KEYS = ("universe",)


def origin_mismatch(events: DataFrame, triggers: DataFrame, keys: Sequence[str] = KEYS
                    ) -> DataFrame:
    """Events whose origins are not exactly the triggers at their first bar."""
    seen = triggers.groupBy(*keys, F.col("idx").alias("t0")).agg(
        F.array_sort(F.collect_set("asset")).alias("seen"))
    return (events.join(seen, [*keys, "t0"], "left")
            .filter(~F.array_sort("origins").eqNullSafe(F.col("seen"))))


def follow_ups(events: DataFrame, triggers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First trigger of each non-origin asset in ``(t0, t0 + 30]``."""
    after = triggers.select(*keys, F.col("idx").alias("_t"), "asset",
                            "direction", "magnitude")
    return (band_join(events.select(*keys, "t0", "origins"), after, keys, 1, FOLLOW, "t0", "_t")
            .filter(~F.array_contains("origins", F.col("asset")))
            .groupBy(*keys, "t0", "asset")
            .agg((F.min("_t") - F.col("t0")).cast("int").alias("delay"),
                 F.min_by("direction", "_t").alias("direction"),
                 F.min_by("magnitude", "_t").alias("magnitude")))


def slots(events: DataFrame, triggers: DataFrame, keys: Sequence[str] = KEYS,
          follow: DataFrame | None = None) -> DataFrame:
    """Present fingerprint slots: origins at delay 0 and first follow-ups."""
    follow = follow_ups(events, triggers, keys) if follow is None else follow
    at_origin = (events.select(*keys, "t0", F.explode("origins").alias("asset"))
                 .join(triggers.select(*keys, F.col("idx").alias("t0"), "asset", "direction",
                                       "magnitude"), [*keys, "t0", "asset"])
                 .withColumn("delay", F.lit(0)))
    return at_origin.unionByName(follow)


def fingerprints(slot_rows: DataFrame, events: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per event with a dense slot array in declared asset order; absent slots null."""
    grid = events.select("universe", "t0").join(assets.select("universe", "asset", "ordinal"),
                                                "universe")
    packed = F.struct("ordinal", F.col("delay").isNotNull().alias("present"), "direction",
                      "magnitude", "delay")
    return (grid.join(slot_rows, ["universe", "t0", "asset"], "left")
            .groupBy("universe", "t0")
            .agg(F.array_sort(F.collect_list(packed)).alias("fp")))


def censor(slot_rows: DataFrame, minutes: int) -> DataFrame:
    """Keep what was observable ``minutes`` after the origin."""
    return slot_rows.filter(F.col("delay") <= minutes)


def component(lp: Column, rp: Column, ld: Column, rdir: Column, lm: Column, rm: Column,
              lt: Column, rt: Column) -> Column:
    """Distance of one slot pair: 0 both absent, 1 on presence mismatch, else a mean of three."""
    dz = F.abs(F.log1p(lm) - F.log1p(rm))
    return (F.when(~lp & ~rp, 0.0).when(lp != rp, 1.0)
            .otherwise(((ld != rdir).cast("double") + dz / (1 + dz) + F.abs(lt - rt) / 30) / 3))


def opportunities(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """How often each asset was an origin; every tied origin counts once."""
    return (events.select(*keys, F.explode("origins").alias("source"))
            .groupBy(*keys, "source").agg(F.count("*").alias("source_events")))


def observations(events: DataFrame, follow: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per (event, origin, followed asset)."""
    return (events.select(*keys, "t0", F.explode("origins").alias("source"))
            .join(follow.withColumnRenamed("asset", "target"), [*keys, "t0"]))


def edge_table(obs: DataFrame, chances: DataFrame, assets: DataFrame) -> DataFrame:
    """All ordered asset pairs with count, mean delay, median magnitude and follow-up rate."""
    left = assets.select("universe", F.col("asset").alias("source"))
    grid = left.join(assets.select("universe", F.col("asset").alias("target")), "universe")
    keys = ["universe", "source", "target"]
    middle = exact_quantiles(obs, keys, "magnitude", [0.5]).select(
        *keys, F.col("value").alias("median_magnitude"))
    stats = obs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("delay").alias("mean_delay")) \
        .join(middle, keys)
    count = F.coalesce("n", F.lit(0))
    return (grid.join(stats, ["universe", "source", "target"], "left")
            .join(chances, ["universe", "source"], "left")
            .withColumn("n", count)
            .withColumn("source_events", F.coalesce("source_events", F.lit(0)))
            .withColumn("rate", F.when(F.col("source") != F.col("target"),
                                       F.try_divide("n", "source_events"))))


def timelines(slot_rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets grouped by delay, in declared order, per event."""
    at = F.struct("ordinal", "asset")
    return (slot_rows.join(assets.select("universe", "asset", "ordinal"), ["universe", "asset"])
            .groupBy("universe", "t0", "delay")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)),
                                          lambda x: x["asset"]), "|").alias("assets")))


def strongest_sequences(events: DataFrame, follow: DataFrame, k: int = 3) -> DataFrame:
    """Most followed assets, then strongest shock, then earliest; events with a follow-up only."""
    breadth = follow.groupBy("universe", "t0").agg(F.count("*").alias("breadth"))
    w = Window.partitionBy("universe").orderBy(F.desc("breadth"), F.desc("magnitude"), "t0")
    return (events.join(breadth, ["universe", "t0"]).withColumn("place", F.row_number().over(w))
            .filter(F.col("place") <= k))


def strongest_edges(edges: DataFrame) -> DataFrame:
    """Per source the edge with most observations; shorter delay, then target, break ties."""
    w = Window.partitionBy("universe", "source").orderBy(F.desc("n"), "mean_delay", "target")
    return edges.filter("n > 0").withColumn("place", F.row_number().over(w)).filter("place = 1")


def numeric(prints: DataFrame) -> DataFrame:
    """Fingerprints as four number arrays: presence, direction, log magnitude and delay."""
    def column(value: Callable[[Column], Column]) -> Column:
        return F.transform("fp", lambda s: F.coalesce(value(s).cast("double"), F.lit(0.0)))

    return prints.select(*[c for c in prints.columns if c != "fp"], F.size("fp").alias("n"),
                         column(lambda s: s["present"]).alias("p"), column(lambda s: s["direction"]).alias("d"),
                         column(lambda s: F.log1p(s["magnitude"])).alias("m"), column(lambda s: s["delay"]).alias("l"))


def stacked(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Dense (event, asset) matrices of numeric fingerprints."""
    p, d, m, lag = (np.stack(pdf[c].to_numpy()) for c in ("p", "d", "m", "l"))
    return p > 0, d, m, lag


def distances(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> np.ndarray:
    """Mean slot distance of every left row to every right row."""
    i, j = np.divmod(np.arange(len(left[0]) * len(right[0])), max(len(right[0]), 1))
    return pair_distances(left, right, i, j).reshape(len(left[0]), len(right[0]))


def pair_distances(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Mean slot distance of left rows ``i`` to right rows ``j``, one asset column at a time."""
    total = np.zeros(len(i))
    for a in range(left[0].shape[1]):
        (lp, ld, lm, ll), (rp, rd, rm, rl) = ([x[:, a][at] for x in side] for side, at in ((left, i), (right, j)))
        dz = np.abs(lm - rm)
        both = ((ld != rd) + dz / (1 + dz) + np.abs(ll - rl) / 30) / 3
        total += np.where(lp & rp, both, (lp != rp).astype(float))
    return np.round(total / left[0].shape[1], 12)


def mask_mismatch(left: np.ndarray, right: np.ndarray, low: int, high: int, segment: int) -> np.ndarray:
    """In how many assets the presence of each pair differs; -1 where the pair is not this bucket's to look at.

    A bucket holds the prints that agree in one segment. The pair belongs to the first segment in
    which it agrees, and to the pass whose range holds its mismatch.
    """
    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.astype(np.float32), b.astype(np.float32)
        return a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)

    found = apart(left, right)
    mine = (found >= low) & (found <= high)
    for s in range(segment + 1):
        differs = apart(left[:, s::high + 1], right[:, s::high + 1]) > 0
        mine &= ~differs if s == segment else differs
    return np.where(mine, found, -1)


def dealt(rows: DataFrame, keys: Sequence[str], name: str, block: int) -> DataFrame:
    """Rows with a block number: about ``block`` rows of one key share a block."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    return rows.join(counts, list(keys)).withColumn(name, F.pmod(F.xxhash64("t0"), F.col("_blocks"))).drop("_blocks")


def nearest_events(queries: DataFrame, library: DataFrame, k: int = 3, block: int = 1024,
                   compared: list[int] | None = None) -> DataFrame:
    """The k nearest library events of each query by (distance, time), itself excluded.

    Both sides have ``universe, t0, fp``. A pair is at least as far apart as its presence masks
    differ, over the number of assets. Passes widen the mismatch looked at (0 to 1, 2 to 3, 4 to 7,
    ...); a query is done once its k-th best lies below the bound of the next pass, and looks at no pair
    whose bound is beyond its k-th best. Masks that differ in at most r assets agree in one of r + 1
    segments, so prints meet by equality of a segment instead of every mask with every mask. Buckets
    meet in blocks, which bounds each task on both sides; the pairs themselves never leave it. The
    last pass, whose range no segment count serves, compares what is left. ``compared`` takes the number of
    distances of each pass.
    """
    names = "universe string, t0 bigint, neighbour bigint, distance double, looked bigint"
    lib = materialize(numeric(library.select("universe", "t0", "fp")), "library")
    waiting = lib if queries is library else materialize(numeric(queries.select("universe", "t0", "fp")), "queries")
    waiting = waiting.withColumn("_far", F.lit(None).cast("double"))
    bucket, meet = ["universe", "segment", "value"], ["universe", "segment", "value", "qb", "lb"]
    w = Window.partitionBy("universe", "t0").orderBy("distance", "neighbour")
    best, low, high = None, 0, 1

    def in_segments(rows: DataFrame, high: int) -> DataFrame:
        """A row per segment of the mask, with the presence in it; one row without where the range covers all assets."""
        split = rows.withColumn("segment", F.explode(F.when(F.col("n") > high, F.sequence(F.lit(0), F.lit(high))).otherwise(
            F.array(F.lit(-1)))))
        bits = F.filter("p", lambda _, i: F.pmod(i, F.lit(high + 1)) == F.col("segment"))
        return split.withColumn("value", F.array_join(F.transform(bits, lambda x: x.cast("int").cast("string")), ""))

    def near(key: tuple, a: pd.DataFrame, b: pd.DataFrame, low: int, high: int) -> pd.DataFrame:
        rows = []
        if not a.empty and not b.empty:
            b = b.sort_values("t0", ignore_index=True)
            right, times = stacked(b), b["t0"].to_numpy()
            for lo in range(0, len(a), 256):
                part = a.iloc[lo:lo + 256]
                left, own = stacked(part), part["t0"].to_numpy()
                apart = mask_mismatch(left[0], right[0], low, high, key[1])
                limit = part["_far"].fillna(np.inf).to_numpy(float) * left[0].shape[1] + 1e-6
                i, j = np.nonzero((apart >= 0) & (apart <= limit[:, None]) & (own[:, None] != times[None, :]))
                d = np.full(apart.shape, np.inf)
                for at in range(0, len(i), 1 << 16):
                    ii, jj = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
                    d[ii, jj] = pair_distances(left, right, ii, jj)
                order, looked = np.argsort(d, axis=1, kind="stable")[:, :k], np.bincount(i, minlength=len(part))
                for q in np.nonzero(looked)[0]:
                    rows += [(key[0], own[q], times[c], d[q, c], 0 if at else looked[q])
                             for at, c in enumerate(order[q]) if np.isfinite(d[q, c])]
        return pd.DataFrame(rows, columns=["universe", "t0", "neighbour", "distance", "looked"])

    def between(low: int, high: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        return lambda key, a, b: near(key, a, b, low, high)

    while True:
        asked, held = in_segments(waiting, high), in_segments(lib, high)
        blocks = [x.groupBy(*bucket).agg(F.ceil(F.count("*") / block).alias(name))
                  for x, name in ((asked, "_qn"), (held, "_ln"))]
        blocks = materialize(blocks[0].join(blocks[1], bucket), "buckets")
        sides = []
        for rows, own, other in ((asked, "q", "l"), (held, "l", "q")):
            rows = rows.join(blocks, bucket).withColumn(f"{own}b", F.pmod(F.xxhash64("t0"), F.col(f"_{own}n"))).withColumn(
                f"{other}b", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_{other}n") - 1)))
            # both sides come from one table; aliases give each its own columns
            sides.append(rows.select(*[F.col(c).alias(c) for c in rows.columns if c not in ("_qn", "_ln")]).groupBy(*meet))
        found = sides[0].cogroup(sides[1]).applyInPandas(between(low, high), names)
        if compared is not None:
            found = materialize(found, "found")
            compared.append(found.agg(F.sum("looked")).first()[0] or 0)
        found = found.drop("looked")
        ranked = (found if best is None else best.unionByName(found)).withColumn(
            "place", F.row_number().over(w)).filter(F.col("place") <= k)
        best = materialize(ranked.drop("place"), "nearest")
        low, high = high + 1, 2 * high + 1
        done = best.groupBy("universe", "t0").agg(F.count("*").alias("_c"), F.max("distance").alias("_m"))
        left = waiting.drop("_far").join(done, ["universe", "t0"], "left").withColumn(
            "_far", F.when(F.col("_c") >= k, F.col("_m")))
        waiting = materialize(left.filter((F.col("n") >= low) & (F.col("_far").isNull() | (
            F.col("_far") >= F.lit(float(low)) / F.col("n") - 1e-9))).drop("_c", "_m"), "queries")
        if waiting.isEmpty():
            return best.withColumn("place", F.row_number().over(w))


def pair_summary(prints: DataFrame, block: int = 1024) -> DataFrame:
    """Per event, its mean distance to the others of its period and its nearest one.

    A period is cut into blocks of events; each pair of blocks adds a sum and a minimum per event,
    so a long period is many tasks and no pair leaves its task.
    """
    keys = ["universe", "period"]
    rows = materialize(dealt(numeric(prints.select(*keys, "t0", "fp")), keys, "b", block), "period-prints")
    blocks = rows.select(*keys, "b").distinct()

    def side(own: str, other: str) -> DataFrame:
        # Aliases give each side its own columns; both come from one table.
        fresh = rows.select(*[F.col(c).alias(own if c == "b" else c) for c in rows.columns])
        return fresh.join(blocks.withColumnRenamed("b", other), keys)

    left, right = side("lb", "rb"), side("rb", "lb")

    def add(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("t0", ignore_index=True)
        right_m, times, out = stacked(b), b["t0"].to_numpy(), []
        for lo in range(0, len(a), 256):
            part = a.iloc[lo:lo + 256]
            own = part["t0"].to_numpy()[:, None] == times[None, :]
            d = distances(stacked(part), right_m)
            total = np.where(own, 0, d).sum(axis=1)
            d[own] = np.inf
            at = d.argmin(axis=1)
            out.append(pd.DataFrame({
                "universe": key[0], "period": key[1], "t0": part["t0"].to_numpy(), "total": total,
                "others": (~own).sum(axis=1), "nearest": times[at], "least": d[np.arange(len(part)), at]}))
        return pd.concat(out)

    meet = [*keys, "lb", "rb"]
    parts = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(
        add, "universe string, period string, t0 bigint, total double, others bigint, nearest bigint, least double")
    closest = F.min(F.when(F.col("others") > 0, F.struct("least", "nearest")))
    return parts.groupBy(*keys, "t0").agg(F.sum("total").alias("_t"), F.sum("others").alias("_n"), closest.alias("_c")).select(
        *keys, "t0", F.try_divide("_t", "_n").alias("mean_distance"),
        F.when(F.col("_n") > 0, F.col("_c.nearest")).otherwise(F.lit(-1).cast("long")).alias("nearest"),
        F.when(F.col("_n") > 0, F.col("_c.least")).alias("nearest_distance"))
