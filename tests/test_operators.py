"""Hand-computed values of single operators."""

from __future__ import annotations

import math
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shockwatch import session
from shockwatch.functions import identity, paths, ranking
from shockwatch.operators import (attention, cluster, comparison, diagnostics, features, forecasts,
                                  graph, grid, portfolio, recovery, resample, scoring, shapes,
                                  shocks, training, volume, windows)
from shockwatch.plans.catalog import ORACLE
from shockwatch.plans.hub import Hub
from shockwatch.plans.study import a36, o7


def one(df, *cols):
    row = df.select(*cols).collect()
    assert len(row) == 1
    return row[0]


def bars_of(spark, closes: dict[str, list[float]], universe="u"):
    data = [(universe, a, i, float(c), 1.0, float(c)) for a, cs in closes.items()
            for i, c in enumerate(cs)]
    return (spark.createDataFrame(data, "universe string, asset string, idx bigint, close double, "
                                        "volume double, amount double")
            .withColumn("ts", F.timestamp_seconds(1_700_000_040 + 60 * F.col("idx"))))


def spans_of(spark, n, universe="u", assets=3):
    return spark.createDataFrame([(universe, 0, n - 1, assets, n)],
                                 "universe string, lo bigint, hi bigint, asset_count bigint, n bigint")


def test_path_metrics(spark):
    df = spark.createDataFrame([(100.0, [101.0, 98.0, 102.0], [102.0, 100.0, 104.0],
                                 [99.0, 97.0, 98.0])],
                               "spot double, c array<double>, h array<double>, l array<double>")
    c = F.col
    got = one(df, paths.terminal_return(c("spot"), c("c")).alias("ret"),
              paths.max_drawdown(c("spot"), c("c")).alias("mdd"),
              paths.amplitude(c("spot"), c("h"), c("l")).alias("amp"),
              paths.horizon_volatility(c("spot"), c("c")).alias("vol"),
              paths.terminal_sign(c("spot"), c("c")).alias("sign"))
    r = np.diff(np.log([100, 101, 98, 102]))
    assert got.ret == pytest.approx(0.02) and got.mdd == pytest.approx(3 / 101)
    assert got.amp == pytest.approx(0.07) and got.sign == 1
    assert got.vol == pytest.approx(math.sqrt(((r - r.mean()) ** 2).sum()))


def test_downside_and_segments(spark):
    down = [math.exp(-0.02)] + [math.exp(-0.02)] * 29
    steady = [math.exp(-0.01 * i) for i in range(1, 31)]
    df = spark.createDataFrame([(1.0, down, steady)], "s double, a array<double>, b array<double>")
    got = one(df, paths.downside_volatility(F.col("s"), F.col("a")).alias("a"),
              paths.downside_volatility(F.col("s"), F.col("b")).alias("b"))
    assert got.a == pytest.approx(0.02) and got.b == pytest.approx(0.01 * math.sqrt(30))
    seg = spark.createDataFrame([(100.0, [200.0] * 10 + [100.0] * 10 + [150.0] * 10)],
                                "s double, c array<double>")
    want = [0.0, 0.5, 0.0]
    for i, value in enumerate(want):
        spot, part = paths.segment(F.col("s"), F.col("c"), 10 * i)
        assert one(seg, paths.max_drawdown(spot, part).alias("m")).m == value


def test_snapshot_values(spark):
    closes = [100.0] * 225 + [100.0, 110.0, 90.0] + [99.0] * 28
    last = features.snapshot(bars_of(spark, {"A": closes})).filter("idx = 255")
    got = one(last, "vol30", "mdd30", "ret30")
    assert got.vol30 == pytest.approx(0.2417300597586146)
    assert got.mdd30 == pytest.approx(0.18181818181818182)
    assert got.ret30 == pytest.approx(-0.01)


@pytest.mark.parametrize("length", [1, 2, 3, 7, 31, 32])
def test_rolling_drawdown_equals_the_fold(spark, length):
    rng = np.random.default_rng(length)
    closes = {a: (100 * np.exp(np.cumsum(rng.standard_t(2, n) * 0.02))).tolist() for a, n in (("A", 120), ("B", 31), ("C", 5))}
    closes["C"][2] = None
    data = [("u", a, i, c) for a, s in closes.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(data, "universe string, asset string, idx bigint, close double")
    w = Window.partitionBy("universe", "asset").orderBy("idx")
    got = {(r.asset, r.idx): r.mdd for r in features.rolling_drawdown(df, length, w).collect()}
    assert len(got) == 156
    for (asset, i), value in got.items():
        frame = closes[asset][max(i - length + 1, 0):i + 1]
        if len(frame) < length or None in frame:
            assert value is None
        else:
            peaks = np.maximum.accumulate(frame)
            assert value == pytest.approx(((peaks - frame) / peaks).max(), abs=1e-15)


def test_snapshot_holds_no_lists(spark):
    bars = bars_of(spark, {"A": [100.0] * 40})
    assert "collect_list" not in features.snapshot(bars)._jdf.queryExecution().optimizedPlan().toString()


def test_volatility_state(spark):
    level, alternating = 100.0, [100.0]
    for i in range(130):
        level *= math.exp(0.003 if i % 2 else -0.003)
        alternating.append(level)
    rows = features.snapshot(bars_of(spark, {"A": alternating, "B": [5.0] * 131}), False) \
        .filter("idx = 130").orderBy("asset").select("ratio", "state", "reason").collect()
    assert rows[0].ratio == pytest.approx(1.0) and rows[0].state == "near_usual"
    assert rows[1].ratio is None and rows[1].reason == "zero_baseline"
    edge = one(spark.range(1), features.volatility_state(F.lit(1.2)).alias("s"))
    assert edge.s == "above_usual"


def test_zero_sigma_never_triggers(spark):
    sig = features.shock_signal(bars_of(spark, {"A": [7.0] * 100, "B": [7.0] * 100}))
    assert sig.filter("sigma = 0").count() == 70
    assert shocks.candidates(sig).count() == 0


def signal(spark, marks, n=400):
    data = [("u", a, i, float(z), 1.0) for a, i, z in marks]
    return (spark.createDataFrame(data, "universe string, asset string, idx bigint, r5 double, "
                                        "sigma double")
            .withColumn("ts", F.timestamp_seconds(60 * F.col("idx"))))


def test_cooldown(spark, rows):
    marks = [("A", i, 7) for i in (65, 66, 94, 95, 96, 124, 125)] + [("B", 190, 6)]
    kept = shocks.triggers(signal(spark, marks), (6,))
    assert rows(kept, "asset", "idx") == [("A", 65), ("A", 95), ("A", 125)]
    stats = shocks.detector_statistics(signal(spark, marks), kept, (6,))
    assert one(stats.filter("scope = 'total'"), "suppressed").suppressed == 4


def events_of(spark, marks, n=400, k=6):
    kept = shocks.triggers(signal(spark, marks), (k,))
    return kept, shocks.merge_events(kept, spans_of(spark, n))


def test_merge_is_anchored(spark):
    _, ev = events_of(spark, [("A", 260, 7), ("B", 270, 7), ("C", 280, 7)])
    got = ev.orderBy("t0").select("t0", F.transform("members", lambda m: m["idx"]).alias("m")).collect()
    assert [(r.t0, r.m) for r in got] == [(260, [260, 270]), (280, [280])]


def test_ties_stay_co_origins(spark):
    _, ev = events_of(spark, [("A", 260, 7), ("B", 260, -8), ("C", 260, 9)])
    got = one(ev, "origins", "direction", "magnitude", "systemic", "systemic_assets")
    assert (got.origins, got.direction, got.magnitude) == (["A", "B", "C"], 0, 9.0)
    assert got.systemic and got.systemic_assets == 3


def test_systemic_waits_for_ten_bars(spark):
    marks = [("A", 260, 7), ("B", 269, 7), ("C", 270, 7)]
    assert one(events_of(spark, marks)[1], "systemic").systemic is True
    late = events_of(spark, [("A", 260, 7)], n=266)[1]
    assert one(late, "systemic").systemic is None


def test_eligibility(spark, rows):
    marks = [("A", 254, 7), ("B", 255, 7), ("C", 369, 7), ("D", 370, 7)]
    data = spark.createDataFrame([(t,) for t in (254, 255, 369, 370)], "t0 bigint")
    got = data.select("t0", (F.size(shocks.exclusion_reasons(F.col("t0"), F.lit(400))) == 0)
                      .alias("ok"))
    assert [r[1] for r in rows(got)] == [False, True, True, False]
    assert marks


def test_calibration_choice(spark):
    counts = {3: 30, 4: 50, 5: 19, 6: 61}
    data = [("u", k, True) for k, n in counts.items() for _ in range(n)]
    ev = spark.createDataFrame(data, "universe string, k int, eligible boolean")
    assert one(shocks.selected_k(ev), "selected_k").selected_k == 4
    none = shocks.selected_k(ev.filter("k = 5"), universes=spans_of(spark, 1))
    assert one(none, "selected_k").selected_k is None


def pairs(spark, p, a):
    return spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(p, a)],
                                 "g string, p double, a double")


@pytest.mark.parametrize("p, a, recall", [
    ([5, 4, 4, 4, 1], [5, 4, 3, 2, 1], 7 / 9), ([1] * 10, list(range(10)), 0.3)])
def test_tie_recall(spark, p, a, recall):
    got = one(ranking.rank_scores(pairs(spark, p, a), ["g"]), "recall")
    assert got.recall == pytest.approx(recall)


def test_spearman(spark):
    got = one(ranking.rank_scores(pairs(spark, [1, 1, 3, 4], [1, 2, 3, 4]), ["g"]), "spearman")
    assert got.spearman == pytest.approx(math.sqrt(0.9))
    flat = one(ranking.rank_scores(pairs(spark, [1, 1, 1], [1, 2, 3]), ["g"]), "spearman", "reason")
    assert flat.spearman is None and flat.reason == "constant_prediction"


def test_scored_universe(spark):
    assets = spark.createDataFrame([("u", f"A{i}", i, "major") for i in range(10)],
                                   "universe string, asset string, ordinal int, tier string")
    ev = spark.createDataFrame([("u", 1, ["A0", "A1"], False), ("u", 2, ["A0"], True),
                                ("u", 3, ["A0"], None)],
                               "universe string, t0 bigint, origins array<string>, systemic boolean")
    got = scoring.scored_universe(ev, assets).groupBy("t0").count().orderBy("t0").collect()
    assert [(r.t0, r["count"]) for r in got] == [(1, 8), (2, 10)]


def test_beta(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0, 0.01, 299)
    btc = np.concatenate([[100.0], 100 * np.exp(np.cumsum(r))]).tolist()
    eth = np.concatenate([[50.0], 50 * np.exp(np.cumsum(2 * r))]).tolist()
    bars = bars_of(spark, {"BTC": btc, "ETH": eth})
    assets = spark.createDataFrame([("u", "BTC", 0, "major"), ("u", "ETH", 1, "small")],
                                   "universe string, asset string, ordinal int, tier string")
    origins = spark.createDataFrame([("u", 260, ["ETH"])],
                                    "universe string, t0 bigint, origins array<string>")
    w = windows.market_windows(origins, bars)
    got = forecasts.baseline_paths(w, origins, assets).filter("method = 'driver_beta'") \
        .orderBy("asset").select("beta").collect()
    assert [round(g.beta, 9) for g in got] == [1.0, 2.0]
    flat = bars_of(spark, {"BTC": [5.0] * 300, "ETH": eth})
    bad = forecasts.baseline_paths(windows.market_windows(origins, flat), origins, assets) \
        .filter("method = 'driver_beta'").select("closes", "error").collect()
    assert all(b.closes is None and b.error for b in bad)


def triggers(spark, marks):
    return spark.createDataFrame([("u", i, a, d, float(z)) for a, i, d, z in marks],
                                 "universe string, idx bigint, asset string, direction int, "
                                 "magnitude double")


def test_follow_up_edges(spark):
    ev = spark.createDataFrame([("u", 100, ["BTC", "ETH"], 9.0)],
                               "universe string, t0 bigint, origins array<string>, magnitude double")
    trig = triggers(spark, [("BTC", 100, 1, 9), ("ETH", 100, 1, 7), ("SOL", 101, 1, 8),
                            ("SOL", 102, 1, 9), ("XRP", 130, -1, 7), ("ADA", 131, 1, 7),
                            ("BTC", 125, 1, 7)])
    assets = spark.createDataFrame([("u", a, i, "major") for i, a in enumerate(
        ("BTC", "ETH", "SOL", "XRP", "ADA"))], "universe string, asset string, ordinal int, tier string")
    follow = graph.follow_ups(ev, trig)
    edges = {(r.source, r.target): r for r in graph.edge_table(
        graph.observations(ev, follow), graph.opportunities(ev), assets).collect()}
    assert len(edges) == 25
    assert edges["BTC", "SOL"].n == 1 and edges["BTC", "SOL"].mean_delay == 1
    assert edges["BTC", "SOL"].median_magnitude == 8 and edges["ETH", "XRP"].n == 1
    assert edges["BTC", "ADA"].rate == 0 and edges["BTC", "ETH"].n == 0
    assert graph.origin_mismatch(ev, trig).count() == 0


def prints(spark, events):
    """events: t0 -> {ordinal: (direction, magnitude, delay)}; ten assets."""
    data = [("u", "p", t, [(i, i in s, *(s.get(i) or (None, None, None))) for i in range(10)])
            for t, s in events.items()]
    return spark.createDataFrame(
        data, "universe string, period string, t0 bigint, fp array<struct<ordinal: int, "
              "present: boolean, direction: int, magnitude: double, delay: int>>")


def test_fingerprint_distance(spark):
    df = prints(spark, {1: {0: (1, 7.0, 0)}, 2: {0: (-1, 7.0, 30)}, 3: {}})
    near = {(r.t0, r.neighbour): r.distance for r in graph.nearest_events(df, df, 5).collect()}
    assert near[1, 2] == pytest.approx(2 / 30) and near[1, 3] == pytest.approx(0.1)


def test_nearest_skips_itself_and_uses_blocks(spark):
    df = prints(spark, {t: {0: (1, 5.0 + t % 7, t % 5)} for t in range(0, 600, 12)})
    small = graph.nearest_events(df, df, 3, block=50).orderBy("t0", "place").collect()
    whole = graph.nearest_events(df, df, 3).orderBy("t0", "place").collect()
    assert small == whole and all(r.t0 != r.neighbour for r in whole)


def test_nearest_prunes_by_presence_and_stays_exact(spark):
    rng = np.random.default_rng(1)
    events = {}
    for t in range(400):
        there = [0] + [a for a in range(1, 10) if rng.random() < 0.4]
        events[t] = {a: (int(rng.choice([-1, 1])), float(rng.uniform(3, 9)), int(rng.integers(0, 30))) for a in there}
    df = prints(spark, events)
    compared = []
    got = {(r.t0, r.place): (r.neighbour, round(r.distance, 9))
           for r in graph.nearest_events(df, df, 3, block=64, compared=compared).collect()}
    m = graph.stacked(graph.numeric(df).orderBy("t0").toPandas())
    d = graph.distances(m, m)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert got == {(t, p + 1): (int(order[t, p]), round(float(d[t, order[t, p]]), 9)) for t in range(400) for p in range(3)}
    assert sum(compared) < 0.7 * 400 * 400


def test_nearest_on_a_large_library_compares_few_pairs(spark):
    """20 000 events in 1024 presence patterns: what is looked at stays far below all pairs."""
    n = 20_000
    df = spark.range(n).selectExpr("'u' as universe", "'p' as period", "id as t0", """
        transform(sequence(0, 9), a -> named_struct('ordinal', a, 'present', (xxhash64(id, a) & 1) = 1,
            'direction', if((xxhash64(id, a, 1) & 1) = 1, 1, -1), 'magnitude', 3 + pmod(xxhash64(id, a, 2), 100) / 20.0D,
            'delay', cast(pmod(xxhash64(id, a, 3), 30) as int))) as fp""")
    compared = []
    queries = df.filter("t0 % 100 = 0")
    assert graph.nearest_events(queries, df, 3, compared=compared).count() == 600
    assert sum(compared) < 0.25 * 200 * n


def wide_prints(spark, n, assets, per_mille):
    """Events in which each asset is present with the given chance: nearly every one has its own mask."""
    return spark.range(n).selectExpr("'u' as universe", "id as t0", f"""
        transform(sequence(0, {assets - 1}), a -> named_struct('ordinal', a, 'present', pmod(xxhash64(id, a), 1000) < {per_mille},
            'direction', if((xxhash64(id, a, 1) & 1) = 1, 1, -1), 'magnitude', 3 + pmod(xxhash64(id, a, 2), 100) / 20.0D,
            'delay', cast(pmod(xxhash64(id, a, 3), 30) as int))) as fp""")


def test_nearest_with_many_assets_is_exact(spark):
    df = wide_prints(spark, 300, 75, 60)
    m = graph.stacked(graph.numeric(df).orderBy("t0").toPandas())
    d = graph.distances(m, m)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :3]
    got = {(r.t0, r.place): (r.neighbour, r.distance) for r in graph.nearest_events(df, df, 3, block=128).collect()}
    assert got == {(t, p + 1): (int(order[t, p]), float(d[t, order[t, p]])) for t in range(300) for p in range(3)}


def test_nearest_with_many_assets_looks_at_few_pairs(spark):
    df, compared = wide_prints(spark, 20_000, 75, 60), []
    assert graph.nearest_events(df.filter("t0 % 200 = 0"), df, 3, compared=compared).count() == 300
    assert sum(compared) < 0.1 * 100 * 20_000


def test_pair_summary_in_blocks(spark):
    rng = np.random.default_rng(2)
    df = prints(spark, {t: {0: (1, float(rng.uniform(3, 9)), int(rng.integers(0, 30)))} for t in range(150)})
    whole, parts = (sorted(graph.pair_summary(df, b).collect()) for b in (1024, 20))
    assert [(r.t0, r.nearest, round(r.mean_distance, 9)) for r in whole] == [
        (r.t0, r.nearest, round(r.mean_distance, 9)) for r in parts]
    alone = graph.pair_summary(prints(spark, {1: {0: (1, 7.0, 0)}})).first()
    assert (alone.mean_distance, alone.nearest, alone.nearest_distance) == (None, -1, None)


def test_structure_issues_name_what_is_wrong(spark):
    def rows(name, assets=("A", "B", "C", "D"), steps=(1, 2), paths=1, **bad):
        return [(name, p, a, s, *[bad.get(c, 1.0) for c in ("open", "high", "low", "close", "volume", "amount")])
                for p in range(paths) for a in assets for s in steps]
    data = (rows("fine") + rows("stranger", ("A", "B", "C", "X")) + rows("few", ("A", "B", "C")) + rows("two", paths=2)
            + rows("nan", volume=float("nan")) + rows("low", low=0.0) + rows("late", steps=(1, 3)) + rows("twice") + rows("twice"))
    df = spark.createDataFrame(data, "forecast_id string, path_id int, asset string, step int, open double, high double, "
                                     "low double, close double, volume double, amount double")
    names = F.array(*[F.lit(a) for a in "ABCD"])
    got = {r.forecast_id: r.issues for r in forecasts.structure_issue(df, names, 2, 1).collect()}
    assert got == {"fine": [], "stranger": ["wrong_assets"], "few": ["wrong_assets", "wrong_shape"], "two": ["wrong_path_count"],
                   "nan": ["not_finite"], "low": ["price_not_positive"], "late": ["step_out_of_range"], "twice": ["duplicate_step"]}


def test_fold_plan_limit_and_runs(spark, monkeypatch):
    spans = spark.createDataFrame([("u", 10_000), ("short", 200)], "universe string, n bigint")
    whole = [r.t0 for r in windows.rolling_origins(spans).orderBy("t0").collect()]
    assert whole == list(range(255, 10_000 - 30, 30))
    monkeypatch.setattr(windows, "FOLDS_PER_TASK", 7)
    assert [r.t0 for r in windows.rolling_origins(spans).orderBy("t0").collect()] == whole
    cut = windows.rolling_origins(spans, limit=12).orderBy("t0").collect()
    assert [r.t0 for r in cut] == whole[:12] and {r.available for r in cut} == {len(whole)}


def test_adjusted_rand(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 1, 2), ("g", 2, 1), ("g", 2, 2)],
                               "g string, l int, r int")
    assert one(cluster.adjusted_rand(df, ["g"], "l", "r"), "ari").ari == pytest.approx(-0.5)


def test_fixed_pair(spark):
    data = [("u", t, "small", a, v, "d") for t, vs in enumerate(((3.0, 2.0, 1.0), (3.0, 1.0, 2.0), (3.0, 1.0, 2.0)))
            for a, v in zip("ABC", vs)]
    df = spark.createDataFrame(data, "universe string, t0 bigint, tier string, asset string, a_vol double, day string")
    assert tuple(one(comparison.fixed_pair(df), "first", "second", "hits")) == ("A", "C", 2)
    tied = df.withColumn("a_vol", F.lit(1.0))
    assert tuple(one(comparison.fixed_pair(tied), "first", "second", "hits")) == ("A", "B", 0)


def test_threshold_counts(spark):
    p, a = [0.04, 0.04, 0.01, 0.01], [0.04, 0.01, 0.04, 0.01]
    got = one(comparison.threshold_sweep(pairs(spark, p, a), ["g"], "p", "a").filter("threshold = 0.03"),
              "tp", "fp", "fn", "tn", "precision", "recall", "f1", "supported", "recommended")
    assert tuple(got) == (1, 1, 1, 1, 0.5, 0.5, 0.5, False, False)


def test_threshold_tie_takes_the_lower(spark):
    df = pairs(spark, [0.9] * 12 + [0.0] * 12, [0.9] * 12 + [0.0] * 12)
    rec = comparison.threshold_sweep(df, ["g"], "p", "a").filter("recommended").collect()
    assert [r.threshold for r in rec] == [0.01]


def test_coverage_bounds_are_inside(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.2, 0.099, 0.201)], "v double") \
        .withColumn("lo", F.lit(0.1)).withColumn("hi", F.lit(0.2))
    got = [r.position for r in diagnostics.coverage(df, "lo", "hi", "v").collect()]
    assert got == ["covered", "covered", "below", "above"]


def test_omission(spark):
    names = ["BTC", "ETH", "SOL", "ADA", "X1", "X2"]
    assets = spark.createDataFrame([("u", a, i, "major") for i, a in enumerate(names)],
                                   "universe string, asset string, ordinal int, tier string")
    pred = spark.createDataFrame([("u", 1, a, v, 0.0) for a, v in zip(names, (9.0, 8.0, 7.0, 1.0, 1.0, 1.0))],
                                 "universe string, t0 bigint, asset string, vol double, mdd double")
    real = dict(zip(names, (0.1, 0.02, 0.03, 0.025, 0.01, 0.01)))
    actual = spark.createDataFrame([("u", 1, a, v, v) for a, v in real.items()],
                                   "universe string, t0 bigint, asset string, vol double, mdd double")
    got = diagnostics.omissions(pred, actual, assets).filter("missed and metric = 'volatility'")
    row = one(got, "asset", "weakest", "excess_bps")
    assert (row.asset, row.weakest) == ("ADA", 0.02) and row.excess_bps == pytest.approx(50)


def test_amplitude_tie_goes_to_the_earlier_event(spark):
    """The quantile of six values lies halfway between the two largest; rounding must not choose."""
    lo, hi = 0.22, 0.39
    assert (lo + hi) / 2 - lo < hi - (lo + hi) / 2  # rounding puts the later event nearer
    rows = spark.createDataFrame([("u", "m", 1, "a", hi), ("u", "m", 2, "b", lo), *[
        ("u", "m", 3 + i, "c", 0.01 * i) for i in range(4)]], "universe string, metric string, t0 long, asset string, relative double")
    got = diagnostics.amplitude_cases(rows).first()
    assert (got.near_t0, got.near_asset, got.max_t0, got.max_asset) == (1, "a", 1, "a")


def test_amplitude_query_compares_distances_as_its_sql_does(spark):
    """Half way between two values the SQL takes the one its doubles put nearer, here the later event."""
    lo, hi = 0.22, 0.39
    omitted = spark.createDataFrame([("u", "m", 1, "a", hi, True), ("u", "m", 2, "b", lo, True), *[
        ("u", "m", 3 + i, "c", 0.01 * i, True) for i in range(4)]],
        "universe string, metric string, t0 long, asset string, relative double, missed boolean")
    got = a36(SimpleNamespace(_once=lambda name, build: omitted)).first()
    con = duckdb.connect()
    con.execute("CREATE TABLE q_omit AS SELECT * FROM (VALUES " + ", ".join(
        f"('u', 'm', {r.t0}, '{r.asset}', {r.relative!r}::DOUBLE, true)" for r in omitted.collect())
        + ") v(universe, metric, t0, asset, relative, missed)")
    own = ORACLE["a36_amplitude_cases"]
    cursor = con.execute("WITH " + own[own.rindex("m AS (SELECT * FROM q_omit"):])
    names = [d[0] for d in cursor.description]
    assert cursor.fetchall() == [tuple(got[n] for n in names)] and got.near_t0 == 2


def test_realised_volatility_has_the_bits_of_the_c_library(spark):
    """Of values equally good the last bit decides, so it has to be that of the SQL engine's logarithm."""
    def welford(series):
        logs = [math.log(p) for p in series]
        n, m, s = 0, 0.0, 0.0
        for x in (b - a for a, b in zip(logs, logs[1:])):
            n += 1
            last, m = m, m + (x - m) / n
            s += (x - last) * (x - m)
        return math.sqrt(s / n) * math.sqrt(30)

    h = Hub(spark, "/root/testdata/sf0.01")
    rows = h.windows.filter("status = 'ready'").join(h.actual, ["universe", "t0", "asset"]).collect()
    assert len(rows) > 50 and all(r.vol == welford([r.hist[-1], *r.fut]) for r in rows)
    odd = spark.createDataFrame([([2.0, 0.0, None],), (None,), ([],), ([-1.0],)], "a array<double>").coalesce(1)
    assert [r.x for r in odd.select(paths.libm_logs("a").alias("x")).collect()] == [[math.log(2), None, None], None, [], [None]]


def test_median_event_tie_goes_to_the_earlier_event(spark, rows):
    """The two middle events of an even number are equally far from the median; rounding must not choose."""
    lo, hi = 3.21, 3.35
    assert hi - (lo + hi) / 2 < (lo + hi) / 2 - lo  # rounding puts the later event nearer
    events = spark.createDataFrame([("u", 1, lo, False), ("u", 2, hi, False), ("u", 3, 5.0, False), ("u", 4, 3.0, True)],
                                   "universe string, t0 long, magnitude double, systemic boolean")
    assert rows(o7(SimpleNamespace(study=events)), "role", "t0") == [
        ("median_strength", 1), ("strongest_non_systemic", 3), ("strongest_systemic", 4)]


def curve(spark, values):
    return spark.createDataFrame([("u", 1, "t", h, float(v)) for h, v in enumerate(values)],
                                 "universe string, t0 bigint, tier string, h int, ratio double")


@pytest.mark.parametrize("values, at", [([1.2] * 121, 9), ([1] * 9 + [2] + [1] * 10, 19),
                                        ([2] * 30, None)])
def test_confirmation(spark, values, at):
    assert one(recovery.confirmations(curve(spark, values)), "confirmed_at").confirmed_at == at


def test_censored_median(spark):
    df = spark.createDataFrame([("g", 9), ("g", 19), ("g", None), ("g", None)],
                               "g string, confirmed_at int")
    got = one(recovery.censored_median(df, ["g"]), "median_minutes", "n_censored")
    assert tuple(got) == (19, 2)
    none = recovery.censored_median(df.filter("confirmed_at is null or confirmed_at = 9"), ["g"])
    assert one(none, "median_minutes").median_minutes is None


def test_volume_ratio_and_controls(spark):
    n, t0, cycle = 31 * 1440, 30 * 1440, 1440
    bars = (spark.range(n).select(F.lit("u").alias("universe"), F.lit("A").alias("asset"),
                                  F.col("id").alias("idx"))
            .withColumn("ts", F.timestamp_seconds(1_735_689_600 + 60 * (F.col("idx") + 1)))
            .withColumn("volume", F.when(F.col("idx").between(t0 - 29, t0), 20.0).otherwise(10.0))
            .withColumn("amount", F.col("volume")))
    vol = grid.observed_volume(bars)
    ev = bars.filter(F.col("idx") == t0).select("universe", F.col("idx").alias("t0"), "ts")
    for gap, hit in ((120, True), (121, False)):
        trig = spark.createDataFrame([("u", t0), ("u", t0 - 7 * cycle - gap)],
                                     "universe string, idx bigint")
        ctl = volume.controls(ev, vol, trig, spans_of(spark, n), F.lit(cycle))
        bad = ctl.filter("rejected = 'shock_within_control_context'").count()
        assert bool(bad) is hit
    ratio = one(volume.log_ratios(ev, vol, ctl), "log_ratio", "volume_sum", "control_median")
    assert ratio.log_ratio == pytest.approx(math.log(2))
    assert (ratio.volume_sum, ratio.control_median) == (600, 300)


def test_weighted_medians(spark, monkeypatch):
    monkeypatch.setattr(resample, "REPS_PER_BLOCK", 4)
    rng = np.random.default_rng(4)
    data = [("g", "x", h, float(rng.normal()), "p", int(rng.integers(0, 6))) for h in range(40) for _ in range(9)]
    curves = spark.createDataFrame(data, "universe string, tier string, h int, ratio double, period string, day_no int")
    weight = {(d, rep): int(rng.integers(0, 3)) for d in range(6) for rep in range(10)}
    weights = spark.createDataFrame([("g", "p", d, rep, w) for (d, rep), w in weight.items() if w],
                                    "universe string, period string, day_no int, rep int, w int")
    got = {(r.h, r.rep): r.value for r in resample.weighted_medians(curves, weights, 10).collect()}
    for h in range(40):
        for rep in range(10):
            repeated = [v for _, _, hh, v, _, d in data if hh == h for _ in range(weight[d, rep])]
            assert got.get((h, rep)) == (pytest.approx(np.median(repeated)) if repeated else None)


def test_weighted_medians_over_many_slices_and_groups(spark, monkeypatch):
    for name, value in (("REPS_PER_BLOCK", 8), ("VALUES_PER_SLICE", 4), ("VALUES_PER_GROUP", 50)):
        monkeypatch.setattr(resample, name, value)
    rng = np.random.default_rng(9)
    days, reps = 30, 20
    data = [("g", t, h, float(rng.integers(0, 40)) / 8, "p", int(rng.integers(0, days))) for t in "xy" for h in range(3) for _ in range(150)]
    data += [("g", "x", 0, 2.5, "p", 3)] * 100  # a value that many rows share
    curves = spark.createDataFrame(data, "universe string, tier string, h int, ratio double, period string, day_no int")
    weight = rng.integers(0, 3, (days, reps))
    weight[:, 7] = 0
    weights = spark.createDataFrame([("g", "p", d, rep, int(w)) for (d, rep), w in np.ndenumerate(weight) if w],
                                    "universe string, period string, day_no int, rep int, w int")
    got = {(r.tier, r.h, r.rep): r.value for r in resample.weighted_medians(curves, weights, reps).collect()}
    assert len(got) == 2 * 3 * (reps - 1)
    for (tier, h, rep), value in got.items():
        assert value == np.median([v for _, t, hh, v, _, d in data if (t, hh) == (tier, h) for _ in range(weight[d, rep])])


@pytest.mark.parametrize("flags, want", [((0, 1, 1), None), ((1, 0, 1), 10), ((1, 1, 1), 30)])
def test_advantage_radius(spark, flags, want):
    data = [("u", "x", i, m, 1.0 if m == "b" else (0.5 if f else 2.0))
            for i, f in enumerate(flags) for m in ("m", "b")]
    df = spark.createDataFrame(data, "universe string, metric string, segment int, method string, mae double")
    got = diagnostics.advantage_radius(df, "m", "b").filter("metric = 'x'")
    assert one(got, "radius").radius == want


def test_overlap_tie(spark):
    v = [4, 3, 2, 2]
    got = one(ranking.rank_scores(pairs(spark, v, v), ["g"]), "recall", "predicted_crosses")
    assert 3 * got.recall == pytest.approx(2.5) and got.predicted_crosses


def test_null_graphs_get_tasks_by_rows(spark, rows, monkeypatch):
    """Tasks of the replicates follow the number of shifted rows, not their bytes."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    setting, store, used = "spark.sql.shuffle.partitions", resample.materialize, []
    before = spark.conf.get(setting)
    monkeypatch.setattr(resample, "materialize", lambda df, label: used.append(spark.conf.get(setting)) or store(df, label))
    marks = spark.createDataFrame([("u", a, 300 + 40 * i + j, 1, 3.5, 0) for i in range(5) for j, a in enumerate("AB")],
                                  "universe string, asset string, idx long, direction int, magnitude double, ts int")
    spans = spark.createDataFrame([("u", 0, 999, 1000, 2)], "universe string, lo long, hi long, n long, asset_count long")
    got = resample.null_graphs(marks, spans, 40)
    plain = resample.graph_statistics(resample.shifted_triggers(marks, spans, 40), spans, ["universe", "rep"])
    assert rows(got, *plain.columns) == rows(plain) and got.count() == 40
    assert used == ["40"] and spark.conf.get(setting) == before
    with session.spread(spark, 100):
        assert len(session.materialize(spark.range(1000).groupBy(F.col("id") % 100).count().toDF("k", "n"), "spread").inputFiles()) == 10


def test_tail_and_holm(spark):
    real = spark.createDataFrame([("u", 3.0, 3.0, 3.0, 3.0)],
                                 "universe string, pairs double, observations double, mean_delay double, edge_mean_delay double")
    null = spark.createDataFrame([("u", i, x, x, x, None if i == 0 else x) for i, x in enumerate((1.0, 3.0, 3.0, 4.0))],
                                 "universe string, rep int, pairs double, observations double, mean_delay double, edge_mean_delay double")
    got = {r.statistic: r for r in resample.tail_tests(real, null, 4).collect()}
    assert got["pairs"].p == pytest.approx(4 / 5)
    assert got["edge_mean_delay"].extreme == 2
    p = spark.createDataFrame([("u", "a", 0.04), ("u", "b", 0.041)], "universe string, statistic string, p double")
    assert [r.p_holm for r in resample.holm(p, ["universe"]).collect()] == [0.08, 0.08]


def test_containment(spark):
    df = spark.createDataFrame([(100.0, 98.0, 102.0, 101.0), (101.0, 103.0, 100.0, 102.0)],
                               "open double, high double, low double, close double")
    got = forecasts.repair_containment(df).collect()
    assert [(r.high, r.low, r.was_corrected) for r in got] == [(102.0, 98.0, True), (103.0, 100.0, False)]
    assert got[0].max_adjustment_bps == pytest.approx(4 / 101 * 1e4)
    assert got[0].original.high == 98.0


def test_audit_tamper_is_found(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "step int, high double")
    assert forecasts.audit_differences(df, df).count() == 0
    assert forecasts.audit_differences(df.withColumn("high", F.col("high") + 1), df).count() == 4


def test_weighted_rate(spark):
    df = spark.createDataFrame([("g", 6, 6), ("g", 0, 12)], "g string, c int, t int")
    assert one(forecasts.weighted_rate(df, ["g"], F.col("c"), F.col("t")), "rate").rate == pytest.approx(6 / 18)


def test_skill(spark):
    df = spark.createDataFrame([("g", 0.01, 0.02)] * 2, "g string, model_error double, baseline_error double")
    got = one(comparison.error_stats(df, ["g"]), "skill", "win")
    assert got.skill == pytest.approx(0.5) and got.win == 2
    zero = df.withColumn("baseline_error", F.lit(0.0))
    assert one(comparison.error_stats(zero, ["g"]), "skill").skill is None


def test_portfolio(spark):
    c = {"BTC": (100.0, [101.0, 98.0, 102.0]), "ETH": (50.0, [50.0, 48.0, 52.0]), "SOL": (10.0, [10.0, 10.0, 10.0])}
    fc = spark.createDataFrame([("u", 1, a, 0, s, x) for a, (s, x) in c.items()],
                               "universe string, t0 bigint, asset string, path_id int, spot double, closes array<double>")
    w = spark.createDataFrame([("u", 1, "BTC", 100.0, 0.5), ("u", 1, "ETH", 50.0, 0.3), ("u", 1, "SOL", 10.0, 0.2)],
                              "universe string, t0 bigint, asset string, spot double, weight double")
    held = portfolio.holdings(w, 10_000)
    assert sorted(r.quantity for r in held.collect()) == [50, 60, 200]
    got = one(portfolio.path_values(fc, held), "values", "pnl", "terminal_return", "mdd")
    assert got["values"] == [10050, 9780, 10220] and got.pnl == 220
    assert got.mdd == pytest.approx(270 / 10050)
    assert portfolio.weight_issue(w).count() == 0
    assert portfolio.weight_issue(w.withColumn("weight", F.col("weight") + 0.1)).count() == 1


def test_metrics_per_path_before_averaging(spark):
    df = spark.createDataFrame([("g", 110.0), ("g", 90.0)], "g string, v double")
    got = one(diagnostics.path_quantiles(df, ["g"], "v", 2), "mean", "p05", "p50", "p95")
    assert got.mean == 100 and got.p50 == 100 and got.p95 == pytest.approx(109)
    assert one(diagnostics.path_quantiles(df, ["g"], "v", 10), "p50").p50 is None


def test_shapes(spark):
    def label(y, d):
        df = spark.createDataFrame([([float(v) for v in y], d)], "y array<double>, d int")
        return one(df, paths.path_shape(F.col("y"), F.col("d")).alias("s")).s
    down = [-1.0 - i / 60 for i in range(61)]
    assert label(down, -1) == "one_way_down"
    assert label([-1.0] * 10 + [-2.0] + [0.0] * 50, -1) == "v_reversal"
    assert label([1.0] * 60 + [0.1], 1) == "upward_false_breakout"
    assert label([1.0] * 61, 1) == "other"
    assert label([1.0] * 61, 0) == "mixed_direction"
    assert label([0.0] + [1.0] * 60, 1) == "zero_initial_move"
    assert label([1.0] * 60, 1) == "incomplete_60m"
    assert set(paths.SHAPES) >= {"other"} and shapes.SPAN == 60


def test_attention_and_alerts(spark):
    df = spark.createDataFrame([("u", 1, a, v) for a, v in (("A", 3.0), ("B", 2.0), ("C", 1.0), ("D", 1.0))],
                               "universe string, idx bigint, asset string, vol30 double")
    got = {r.asset: r for r in attention.partition_attention(df).collect()}
    assert got["C"].group == "focused" and got["C"].cutoff_tied and got["D"].group == "deferred"
    al = attention.alerts(df.withColumnRenamed("vol30", "vol").withColumn("mdd", F.lit(0.03)),
                          ["universe", "idx"])
    assert {r.asset for r in al.filter("alert").collect()} == {"A", "B"}


def test_ledger_keeps_every_task(spark, rows):
    man = spark.createDataFrame([("u", t) for t in range(5)], "universe string, t0 bigint")
    art = spark.createDataFrame([("u", 0, "scored"), ("u", 1, "scored"), ("u", 1, "failed"),
                                 ("u", 2, "odd"), ("u", 9, "scored")], "universe string, t0 bigint, status string")
    got = comparison.ledger(man, art, ["universe", "t0"])
    assert [s for _, s in rows(got, "t0", "status")] == ["scored", "duplicate", "invalid_artifact", "missing", "missing"]
    assert comparison.unassigned(man, art, ["universe", "t0"]).count() == 1


def test_bar_rules(spark):
    nan, inf = float("nan"), float("inf")
    cases = [((1, 2, 1, 2, 1, 1), None), ((nan, 2, 1, 2, 1, 1), "not_finite"), ((1, inf, 1, 2, 1, 1), "not_finite"),
             ((0, 2, 0, 2, 1, 1), "price_not_positive"), ((1, 2, 1, 2, -1, 1), "negative_volume"),
             ((1, 1.5, 1, 2, 1, 1), "ohlc_containment"), ((1, 2, 1, 2, 0, 1), "zero_volume_mismatch")]
    df = spark.createDataFrame([(i, *map(float, c)) for i, (c, _) in enumerate(cases)],
                               "i int, open double, high double, low double, close double, volume double, amount double")
    got = df.select("i", grid.bar_reason().alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [want for _, want in cases]
    good, bad = grid.split_valid(df)
    assert (good.count(), bad.count()) == (1, 6)


def test_identity_helpers(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "x string, y int")
    ids = df.select(identity.content_id("w_", "x", "y").alias("i"), identity.comparison_key(["x", "y"]).alias("k")).collect()
    assert ids[0].i == ids[1].i != ids[2].i and ids[2].k is None and ids[0].k
    tags = spark.createDataFrame([(float("nan"),), (float("-inf"),), (1.0,)], "v double") \
        .select(identity.non_finite_tag(F.col("v")).alias("t")).collect()
    assert [t.t for t in tags] == ["NaN", "-Infinity", None]


def test_failed_model_keeps_its_rows(spark):
    bars = bars_of(spark, {"A": [1.0] * 300, "B": [2.0] * 300})
    w = windows.market_windows(spark.createDataFrame([("u", 260), ("u", 265)], "universe string, t0 bigint"), bars)

    def broken(_):
        raise ValueError("no weights")
    got = forecasts.apply_model(w, broken, "m").collect()
    assert len(got) == 4 and all(r.error == "ValueError: no weights" and r.closes is None for r in got)


def test_model_as_table_function(spark, rows):
    bars = bars_of(spark, {"A": [1.0 + i for i in range(300)], "B": [2.0] * 300})
    w = windows.market_windows(spark.createDataFrame([("u", 260), ("u", 265), ("u", 3)], "universe string, t0 bigint"), bars)

    def two_paths(hist):
        if hist["A"][-1] > 263:
            raise ValueError("too high")
        return [{a: [h[-1] * f] * 30 for a, h in hist.items()} for f in (1, 2)]
    forecasts.register_model(spark, two_paths, "two_paths")
    sent = forecasts.histories(w)
    got = spark.sql("SELECT w.universe, w.t0, p.* FROM {sent} w, LATERAL two_paths(w.histories) p", sent=sent)
    columns = ("universe", "t0", "asset", "path_id", "spot", "closes", "error")
    assert str(rows(got, *columns)) == str(rows(forecasts.apply_model(w, two_paths, "m"), *columns)) and got.count() == 6
    nothing = spark.sql("SELECT * FROM two_paths(CAST(NULL AS MAP<STRING, ARRAY<DOUBLE>>))")
    assert nothing.columns == ["asset", "path_id", "spot", "closes", "error"] and nothing.count() == 0
    with pytest.raises(Exception, match="two_paths takes a map"):
        spark.sql("SELECT * FROM two_paths(1)").collect()


def test_past_is_blind_to_the_future(spark, rows):
    rng = np.random.default_rng(5)
    base = (100 * np.exp(np.cumsum(rng.standard_t(2, 420) * 0.01))).tolist()
    other = base[:300] + [c * 3 for c in base[300:]]
    out = []
    for closes in (base, other):
        bars = bars_of(spark, {"A": closes, "B": closes[::1]})
        snap = features.snapshot(bars).filter("idx < 300")
        trig = shocks.triggers(features.shock_signal(bars)).filter("idx < 300")
        out.append((rows(snap, "asset", "idx", "vol30", "vol255", "ratio"), rows(trig, "k", "asset", "idx")))
    assert str(out[0]) == str(out[1])


def test_training_scale_ignores_the_future(spark):
    closes = [float(100 + i % 7) for i in range(256)] + [1e6] * 30
    bars = bars_of(spark, {"A": closes}).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    seg = training.segments(spark.createDataFrame([("u", 255)], "universe string, t0 bigint"), bars, F.lit(60))
    got = seg.agg(F.count("*").alias("n"), F.avg(F.when(F.col("pos") <= 256, F.col("z_close"))).alias("m"),
                  F.max("z_close").alias("top")).first()
    assert got.n == 286 and abs(got.m) < 1e-6 and got.top == 5.0
