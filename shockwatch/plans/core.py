"""Grid, features, detection, windows, baselines and event scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import features, forecasts, grid, scoring, shocks, windows
from . import hub as H
from .oracle import r, sql
from .registry import query


def rd(column, digits: int = 6):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits)


@query("g1_rejects", sql("""
 SELECT universe, asset, 'price_not_positive' AS reason, count(*) n FROM q_ticks
 WHERE price <= 0 GROUP BY universe, asset
 UNION ALL
 SELECT universe, asset, 'valid', count(*) FROM q_ticks WHERE price > 0 GROUP BY universe, asset"""))
def g1_rejects(h):
    """Bar rules applied to each tick seen as a one-trade bar."""
    bar = h.ticks.withColumns({c: F.col("price") for c in ("open", "high", "low", "close")})
    return (bar.withColumn("reason", F.coalesce(grid.bar_reason(), F.lit("valid")))
            .groupBy("universe", "asset", "reason").agg(F.count("*").alias("n")))


@query("g2_gaps_and_dups", sql("""
 SELECT universe, asset, cell, CASE WHEN nxt - cell > 1 THEN 'gap' END issue, nxt - cell - 1 missing
 FROM (SELECT universe, asset, cell, lead(cell) OVER (PARTITION BY universe, asset ORDER BY cell) nxt
       FROM q_cells) WHERE nxt - cell > 1"""))
def g2_gaps(h):
    return grid.continuity(h.cells).select("universe", "asset", "cell", "issue", "missing")


@query("g3_misaligned", sql("""
 SELECT c.universe, c.cell, count(DISTINCT c.asset) assets, any_value(s.asset_count) expected
 FROM q_cells c JOIN q_spans s ON s.universe = c.universe AND c.cell BETWEEN s.lo AND s.hi
 GROUP BY c.universe, c.cell HAVING count(DISTINCT c.asset) <> any_value(s.asset_count)"""))
def g3_misaligned(h):
    return grid.misaligned(h.cells, h.spans)


@query("g4_common_interval", sql("SELECT universe, lo, hi, n, asset_count FROM q_spans"))
def g4_common_interval(h):
    return h.spans.select("universe", "lo", "hi", "n", "asset_count")


@query("u1_dense_bars", sql(f"""
 SELECT universe, asset, idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {r('open', 8)} AS open,
        {r('high', 8)} AS high, {r('low', 8)} AS low, {r('close', 8)} AS close, {r('volume')} volume,
        {r('amount', 2)} amount, synthetic FROM q_bars"""))
def u1_dense_bars(h):
    return h.bars_once.select("universe", "asset", "idx",
                         F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                         *[rd(c, 8).alias(c) for c in ("open", "high", "low", "close")],
                         rd("volume").alias("volume"),
                         rd("amount", 2).alias("amount"), "synthetic")


@query("s14_universe", sql("SELECT universe, asset, ordinal, tier FROM q_assets"))
def s14_universe(h):
    return h.assets.select("universe", "asset", "ordinal", "tier")


@query("g5_g6_closed_and_stale", sql("""
 WITH c AS (SELECT universe, max(ts) AS now FROM (SELECT 'events' universe, ts FROM events
   UNION ALL SELECT 'lineitem', l_shipdate FROM lineitem UNION ALL SELECT 'orders', o_orderdate FROM orders)
   GROUP BY universe),
 d AS (SELECT *, CASE universe WHEN 'events' THEN 3600 ELSE 86400 END step FROM c),
 e AS (SELECT *, CAST(floor(epoch(now) / step) * step AS BIGINT) cut FROM d)
 SELECT universe, cut cutoff, CAST(greatest(floor(epoch(now)) - cut, 0) AS BIGINT) age,
        greatest(floor(epoch(now)) - cut, 0) > 180 stale FROM e"""))
def g5_g6(h):
    """Closed-bar cutoff and staleness with the latest record of each source as the clock."""
    def clock(name, table, column):
        return h.table(table).agg(F.max(column).cast("timestamp").alias("now")) \
            .select(F.lit(name).alias("universe"), "now")
    parts = [clock("events", "events", "ts"), clock("lineitem", "lineitem", "l_shipdate"),
             clock("orders", "orders", "o_orderdate")]
    now = parts[0].unionByName(parts[1]).unionByName(parts[2])
    cut = F.when(F.col("universe") == "events", grid.closed_cutoff(F.col("now"), 3600)) \
        .otherwise(grid.closed_cutoff(F.col("now"), 86400))
    age, stale = grid.staleness(F.col("now"), F.col("cut"), F.lit(False))
    return now.withColumn("cut", cut).select(
        "universe", F.unix_timestamp("cut").alias("cutoff"), age.alias("age"),
        stale.alias("stale"))


SNAP = """
 SELECT universe, asset, idx, close, r,
        CASE WHEN count(r) OVER w30 = 30 THEN stddev_pop(r) OVER w30 * sqrt(30) END vol30,
        CASE WHEN count(r) OVER w255 = 255 THEN stddev_pop(r) OVER w255 * sqrt(30) END vol255,
        close / lag(close, 30) OVER w - 1 ret30,
        CASE WHEN count(r) OVER w10 = 10 THEN stddev_pop(r) OVER w10 END recent,
        CASE WHEN count(r) OVER w120 = 120 THEN stddev_pop(r) OVER w120 END base
 FROM q_rets WINDOW w AS (PARTITION BY universe, asset ORDER BY idx),
  w30 AS (PARTITION BY universe, asset ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
  w255 AS (PARTITION BY universe, asset ORDER BY idx ROWS BETWEEN 254 PRECEDING AND CURRENT ROW),
  w10 AS (PARTITION BY universe, asset ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
  w120 AS (PARTITION BY universe, asset ORDER BY idx ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)"""
MDD31 = """
 SELECT universe, asset, idx, max((peak - c) / peak) mdd30 FROM (
  SELECT b.universe, b.asset, b.idx, x.close c, max(x.close) OVER (
         PARTITION BY b.universe, b.asset, b.idx ORDER BY x.idx) peak
  FROM q_bars b JOIN q_bars x ON x.universe = b.universe AND x.asset = b.asset
   AND x.idx BETWEEN b.idx - 30 AND b.idx WHERE b.idx >= 30) GROUP BY ALL"""


@query("a1_attention_top3", sql(f"""
 WITH s AS ({SNAP}), m AS ({MDD31}),
 f AS (SELECT universe, asset, idx, vol30, mdd30, ret30,
              row_number() OVER (PARTITION BY universe, idx ORDER BY vol30 DESC, asset) rnk,
              vol30 = lead(vol30) OVER (PARTITION BY universe, idx ORDER BY vol30 DESC, asset) tied
       FROM s JOIN m USING (universe, asset, idx) WHERE vol30 IS NOT NULL)
 SELECT universe, idx, asset, CAST(rnk AS BIGINT) AS rnk, {r('vol30')} vol30, {r('mdd30')} mdd30,
        {r('ret30')} ret30, CASE WHEN rnk <= 3 THEN 'focused' ELSE 'deferred' END grp,
        COALESCE(rnk = 3 AND tied, FALSE) cutoff_tied FROM f"""))
def attention_top3(h):
    """Which assets to check first, at every closed bar: the flagship report."""
    from ..operators.attention import partition_attention
    snap = features.snapshot(h.bars_once, long_frame=False)
    ranked = partition_attention(snap.filter("vol30 is not null"), limit=3)
    return ranked.select("universe", "idx", "asset", F.col("rank").cast("long").alias("rnk"),
                         rd("vol30").alias("vol30"), rd("mdd30").alias("mdd30"),
                         rd("ret30").alias("ret30"), F.col("group").alias("grp"), "cutoff_tied")


@query("a2_a3_volatility_state", sql(f"""
 WITH s AS ({SNAP})
 SELECT universe, asset, idx, {r('vol255')} vol255,
        {r('CASE WHEN base <> 0 THEN recent / base END')} ratio,
        CASE WHEN base IS NULL OR base = 0 OR recent IS NULL THEN 'unavailable'
             WHEN recent / base >= 1.2 THEN 'above_usual' ELSE 'near_usual' END AS state,
        CASE WHEN base IS NULL THEN 'insufficient_history' WHEN base = 0 THEN 'zero_baseline' END reason
 FROM s"""))
def volatility_state(h):
    return features.snapshot(h.bars_once).select("universe", "asset", "idx", rd("vol255").alias("vol255"),
                                            rd("ratio").alias("ratio"), "state", "reason")


@query("f1_f3_returns", sql(f"""
 SELECT universe, asset, idx, {r('r')} r, {r('r5')} r5,
        {r('close / lag(close, 30) OVER (PARTITION BY universe, asset ORDER BY idx) - 1')} ret30
 FROM q_rets"""))
def f1_f3_returns(h):
    from ..operators.halo import chunk_window, drop_halo, with_halo
    w = chunk_window(grid.KEYS)
    rows = drop_halo(with_halo(h.bars_once, back=30)
                     .withColumn("r", F.log("close") - F.log(F.lag("close").over(w)))
                     .withColumn("r5", F.log(F.col("close") / F.lag("close", 5).over(w)))
                     .withColumn("ret30", F.col("close") / F.lag("close", 30).over(w) - 1))
    return rows.select("universe", "asset", "idx", rd("r").alias("r"), rd("r5").alias("r5"),
                       rd("ret30").alias("ret30"))


@query("w1_signal", sql(f"""
 SELECT universe, asset, idx, {r('sigma')} sigma, COALESCE(sigma = 0, FALSE) zero_sigma
 FROM q_signal"""))
def w1_signal(h):
    return h.signal.select("universe", "asset", "idx", rd("sigma").alias("sigma"),
                           F.coalesce(F.col("sigma") == 0, F.lit(False)).alias("zero_sigma"))


@query("w2_candidates_by_k", sql("""
 SELECT universe, k, asset, count(*) n FROM q_cand GROUP BY ALL"""))
def w2_candidates(h):
    return shocks.candidates(h.signal).groupBy("universe", "k", "asset").agg(
        F.count("*").alias("n"))


@query("w4_o2_triggers", sql(f"""
 SELECT universe, k, idx, asset, direction, {r('magnitude')} magnitude FROM q_trig"""))
def w4_triggers(h):
    return (h.triggers.select("universe", "k", "idx", "asset", "direction",
                              rd("magnitude").alias("magnitude"))
            .orderBy("universe", "k", "idx", "asset"))


@query("w5_j11_g7_events", sql(f"""
 SELECT universe, k, t0, origins, direction, {r('magnitude')} magnitude, systemic_assets,
        CAST(systemic AS VARCHAR) systemic, eligible, reasons, n_members FROM q_events"""))
def w5_events(h):
    return h.events.select("universe", "k", "t0", F.array_join("origins", "|").alias("origins"),
                           "direction", rd("magnitude").alias("magnitude"), "systemic_assets",
                           F.col("systemic").cast("string").alias("systemic"), "eligible", F.array_join("reasons", "|").alias("reasons"),
                           F.size("members").cast("long").alias("n_members"))


@query("j11_past_systemic", sql("""
 SELECT e.universe, e.t0, count(DISTINCT t.asset) past_assets, count(DISTINCT t.asset) >= 3 past_systemic
 FROM q_study e JOIN q_st t ON t.universe = e.universe AND t.idx BETWEEN e.t0 - 10 AND e.t0
 GROUP BY ALL"""))
def j11_past(h):
    return (shocks.systemic_counts(h.study, h.study_triggers, ("universe",), ahead=0)
            .select("universe", "t0", F.col("systemic_assets").alias("past_assets"),
                    (F.col("systemic_assets") >= 3).alias("past_systemic")))


@query("a26_detector_statistics", sql("""
 WITH g(k) AS (VALUES (3), (4), (5), (6)),
 raw AS (SELECT universe, asset, k, count(*) FILTER (sigma > 0 AND abs(r5) > k * sigma) raw,
                count(*) FILTER (sigma = 0) zero_sigma FROM q_signal, g GROUP BY ALL),
 b AS (SELECT raw.*, COALESCE(t.kept, 0) kept FROM raw LEFT JOIN
       (SELECT universe, asset, k, count(*) kept FROM q_trig GROUP BY ALL) t USING (universe, asset, k))
 SELECT universe, k, COALESCE(asset, 'total') AS scope, CAST(sum(raw) AS BIGINT) raw,
        CAST(sum(kept) AS BIGINT) kept, CAST(sum(raw) - sum(kept) AS BIGINT) suppressed,
        CAST(sum(zero_sigma) AS BIGINT) zero_sigma
 FROM b GROUP BY GROUPING SETS ((universe, k, asset), (universe, k))"""))
def a26_stats(h):
    return shocks.detector_statistics(h.signal, h.triggers)


@query("a27_selected_k", sql("""
 WITH c AS (SELECT universe, k, count(*) FILTER (eligible) n FROM q_events GROUP BY ALL),
 s AS (SELECT universe, arg_min(k, abs(n - 40) * 100 - k) k FROM c WHERE n BETWEEN 20 AND 60
       GROUP BY universe)
 SELECT q_spans.universe, CAST(s.k AS DOUBLE) selected_k FROM q_spans LEFT JOIN s USING (universe)"""))
def a27_selected_k(h):
    return shocks.selected_k(h.events, universes=h.spans).withColumn(
        "selected_k", F.col("selected_k").cast("double"))


@query("f18_j2_truth_status", sql("""
 WITH o AS (SELECT universe, n, unnest(range(255, n, 30)) t0 FROM q_spans)
 SELECT o.universe, o.t0, a.asset, CASE WHEN o.t0 + 30 < o.n THEN 'ready' ELSE 'pending_truth' END status
 FROM o JOIN q_assets a USING (universe)"""))
def f18_j2_truth(h):
    """Origins to the very end of the data: the last ones still wait for their truth."""
    origins = windows.rolling_origins(h.spans, horizon=0)
    return windows.market_windows(origins, h.bars).select("universe", "t0", "asset", "status")


@query("j1_market_windows", sql(f"""
 SELECT universe, t0, asset, count(*) FILTER (o <= 0) n_hist, count(*) FILTER (o > 0) n_fut,
        {r('sum(close) FILTER (o <= 0)', 3)} hist_sum, {r('max(close) FILTER (o = 0)', 8)} spot
 FROM q_rwin GROUP BY ALL"""))
def j1_windows(h):
    return h.rolling_windows.select(
        "universe", "t0", "asset", F.size("hist").cast("long").alias("n_hist"),
        F.size("fut").cast("long").alias("n_fut"), rd(paths.total(F.col("hist")), 3)
        .alias("hist_sum"), rd(F.element_at("hist", -1), 8).alias("spot"))


@query("f18_fold_plan", sql("""
 WITH o AS (SELECT universe, n, unnest(range(255, n - 30, 30)) t0 FROM q_spans)
 SELECT universe, t0, available FROM (SELECT *, count(*) OVER (PARTITION BY universe) available,
        row_number() OVER (PARTITION BY universe ORDER BY t0) i FROM o)"""))
def f18_plan(h):
    return windows.rolling_origins(h.spans).withColumn(
        "available", F.col("available").cast("long"))


@query("f16_f17_calendar_origins", sql("""
 WITH g AS (SELECT universe, unnest(range(255, n - 30, 3)) t0 FROM q_spans),
 p AS (SELECT universe, t0, t0 // 48 day_no, row_number() OVER (PARTITION BY universe, t0 // 48
        ORDER BY t0) - 1 pos, count(*) OVER (PARTITION BY universe, t0 // 48) n FROM g)
 SELECT DISTINCT p.universe, p.t0, p.day_no FROM p, range(8) i(i)
 WHERE n <= 8 OR pos = (i.i * (n - 1)) // 7"""))
def f17_origins(h):
    return windows.calendar_origins(h.spans, per_day=8, stride=3, bars_per_day=48).select(
        "universe", "t0", "day_no")


@query("b1_b5_baseline_risk", sql(f"""
 SELECT p.universe, p.t0, p.asset, p.method, {r('p.mdd')} mdd, {r('p.vol')} vol,
        {r('b.beta')} beta FROM q_risk p
 LEFT JOIN q_beta b ON b.universe = p.universe AND b.t0 = p.t0 AND b.asset = p.asset
       AND p.method = 'driver_beta'"""))
def b1_risk(h):
    base = forecasts.baseline_paths(h.windows, h.study, h.assets)
    rows = base.unionByName(H.mirror(h.windows), allowMissingColumns=True)
    return forecasts.path_risk(rows).select(
        "universe", "t0", "asset", "method", rd("mdd").alias("mdd"), rd("vol").alias("vol"),
        rd(F.when(F.col("method") == "driver_beta", F.col("beta"))).alias("beta"))


@query("b4_b6_naive_scalars", sql(f"""
 SELECT universe, t0, asset, {r('vol255')} dynamic_naive, {r('vol30')} historical_volatility,
        {r('mdd30')} historical_drawdown, 0.0::DOUBLE naive_last_return, 0.0::DOUBLE naive_last_mdd FROM q_roll"""))
def b4_naive(h):
    last = forecasts.naive_last(h.rolling_windows).select(
        "universe", "t0", "asset",
        paths.terminal_return(F.col("spot"), F.col("closes")).alias("naive_last_return"),
        paths.max_drawdown(F.col("spot"), F.col("closes")).alias("naive_last_mdd"))
    return h.rolling.join(last, ["universe", "t0", "asset"]).select(
        "universe", "t0", "asset", rd("vol255").alias("dynamic_naive"),
        rd("vol30").alias("historical_volatility"), rd("mdd30").alias("historical_drawdown"),
        "naive_last_return", "naive_last_mdd")


@query("a9_a10_event_scores", sql(f"""
 SELECT universe, t0, method, metric, 'scored' AS status, asset_count, {r('mae')} mae,
        {r('recall')} recall, {r('chance')} chance, {r('spearman')} spearman, reason,
        predicted_tied, actual_tied FROM q_scores"""))
def a9_scores(h):
    return h.scores.select("universe", "t0", "method", "metric", "status", "asset_count",
                           rd("mae").alias("mae"), rd("recall").alias("recall"),
                           rd("chance").alias("chance"), rd("spearman").alias("spearman"),
                           "reason", "predicted_tied", "actual_tied")


@query("a8_a19_j6_summary", sql(f"""
 WITH c AS (SELECT universe, t0 FROM q_scores GROUP BY ALL HAVING count(DISTINCT method) = 4),
 e AS (SELECT s.*, CASE WHEN v.systemic THEN 'systemic' ELSE 'non_systemic' END grp0 FROM q_scores s
       JOIN c USING (universe, t0) JOIN q_study v USING (universe, t0))
 SELECT universe, method, metric, COALESCE(grp0, 'all') grp, count(*) events, {r('avg(mae)')} mae,
        {r('avg(mae) * 10000', 3)} mae_bps, {r('avg(recall)')} recall, {r('avg(spearman)')} spearman,
        count(spearman) spearman_defined, count(*) - count(spearman) spearman_undefined
 FROM e GROUP BY GROUPING SETS ((universe, method, metric, grp0), (universe, method, metric))"""))
def a8_summary(h):
    """Mean of event means over the events all methods scored, by margin."""
    paired = scoring.common_paired(h.scores, len(H.METHODS))
    flag = F.when(F.col("systemic"), "systemic").otherwise("non_systemic")
    rows = (h.scores.join(paired, ["universe", "t0"])
            .join(h.study.select("universe", "t0", flag.alias("grp0")), ["universe", "t0"]))
    return (rows.groupingSets([["universe", "method", "metric", "grp0"],
                               ["universe", "method", "metric"]],
                              "universe", "method", "metric", "grp0")
            .agg(F.coalesce("grp0", F.lit("all")).alias("grp"), F.count("*").alias("events"),
                 rd(F.avg("mae")).alias("mae"), rd(F.avg("mae") * 10000, 3).alias("mae_bps"),
                 rd(F.avg("recall")).alias("recall"), rd(F.avg("spearman")).alias("spearman"),
                 F.count("spearman").alias("spearman_defined"),
                 (F.count("*") - F.count("spearman")).alias("spearman_undefined"))
            .drop("grp0"))


@query("j16_scored_universe", sql("SELECT universe, t0, asset, tier FROM q_scored"))
def j16(h):
    return scoring.scored_universe(h.study, h.assets).select("universe", "t0", "asset", "tier")


@query("g11_risk_bounds", sql("""
 WITH t AS (SELECT universe, t0, asset, method, mdd, vol FROM q_risk_all)
 SELECT universe, t0, method, count(DISTINCT t.asset) = any_value(asset_count) AND count(*) =
        any_value(asset_count) AND bool_and(mdd BETWEEN 0 AND 1 AND vol >= 0) usable
 FROM t JOIN q_spans USING (universe) GROUP BY universe, t0, method"""))
def g11(h):
    actual = h.actual.withColumn("method", F.lit("actual"))
    return scoring.risk_table_status(h.risk.unionByName(actual.select(h.risk.columns)),
                                     h.spans.select("universe", "asset_count"),
                                     ["universe", "t0", "method"])


@query("g12_g13_overlap", sql("""
 SELECT universe, t0, t0 - p spacing FROM (SELECT universe, t0, lag(t0) OVER (PARTITION BY universe
        ORDER BY t0) p FROM q_study) WHERE t0 - p < 30"""))
def g12_overlap(h):
    return grid.non_overlap(h.study.select("universe", "t0"), 30, pos="t0")


@query("g10_observed_volume", sql(f"""
 SELECT universe, asset, idx, CASE WHEN count(*) OVER w < 30 THEN 'boundary_insufficient'
        WHEN NOT bool_and(volume >= 0 AND amount >= 0 AND (volume = 0) = (amount = 0)) OVER w
        THEN 'volume_invalid' ELSE 'valid' END volume_status,
        {r('CASE WHEN count(*) OVER w = 30 THEN sum(volume) OVER w END', 3)} volume_sum
 FROM q_bars WINDOW w AS (PARTITION BY universe, asset ORDER BY idx
                          ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def g10_volume(h):
    return grid.observed_volume(h.bars_once).select("universe", "asset", "idx", "volume_status",
                                               rd("volume_sum", 3).alias("volume_sum"))
