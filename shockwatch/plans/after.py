"""What happens after a shock: recovery, volume, path shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import grid, recovery, shapes, volume
from .core import rd
from .oracle import part, r, sql
from .registry import query

# A control keeps this many bars on both sides free of shocks. The hourly sample is too short for it (its
# controls lie 24 bars apart), so the ratios of the sample use a shorter one; both are registered.
CONTEXT, SHORT_CONTEXT = 120, 12

part("q_dec", """
 SELECT universe, t0, asset, o h, sqrt(10) * base baseline, sqrt(10) * recent recent,
        CASE WHEN base > 0 THEN recent / base END ratio
 FROM (SELECT *, stddev_pop(r) OVER (PARTITION BY universe, t0, asset ORDER BY o ROWS BETWEEN 9 PRECEDING
              AND CURRENT ROW) recent,
              stddev_pop(r) FILTER (o BETWEEN -124 AND -5) OVER (PARTITION BY universe, t0, asset) base
       FROM (SELECT e.universe, e.t0, b.asset, CAST(b.idx - e.t0 AS INT) o,
                    CASE WHEN b.idx > e.t0 - 125 THEN b.r END r
             FROM q_study e JOIN q_rets b ON b.universe = e.universe
              AND b.idx BETWEEN e.t0 - 125 AND e.t0 + 120 WHERE e.t0 + 120 < e.n)) WHERE o >= 0""")
part("q_curve", """
 SELECT d.universe, d.t0, a.tier, d.h, median(d.ratio) ratio FROM q_dec d JOIN q_assets a
   ON a.universe = d.universe AND a.asset = d.asset GROUP BY d.universe, d.t0, a.tier, d.h
 HAVING count(d.ratio) = count(*)""")
part("q_conf", """
 SELECT universe, t0, tier, min(h) FILTER (run = 10) confirmed_at, count(*) points FROM (
  SELECT *, sum((ratio <= 1.2)::INT) OVER (PARTITION BY universe, t0, tier ORDER BY h
         ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) run FROM q_curve) GROUP BY universe, t0, tier""")


def _curves(h):
    return h._once("curves", lambda: recovery.tier_curves(
        recovery.decay_ratios(h.study, h.bars, h.spans), h.assets))


@query("w6_decay_ratios", sql(f"""
 SELECT universe, t0, asset, h, {r('baseline')} baseline, {r('recent')} recent, {r('ratio')} ratio
 FROM q_dec"""))
def w6(h):
    return recovery.decay_ratios(h.study, h.bars, h.spans).select(
        "universe", "t0", "asset", "h", rd("baseline").alias("baseline"),
        rd("recent").alias("recent"), rd("ratio").alias("ratio"))


@query("a31_recovery_curves", sql(f"""
 SELECT universe, t0, tier, h, {r('ratio')} ratio FROM q_curve"""))
def a31(h):
    return _curves(h).select("universe", "t0", "tier", "h", rd("ratio").alias("ratio"))


@query("a31_decay_status", sql("""
 SELECT universe, t0, CASE WHEN t0 < 125 OR t0 + 120 >= n THEN 'boundary_insufficient'
        ELSE 'available' END status FROM q_study"""))
def a31_status(h):
    return h.study.join(h.spans, "universe").select(
        "universe", "t0", recovery.decay_status(F.col("t0"), F.col("n")).alias("status"))


@query("a32_median_curve", sql(f"""
 SELECT universe, tier, h, {r('median(ratio)')} ratio FROM q_curve GROUP BY universe, tier, h"""))
def a32(h):
    return recovery.median_curve(_curves(h)).select("universe", "tier", "h",
                                                    rd("ratio").alias("ratio"))


@query("w7_confirmations", sql("""
 SELECT universe, t0, tier, CAST(confirmed_at AS DOUBLE) confirmed_at, points FROM q_conf"""))
def w7(h):
    return recovery.confirmations(_curves(h)).withColumn(
        "confirmed_at", F.col("confirmed_at").cast("double"))


@query("w7_streaks", sql("""
 SELECT universe, t0, tier, h, CASE WHEN ratio <= 1.2 THEN h - COALESCE(b, -1) ELSE 0 END streak,
        CASE WHEN ratio <= 1.2 THEN h - COALESCE(b, -1) ELSE 0 END >= 10 confirmed,
        max((CASE WHEN ratio <= 1.2 THEN h - COALESCE(b, -1) ELSE 0 END >= 10)::INT) OVER (
         PARTITION BY universe, t0, tier ORDER BY h) = 1 had_confirmed
 FROM (SELECT *, max(CASE WHEN NOT ratio <= 1.2 THEN h END) OVER (PARTITION BY universe, t0, tier
       ORDER BY h) b FROM q_curve)"""))
def w7_streaks(h):
    return recovery.streaks(_curves(h)).select("universe", "t0", "tier", "h", "streak",
                                               "confirmed", "had_confirmed")


@query("a33_censored_median", sql("""
 SELECT universe, tier, n, n_confirmed, n - n_confirmed n_censored, CAST(m AS DOUBLE) median_minutes
 FROM (SELECT universe, tier, count(*) n, count(confirmed_at) n_confirmed,
              min(confirmed_at) FILTER (rn >= (nn + 1) // 2) m
       FROM (SELECT *, row_number() OVER (PARTITION BY universe, tier ORDER BY confirmed_at NULLS LAST) rn,
                    count(*) OVER (PARTITION BY universe, tier) nn FROM q_conf)
       GROUP BY universe, tier)"""))
def a33(h):
    return recovery.censored_median(recovery.confirmations(_curves(h)), ("universe", "tier")) \
        .withColumn("median_minutes", F.col("median_minutes").cast("double"))


part("q_vol30", """
 SELECT universe, asset, idx, ts, CASE WHEN count(*) OVER w < 30 THEN 'boundary_insufficient'
        WHEN NOT bool_and(volume >= 0 AND amount >= 0 AND (volume = 0) = (amount = 0)) OVER w
        THEN 'volume_invalid' ELSE 'valid' END volume_status,
        CASE WHEN count(*) OVER w = 30 THEN sum(volume) OVER w END volume_sum
 FROM q_bars WINDOW w AS (PARTITION BY universe, asset ORDER BY idx
                          ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def controls_sql(context: int) -> str:
    return f"""
 SELECT s.universe, s.t0, v.asset, s.back, v.volume_sum, CASE WHEN s.c < 0 THEN 'outside_authorized_data'
        WHEN s.c < {context} OR s.c + {context} >= s.t0 THEN 'context_boundary_insufficient'
        WHEN s.c - {context} < 65 THEN 'detector_coverage_unknown'
        WHEN (isodow(v.ts) >= 6) <> (isodow(s.ts) >= 6) THEN 'weekday_weekend_mismatch'
        WHEN EXISTS (SELECT 1 FROM q_st t WHERE t.universe = s.universe
                     AND t.idx BETWEEN s.c - {context} AND s.c + {context}) THEN 'shock_within_control_context'
        WHEN v.volume_status <> 'valid' THEN 'control_' || v.volume_status END rejected
 FROM (SELECT universe, t0, ts, b.back, t0 - b.back * CASE WHEN universe = 'events' THEN 24 ELSE 7 END c
       FROM q_study, range(1, 29) b(back)) s
 LEFT JOIN q_vol30 v ON v.universe = s.universe AND v.idx = s.c"""


def ratio_sql(controls: str) -> str:
    return f"""
 SELECT e.universe, e.t0, v.asset, COALESCE(g.n, 0) n_controls, CASE WHEN g.n >= 3 THEN g.m END control_median,
        concat_ws('|', CASE WHEN v.volume_status <> 'valid' THEN 'event_' || v.volume_status END,
                  CASE WHEN COALESCE(g.n, 0) < 3 THEN 'fewer_than_3_controls' END,
                  CASE WHEN g.n >= 3 AND g.m <= 0 THEN 'zero_control_baseline' END,
                  CASE WHEN v.volume_sum <= 0 THEN 'zero_event_volume' END) reasons, v.volume_sum
 FROM q_study e JOIN q_vol30 v ON v.universe = e.universe AND v.idx = e.t0
 LEFT JOIN (SELECT universe, t0, asset, count(*) n, median(volume_sum) m FROM {controls} WHERE rejected IS NULL
            GROUP BY universe, t0, asset) g ON g.universe = e.universe AND g.t0 = e.t0 AND g.asset = v.asset"""


part("q_ctl", controls_sql(SHORT_CONTEXT))
part("q_ctl_full", controls_sql(CONTEXT))
part("q_ratio", ratio_sql("q_ctl_full"))
part("q_ratio_short", ratio_sql("q_ctl"))


def _controls(h, context=CONTEXT):
    cycle = F.when(F.col("universe") == "events", 24).otherwise(7)
    return volume.controls(h.study, grid.observed_volume(h.bars), h.study_triggers, h.spans,
                           cycle, context)


def _ratios(h, context=CONTEXT):
    return h._once(f"ratios_{context}", lambda: volume.log_ratios(
        h.study, grid.observed_volume(h.bars), _controls(h, context)))


@query("j12_j13_controls", sql("""
 SELECT universe, rejected, count(DISTINCT (t0, back)) n FROM q_ctl_full WHERE rejected IS NOT NULL
 GROUP BY universe, rejected"""))
def j12(h):
    return volume.rejection_counts(_controls(h))


@query("j12_j13_controls_short_context", sql("""
 SELECT universe, rejected, count(DISTINCT (t0, back)) n FROM q_ctl WHERE rejected IS NOT NULL
 GROUP BY universe, rejected"""))
def j12_short(h):
    return volume.rejection_counts(_controls(h, SHORT_CONTEXT))


def event_ratio_sql(ratios: str) -> str:
    return sql(f"""
 SELECT universe, t0, asset, n_controls, {r('control_median', 3)} control_median, reasons,
        {r("CASE WHEN reasons = '' THEN ln(volume_sum) - ln(control_median) END")} log_ratio
 FROM {ratios}""")


@query("a34_volume_ratio", event_ratio_sql("q_ratio_short"))
def a34(h, context=SHORT_CONTEXT):
    return _ratios(h, context).select("universe", "t0", "asset", "n_controls",
                                      rd("control_median", 3).alias("control_median"),
                                      F.array_join("reasons", "|").alias("reasons"),
                                      rd("log_ratio").alias("log_ratio"))


@query("a34_volume_ratio_short_context", event_ratio_sql("q_ratio_short"))
def a34_short(h):
    return a34(h, SHORT_CONTEXT)


@query("a34_volume_ratio_full_context", event_ratio_sql("q_ratio"))
def a34_full(h):
    return a34(h, CONTEXT)


def group_ratio_sql(ratios: str) -> str:
    return sql(f"""
 WITH t AS (SELECT q.universe, q.t0, a.tier, CASE WHEN bool_and(reasons = '')
            THEN avg(CASE WHEN reasons = '' THEN ln(volume_sum) - ln(control_median) END) END v
            FROM {ratios} q JOIN q_assets a ON a.universe = q.universe AND a.asset = q.asset
            GROUP BY q.universe, q.t0, a.tier),
 e AS (SELECT t.*, CASE e.direction WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'mixed' END AS dir
       FROM t JOIN q_study e USING (universe, t0))
 SELECT universe, tier, COALESCE(dir, 'all') AS direction, count(*) expected, count(v) valid,
        {r('avg(v)')} mean_log_ratio, {r('exp(avg(v))')} geometric_multiple
 FROM e GROUP BY GROUPING SETS ((universe, tier, dir), (universe, tier))""")


@query("a34_f30_volume_groups", group_ratio_sql("q_ratio"))
def a34_groups(h, context=CONTEXT):
    named = F.when(F.col("direction") == 1, "up").when(F.col("direction") == -1, "down") \
        .otherwise("mixed")
    rows = volume.tier_ratios(_ratios(h, context), h.assets).join(
        h.study.select("universe", "t0", named.alias("dir")), ["universe", "t0"])
    return (rows.groupingSets([["universe", "tier", "dir"], ["universe", "tier"]],
                              "universe", "tier", "dir")
            .agg(F.coalesce("dir", F.lit("all")).alias("direction"),
                 F.count("*").alias("expected"), F.count("mean_log_ratio").alias("valid"),
                 rd(F.avg("mean_log_ratio")).alias("mean_log_ratio"),
                 rd(F.exp(F.avg("mean_log_ratio"))).alias("geometric_multiple")).drop("dir"))


@query("a34_f30_volume_groups_short_context", group_ratio_sql("q_ratio_short"))
def a34_groups_short(h):
    return a34_groups(h, SHORT_CONTEXT)


part("q_shape", """
 WITH c AS (SELECT o.universe, o.t0, CAST(b.idx - o.t0 AS INT) h, avg(ln(b.close / p.close)) y
            FROM (SELECT universe, t0, unnest(string_split(origins, '|')) asset FROM q_study) o
            JOIN q_bars p ON p.universe = o.universe AND p.asset = o.asset AND p.idx = o.t0 - 5
            JOIN q_bars b ON b.universe = o.universe AND b.asset = o.asset AND b.idx BETWEEN o.t0 AND o.t0 + 60
            GROUP BY o.universe, o.t0, b.idx),
 s AS (SELECT universe, t0, count(*) n, arg_min(y, h) y0, arg_max(y, h) y1, arg_min(h, (y, h)) trough,
              sum(step) travel
       FROM (SELECT *, abs(y - lag(y) OVER (PARTITION BY universe, t0 ORDER BY h)) step FROM c)
       GROUP BY universe, t0)
 SELECT e.universe, e.t0, s.y0, s.y1, s.trough, s.travel,
        CASE WHEN COALESCE(s.n, 0) <> 61 THEN 'incomplete_60m' WHEN e.direction = 0 THEN 'mixed_direction'
             WHEN s.y0 = 0 THEN 'zero_initial_move'
             WHEN e.direction = -1 AND s.trough <= 30 AND s.y1 >= -0.2 * abs(s.y0) THEN 'v_reversal'
             WHEN e.direction = 1 AND s.y1 <= 0.2 * abs(s.y0) THEN 'upward_false_breakout'
             WHEN s.y1 - s.y0 <= -0.5 * abs(s.y0) AND s.travel > 0 AND (s.y0 - s.y1) / s.travel >= 0.5
             THEN 'one_way_down' ELSE 'other' END shape
 FROM q_study e LEFT JOIN s ON s.universe = e.universe AND s.t0 = e.t0""")


@query("f26_f27_shapes", sql(f"""
 SELECT universe, t0, shape, {r('y0')} first_y, {r('y1')} last_y FROM q_shape"""))
def f26(h):
    return shapes.event_shapes(h.study, h.bars).select(
        "universe", "t0", "shape", rd(F.try_element_at("y", F.lit(1))).alias("first_y"),
        rd(F.try_element_at("y", F.lit(-1))).alias("last_y"))


@query("a38_shape_errors", sql(f"""
 WITH m AS (SELECT universe, t0, tier, method, avg(abs(p - a)) mae FROM q_pairs
            WHERE metric = 'max_drawdown' GROUP BY ALL),
 x AS (SELECT universe, t0, tier, mae model FROM m WHERE method = 'mirror')
 SELECT m.universe, m.tier, s.shape, m.method, count(*) n, {r('avg(m.mae)')} mae,
        {r('avg(x.model - m.mae)')} model_minus_method
 FROM m JOIN q_shape s ON s.universe = m.universe AND s.t0 = m.t0
 JOIN x ON x.universe = m.universe AND x.t0 = m.t0 AND x.tier = m.tier
 GROUP BY m.universe, m.tier, s.shape, m.method"""))
def a38(h):
    mae = (h.pairs.filter("metric = 'max_drawdown'").groupBy("universe", "t0", "tier", "method")
           .agg(F.avg(F.abs(F.col("p") - F.col("a"))).alias("mae")))
    model = mae.filter("method = 'mirror'").select("universe", "t0", "tier",
                                                   F.col("mae").alias("model"))
    shape = shapes.event_shapes(h.study, h.bars).select("universe", "t0", "shape")
    return (mae.join(model, ["universe", "t0", "tier"]).join(shape, ["universe", "t0"])
            .groupBy("universe", "tier", "shape", "method")
            .agg(F.count("*").alias("n"), rd(F.avg("mae")).alias("mae"),
                 rd(F.avg(F.col("model") - F.col("mae"))).alias("model_minus_method")))


@query("f28_normalised_paths", sql(f"""
 SELECT universe, t0, asset, method, step, {r('close / spot - 1')} x, {r('100 * (close / spot)', 5)} level
 FROM q_path WHERE method <> 'actual'"""))
def f28(h):
    """Every forecast path as returns from spot, and as levels with spot at 100."""
    rows = h.forecasts.select("universe", "t0", "asset", "method",
                              F.posexplode(paths.normalised(F.col("spot"), F.col("closes"))).alias("step", "x"))
    return rows.select("universe", "t0", "asset", "method", (F.col("step") + 1).alias("step"),
                       rd("x").alias("x"), rd(100 * (1 + F.col("x")), 5).alias("level"))


@query("f28_normalised_paths_by_method", sql(f"""
 SELECT universe, t0, asset, method, step, {r('close / spot - 1')} x FROM q_path WHERE method <> 'actual'"""))
def f28_by_method(h):
    rows = h.forecasts.select("universe", "t0", "asset", "method",
                              F.posexplode(paths.normalised(F.col("spot"), F.col("closes"))).alias("step", "x"))
    return rows.select("universe", "t0", "asset", "method", (F.col("step") + 1).alias("step"),
                       rd("x").alias("x"))
