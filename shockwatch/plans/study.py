"""Secondary analyses of the event study."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.ranking import average_rank, rank_scores, top_weights
from ..operators import comparison, diagnostics, resample, shocks
from ..session import materialize
from . import hub as H
from . import oracle as O
from .core import rd
from .oracle import part, r, sql
from .registry import query

STRONG = 3.5
REPS = resample.STRATIFIED_REPLICATES
NULL_REPS = 200

part("q_axis", """
 SELECT p.universe, p.t0, p.asset, p.method, p.metric, p.p, p.a, x.axis, CASE x.axis WHEN 'tier' THEN p.tier
        WHEN 'strength' THEN CASE WHEN e.magnitude < 3.5 THEN 'below' ELSE 'strong' END
        ELSE CASE WHEN e.systemic THEN 'systemic' ELSE 'non_systemic' END END grp
 FROM q_pairs p JOIN q_study e USING (universe, t0), (VALUES ('tier'), ('strength'), ('systemic')) x(axis)""")
part("q_axis_vol", "SELECT * FROM q_axis WHERE metric = 'volatility'")


@query("a20_f19_group_axes", sql(f"""
 WITH v AS ({O.rank_scores('q_axis_vol', 'universe, t0, method, axis, grp')}),
 m AS (SELECT universe, t0, method, axis, grp, avg(abs(p - a)) mdd_mae FROM q_axis
       WHERE metric = 'max_drawdown' GROUP BY ALL),
 e AS (SELECT universe, method, axis, grp, count(*) events, avg(mdd_mae) mdd_mae,
              count(CASE WHEN asset_count >= 3 THEN recall END) top3_defined,
              avg(CASE WHEN asset_count >= 3 THEN recall END) top3
       FROM v JOIN m USING (universe, t0, method, axis, grp) GROUP BY universe, method, axis, grp),
 g AS (SELECT * FROM (SELECT DISTINCT universe, method FROM q_pairs), (VALUES ('tier', 'major'), ('tier', 'small'),
       ('strength', 'below'), ('strength', 'strong'), ('systemic', 'systemic'), ('systemic', 'non_systemic')) l(axis, grp))
 SELECT universe, method, axis, grp, COALESCE(events, 0) events, {r('mdd_mae')} mdd_mae,
        COALESCE(top3_defined, 0) top3_defined, {r('top3')} top3
 FROM g LEFT JOIN e USING (universe, method, axis, grp)"""))
def a20(h):
    return diagnostics.group_axes(h.pairs, h.study, STRONG).select(
        "universe", "method", "axis", "grp", "events", rd("mdd_mae").alias("mdd_mae"),
        "top3_defined", rd("top3").alias("top3"))


@query("a21_direction_decomposition", sql(f"""
 WITH m AS (SELECT universe, t0, method, mae FROM q_scores WHERE metric = 'max_drawdown'),
 g AS (SELECT m.universe, m.method, e.direction, m.mae - x.mae gap FROM m JOIN m x USING (universe, t0)
       JOIN q_study e USING (universe, t0) WHERE x.method = 'mirror' AND m.method <> 'mirror'),
 w AS (SELECT universe, method, count(*) n_all, avg(gap) gap_all FROM g GROUP BY ALL)
 SELECT universe, method, direction, count(*) n, {r('avg(gap)')} gap,
        {r('count(*) / any_value(n_all)::DOUBLE * avg(gap)')} contribution,
        {r('count(*) / any_value(n_all)::DOUBLE * avg(gap) / NULLIF(any_value(gap_all), 0)')} share
 FROM g JOIN w USING (universe, method) GROUP BY universe, method, direction"""))
def a21(h):
    return diagnostics.direction_decomposition(h.scores, h.study, H.MODEL).select(
        "universe", "method", "direction", "n", rd("gap").alias("gap"),
        rd("contribution").alias("contribution"), rd("share").alias("share"))


part("q_sign", """
 SELECT universe, t0, asset, method, CAST(sign(round(arg_max(close, step) - any_value(spot), 9)) AS INT) sgn
 FROM q_path GROUP BY universe, t0, asset, method""")
part("q_signs", """
 SELECT s.universe, s.t0, s.asset, s.method, s.sgn, a.sgn actual, e.direction FROM q_sign s
 JOIN q_sign a ON a.universe = s.universe AND a.t0 = s.t0 AND a.asset = s.asset AND a.method = 'actual'
 JOIN q_study e ON e.universe = s.universe AND e.t0 = s.t0 WHERE s.method <> 'actual'""")


def _signs(h):
    # A replayed path may miss its spot by rounding noise; nine decimals decide flatness.
    sign = F.signum(F.round(F.element_at("closes", -1) - F.col("spot"), 9)).cast("int")
    spot = F.element_at("hist", -1)
    actual = h.windows.filter("status = 'ready'").select(
        "universe", "t0", "asset",
        F.signum(F.round(F.element_at("fut", -1) - spot, 9)).cast("int").alias("actual"))
    return (h.forecasts.filter("closes is not null")
            .select("universe", "t0", "asset", "method", sign.alias("sign"))
            .join(actual, ["universe", "t0", "asset"]))


@query("a22_b8_f9_sign_accuracy", sql(f"""
 WITH b AS (SELECT DISTINCT universe, t0, asset, actual, direction FROM q_signs),
 e AS (SELECT universe, method, sgn, actual, direction FROM q_signs
       UNION ALL SELECT universe, 'always_continue', CASE WHEN direction <> 0 THEN direction END, actual, direction FROM b
       UNION ALL SELECT universe, 'always_reverse', CASE WHEN direction <> 0 THEN -direction END, actual, direction FROM b)
 SELECT universe, method, count(*) FILTER (direction <> 0 AND actual <> 0) common_pairs,
        count(*) FILTER (direction <> 0 AND actual <> 0 AND sgn = actual) correct,
        count(*) FILTER (direction <> 0 AND actual <> 0 AND sgn = 0) flat, count(*) FILTER (sgn IS NULL) unavailable,
        {r('count(*) FILTER (direction <> 0 AND actual <> 0 AND sgn = actual) / NULLIF(count(*) FILTER (direction <> 0 AND actual <> 0), 0)')} accuracy
 FROM e GROUP BY universe, method"""))
def a22(h):
    return diagnostics.sign_accuracy(_signs(h), h.study).withColumn("accuracy", rd("accuracy"))


part("q_seg", """
 WITH p AS (SELECT universe, t0, asset, method, step, close FROM q_path
            UNION ALL SELECT universe, t0, asset, m.method, 0, spot FROM q_spot,
            (VALUES ('historical_30'), ('no_propagation'), ('driver_beta'), ('mirror'), ('actual')) m(method)),
 x AS (SELECT p.*, s.segment FROM p, range(3) s(segment) WHERE p.step BETWEEN 10 * s.segment AND 10 * s.segment + 10)
 SELECT universe, t0, asset, method, segment, max((peak - close) / peak) mdd,
        CASE WHEN min(lr) = max(lr) THEN 0.0 ELSE stddev_pop(lr) END * sqrt(10) vol
 FROM (SELECT *, max(close) OVER w peak, ln(close) - ln(lag(close) OVER w) lr FROM x
       WINDOW w AS (PARTITION BY universe, t0, asset, method, segment ORDER BY step))
 GROUP BY universe, t0, asset, method, segment""")
part("q_segmae", """
 SELECT p.universe, p.t0, p.method, p.segment, m.metric, avg(abs(CASE m.metric WHEN 'max_drawdown'
        THEN p.mdd - a.mdd ELSE p.vol - a.vol END)) mae
 FROM q_seg p JOIN q_seg a ON a.universe = p.universe AND a.t0 = p.t0 AND a.asset = p.asset AND a.segment = p.segment
  AND a.method = 'actual' JOIN q_scored s ON s.universe = p.universe AND s.t0 = p.t0 AND s.asset = p.asset,
  (VALUES ('max_drawdown'), ('volatility')) m(metric) WHERE p.method <> 'actual'
 GROUP BY p.universe, p.t0, p.method, p.segment, m.metric""")


def _with_actual(h):
    actual = h.windows.filter("status = 'ready'").select(
        "universe", "t0", "asset", F.element_at("hist", -1).alias("spot"),
        F.lit("actual").alias("method"), F.col("fut").alias("closes"))
    return h.forecasts.filter("closes is not null").select(actual.columns).unionByName(actual)


def _segment_errors(h):
    def one(i):
        spot, part_ = paths.segment(F.col("spot"), F.col("closes"), 10 * i)
        return F.struct(F.lit(i).alias("segment"), paths.max_drawdown(spot, part_).alias("mdd"),
                        paths.horizon_volatility(spot, part_).alias("vol"))
    keys = ["universe", "t0", "asset"]
    rows = _with_actual(h).select(*keys, "method", F.explode(F.array(*[one(i) for i in range(3)]))
                                  .alias("_s")).select(*keys, "method", "_s.*")
    scored = h.pairs.select(*keys).distinct()
    actual = rows.filter("method = 'actual'").select(*keys, "segment", F.col("mdd").alias("am"),
                                                     F.col("vol").alias("av"))
    both = (rows.filter("method <> 'actual'").join(actual, [*keys, "segment"]).join(scored, keys))
    return (both.groupBy("universe", "t0", "method", "segment")
            .agg(F.avg(F.abs(F.col("mdd") - F.col("am"))).alias("m"),
                 F.avg(F.abs(F.col("vol") - F.col("av"))).alias("v"))
            .select("universe", "t0", "method", "segment", F.explode(F.array(
                F.struct(F.lit("max_drawdown").alias("metric"), F.col("m").alias("mae")),
                F.struct(F.lit("volatility").alias("metric"), F.col("v").alias("mae")))).alias("_m"))
            .select("universe", "t0", "method", "segment", "_m.*"))


@query("f8_segment_errors", sql(f"""
 SELECT universe, method, CAST(segment AS INT) segment, metric, count(*) events, {r('avg(mae)')} mae
 FROM q_segmae GROUP BY universe, method, segment, metric"""))
def f8(h):
    return _segment_errors(h).groupBy("universe", "method", "segment", "metric").agg(
        F.count("*").alias("events"), rd(F.avg("mae")).alias("mae"))


@query("a23_advantage_radius", sql("""
 WITH m AS (SELECT universe, metric, segment, avg(mae) FILTER (method = 'mirror')
            < avg(mae) FILTER (method = 'historical_30') better FROM q_segmae GROUP BY universe, metric, segment),
 j AS (SELECT * FROM m UNION ALL SELECT universe, 'joint', segment, bool_and(better) FROM m GROUP BY universe, segment),
 p AS (SELECT *, bool_and(better) OVER (PARTITION BY universe, metric ORDER BY segment) pre FROM j)
 SELECT universe, metric, CAST(NULLIF(10 * count(*) FILTER (pre), 0) AS DOUBLE) radius FROM p GROUP BY universe, metric"""))
def a23(h):
    return diagnostics.advantage_radius(_segment_errors(h), H.MODEL, "historical_30").withColumn(
        "radius", F.col("radius").cast("double"))


part("q_down", """
 SELECT universe, t0, asset, method, sqrt(sum(least(lr, 0) ** 2)) dv FROM (
  SELECT *, ln(close) - ln(COALESCE(lag(close) OVER (PARTITION BY universe, t0, asset, method ORDER BY step), spot)) lr
  FROM q_path) GROUP BY universe, t0, asset, method""")
part("q_downp", """
 SELECT p.universe, p.t0, p.method, p.asset, round(p.dv, 12) p, round(a.dv, 12) a FROM q_down p JOIN q_down a
   ON a.universe = p.universe AND a.t0 = p.t0 AND a.asset = p.asset AND a.method = 'actual'
 JOIN q_scored s ON s.universe = p.universe AND s.t0 = p.t0 AND s.asset = p.asset WHERE p.method <> 'actual'""")


@query("a24_f7_downside", sql(f"""
 SELECT universe, method, count(*) events, {r('avg(mae)')} mae, {r('avg(recall)')} recall, {r('avg(chance)')} chance
 FROM ({O.rank_scores('q_downp', 'universe, t0, method')}) GROUP BY universe, method"""))
def a24(h):
    keys = ["universe", "t0", "asset"]
    rows = _with_actual(h).select(*keys, "method", F.round(paths.downside_volatility(
        F.col("spot"), F.col("closes")), 12).alias("p"))
    actual = rows.filter("method = 'actual'").select(*keys, F.col("p").alias("a"))
    scored = h.pairs.select(*keys).distinct()
    pairs = rows.filter("method <> 'actual'").join(actual, keys).join(scored, keys)
    return rank_scores(pairs, ["universe", "t0", "method"]).groupBy("universe", "method").agg(
        F.count("*").alias("events"), rd(F.avg("mae")).alias("mae"),
        rd(F.avg("recall")).alias("recall"), rd(F.avg("chance")).alias("chance"))


part("q_omit", """
 WITH s AS (SELECT p.universe, p.t0, p.asset, row_number() OVER (PARTITION BY p.universe, p.t0
            ORDER BY p.vol DESC, a.ordinal) <= 3 selected FROM q_risk p JOIN q_assets a USING (universe, asset)
            WHERE p.method = 'historical_30'),
 l AS (SELECT s.*, m.metric, CASE m.metric WHEN 'volatility' THEN x.vol ELSE x.mdd END actual
       FROM s JOIN q_actual x USING (universe, t0, asset), (VALUES ('volatility'), ('max_drawdown')) m(metric)),
 w AS (SELECT *, min(actual) FILTER (selected) OVER (PARTITION BY universe, t0, metric) weakest FROM l)
 SELECT *, NOT selected AND actual > weakest missed,
        CASE WHEN NOT selected AND actual > weakest THEN (actual - weakest) * 10000 END excess_bps,
        CASE WHEN NOT selected AND actual > weakest THEN (actual - weakest) / NULLIF(weakest, 0) END AS relative FROM w""")


def _omissions(h):
    return h._once("omissions", lambda: diagnostics.omissions(
        h.risk.filter("method = 'historical_30'"), h.actual, h.assets))


@query("a35_f29_omissions", sql(f"""
 SELECT universe, t0, metric, asset, {r('weakest')} weakest, {r('actual')} actual, {r('excess_bps', 3)} excess_bps,
        {r('relative')} AS relative FROM q_omit WHERE missed"""))
def a35(h):
    return _omissions(h).filter("missed").select(
        "universe", "t0", "metric", "asset", rd("weakest").alias("weakest"),
        rd("actual").alias("actual"), rd("excess_bps", 3).alias("excess_bps"),
        rd("relative").alias("relative"))


@query("a35_omission_rates", sql(f"""
 WITH p AS (SELECT universe, t0, metric AS scope, count(*) FILTER (missed) c FROM q_omit GROUP BY ALL),
 u AS (SELECT universe, t0, 'either' AS scope, count(DISTINCT asset) FILTER (missed) c FROM q_omit GROUP BY universe, t0),
 b AS (SELECT universe, t0, 'both' AS scope, min(c) c FROM p GROUP BY universe, t0),
 a AS (SELECT * FROM p UNION ALL SELECT * FROM u UNION ALL SELECT * FROM b)
 SELECT universe, scope, count(*) events, count(*) FILTER (c > 0) omitted, {r('avg((c > 0)::INT)')} rate,
        CAST(sum(c) AS BIGINT) missed_pairs, {r('avg(c)')} mean_missed FROM a GROUP BY universe, scope"""))
def a35_rates(h):
    return diagnostics.omission_summary(_omissions(h)).withColumn("rate", rd("rate")).withColumn(
        "mean_missed", rd("mean_missed"))


@query("a5_omission_quantiles", sql(f"""
 SELECT universe, metric, q::DOUBLE q, {r('quantile_cont(excess_bps, [0.1, 0.5, 0.75, 0.9, 0.99])[i]', 3)} x
 FROM q_omit, (VALUES (1, 0.1), (2, 0.5), (3, 0.75), (4, 0.9), (5, 0.99)) v(i, q) WHERE missed GROUP BY universe, metric, i, q"""))
def a5(h):
    from ..operators.quantiles import exact_quantiles
    rows = _omissions(h).filter("missed")
    return exact_quantiles(rows, ["universe", "metric"], "excess_bps",
                           [0.1, 0.5, 0.75, 0.9, 0.99]).select(
        "universe", "metric", "q", rd("value", 3).alias("x"))


@query("a36_amplitude_cases", sql(f"""
 WITH m AS (SELECT * FROM q_omit WHERE missed AND relative IS NOT NULL),
 q AS (SELECT universe, metric, quantile_cont(relative, 0.9) p90 FROM m GROUP BY ALL)
 SELECT universe, metric, {r('any_value(p90)')} p90, arg_min(t0, (abs(relative - p90), t0, asset)) near_t0,
        arg_min(asset, (abs(relative - p90), t0, asset)) near_asset, arg_min(t0, (-relative, t0, asset)) max_t0,
        arg_min(asset, (-relative, t0, asset)) max_asset, {r('max(relative)')} max_relative
 FROM m JOIN q USING (universe, metric) GROUP BY universe, metric"""))
def a36(h):
    return diagnostics.amplitude_cases(_omissions(h), digits=None).select(
        "universe", "metric", rd("p90").alias("p90"), "near_t0", "near_asset", "max_t0", "max_asset",
        rd("max_relative").alias("max_relative"))


part("q_volmdd", """
 SELECT x.universe, x.t0, x.asset, x.vol p, x.mdd a FROM q_actual x""")


@query("a37_risk_overlap", sql(f"""
 SELECT universe, t0, {r('3 * recall')} expected_intersection, predicted_crosses vol_tied, actual_crosses mdd_tied,
        NOT (predicted_crosses OR actual_crosses) AND recall >= 0.999999 full_overlap
 FROM ({O.rank_scores('q_volmdd', 'universe, t0')})"""))
def a37(h):
    pairs = h.actual.select("universe", "t0", "asset", F.col("vol").alias("p"), F.col("mdd").alias("a"))
    s = rank_scores(pairs, ["universe", "t0"])
    tied = F.col("predicted_crosses") | F.col("actual_crosses")
    return s.select("universe", "t0", rd(3 * F.col("recall")).alias("expected_intersection"),
                    F.col("predicted_crosses").alias("vol_tied"),
                    F.col("actual_crosses").alias("mdd_tied"),
                    (~tied & (F.col("recall") >= 0.999999)).alias("full_overlap"))


part("q_em", f"""
 WITH v AS ({O.rank_scores("(SELECT * FROM q_pairs WHERE metric = 'volatility')", 'universe, t0, tier, method')}),
 m AS (SELECT universe, t0, tier, method, avg(abs(p - a)) mdd_mae FROM q_pairs WHERE metric = 'max_drawdown' GROUP BY ALL)
 SELECT universe, t0, tier, method, asset_count n_assets, mdd_mae, mae vol_mae,
        CASE WHEN asset_count >= 3 THEN recall END vol_top3, CASE WHEN asset_count >= 3 THEN 3.0 / asset_count END chance
 FROM v JOIN m USING (universe, t0, tier, method)""")


def event_metrics(h):
    """Per (event, tier, method): errors on the scored universe, top-3 recall from three assets up."""
    def build():
        keys = ["universe", "t0", "tier", "method"]
        vol = rank_scores(h.pairs.filter("metric = 'volatility'"), keys)
        mdd = h.pairs.filter("metric = 'max_drawdown'").groupBy(*keys).agg(
            F.avg(F.abs(F.col("p") - F.col("a"))).alias("mdd_mae"))
        enough = F.col("asset_count") >= 3
        return vol.join(mdd, keys).select(
            *keys, F.col("asset_count").alias("n_assets"), "mdd_mae", F.col("mae").alias("vol_mae"),
            F.when(enough, F.col("recall")).alias("vol_top3"),
            F.when(enough, 3 / F.col("asset_count")).alias("chance"))
    return h._once("event_metrics", build)


@query("a64_event_metrics", sql(f"""
 SELECT universe, t0, tier, method, n_assets, {r('mdd_mae')} mdd_mae, {r('vol_mae')} vol_mae, {r('vol_top3')} vol_top3,
        {r('chance')} chance FROM q_em"""))
def a64(h):
    return event_metrics(h).select("universe", "t0", "tier", "method", "n_assets",
                                   *[rd(c).alias(c) for c in ("mdd_mae", "vol_mae", "vol_top3",
                                                              "chance")])


SESSION = "CASE WHEN hour({0}) < 8 THEN 'Asia' WHEN hour({0}) < 16 THEN 'Europe' ELSE 'Americas' END"
part("q_gap", f"""
 SELECT a.universe, a.t0, a.tier, e.period, e.ts, {SESSION.format('e.ts')} AS session, a.mdd_mae - b.mdd_mae mdd_mae,
        a.vol_top3 - b.vol_top3 vol_top3
 FROM q_em a JOIN q_em b USING (universe, t0, tier) JOIN q_study e USING (universe, t0)
 WHERE a.method = 'mirror' AND b.method = 'historical_30'""")


def _gaps(h):
    m = event_metrics(h)
    keys = ["universe", "t0", "tier"]
    b = m.filter("method = 'historical_30'").select(*keys, F.col("mdd_mae").alias("bm"),
                                                    F.col("vol_top3").alias("bt"))
    return (m.filter(F.col("method") == H.MODEL).join(b, keys)
            .join(h.study.select("universe", "t0", "ts", "period"), ["universe", "t0"])
            .select(*keys, "period", "ts", diagnostics.session(F.col("ts")).alias("session"),
                    (F.col("mdd_mae") - F.col("bm")).alias("mdd_mae"),
                    (F.col("vol_top3") - F.col("bt")).alias("vol_top3")))


@query("a39_f12_session_groups", sql(f"""
 SELECT universe, tier, session, COALESCE(period, 'combined') period, count(*) n, {r('avg(mdd_mae)')} mdd_gap,
        {r('avg(vol_top3)')} top3_gap FROM q_gap
 GROUP BY GROUPING SETS ((universe, tier, session, period), (universe, tier, session))"""))
def a39(h):
    return (_gaps(h).withColumnRenamed("period", "p0")
            .groupingSets([["universe", "tier", "session", "p0"], ["universe", "tier", "session"]],
                          "universe", "tier", "session", "p0")
            .agg(F.coalesce("p0", F.lit("combined")).alias("period"), F.count("*").alias("n"),
                 rd(F.avg("mdd_mae")).alias("mdd_gap"), rd(F.avg("vol_top3")).alias("top3_gap"))
            .drop("p0"))


@query("a40_tail_flags", sql(f"""
 WITH m AS (SELECT m.*, e.period FROM q_em m JOIN q_study e USING (universe, t0) WHERE m.method = 'mirror'),
 c AS (SELECT universe, period, tier, quantile_cont(mdd_mae, 0.9) cutoff FROM m GROUP BY ALL),
 p AS (SELECT e.universe, e.t0, count(DISTINCT t.asset) >= 3 past FROM q_study e JOIN q_st t
       ON t.universe = e.universe AND t.idx BETWEEN e.t0 - 10 AND e.t0 GROUP BY ALL),
 v AS (SELECT universe, t0, tier, avg(vol) pre FROM (SELECT w.universe, w.t0, w.asset, stddev_pop(w.r) * sqrt(30) vol
       FROM q_win w WHERE w.o BETWEEN -29 AND 0 GROUP BY ALL) JOIN q_assets USING (universe, asset) GROUP BY ALL)
 SELECT m.universe, m.t0, m.tier, m.period, m.mdd_mae >= c.cutoff worst, {r('c.cutoff')} cutoff,
        {r('v.pre')} pre30_volatility, p.past past_systemic
 FROM m JOIN c USING (universe, period, tier) JOIN p USING (universe, t0) JOIN v USING (universe, t0, tier)"""))
def a40(h):
    return _tails(h).select("universe", "t0", "tier", "period", "worst", rd("cutoff").alias("cutoff"),
                            rd("pre30_volatility").alias("pre30_volatility"), "past_systemic")


def _tails(h):
    m = event_metrics(h).filter(F.col("method") == H.MODEL).join(
        h.study.select("universe", "t0", "period", "ts"), ["universe", "t0"])
    flagged = diagnostics.tail_flags(m, ["universe", "period", "tier"], "mdd_mae")
    past = shocks.systemic_counts(h.study, h.study_triggers, ("universe",), ahead=0).select(
        "universe", "t0", (F.col("systemic_assets") >= 3).alias("past_systemic"))
    r30 = paths.log_returns(F.slice("hist", -31, 31))
    vol = (h.windows.select("universe", "t0", "asset", (paths.std_pop(r30) * F.sqrt(F.lit(30)))
                            .alias("v"))
           .join(h.assets.select("universe", "asset", "tier"), ["universe", "asset"])
           .groupBy("universe", "t0", "tier").agg(F.avg("v").alias("pre30_volatility")))
    return flagged.join(past, ["universe", "t0"]).join(vol, ["universe", "t0", "tier"])


DAYNO = """CASE WHEN universe = 'events' THEN day(ts) - 1 ELSE dayofyear(ts) - 1 END"""
NDAYS = """CASE WHEN universe = 'events' THEN day(last_day(ts)) ELSE dayofyear(make_date(year(ts), 12, 31)) END"""
DRAW = "('0x' || substr(md5(concat_ws('|', {})), 1, 8))::BIGINT"


def weights_sql(days: str, reps: int) -> str:
    return f"""
 SELECT universe, period, day_no, rep, count(*) w FROM (
  SELECT s.universe, s.period, rep.rep, {DRAW.format("'20260926', s.period, rep.rep, i.i")} % s.n_days day_no
  FROM (SELECT DISTINCT universe, period, n_days FROM {days}) s, range({reps}) rep(rep), range(366) i(i)
  WHERE i.i < s.n_days) SEMI JOIN {days} USING (universe, period, day_no) GROUP BY universe, period, day_no, rep"""


part("q_days", f"""
 SELECT DISTINCT universe, period, {DAYNO} day_no, {NDAYS} n_days FROM q_study""")
part("q_w", weights_sql("q_days", REPS))
part("q_gapv", f"""
 SELECT universe, tier, 'mdd_mae' AS metric, period, session, {DAYNO} day_no, mdd_mae v FROM q_gap
 UNION ALL SELECT universe, tier, 'vol_top3', period, session, {DAYNO}, vol_top3 FROM q_gap""")


def _days(h):
    number, length = resample.calendar_day(F.col("ts"), F.col("universe"))
    return h.study.select("universe", "t0", "period", number.alias("day_no"),
                          length.alias("n_days"))


def _weights(h):
    return h._once("weights", lambda: resample.strata_weights(
        _days(h).select("universe", "period", "day_no", "n_days").distinct(), REPS))


def _gap_values(h):
    cells = F.array(F.struct(F.lit("mdd_mae").alias("metric"), F.col("mdd_mae").alias("v")),
                    F.struct(F.lit("vol_top3").alias("metric"), F.col("vol_top3").alias("v")))
    return (_gaps(h).join(_days(h).select("universe", "t0", "day_no"), ["universe", "t0"])
            .select("universe", "tier", "period", "session", "day_no", F.explode(cells).alias("_c"))
            .select("universe", "tier", "period", "session", "day_no", "_c.*"))


BANDS = f"""{r('quantile_cont(m, 0.025)')} low, {r('quantile_cont(m, 0.975)')} high,
        {r('quantile_cont(m, 0.05 / 52)')} adjusted_low, {r('quantile_cont(m, 1 - 0.05 / 52)')} adjusted_high"""


@query("a42_stratified_mean", sql(f"""
 WITH d AS (SELECT universe, tier, metric, period, day_no, sum(v) s, count(v) c FROM q_gapv WHERE v IS NOT NULL GROUP BY ALL),
 p AS (SELECT universe, tier, metric, CAST(sum(c) AS BIGINT) n, count(*) n_days, sum(s) / sum(c) estimate FROM d
       GROUP BY universe, tier, metric),
 b AS (SELECT d.universe, d.tier, d.metric, w.rep, sum(w.w * d.s) / sum(w.w * d.c) m FROM d JOIN p USING (universe, tier, metric)
       JOIN q_w w ON w.universe = d.universe AND w.period = d.period AND w.day_no = d.day_no
       WHERE p.n >= 10 AND p.n_days >= 5 GROUP BY d.universe, d.tier, d.metric, w.rep),
 q AS (SELECT universe, tier, metric, {BANDS} FROM b GROUP BY universe, tier, metric)
 SELECT universe, tier, metric, n, n_days, {r('estimate')} estimate, n >= 10 AND n_days >= 5 stable, low, high,
        adjusted_low, adjusted_high FROM p LEFT JOIN q USING (universe, tier, metric)"""))
def a42(h):
    return resample.stratified_mean(_gap_values(h), _weights(h), ["universe", "tier", "metric"]).select(
        "universe", "tier", "metric", "n", "n_days", rd("estimate").alias("estimate"), "stable",
        *[rd(c).alias(c) for c in ("low", "high", "adjusted_low", "adjusted_high")])


part("q_tail", f"""
 WITH m AS (SELECT m.*, e.period, e.ts, e.systemic FROM q_em m JOIN q_study e USING (universe, t0) WHERE m.method = 'mirror'),
 c AS (SELECT universe, period, tier, quantile_cont(mdd_mae, 0.9) cutoff FROM m GROUP BY ALL)
 SELECT universe, tier, period, {DAYNO} day_no, mdd_mae >= cutoff worst, systemic FROM m JOIN c USING (universe, period, tier)""")


@query("a40_a42_tail_contrast", sql(f"""
 WITH x AS (SELECT universe, tier, period, day_no, CASE WHEN worst THEN 'a' ELSE 'b' END side, systemic::INT::DOUBLE v FROM q_tail),
 d AS (SELECT universe, tier, period, day_no, side, sum(v) s, count(v) c FROM x GROUP BY ALL),
 p AS (SELECT universe, tier, CAST(COALESCE(sum(c) FILTER (side = 'a'), 0) AS BIGINT) n_a,
              CAST(COALESCE(sum(c) FILTER (side = 'b'), 0) AS BIGINT) n_b,
              count(*) FILTER (side = 'a') days_a, count(*) FILTER (side = 'b') days_b,
              sum(s) FILTER (side = 'a') / sum(c) FILTER (side = 'a') - sum(s) FILTER (side = 'b') / sum(c) FILTER (side = 'b') estimate
       FROM d GROUP BY universe, tier),
 b AS (SELECT d.universe, d.tier, w.rep, sum(w.w * d.s) FILTER (side = 'a') / NULLIF(sum(w.w * d.c) FILTER (side = 'a'), 0)
              - sum(w.w * d.s) FILTER (side = 'b') / NULLIF(sum(w.w * d.c) FILTER (side = 'b'), 0) m
       FROM d JOIN p USING (universe, tier) JOIN q_w w ON w.universe = d.universe AND w.period = d.period AND w.day_no = d.day_no
       WHERE least(n_a, n_b) >= 10 AND least(days_a, days_b) >= 5 GROUP BY d.universe, d.tier, w.rep),
 q AS (SELECT universe, tier, {BANDS} FROM b GROUP BY universe, tier)
 SELECT universe, tier, n_a, n_b, days_a, days_b, {r('estimate')} estimate,
        least(n_a, n_b) >= 10 AND least(days_a, days_b) >= 5 stable, low, high, adjusted_low, adjusted_high
 FROM p LEFT JOIN q USING (universe, tier)"""))
def a42_contrast(h):
    """Systemic share among the worst-decile events against the rest."""
    rows = (_tails(h).join(_days(h).select("universe", "t0", "day_no"), ["universe", "t0"])
            .join(h.study.select("universe", "t0", "systemic"), ["universe", "t0"])
            .select("universe", "tier", "period", "day_no",
                    F.when(F.col("worst"), "a").otherwise("b").alias("side"),
                    F.col("systemic").cast("int").cast("double").alias("v")))
    return resample.stratified_contrast(rows, _weights(h), ["universe", "tier"]).select(
        "universe", "tier", "n_a", "n_b", "days_a", "days_b", rd("estimate").alias("estimate"), "stable",
        *[rd(c).alias(c) for c in ("low", "high", "adjusted_low", "adjusted_high")])


@query("a66_stable_candidate", sql(f"""
 WITH d AS (SELECT universe, tier, metric, period, day_no, sum(v) s, count(v) c FROM q_gapv WHERE v IS NOT NULL GROUP BY ALL),
 p AS (SELECT universe, tier, metric, sum(c) n, count(*) n_days, sum(s) / sum(c) estimate FROM d GROUP BY universe, tier, metric),
 pp AS (SELECT universe, tier, metric, period, sum(c) n, count(*) n_days, sum(s) / sum(c) estimate FROM d
        GROUP BY universe, tier, metric, period),
 b AS (SELECT d.universe, d.tier, d.metric, w.rep, sum(w.w * d.s) / sum(w.w * d.c) m FROM d JOIN p USING (universe, tier, metric)
       JOIN q_w w ON w.universe = d.universe AND w.period = d.period AND w.day_no = d.day_no
       WHERE p.n >= 10 AND p.n_days >= 5 GROUP BY d.universe, d.tier, d.metric, w.rep),
 q AS (SELECT universe, tier, metric, quantile_cont(m, 0.05 / 52) al, quantile_cont(m, 1 - 0.05 / 52) ah FROM b
       GROUP BY universe, tier, metric),
 a AS (SELECT pp.universe, pp.tier, pp.metric, bool_and(pp.n >= 10 AND pp.n_days >= 5 AND pp.estimate * p.estimate > 0) ok
       FROM pp JOIN p USING (universe, tier, metric) GROUP BY pp.universe, pp.tier, pp.metric)
 SELECT universe, tier, metric, COALESCE(n >= 10 AND n_days >= 5 AND (al > 0 OR ah < 0) AND ok, FALSE) candidate
 FROM p LEFT JOIN q USING (universe, tier, metric) LEFT JOIN a USING (universe, tier, metric)"""))
def a66(h):
    keys = ["universe", "tier", "metric"]
    values = _gap_values(h)
    combined = resample.stratified_mean(values, _weights(h), keys)
    parts_ = values.filter("v is not null").groupBy(*keys, "period").agg(
        F.avg("v").alias("estimate"),
        ((F.count("*") >= 10) & (F.count_distinct("day_no") >= 5)).alias("stable"))
    return resample.stable_candidate(combined, parts_, keys).select(*keys, "candidate")


CHECKED_REPS = 100
part("q_cdays", f"""
 SELECT DISTINCT universe, period, {DAYNO} day_no, {NDAYS} n_days FROM q_study SEMI JOIN q_curve USING (universe, t0)""")
part("q_cw", weights_sql("q_cdays", CHECKED_REPS))


def _curve_medians(h, reps):
    from .after import _curves
    number, length = resample.calendar_day(F.col("ts"), F.col("universe"))
    curves = materialize(_curves(h).join(h.study.select(
        "universe", "t0", "period", number.alias("day_no"), length.alias("n_days")),
        ["universe", "t0"]), "dated-curves")
    weights = resample.strata_weights(curves.select("universe", "period", "day_no", "n_days").distinct(), reps)
    return resample.weighted_medians(curves, weights, reps)


@query("a43_curve_replicates", sql(f"""
 WITH c AS (SELECT q.universe, q.tier, q.h, q.ratio, e.period, {DAYNO.replace('universe', 'e.universe').replace('ts', 'e.ts')} day_no
            FROM q_curve q JOIN q_study e ON e.universe = q.universe AND e.t0 = q.t0),
 x AS (SELECT c.universe, c.tier, c.h, w.rep, c.ratio, sum(w.w) OVER (PARTITION BY c.universe, c.tier, c.h, w.rep
              ORDER BY c.ratio ROWS UNBOUNDED PRECEDING) upto, sum(w.w) OVER (PARTITION BY c.universe, c.tier, c.h, w.rep) tot
       FROM c JOIN q_cw w ON w.universe = c.universe AND w.period = c.period AND w.day_no = c.day_no)
 SELECT universe, tier, h, CAST(rep AS BIGINT) rep, {r('(min(ratio) FILTER (upto > (tot - 1) // 2) + min(ratio) FILTER (upto > tot // 2)) / 2')} AS value
 FROM x GROUP BY universe, tier, h, rep"""))
def a43_replicates(h):
    """Weighted median curves of the first hundred replicates; a replicate does not depend on how many there are."""
    return _curve_medians(h, CHECKED_REPS).select("universe", "tier", "h", "rep", rd("value").alias("value"))


@query("a43_curve_bootstrap")
def a43(h):
    """Pointwise band of the weighted median recovery curve over all replicates.

    Its replicates are those of a43_curve_replicates, which SQL checks; sorting all of them again is too much for SQL.
    """
    return _curve_medians(h, REPS).groupBy("universe", "tier", "h").agg(
        F.count("*").alias("replicates"), rd(F.percentile("value", 0.025)).alias("low"),
        rd(F.percentile("value", 0.975)).alias("high"))


part("q_shift", f"""
 SELECT t.universe, rep.rep, t.asset, (t.idx + {DRAW.format("'20260926', rep.rep, t.asset")} % s.n) % s.n idx
 FROM q_st t JOIN q_spans s USING (universe), range({NULL_REPS}) rep(rep)
 UNION ALL SELECT universe, -1, asset, idx FROM q_st""")
part("q_sanch(universe, rep, t0)", """
 SELECT universe, rep, min(idx) FROM q_shift GROUP BY ALL
 UNION ALL
 SELECT t.universe, t.rep, min(t.idx) FROM q_sanch p JOIN q_shift t
   ON t.universe = p.universe AND t.rep = p.rep AND t.idx > p.t0 + 10 GROUP BY t.universe, t.rep, p.t0""")
part("q_null", """
 WITH e AS (SELECT a.universe, a.rep, a.t0, a.t0 >= 255 AND a.t0 + 30 < s.n ok FROM q_sanch a JOIN q_spans s USING (universe)),
 o AS (SELECT e.universe, e.rep, e.t0, t.asset source FROM e JOIN q_shift t ON t.universe = e.universe AND t.rep = e.rep
       AND t.idx = e.t0 WHERE e.ok),
 f AS (SELECT e.universe, e.rep, e.t0, t.asset target, min(t.idx) - e.t0 delay FROM e JOIN q_shift t
       ON t.universe = e.universe AND t.rep = e.rep AND t.idx > e.t0 AND t.idx <= e.t0 + 30 WHERE e.ok
       AND NOT EXISTS (SELECT 1 FROM o WHERE o.universe = e.universe AND o.rep = e.rep AND o.t0 = e.t0 AND o.source = t.asset)
       GROUP BY e.universe, e.rep, e.t0, t.asset),
 g AS (SELECT o.universe, o.rep, o.source, f.target, count(*) c, sum(f.delay) d FROM o JOIN f USING (universe, rep, t0)
       GROUP BY o.universe, o.rep, o.source, f.target),
 x AS (SELECT universe, rep, count(*) pairs, sum(c) observations, sum(d) / sum(c) mean_delay, avg(d / c) edge_mean_delay
       FROM g GROUP BY universe, rep)
 SELECT universe, rep, count(*) merged, count(*) FILTER (ok) eligible, COALESCE(any_value(x.pairs), 0) pairs,
        CAST(COALESCE(any_value(x.observations), 0) AS BIGINT) observations, any_value(x.mean_delay) mean_delay,
        any_value(x.edge_mean_delay) edge_mean_delay FROM e LEFT JOIN x USING (universe, rep) GROUP BY universe, rep""")


def _null(h):
    return h._once("null_graphs", lambda: resample.null_graphs(h.study_triggers, h.spans, NULL_REPS))


@query("a45_shift_null", sql(f"""
 SELECT universe, rep, merged, eligible, pairs, observations, {r('mean_delay')} mean_delay,
        {r('edge_mean_delay')} edge_mean_delay FROM q_null WHERE rep >= 0"""))
def a45(h):
    return _null(h).select("universe", F.col("rep").cast("long").alias("rep"), "merged", "eligible",
                           "pairs", "observations", rd("mean_delay").alias("mean_delay"),
                           rd("edge_mean_delay").alias("edge_mean_delay"))


@query("a45_a46_holm", sql(f"""
 WITH l AS (SELECT universe, rep, s.statistic, CASE s.statistic WHEN 'pairs' THEN pairs::DOUBLE WHEN 'observations'
            THEN observations::DOUBLE WHEN 'mean_delay' THEN mean_delay ELSE edge_mean_delay END v
            FROM q_null, (VALUES ('pairs'), ('observations'), ('mean_delay'), ('edge_mean_delay')) s(statistic)),
 t AS (SELECT n.universe, n.statistic, any_value(x.v) AS real, count(*) FILTER (CASE WHEN n.statistic IN ('pairs', 'observations')
              THEN n.v >= x.v ELSE n.v <= x.v END) extreme, avg(n.v) null_mean
       FROM l n JOIN l x ON x.universe = n.universe AND x.statistic = n.statistic AND x.rep = -1 WHERE n.rep >= 0
       GROUP BY n.universe, n.statistic),
 p AS (SELECT *, (1 + extreme) / {1 + NULL_REPS}.0 p FROM t),
 h AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY universe) - row_number() OVER (PARTITION BY universe
              ORDER BY p, statistic) + 1) * p) step FROM p)
 SELECT universe, statistic, {r('"real"')} AS real, extreme, {r('null_mean')} null_mean, {r('p')} p,
        {r('max(step) OVER (PARTITION BY universe ORDER BY p, statistic)')} p_holm FROM h"""))
def a46(h):
    real = resample.graph_statistics(h.study_triggers, h.spans, ["universe"])
    tests = resample.tail_tests(real, _null(h), NULL_REPS)
    return resample.holm(tests, ["universe"]).select(
        "universe", "statistic", rd("real").alias("real"), "extreme", rd("null_mean").alias("null_mean"),
        rd("p").alias("p"), rd("p_holm").alias("p_holm"))


@query("a45_null_summary", sql(f"""
 WITH l AS (SELECT universe, rep, s.statistic, CASE s.statistic WHEN 'pairs' THEN pairs::DOUBLE WHEN 'observations'
            THEN observations::DOUBLE WHEN 'mean_delay' THEN mean_delay ELSE edge_mean_delay END v
            FROM q_null, (VALUES ('pairs'), ('observations'), ('mean_delay'), ('edge_mean_delay')) s(statistic) WHERE rep >= 0)
 SELECT universe, statistic, count(*) replicates, count(*) - count(v) empty, {r('quantile_cont(v, 0.05)')} p05,
        {r('quantile_cont(v, 0.5)')} p50, {r('quantile_cont(v, 0.95)')} p95 FROM l GROUP BY universe, statistic"""))
def a45_summary(h):
    """The null distribution of each statistic, and how many replicates left it undefined."""
    return resample.null_summary(_null(h)).select(
        "universe", "statistic", "replicates", "empty", *[rd(q).alias(q) for q in ("p05", "p50", "p95")])


part("q_ens", """
 SELECT s.universe, s.t0, s.asset, p.p path_id, s.step, s.spot, s.spot * exp(sum(w.r) OVER (
        PARTITION BY s.universe, s.t0, s.asset, p.p ORDER BY s.step)) AS close
 FROM (SELECT universe, t0, asset, spot, g.step FROM q_spot, range(1, 31) g(step)) s, range(10) p(p)
 JOIN q_win w ON w.universe = s.universe AND w.t0 = s.t0 AND w.asset = s.asset AND w.o = s.step - 30 - 3 * p.p""")
part("q_ensrisk", """
 SELECT universe, t0, asset, path_id, max((peak - close) / peak) mdd, arg_max(close, step) / any_value(spot) - 1 ret,
        CASE WHEN min(lr) = max(lr) THEN 0.0 ELSE stddev_pop(lr) END * sqrt(30) vol,
        (max(close) - min(close)) / any_value(spot) amplitude, arg_max(close, step) last_close, any_value(spot) spot
 FROM (SELECT *, greatest(spot, max(close) OVER w) peak, ln(close) - ln(COALESCE(lag(close) OVER w, spot)) lr
       FROM q_ens WINDOW w AS (PARTITION BY universe, t0, asset, path_id ORDER BY step))
 GROUP BY universe, t0, asset, path_id""")


def _ensemble(h):
    return h._once("ensemble", lambda: H.ensemble(h.windows))


def _ensemble_risk(h):
    spot, closes = F.col("spot"), F.col("closes")
    return _ensemble(h).select(
        "universe", "t0", "asset", "path_id", paths.max_drawdown(spot, closes).alias("mdd"),
        paths.terminal_return(spot, closes).alias("ret"),
        paths.horizon_volatility(spot, closes).alias("vol"),
        paths.amplitude(spot, closes, closes).alias("amplitude"))


@query("a4_a58_f5_f6_path_distributions", sql(f"""
 SELECT universe, t0, asset, metric, count(v) n_paths, {r('avg(v)')} mean, {r('quantile_cont(v, 0.05)')} p05,
        {r('quantile_cont(v, 0.5)')} p50, {r('quantile_cont(v, 0.95)')} p95
 FROM (SELECT universe, t0, asset, m.metric, CASE m.metric WHEN 'max_drawdown' THEN mdd WHEN 'terminal_return' THEN ret
       WHEN 'volatility' THEN vol ELSE amplitude END v FROM q_ensrisk,
       (VALUES ('max_drawdown'), ('terminal_return'), ('volatility'), ('amplitude')) m(metric))
 GROUP BY universe, t0, asset, metric"""))
def a4(h):
    """Metrics of each path first, their distribution over the ten paths after."""
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("v")) for n, c in (
        ("max_drawdown", "mdd"), ("terminal_return", "ret"), ("volatility", "vol"),
        ("amplitude", "amplitude"))])
    rows = _ensemble_risk(h).select("universe", "t0", "asset", F.explode(cells).alias("_c")).select(
        "universe", "t0", "asset", "_c.*")
    return diagnostics.path_quantiles(rows, ["universe", "t0", "asset", "metric"], "v",
                                      H.ENSEMBLE_PATHS).select(
        "universe", "t0", "asset", "metric", "n_paths",
        *[rd(c).alias(c) for c in ("mean", "p05", "p50", "p95")])


@query("a59_price_fan", sql(f"""
 SELECT universe, t0, asset, step, {r('quantile_cont(close / spot, 0.05)')} p05, {r('quantile_cont(close / spot, 0.5)')} p50,
        {r('quantile_cont(close / spot, 0.95)')} p95 FROM q_ens GROUP BY universe, t0, asset, step"""))
def a59(h):
    rows = _ensemble(h).select("universe", "t0", "asset", "spot", F.posexplode("closes").alias("s", "close"))
    return rows.groupBy("universe", "t0", "asset", (F.col("s") + 1).cast("long").alias("step")).agg(
        *[rd(F.percentile(F.col("close") / F.col("spot"), q)).alias(n) for n, q in (("p05", 0.05), ("p50", 0.5),
                                                               ("p95", 0.95))])


@query("a15_coverage", sql(f"""
 WITH b AS (SELECT universe, t0, asset, quantile_cont(mdd, 0.05) lo, quantile_cont(mdd, 0.95) hi FROM q_ensrisk GROUP BY ALL),
 c AS (SELECT b.universe, a.tier, CASE WHEN x.mdd < lo THEN 'below' WHEN x.mdd > hi THEN 'above' ELSE 'covered' END pos
       FROM b JOIN q_actual x USING (universe, t0, asset) JOIN q_assets a USING (universe, asset))
 SELECT universe, COALESCE(tier, 'pooled') AS scope, count(*) n, count(*) FILTER (pos = 'covered') covered,
        count(*) FILTER (pos = 'below') below, count(*) FILTER (pos = 'above') above,
        {r("avg((pos = 'covered')::INT)")} rate FROM c GROUP BY GROUPING SETS ((universe, tier), (universe))"""))
def a15(h):
    keys = ["universe", "t0", "asset"]
    band = diagnostics.path_quantiles(_ensemble_risk(h), keys, "mdd", H.ENSEMBLE_PATHS)
    rows = diagnostics.coverage(band.join(h.actual, keys), "p05", "p95", "mdd").join(
        h.assets.select("universe", "asset", "tier"), ["universe", "asset"])
    pos = F.col("position")
    return (rows.groupingSets([["universe", "tier"], ["universe"]], "universe", "tier")
            .agg(F.coalesce("tier", F.lit("pooled")).alias("scope"), F.count("*").alias("n"),
                 F.count_if(pos == "covered").alias("covered"), F.count_if(pos == "below").alias("below"),
                 F.count_if(pos == "above").alias("above"),
                 rd(F.avg((pos == "covered").cast("int"))).alias("rate")).drop("tier"))


@query("a6_a7_portfolio", sql(f"""
 WITH q AS (SELECT universe, t0, asset, 10000.0 / count(*) OVER (PARTITION BY universe, t0) / spot quantity, spot FROM q_spot),
 v AS (SELECT e.universe, e.t0, e.path_id, e.step, sum(q.quantity * e.close) AS value FROM q_ens e
       JOIN q USING (universe, t0, asset) GROUP BY ALL),
 p AS (SELECT *, greatest(10000.0, max(value) OVER (PARTITION BY universe, t0, path_id ORDER BY step)) peak FROM v)
 SELECT universe, t0, path_id, {r('arg_max(value, step)', 4)} final_value, {r('arg_max(value, step) - 10000.0', 4)} pnl,
        {r('arg_max(value, step) / 10000.0 - 1')} terminal_return, {r('max((peak - value) / peak)')} mdd
 FROM p GROUP BY universe, t0, path_id"""))
def a6(h):
    from ..operators import portfolio
    equal = portfolio.equal_weights(_ensemble(h).select("universe", "t0", "asset", "spot").distinct())
    held = portfolio.holdings(equal, 10_000.0)
    return portfolio.path_values(_ensemble(h), held).select(
        "universe", "t0", F.col("path_id").cast("long").alias("path_id"),
        rd("final_value", 4).alias("final_value"), rd("pnl", 4).alias("pnl"),
        rd("terminal_return").alias("terminal_return"), rd("mdd").alias("mdd"))


@query("a6_contributions", sql(f"""
 WITH q AS (SELECT universe, t0, asset, 10000.0 / count(*) OVER (PARTITION BY universe, t0) / spot quantity FROM q_spot)
 SELECT e.universe, e.t0, e.asset, {r('avg(q.quantity * (e.last_close - e.spot))', 4)} mean_pnl FROM q_ensrisk e
 JOIN q USING (universe, t0, asset) GROUP BY e.universe, e.t0, e.asset"""))
def a6_contributions(h):
    from ..operators import portfolio
    equal = portfolio.equal_weights(_ensemble(h).select("universe", "t0", "asset", "spot").distinct())
    return portfolio.contributions(_ensemble(h), portfolio.holdings(equal, 10_000.0)).groupBy(
        "universe", "t0", "asset").agg(rd(F.avg("pnl"), 4).alias("mean_pnl"))


@query("a49_o5_failure_profile", sql(f"""
 WITH m AS (SELECT m.*, e.direction, e.systemic, {SESSION.format('e.ts')} AS session FROM (
             SELECT universe, t0, mae FROM q_scores WHERE method = 'mirror' AND metric = 'max_drawdown') m
            JOIN q_study e USING (universe, t0)),
 k AS (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY mae DESC, t0) <= 10 top FROM m),
 l AS (SELECT universe, top, f.field, CASE f.field WHEN 'direction' THEN direction::VARCHAR WHEN 'systemic' THEN systemic::VARCHAR
       ELSE session END AS label FROM k, (VALUES ('direction'), ('systemic'), ('session')) f(field)),
 c AS (SELECT universe, field, label, count(*) FILTER (top) worst, count(*) population FROM l GROUP BY ALL)
 SELECT universe, field, label, worst, population, {r('worst / NULLIF(sum(worst) OVER (PARTITION BY universe, field), 0)')} worst_share,
        {r('population / sum(population) OVER (PARTITION BY universe, field)')} population_share FROM c"""))
def a49(h):
    rows = (h.scores.filter((F.col("method") == H.MODEL) & (F.col("metric") == "max_drawdown"))
            .select("universe", "t0", "mae")
            .join(h.study.select("universe", "t0", "direction", "systemic", diagnostics.session(
                F.col("ts")).alias("session")), ["universe", "t0"]))
    return diagnostics.failure_profile(rows, "mae", ("direction", "systemic", "session")).withColumn(
        "worst_share", rd("worst_share")).withColumn("population_share", rd("population_share"))


@query("a62_w10_replay_extract", sql(f"""
 WITH k AS (SELECT universe, arg_min(t0, (-magnitude, t0)) t0 FROM q_study GROUP BY universe)
 SELECT e.universe, e.t0, b.asset, CAST(b.idx - e.t0 AS INT) o, CASE WHEN b.idx <= e.t0 THEN 'past' ELSE 'future' END AS side,
        {r('b.close', 8)} AS close FROM k e JOIN q_bars b ON b.universe = e.universe AND b.idx BETWEEN e.t0 - 30 AND e.t0 + 30"""))
def a62(h):
    """Observed closes around the strongest event of each universe, 30 bars either side."""
    from ..operators.bandjoin import band_join
    top = h.study.groupBy("universe").agg(F.min_by("t0", F.struct(
        (-F.col("magnitude")).alias("m"), "t0")).alias("t0"))
    near = band_join(top, h.bars.select("universe", "asset", F.col("idx").alias("_i"), "close"),
                     ("universe",), -30, 30, "t0", "_i")
    return near.select("universe", "t0", "asset", (F.col("_i") - F.col("t0")).cast("int").alias("o"),
                       F.when(F.col("_i") <= F.col("t0"), "past").otherwise("future").alias("side"),
                       rd("close", 8).alias("close"))


@query("w10_inclusion_weights", sql(f"""
 SELECT universe, t0, method, metric, asset, {r('rp')} avg_rank, {r('wp')} weight, pti tied
 FROM ({O.ranked('q_pairs', 'universe, t0, method, metric')})"""))
def w10(h):
    keys = ["universe", "t0", "method", "metric"]
    rows = top_weights(h.pairs, keys, "p", "weight").withColumn("avg_rank", average_rank(keys, "p"))
    return rows.select(*keys, "asset", rd("avg_rank").alias("avg_rank"), rd("weight").alias("weight"),
                       F.col("weight_tied").alias("tied"))


@query("o7_replay_selection", sql("""
 WITH s AS (SELECT universe, arg_min(t0, (-magnitude, t0)) t0 FROM q_study WHERE systemic GROUP BY universe),
 n AS (SELECT universe, arg_min(t0, (-magnitude, t0)) t0 FROM q_study WHERE NOT systemic GROUP BY universe),
 m AS (SELECT universe, median(magnitude) m FROM q_study GROUP BY universe),
 c AS (SELECT universe, arg_min(t0, (abs(magnitude - m), t0)) t0 FROM q_study JOIN m USING (universe)
       WHERE (universe, t0) NOT IN (SELECT universe, t0 FROM s UNION ALL SELECT universe, t0 FROM n) GROUP BY universe)
 SELECT universe, t0, 'strongest_systemic' AS role FROM s UNION ALL SELECT universe, t0, 'strongest_non_systemic' FROM n
 UNION ALL SELECT universe, t0, 'median_strength' FROM c"""))
def o7(h):
    from ..operators.quantiles import exact_quantiles
    strongest = F.min_by("t0", F.struct((-F.col("magnitude")).alias("m"), "t0")).alias("t0")
    s = h.study.filter("systemic").groupBy("universe").agg(strongest) \
        .withColumn("role", F.lit("strongest_systemic"))
    n = h.study.filter("not systemic").groupBy("universe").agg(strongest) \
        .withColumn("role", F.lit("strongest_non_systemic"))
    taken = s.unionByName(n)
    mid = exact_quantiles(h.study, ["universe"], "magnitude", [0.5]).select("universe", "value")
    # The two middle events of an even number are equally far from the median; nine decimals decide.
    gap = F.round(F.abs(F.col("magnitude") - F.col("value")), 9)
    c = (h.study.join(taken, ["universe", "t0"], "left_anti").join(mid, "universe").groupBy("universe")
         .agg(F.min_by("t0", F.struct(gap.alias("d"), "t0")).alias("t0")).withColumn("role", F.lit("median_strength")))
    return taken.unionByName(c)


@query("a60_path_shape_differences", sql(f"""
 WITH d AS (SELECT universe, asset, day, m_mdd - a_mdd AS diff FROM q_roll)
 SELECT universe, asset, count(*) n, {r('avg(diff)')} mean, {r('median(diff)')} median, {r('quantile_cont(diff, 0.9)')} p90,
        {r('avg((diff > 0)::INT)')} raised FROM d GROUP BY universe, asset"""))
def a60(h):
    from ..operators.quantiles import exact_quantiles
    rows = h.rolling.withColumn("diff", F.col("m_mdd") - F.col("a_mdd"))
    q = exact_quantiles(rows, ["universe", "asset"], "diff", [0.5, 0.9]).groupBy("universe", "asset").agg(
        rd(F.max(F.when(F.col("q") == 0.5, F.col("value")))).alias("median"),
        rd(F.max(F.when(F.col("q") == 0.9, F.col("value")))).alias("p90"))
    return rows.groupBy("universe", "asset").agg(
        F.count("*").alias("n"), rd(F.avg("diff")).alias("mean"),
        rd(F.avg((F.col("diff") > 0).cast("int"))).alias("raised")).join(q, ["universe", "asset"])


@query("a52_distinct", sql("""
 SELECT universe, count(DISTINCT t0) AS events, count(DISTINCT day) AS days, count(DISTINCT period) AS periods,
        count(*) - count(DISTINCT t0) AS duplicates FROM q_study GROUP BY universe"""))
def a52(h):
    return h.study.groupBy("universe").agg(
        F.count_distinct("t0").alias("events"), F.count_distinct("day").alias("days"),
        F.count_distinct("period").alias("periods"),
        (F.count("*") - F.count_distinct("t0")).alias("duplicates"))


@query("w11_revealed_prefix", sql(f"""
 WITH x AS (SELECT w.universe, w.t0, w.asset, w.close c, max(w.close) OVER (PARTITION BY w.universe, w.t0, w.asset ORDER BY w.o) peak
            FROM q_win w WHERE w.o BETWEEN 0 AND 12),
 d AS (SELECT universe, t0, asset, max((peak - c) / peak) dd FROM x GROUP BY ALL),
 s AS (SELECT universe, t0, asset, row_number() OVER (PARTITION BY universe, t0 ORDER BY vol DESC, asset) <= 3 f
       FROM q_risk WHERE method = 'historical_30')
 SELECT universe, t0, CASE WHEN f THEN 'focused' ELSE 'deferred' END grp, arg_max(asset, (round(dd, 9), asset)) asset,
        {r('max(dd)')} dd FROM d JOIN s USING (universe, t0, asset) GROUP BY ALL"""))
def w11(h):
    """Twelve bars after the shock: the worst focused and the worst deferred asset so far."""
    from ..operators.attention import partition_attention
    split = partition_attention(h.risk.filter("method = 'historical_30'"), 3, ("universe", "t0"), "vol")
    spot = F.element_at("hist", -1)
    seen = h.windows.select("universe", "t0", "asset", paths.max_drawdown(
        spot, F.slice("fut", 1, 12)).alias("dd"))
    return (split.join(seen, ["universe", "t0", "asset"]).groupBy("universe", "t0", F.col("group").alias("grp"))
            .agg(F.max_by("asset", F.struct(F.round("dd", 9).alias("d"), "asset")).alias("asset"),
                 rd(F.max("dd")).alias("dd")))
