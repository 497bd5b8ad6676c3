"""Checks and repairs of forecast rows, identities, calendar features and training export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, paths
from ..operators import diagnostics, forecasts, training, windows
from ..operators.bandjoin import band_join
from ..operators.resample import draw
from ..operators.volume import weekend
from ..session import materialize
from ..sources.tables import INTERVALS
from . import hub as H
from .core import rd
from .hub import DAMPING
from .oracle import part, r, sql
from .registry import query

# Raw forecast rows as a model would hand them over: the wick of the replayed bar around the
# forecast close, the previous close as open, its volume less two. Opens may stick out of the
# wick (narrowed by a tenth of a percent) and volumes may be negative, which is what the audits
# are for.
part("q_raw", """
 SELECT p.universe, p.t0, p.asset, p.method, p.step,
        COALESCE(lag(p.close) OVER (PARTITION BY p.universe, p.t0, p.asset, p.method ORDER BY p.step), p.spot) open,
        p.close * (b.high / b.close) * 0.999 high, p.close * (b.low / b.close) * 1.001 low, p.close AS close, b.volume - 2 volume,
        (b.volume - 2) * p.close amount
 FROM q_path p JOIN q_bars b ON b.universe = p.universe AND b.asset = p.asset
  AND b.idx = p.t0 + CASE WHEN p.method = 'mirror' THEN 1 - p.step ELSE p.step - 30 END
 WHERE p.method <> 'actual'""")
part("q_fix", """
 SELECT *, greatest(open, high, low, close) nh, least(open, high, low, close) nl,
        greatest(open, high, low, close) <> high OR least(open, high, low, close) <> low fixed,
        greatest((greatest(open, high, low, close) - high) / close * 10000,
                 (low - least(open, high, low, close)) / close * 10000) bps,
        volume >= 0 AND amount >= 0 volume_valid FROM q_raw""")


def _raw(h):
    def build():
        keys = ["universe", "t0", "asset"]
        source = band_join(h.study.select("universe", "t0"), h.bars.select(
            "universe", "asset", F.col("idx").alias("_i"), "high", "low", "close", "volume"),
            ("universe",), -29, 0, "t0", "_i").withColumn("o", (F.col("_i") - F.col("t0")).cast("int"))
        steps = F.array(F.struct(F.lit(False).alias("mirrored"), (F.col("o") + 30).alias("step")),
                        F.struct(F.lit(True).alias("mirrored"), (1 - F.col("o")).alias("step")))
        source = source.select(*keys, (F.col("high") / F.col("close") * 0.999).alias("up"),
                               (F.col("low") / F.col("close") * 1.001).alias("down"), "volume",
                               F.explode(steps).alias("_s")).select(*keys, "up", "down", "volume", "_s.*")
        pairs = F.arrays_zip(F.concat(F.array("spot"), F.slice("closes", 1, 29)).alias("open"),
                             F.col("closes").alias("close"))
        rows = (h.forecasts.select(*keys, "method", (F.col("method") == H.MODEL).alias("mirrored"),
                                   F.posexplode(pairs).alias("_p", "_c"))
                .select(*keys, "method", "mirrored", (F.col("_p") + 1).alias("step"), "_c.open", "_c.close"))
        return rows.join(source, [*keys, "mirrored", "step"]).select(
            *keys, "method", "step", "open", (F.col("close") * F.col("up")).alias("high"),
            (F.col("close") * F.col("down")).alias("low"), "close",
            (F.col("volume") - 2).alias("volume"), ((F.col("volume") - 2) * F.col("close")).alias("amount"))
    return h._once("raw_paths", build)


def _repaired(h):
    return forecasts.volume_audit(forecasts.repair_containment(_raw(h)))


@query("g15_containment", sql(f"""
 SELECT universe, t0, asset, method, count(*) candles, count(*) FILTER (fixed) corrected, {r('max(bps)', 3)} max_bps,
        {r('sum(nh / close)', 5)} high_sum, {r('sum(nl / close)', 5)} low_sum FROM q_fix
 GROUP BY universe, t0, asset, method"""))
def g15(h):
    return _repaired(h).groupBy("universe", "t0", "asset", "method").agg(
        F.count("*").alias("candles"), F.count_if(F.col("was_corrected")).alias("corrected"),
        rd(F.max("max_adjustment_bps"), 3).alias("max_bps"),
        rd(F.sum(F.col("high") / F.col("close")), 5).alias("high_sum"),
        rd(F.sum(F.col("low") / F.col("close")), 5).alias("low_sum"))


@query("g17_volume_audit", sql("""
 SELECT universe, t0, asset, method, count(*) candles, count(*) FILTER (NOT volume_valid) invalid FROM q_fix
 GROUP BY universe, t0, asset, method"""))
def g17(h):
    return _repaired(h).groupBy("universe", "t0", "asset", "method").agg(
        F.count("*").alias("candles"), F.count_if(~F.col("volume_valid")).alias("invalid"))


@query("a16_weighted_rates", sql(f"""
 SELECT universe, method, CAST(sum(fixed::INT) AS BIGINT) hits, count(*) total, {r('sum(fixed::INT) / count(*)')} rate
 FROM q_fix GROUP BY universe, method"""))
def a16(h):
    return forecasts.weighted_rate(_repaired(h), ["universe", "method"],
                                   F.col("was_corrected").cast("int"), F.lit(1)).select(
        "universe", "method", "hits", F.col("total").cast("long").alias("total"), rd("rate").alias("rate"))


@query("g8_structure", sql("""
 SELECT universe, t0, method, count(*) - CASE t0 % 7 WHEN 3 THEN any_value(asset_count) ELSE 0 END
        + CASE t0 % 7 WHEN 4 THEN any_value(asset_count) ELSE 0 END AS rows,
        CASE t0 % 7 WHEN 1 THEN 'wrong_assets' WHEN 2 THEN 'not_finite' WHEN 3 THEN 'wrong_shape' WHEN 4 THEN 'duplicate_step'
        WHEN 5 THEN 'step_out_of_range' ELSE '' END issues
 FROM q_raw JOIN q_spans USING (universe) GROUP BY universe, t0, method"""))
def g8(h):
    """Structure of each raw forecast against the assets of its universe; some are damaged by their origin."""
    fault = F.col("t0") % 7
    declared = h.assets.groupBy("universe").agg(F.collect_list("asset").alias("_names"))
    rows = (_raw(h).withColumn("path_id", F.lit(0)).join(declared, "universe")
            .withColumn("asset", F.when((fault == 1) & (F.col("asset") == F.array_min("_names")), "stranger").otherwise(F.col("asset")))
            .withColumn("volume", F.when((fault == 2) & (F.col("step") == 3), float("nan")).otherwise(F.col("volume")))
            .withColumn("step", F.when((fault == 5) & (F.col("step") == 30), 31).otherwise(F.col("step")))
            .filter(~((fault == 3) & (F.col("step") == 30)))
            .withColumn("forecast_id", F.concat_ws("|", "universe", "t0", "method")))
    rows = rows.unionByName(rows.filter((fault == 4) & (F.col("step") == 1)))
    part_ = F.split("forecast_id", "\\|")
    return forecasts.structure_issue(rows, F.col("_names"), 30, 1).select(
        part_[0].alias("universe"), part_[1].cast("long").alias("t0"), part_[2].alias("method"),
        "rows", F.array_join("issues", "|").alias("issues"))


TAMPERED = "(t0 * 31 + step) % 101 = 0"
MOVED = "(t0 * 17 + step) % 103 = 0"


@query("g16_g20_audit_verification", sql(f"""
 SELECT universe, count(*) candles, 2 * count(*) FILTER ({TAMPERED} OR {MOVED}) audit_differences,
        count(*) FILTER ({MOVED}) close_differences FROM q_raw GROUP BY universe"""))
def g16(h):
    """Saved repairs, some of them tampered with, against recomputed ones; and which closes moved."""
    cols = ["universe", "t0", "asset", "method", "step", "open", "high", "low", "close",
            "was_corrected", "max_adjustment_bps", "volume_valid"]
    saved = materialize(_repaired(h).select(cols).withColumns({
        "high": F.when(F.expr(TAMPERED), F.col("high") + 1).otherwise(F.col("high")),
        "close": F.when(F.expr(MOVED), F.col("close") + 1).otherwise(F.col("close"))}), "audit")
    changed = forecasts.audit_differences(saved, _repaired(h).select(cols)) \
        .groupBy("universe").agg(F.count("*").alias("audit_differences"))
    close = ["universe", "t0", "asset", "method", "step", "close"]
    moved = saved.select(close).exceptAll(_raw(h).select(close)).groupBy("universe").agg(
        F.count("*").alias("close_differences"))
    return (_raw(h).groupBy("universe").agg(F.count("*").alias("candles"))
            .join(changed, "universe", "left").join(moved, "universe", "left")
            .fillna(0, ["audit_differences", "close_differences"]))


part("q_aud", """
 SELECT universe, t0, method, count(*) total, count(*) FILTER (fixed) hits, count(*) FILTER (NOT volume_valid) bad
 FROM q_fix GROUP BY universe, t0, method""")


def _audits(h):
    return _repaired(h).groupBy("universe", "t0", "method").agg(
        F.count("*").alias("total"), F.count_if(F.col("was_corrected")).alias("hits"),
        F.count_if(~F.col("volume_valid")).alias("bad"))


@query("g18_audit_consistency", sql("""
 SELECT universe, method, count(*) audits, count(*) FILTER (t0 % 11 <> 0 AND t0 % 13 <> 0) consistent FROM q_aud
 GROUP BY universe, method"""))
def g18(h):
    """Stored rates and labels, some of them false, against their own counts."""
    true = F.when(F.col("hits") == 0, "unchanged").otherwise("corrected")
    false = F.when(F.col("hits") == 0, "corrected").otherwise("unchanged")
    status = F.when(F.col("t0") % 11 == 0, false).otherwise(true)
    rate = F.col("hits") / F.col("total") + F.when(F.col("t0") % 13 == 0, 0.01).otherwise(0.0)
    fine = forecasts.audit_consistent(rate, F.col("hits"), F.col("total"), status)
    return _audits(h).groupBy("universe", "method").agg(F.count("*").alias("audits"),
                                                        F.count_if(fine).alias("consistent"))


@query("j8_x5_matched_workloads", sql(f"""
 SELECT a.universe, a.method model_a, b.method model_b, count(*) matched, {r('sum(a.hits) / sum(a.total)')} rate_a,
        {r('sum(b.hits) / sum(b.total)')} rate_b FROM q_aud a JOIN q_aud b USING (universe, t0)
 WHERE a.method < b.method AND t0 % 9 <> 0 GROUP BY a.universe, a.method, b.method"""))
def j8(h):
    """Groups compared only on workloads whose complete control context is the same."""
    names = h.assets.groupBy("universe").agg(F.array_join(F.array_sort(F.collect_list("asset")), "|").alias("assets"))
    rows = _audits(h).join(names, "universe").withColumns({
        "horizon": F.lit(30), "lookback": F.lit(256), "paths": F.lit(1), "candles": F.col("total"),
        "interval": F.when(F.col("universe") == "events", 3600).otherwise(86400),
        "seed": F.when(F.col("t0") % 9 != 0, F.col("t0"))})  # runs that did not record their seed match nothing
    rows = rows.withColumn("key", identity.comparison_key([
        "universe", "t0", "horizon", "lookback", "paths", "candles", "interval", "assets", "seed"])).filter("key is not null")
    b = rows.select("key", F.col("method").alias("model_b"), F.col("hits").alias("hb"), F.col("total").alias("tb"))
    return (rows.withColumnRenamed("method", "model_a").join(b, "key").filter("model_a < model_b")
            .groupBy("universe", "model_a", "model_b").agg(
                F.count("*").alias("matched"), rd(F.sum("hits") / F.sum("total")).alias("rate_a"),
                rd(F.sum("hb") / F.sum("tb")).alias("rate_b")))


@query("a54_rate_groups", sql(f"""
 WITH e AS (SELECT a.universe, CASE WHEN a.bad = 0 THEN 'zero' ELSE 'nonzero' END zero_group,
            CASE WHEN a.bad / a.total >= 0.25 THEN 'high' ELSE 'low' END level_group, s.mae
            FROM q_aud a JOIN q_scores s ON s.universe = a.universe AND s.t0 = a.t0 AND s.method = a.method
            AND s.metric = 'volatility' WHERE a.method = 'mirror'),
 l AS (SELECT universe, 'zero_vs_nonzero' AS axis, zero_group grp, mae FROM e UNION ALL SELECT universe, 'low_vs_high', level_group, mae FROM e),
 c AS (SELECT universe, axis, count(*) FILTER (grp IN ('zero', 'low')) n_left, count(*) FILTER (grp IN ('nonzero', 'high')) n_right,
       avg(mae) FILTER (grp IN ('nonzero', 'high')) - avg(mae) FILTER (grp IN ('zero', 'low')) delta FROM l GROUP BY universe, axis)
 SELECT universe, axis, n_left, n_right, {r('delta')} delta,
        CASE WHEN least(n_left, n_right) >= 5 THEN 'descriptive_only' ELSE 'insufficient_evidence' END status FROM c"""))
def a54(h):
    rows = _audits(h).filter(F.col("method") == H.MODEL).join(
        h.scores.filter("metric = 'volatility'").select("universe", "t0", "method", "mae"), ["universe", "t0", "method"])
    axes = F.array(F.struct(F.lit("zero_vs_nonzero").alias("axis"), (F.col("bad") > 0).alias("right")),
                   F.struct(F.lit("low_vs_high").alias("axis"), (F.col("bad") / F.col("total") >= 0.25).alias("right")))
    right = F.col("right")
    n_left, n_right = F.count_if(~right), F.count_if(right)
    return (rows.select("universe", "mae", F.explode(axes).alias("_a")).select("universe", "mae", "_a.*")
            .groupBy("universe", "axis").agg(
                n_left.alias("n_left"), n_right.alias("n_right"),
                rd(F.avg(F.when(right, F.col("mae"))) - F.avg(F.when(~right, F.col("mae")))).alias("delta"),
                F.when(F.least(n_left, n_right) >= 5, "descriptive_only").otherwise("insufficient_evidence").alias("status")))


@query("g14_attention_issues", sql("""
 SELECT universe, COALESCE(CASE WHEN NOT regexp_full_match(asset, '[A-Z][A-Z0-9]*') THEN 'bad_symbol'
        WHEN vol30 IS NULL OR vol30 < 0 THEN 'bad_volatility' END, 'valid') issue, count(*) n
 FROM (SELECT universe, asset, CASE WHEN count(r) OVER w = 30 THEN stddev_pop(r) OVER w END vol30 FROM q_rets
       WINDOW w AS (PARTITION BY universe, asset ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) GROUP BY ALL"""))
def g14(h):
    from ..operators import features
    from ..operators.grid import attention_issue
    rows = features.snapshot(h.bars, long_frame=False)
    return rows.withColumn("issue", F.coalesce(attention_issue(), F.lit("valid"))).groupBy(
        "universe", "issue").agg(F.count("*").alias("n"))


@query("f13_f15_calendar", sql("""
 SELECT universe, hour(s) AS hour, isodow(s) - 1 AS weekday, day(s) AS day, month(s) AS month,
        least((day(s) - 1) // 7, 3) segment, isodow(s) >= 6 weekend, count(*) n
 FROM (SELECT universe, ts - CASE universe WHEN 'events' THEN INTERVAL 1 HOUR ELSE INTERVAL 1 DAY END s FROM q_bars) GROUP BY ALL"""))
def f13(h):
    step = F.when(F.col("universe") == "events", INTERVALS["events"]).otherwise(INTERVALS["orders"])
    start = F.timestamp_seconds(F.unix_timestamp("ts") - step)
    cal = training.calendar_features(start)
    rows = h.bars.select("universe", *[cal[k].cast("long").alias(k) for k in ("hour", "weekday", "day", "month")],
                         diagnostics.segment_of_month(start).cast("long").alias("segment"), weekend(start).alias("weekend"))
    return rows.groupBy(rows.columns).agg(F.count("*").alias("n"))


@query("f20_f21_identity", sql("""
 SELECT universe, count(*) windows, count(*) distinct_ids, CAST(sum(('0x' || substr(sha256(concat_ws('|', 7, universe, t0, asset)), 1, 8))::BIGINT)
        AS BIGINT) seed_sum FROM q_roll GROUP BY universe"""))
def f20(h):
    rows = h.rolling_windows.filter("status = 'ready'")
    seeds = identity.stable_seed(F.lit(7), F.col("universe"), F.col("t0"), F.col("asset"))
    return rows.groupBy("universe").agg(
        F.count("*").alias("windows"),
        F.count_distinct(identity.content_id("window_", "universe", "t0", "asset", "hist")).alias("distinct_ids"),
        F.sum(seeds).alias("seed_sum"))


@query("f22_non_finite_tags", sql("""
 SELECT universe, CASE WHEN volume > 0 THEN 'finite' ELSE 'NaN' END tag, count(*) n FROM q_bars GROUP BY ALL"""))
def f22(h):
    vwap = F.when(F.col("volume") > 0, F.col("amount") / F.col("volume")).otherwise(F.lit(float("nan")))
    return h.bars.withColumn("tag", F.coalesce(identity.non_finite_tag(vwap), F.lit("finite"))).groupBy(
        "universe", "tag").agg(F.count("*").alias("n"))


@query("b10_f23_training_segments", sql(f"""
 WITH x AS (SELECT o.universe, o.t0, b.asset, CAST(b.idx - o.t0 + 256 AS INT) pos, b.close, b.volume
            FROM (SELECT universe, unnest(range(255, n - 30, 30)) t0 FROM q_spans) o
            JOIN q_bars b ON b.universe = o.universe AND b.idx BETWEEN o.t0 - 255 AND o.t0 + 30),
 s AS (SELECT universe, t0, asset, avg(close) mc, stddev_pop(close) sc, avg(volume) mv, stddev_pop(volume) sv
       FROM x WHERE pos <= 256 GROUP BY ALL),
 z AS (SELECT x.universe, x.t0, x.asset, x.pos, greatest(least((close - mc) / (sc + 1e-5), 5), -5) zc,
              greatest(least((volume - mv) / (sv + 1e-5), 5), -5) zv FROM x JOIN s USING (universe, t0, asset))
 SELECT universe, t0, asset, count(*) bars, {r('avg(zc) FILTER (pos > 256)')} future_close, {r('max(zc)')} max_close,
        {r('avg(zv) FILTER (pos > 256)')} future_volume, count(*) FILTER (abs(zc) = 5) clipped,
        {'''('0x' || substr(md5(concat_ws('|', 20260926, 0, universe, t0, asset)), 1, 8))::BIGINT'''} order_key
 FROM z GROUP BY universe, t0, asset"""))
def b10(h):
    step = F.when(F.col("universe") == "events", INTERVALS["events"]).otherwise(INTERVALS["orders"])
    rows = training.segments(windows.rolling_origins(h.spans), h.bars, step)
    late = lambda c: F.avg(F.when(F.col("pos") > 256, F.col(c)))
    return rows.groupBy("universe", "t0", "asset").agg(
        F.count("*").alias("bars"), rd(late("z_close")).alias("future_close"), rd(F.max("z_close")).alias("max_close"),
        rd(late("z_volume")).alias("future_volume"), F.count_if(F.abs("z_close") == 5).alias("clipped")).withColumn(
        "order_key", training.shuffle_key(0))


@query("f33_overlay_state", sql("""
 SELECT m.universe, m.t0, CASE WHEN a.n IS NULL THEN 'unavailable' WHEN a.t0 < m.t0 THEN 'stale'
        WHEN a.status = 'pending_truth' THEN 'running' WHEN a.status = 'failed' THEN 'error'
        WHEN a.n > 1 THEN 'invalid' ELSE 'ready' END state
 FROM q_man m LEFT JOIN (SELECT universe, t0, count(*) n, min(status) status FROM q_art GROUP BY universe, t0) a
   ON a.universe = m.universe AND a.t0 = (SELECT max(x.t0) FROM q_art x WHERE x.universe = m.universe AND x.t0 IN (m.t0, m.t0 - 15))"""))
def f33(h):
    """State of the newest forecast of a window: its own, or the one from half a stride earlier."""
    from .compare import _attempts, _manifest
    made = _attempts(h).groupBy("universe", F.col("t0").alias("made_at")).agg(
        F.count("*").alias("n"), F.min("status").alias("status"))
    tries = _manifest(h).withColumn("made_at", F.explode(F.array(F.col("t0"), F.col("t0") - 15)))
    newest = tries.join(made, ["universe", "made_at"]).groupBy("universe", "t0").agg(
        F.max_by(F.struct("made_at", "n", "status"), "made_at").alias("f"))
    state = (F.when(F.col("f").isNull(), "unavailable").when(F.col("f.made_at") < F.col("t0"), "stale")
             .when(F.col("f.status") == "pending_truth", "running").when(F.col("f.status") == "failed", "error")
             .when(F.col("f.n") > 1, "invalid").otherwise("ready"))
    return _manifest(h).join(newest, ["universe", "t0"], "left").select("universe", "t0", state.alias("state"))


@query("j20_replay_recovery", sql("""
 WITH s AS (SELECT universe, arg_min(t0, (-magnitude, t0)) t0 FROM q_study GROUP BY universe)
 SELECT s.universe, s.t0, a.tier, CAST(c.confirmed_at AS DOUBLE) confirmed_at, COALESCE(c.points, 0) points
 FROM s JOIN (SELECT DISTINCT universe, tier FROM q_assets) a ON a.universe = s.universe
 LEFT JOIN q_conf c ON c.universe = s.universe AND c.t0 = s.t0 AND c.tier = a.tier"""))
def j20(h):
    from ..operators import recovery
    from .after import _curves
    top = h.study.groupBy("universe").agg(F.min_by("t0", F.struct(
        (-F.col("magnitude")).alias("m"), "t0")).alias("t0"))
    tiers = h.assets.select("universe", "tier").distinct()
    return (top.join(tiers, "universe").join(recovery.confirmations(_curves(h)), ["universe", "t0", "tier"], "left")
            .select("universe", "t0", "tier", F.col("confirmed_at").cast("double").alias("confirmed_at"),
                    F.coalesce("points", F.lit(0)).alias("points")))


@query("j21_tier_lookup", sql("""
 SELECT universe, asset, min(tier) tier, count(*) matches FROM q_assets GROUP BY universe, asset"""))
def j21(h):
    names = h.cells.select("universe", "asset").distinct()
    return names.join(h.assets, ["universe", "asset"], "left").groupBy("universe", "asset").agg(
        F.min("tier").alias("tier"), F.count("tier").alias("matches"))


@query("o9_evenly_spaced", sql("""
 WITH p AS (SELECT universe, t0, row_number() OVER (PARTITION BY universe ORDER BY t0) - 1 pos,
            count(*) OVER (PARTITION BY universe) n FROM (SELECT DISTINCT universe, t0 FROM q_roll))
 SELECT DISTINCT universe, t0 FROM p, range(8) i(i) WHERE pos = (i.i * (n - 1)) // 7 OR n <= 8"""))
def o9(h):
    """Positions on the regular grid of origins are arithmetic, so no universe is sorted."""
    grid = windows.rolling_origins(h.spans)
    return windows.evenly_placed(grid, F.floor((F.col("t0") - 255) / 30), F.col("available"), 8).select("universe", "t0")


@query("u6_rows_equal", sql("""
 SELECT universe, count(*) compared, count(*) FILTER (t0 % 7 = 0) unequal FROM q_roll GROUP BY universe"""))
def u6(h):
    """Saved realised risk, some of it altered, against bars joined to every step of a window."""
    from ..operators.comparison import close_to
    saved = h.rolling.select("universe", "t0", "asset", "a_mdd", (F.col("a_vol") * F.when(
        F.col("t0") % 7 == 0, 1.01).otherwise(1.0) + F.when(F.col("t0") % 7 == 0, 0.001).otherwise(0.0)).alias("a_vol"))
    steps = windows.rolling_origins(h.spans).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(30))))
    closes = (steps.withColumn("idx", F.col("t0") + F.col("step")).join(
        h.bars.select("universe", "asset", "idx", "close"), ["universe", "idx"])
        .groupBy("universe", "t0", "asset").agg(F.array_sort(F.collect_list(F.struct("step", "close"))).alias("_p"))
        .filter(F.size("_p") == 31).withColumn("_c", F.transform("_p", lambda x: x["close"])))
    spot, future = F.element_at("_c", 1), F.slice("_c", 2, 30)
    again = closes.select("universe", "t0", "asset", paths.max_drawdown(spot, future).alias("mdd"),
                          paths.horizon_volatility(spot, future).alias("vol"))
    both = saved.join(again, ["universe", "t0", "asset"], "full_outer")
    fine = close_to(F.col("a_vol"), F.col("vol")) & close_to(F.col("a_mdd"), F.col("mdd"))
    return both.groupBy("universe").agg(F.count("*").alias("compared"),
                                        F.count_if(~F.coalesce(fine, F.lit(False))).alias("unequal"))


@query("f4_f6_path_metrics", sql(f"""
 SELECT universe, t0, asset, method, {r('arg_max(close, step) / any_value(spot) - 1')} terminal_return,
        {r('(max(close) - min(close)) / any_value(spot)')} amplitude, {r('max(close) / any_value(spot)')} high,
        {r('min(close) / any_value(spot)')} low FROM q_path WHERE method <> 'actual' GROUP BY universe, t0, asset, method"""))
def f4(h):
    spot, closes = F.col("spot"), F.col("closes")
    return h.forecasts.filter("closes is not null").select(
        "universe", "t0", "asset", "method", rd(paths.terminal_return(spot, closes)).alias("terminal_return"),
        rd(paths.amplitude(spot, closes, closes)).alias("amplitude"), rd(F.array_max(closes) / spot).alias("high"),
        rd(F.array_min(closes) / spot).alias("low"))


def damped_reverse(hist):
    """A user model: the last 30 returns of every asset, damped, in reverse order."""
    import numpy as np
    out = {}
    for asset, closes in hist.items():
        r_ = np.diff(np.log(np.asarray(closes)))[-30:][::-1] * DAMPING
        out[asset] = closes[-1] * np.exp(np.cumsum(r_))
    return [out]


@query("b9_x2_model_hook", sql(f"""
 SELECT universe, t0, asset, 'user_model' AS method, 0::INT path_id, 30::INT steps, {r('mdd')} mdd, {r('vol')} vol
 FROM q_risk WHERE method = 'mirror'"""))
def b9(h):
    """A Python forecaster applied per window; must equal the same rule in expressions."""
    rows = forecasts.path_risk(forecasts.apply_model(h.windows, damped_reverse, "user_model"))
    return rows.select("universe", "t0", "asset", "method", "path_id", F.size("closes").alias("steps"),
                       rd("mdd").alias("mdd"), rd("vol").alias("vol"))


@query("x4_lateral_paths", sql(f"""
 SELECT universe, t0, asset, 0::INT path_id, 30::INT steps, {r('mdd')} mdd, {r('vol')} vol FROM q_risk WHERE method = 'mirror'"""))
def x4(h):
    """The same forecaster as a table function, called per window in SQL."""
    forecasts.register_model(h.spark, damped_reverse, "damped_reverse_paths")
    rows = forecasts.path_risk(h.spark.sql("""
        SELECT w.universe, w.t0, p.* FROM {windows} w, LATERAL damped_reverse_paths(w.histories) p""",
        windows=forecasts.histories(h.windows)))
    return rows.select("universe", "t0", "asset", "path_id", F.size("closes").alias("steps"),
                       rd("mdd").alias("mdd"), rd("vol").alias("vol"))


@query("b9_multi_path_seeds", sql(f"""
 SELECT universe, t0, asset, p.p::INT path_id, {'''('0x' || substr(md5(concat_ws('|', 7, universe, t0, asset, p.p)), 1, 8))::BIGINT'''} seed
 FROM q_spot, range(10) p(p)"""))
def b9_seeds(h):
    return H.ensemble(h.windows).select(
        "universe", "t0", "asset", "path_id",
        draw(7, F.col("universe"), F.col("t0"), F.col("asset"), F.col("path_id")).alias("seed"))
