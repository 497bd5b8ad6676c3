"""Rolling evaluation: errors, rankings, confusion, ledgers, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranking import competition_rank
from ..operators import comparison as C
from ..operators import resample, windows
from .core import rd
from .oracle import part, r, rank_scores, sql
from .registry import query

part("q_err", """
 SELECT universe, t0, asset, tier, day, period, 'terminal_return' AS metric, m_ret predicted, 0.0 base,
        a_ret actual, abs(m_ret - a_ret) model_error, abs(a_ret) baseline_error FROM q_roll
 UNION ALL
 SELECT universe, t0, asset, tier, day, period, 'volatility', m_vol, vol30, a_vol, abs(m_vol - a_vol),
        abs(vol30 - a_vol) FROM q_roll""")
part("q_errw", """
 SELECT universe, t0, day, period, metric, asset, model_error, baseline_error FROM q_err
 UNION ALL SELECT universe, t0, day, period, metric, 'equal_weight_assets', avg(model_error),
        avg(baseline_error) FROM q_err GROUP BY universe, t0, day, period, metric""")
TIE = "abs(model_error - baseline_error) <= greatest(1e-10 * greatest(model_error, baseline_error), 1e-12)"


def _errors(h):
    return C.error_pairs(h.rolling)


# The model gives no forecast for every eleventh origin of one universe.
FAILED = "universe = 'lineitem' AND t0 % 11 = 0"


@query("j3_scores", sql(f"""
 SELECT m.universe, m.t0, s.asset, k.metric, CASE WHEN NOT (m.{FAILED.replace('AND t0', 'AND m.t0')}) THEN {r('e.predicted')} END predicted,
        {r('e.actual')} actual, CASE WHEN NOT (m.{FAILED.replace('AND t0', 'AND m.t0')}) THEN {r('e.model_error')} END absolute_error,
        CASE WHEN m.{FAILED.replace('AND t0', 'AND m.t0')} THEN 'failed' WHEN e.actual IS NULL THEN 'pending_truth' ELSE 'scored' END AS status
 FROM (SELECT universe, n, unnest(range(255, n, 30)) t0 FROM q_spans) m JOIN q_assets s USING (universe)
 CROSS JOIN (VALUES ('terminal_return'), ('volatility')) k(metric)
 LEFT JOIN q_err e ON e.universe = m.universe AND e.t0 = m.t0 AND e.asset = s.asset AND e.metric = k.metric"""))
def j3(h):
    """Predictions of every planned origin against the truth there is."""
    keys = ["universe", "t0", "asset", "metric"]
    planned = windows.rolling_origins(h.spans, horizon=0).join(h.assets.select("universe", "asset"), "universe").withColumn(
        "metric", F.explode(F.array(F.lit("terminal_return"), F.lit("volatility"))))
    rows = planned.join(_errors(h).select(*keys, "predicted", "actual", "model_error"), keys, "left").withColumn(
        "status", F.when(F.expr(FAILED), "failed").when(F.col("actual").isNull(), "pending_truth").otherwise("scored"))
    there = F.col("status") != "failed"
    return rows.select(*keys, rd(F.when(there, F.col("predicted"))).alias("predicted"), rd("actual").alias("actual"),
                       rd(F.when(there, F.col("model_error"))).alias("absolute_error"), "status")


@query("a11_f31_error_stats", sql(f"""
 SELECT universe, metric, asset, COALESCE(period, 'overall') segment, count(*) n,
        {r('avg(model_error)')} model_mae, {r('avg(baseline_error)')} baseline_mae,
        {r('1 - avg(model_error) / NULLIF(avg(baseline_error), 0)')} skill,
        count(*) FILTER (model_error < baseline_error AND NOT {TIE}) win, count(*) FILTER ({TIE}) tie,
        count(*) FILTER (model_error >= baseline_error AND NOT {TIE}) loss
 FROM q_errw GROUP BY GROUPING SETS ((universe, metric, asset, period), (universe, metric, asset))"""))
def a11(h):
    rows = C.with_equal_weight(_errors(h))
    keys = ["universe", "metric", "asset"]
    by_segment = C.error_stats(rows.withColumnRenamed("period", "segment"), [*keys, "segment"])
    overall = C.error_stats(rows, keys).withColumn("segment", F.lit("overall"))
    return by_segment.unionByName(overall).select(
        *keys, "segment", "n", rd("model_mae").alias("model_mae"),
        rd("baseline_mae").alias("baseline_mae"), rd("skill").alias("skill"), "win", "tie", "loss")


def top2(value: str, keys: str, source: str = "q_roll") -> str:
    return f"""
 SELECT {keys}, list(asset ORDER BY asset) s FROM (SELECT *, rank() OVER (PARTITION BY {keys}
        ORDER BY {value} DESC) rk FROM {source}) WHERE rk <= 2 GROUP BY {keys}"""


part("q_sets", f"""
 SELECT a.universe, a.t0, a.s actual, x.strategy, x.s chosen FROM ({top2('a_vol', 'universe, t0')}) a
 JOIN (SELECT universe, t0, 'model' AS strategy, s FROM ({top2('m_vol', 'universe, t0')})
       UNION ALL SELECT universe, t0, 'historical_volatility', s FROM ({top2('vol30', 'universe, t0')})
       UNION ALL SELECT o.universe, o.t0, 'constant_initial', f.s FROM (SELECT DISTINCT universe, t0 FROM q_roll) o
       JOIN (SELECT universe, arg_min(s, t0) s FROM ({top2('vol30', 'universe, t0')}) GROUP BY universe) f
         ON f.universe = o.universe) x USING (universe, t0)""")
SET = """len(list_intersect(actual, chosen))"""


@query("w8_u3_u4_set_scores", sql(f"""
 SELECT universe, t0, strategy, array_to_string(actual, '|') actual, array_to_string(chosen, '|') chosen,
        actual = chosen AS exact, {SET} common, {r(f'{SET} / len(chosen)')} AS precision,
        {r(f'{SET} / len(actual)')} recall, {r(f'{SET} / (len(actual) + len(chosen) - {SET})')} jaccard,
        array_to_string(list_sort(list_filter(chosen, lambda x: NOT list_contains(actual, x))), '|') added,
        array_to_string(list_sort(list_filter(actual, lambda x: NOT list_contains(chosen, x))), '|') removed FROM q_sets"""))
def w8(h):
    return C.set_scores(C.strategy_sets(h.rolling)).select(
        "universe", "t0", "strategy", F.array_join("actual", "|").alias("actual"),
        F.array_join("chosen", "|").alias("chosen"), "exact",
        F.col("common").cast("long").alias("common"), rd("precision").alias("precision"),
        rd("recall").alias("recall"), rd("jaccard").alias("jaccard"),
        F.array_join(F.array_sort("added"), "|").alias("added"),
        F.array_join(F.array_sort("removed"), "|").alias("removed"))


@query("a12_ranking_stats", sql(f"""
 SELECT universe, strategy, count(*) windows, count(*) FILTER (actual = chosen) exact_hits,
        {r(f'avg({SET} / len(chosen))')} AS precision, {r(f'avg({SET} / len(actual))')} recall,
        {r(f'avg({SET} / (len(actual) + len(chosen) - {SET}))')} jaccard, {r('avg(len(chosen))')} mean_selected
 FROM q_sets GROUP BY universe, strategy"""))
def a12(h):
    return C.set_scores(C.strategy_sets(h.rolling)).groupBy("universe", "strategy").agg(
        F.count("*").alias("windows"), F.count_if(F.col("exact")).alias("exact_hits"),
        rd(F.avg("precision")).alias("precision"), rd(F.avg("recall")).alias("recall"),
        rd(F.avg("jaccard")).alias("jaccard"), rd(F.avg("selected")).alias("mean_selected"))


@query("a12_selection_counts", sql("""
 SELECT universe, strategy, asset, count(*) n FROM (SELECT universe, strategy, unnest(chosen) asset FROM q_sets)
 GROUP BY universe, strategy, asset"""))
def a12_counts(h):
    return (C.strategy_sets(h.rolling).select("universe", "strategy",
                                              F.explode("chosen").alias("asset"))
            .groupBy("universe", "strategy", "asset").agg(F.count("*").alias("n")))


CONF = """count(*) FILTER (m_mdd > {t} AND a_mdd > {t}) tp, count(*) FILTER (m_mdd > {t} AND NOT a_mdd > {t}) fp,
        count(*) FILTER (NOT m_mdd > {t} AND a_mdd > {t}) fn, count(*) FILTER (NOT m_mdd > {t} AND NOT a_mdd > {t}) tn"""


@query("a13_confusion", sql(f"""
 WITH c AS (SELECT universe, COALESCE(asset, 'all_assets') AS scope, {CONF.format(t=0.5)} FROM q_roll
            GROUP BY GROUPING SETS ((universe, asset), (universe)))
 SELECT *, {r('tp / NULLIF(tp + fp, 0)')} AS precision, {r('tp / NULLIF(tp + fn, 0)')} recall FROM c"""))
def a13(h):
    """Half the price lost is the alarm level for these volatile sample series."""
    both = h.rolling.withColumn("scope", F.explode(F.array(F.col("asset"), F.lit("all_assets"))))
    return C.confusion(both, ["universe", "scope"], F.col("m_mdd") > 0.5, F.col("a_mdd") > 0.5) \
        .withColumn("precision", rd("precision")).withColumn("recall", rd("recall"))


part("q_sweep", """
 WITH g(threshold) AS (VALUES (0.3), (0.5), (0.7), (0.9)),
 c AS (SELECT universe, threshold, count(*) FILTER (m_mdd > threshold AND a_mdd > threshold) tp,
              count(*) FILTER (m_mdd > threshold AND NOT a_mdd > threshold) fp,
              count(*) FILTER (NOT m_mdd > threshold AND a_mdd > threshold) fn,
              count(*) FILTER (NOT m_mdd > threshold AND NOT a_mdd > threshold) tn FROM q_roll, g GROUP BY ALL)
 SELECT *, 2 * tp / NULLIF(2 * tp + fp + fn, 0) f1, tp + fn >= 10 AND tp + fp >= 10 supported FROM c""")


@query("a14_threshold_sweep", sql(f"""
 SELECT universe, threshold::DOUBLE threshold, tp, fp, fn, tn, {r('tp / NULLIF(tp + fp, 0)')} AS precision,
        {r('tp / NULLIF(tp + fn, 0)')} recall, {r('f1')} f1, supported,
        COALESCE(supported AND threshold = arg_min(threshold, (-f1, threshold)) FILTER (supported)
                 OVER (PARTITION BY universe), FALSE) recommended FROM q_sweep"""))
def a14(h):
    rows = C.threshold_sweep(h.rolling, ["universe"], "m_mdd", "a_mdd", (0.3, 0.5, 0.7, 0.9))
    return rows.select("universe", "threshold", "tp", "fp", "fn", "tn",
                       rd("precision").alias("precision"), rd("recall").alias("recall"),
                       rd("f1").alias("f1"), "supported", "recommended")


# Attempts at a task: a falling bar of either of the first two assets at the origin starts one.
part("q_man", "SELECT universe, n, unnest(range(255, n, 30)) t0 FROM q_spans")
part("q_art", """
 SELECT b.universe, b.idx t0, b.asset, b.close, CASE WHEN b.close < b.open * 0.2 THEN 'failed'
        WHEN b.idx + 30 < s.n THEN 'scored' ELSE 'pending_truth' END status
 FROM q_bars b JOIN q_assets a USING (universe, asset) JOIN q_spans s USING (universe)
 WHERE a.ordinal <= 1 AND b.close < b.open AND b.idx % 15 = 0""")
part("q_led", """
 SELECT m.universe, m.t0, COALESCE(a.n, 0) attempts, CASE WHEN a.n IS NULL THEN 'missing'
        WHEN a.n > 1 THEN 'duplicate' ELSE a.status END status, a.value
 FROM q_man m LEFT JOIN (SELECT universe, t0, count(*) n, min(status) status, min(close) AS value FROM q_art
                         GROUP BY universe, t0) a USING (universe, t0)""")


def _manifest(h):
    return windows.rolling_origins(h.spans, horizon=0).select("universe", "t0")


def _attempts(h):
    """Artifacts on a finer grid than the manifest: some tasks get none, some two."""
    rows = (h.bars.filter("close < open and idx % 15 = 0")
            .join(h.assets.filter("ordinal <= 1").select("universe", "asset"), ["universe", "asset"])
            .join(h.spans.select("universe", "n"), "universe"))
    return rows.select("universe", F.col("idx").alias("t0"), "asset", "close", F.when(
        F.col("close") < F.col("open") * 0.2, "failed").when(
        F.col("idx") + 30 < F.col("n"), "scored").otherwise("pending_truth").alias("status"))


@query("j4_ledger", sql("SELECT universe, t0, attempts, status FROM q_led"))
def j4(h):
    return C.ledger(_manifest(h), _attempts(h), ["universe", "t0"])


@query("j4_u5_unassigned", sql("""
 SELECT universe, t0, asset, status FROM q_art ANTI JOIN q_man USING (universe, t0)"""))
def j4_unassigned(h):
    return C.unassigned(_manifest(h), _attempts(h), ["universe", "t0"]).select(
        "universe", "t0", "asset", "status")


@query("a17_status_counts", sql("""
 SELECT universe, count(*) requested, count(*) FILTER (status = 'scored') scored,
        count(*) FILTER (status = 'failed') failed, count(*) FILTER (status = 'pending_truth') pending_truth,
        count(*) FILTER (status = 'missing') missing, count(*) FILTER (status = 'duplicate') duplicate
 FROM q_led GROUP BY universe"""))
def a17(h):
    kinds = ["scored", "failed", "pending_truth", "missing", "duplicate"]
    return C.ledger(_manifest(h), _attempts(h), ["universe", "t0"]).groupBy("universe").agg(
        F.count("*").alias("requested"),
        *[F.count_if(F.col("status") == k).alias(k) for k in kinds])


part("q_rep", """
 SELECT COALESCE(l.universe, x.universe) universe, COALESCE(l.t0, x.t0) t0, l.status ls, x.status rs
 FROM (SELECT universe, t0, CASE WHEN attempts = 1 THEN status ELSE 'missing' END status FROM q_led) l
 FULL JOIN (SELECT universe, t0, min(status) status FROM q_art WHERE t0 >= 255 GROUP BY universe, t0) x
   ON x.universe = l.universe AND x.t0 = l.t0""")


CONTEXT = ("provenance", "configuration", "revision", "target")


def _context(df, damaged):
    """What a report says about itself; one of its fields is another every few origins if ``damaged``."""
    for i, name in enumerate(CONTEXT):
        odd = (F.floor(F.col("t0") / 15) % 6 == i + 1) & F.lit(damaged)
        df = df.withColumn(name, F.when(odd, "other").otherwise("same"))
    return df


@query("j5_u2_model_vs_model", sql("""
 SELECT universe, t0, CASE WHEN rs IS NULL THEN 'only_left' WHEN ls IS NULL THEN 'only_right'
        WHEN ls <> 'scored' AND rs <> 'scored' THEN 'both_unscored' WHEN ls <> 'scored' THEN 'left_unscored'
        WHEN rs <> 'scored' THEN 'right_unscored' ELSE CASE (t0 // 15) % 6 WHEN 1 THEN 'provenance_mismatch'
        WHEN 2 THEN 'configuration_mismatch' WHEN 3 THEN 'revision_mismatch' WHEN 4 THEN 'target_mismatch'
        ELSE 'matched' END END pairing FROM q_rep"""))
def j5(h):
    left = (C.ledger(_manifest(h), _attempts(h), ["universe", "t0"])
            .withColumn("status", F.when(F.col("attempts") == 1, F.col("status"))
                        .otherwise("missing")).withColumn("value", F.lit(0.0)))
    right = (_attempts(h).filter("t0 >= 255").groupBy("universe", "t0")
             .agg(F.min("status").alias("status"), F.min("close").alias("value")))
    return C.compare_reports(_context(left, False), _context(right, True), ["universe", "t0"], CONTEXT).select(
        "universe", "t0", "pairing")


@query("g9_window_match", sql("""
 SELECT f.universe, f.t0, f.asset, CASE WHEN w.spot IS NULL THEN 'no_window' WHEN f.t0 % 7 = 1 THEN 'source_mismatch'
        WHEN f.t0 % 7 = 2 THEN 'quote_mismatch' WHEN f.t0 % 7 = 3 THEN 'interval_mismatch' WHEN f.t0 % 7 = 4 THEN 'as_of_mismatch'
        WHEN f.t0 % 7 = 5 THEN 'assets_mismatch' WHEN w.spot <> f.close OR f.t0 % 7 = 6 THEN 'spot_mismatch' ELSE 'matched' END status
 FROM q_art f LEFT JOIN (SELECT universe, t0, asset, spot FROM q_roll) w USING (universe, t0, asset)"""))
def g9(h):
    """Forecast artifacts against their input windows: source, quote, interval, time, assets and last close."""
    keys = ["universe", "t0", "asset"]
    names = h.assets.groupBy("universe").agg(F.array_sort(F.collect_list("asset")).alias("assets"))
    stamps = h.bars.select("universe", "asset", F.col("idx").alias("t0"), F.col("ts").alias("as_of"))
    about = (h.rolling_windows.filter("status = 'ready'").select(*keys, F.element_at("hist", -1).alias("spot"))
             .join(names, "universe").join(stamps, keys)
             .withColumns({"source": F.lit("tables"), "quote": F.lit("USD"), "interval": F.when(
                 F.col("universe") == "events", 3600).otherwise(86400)}))
    odd = F.col("t0") % 7
    said = (_attempts(h).select(*keys, F.col("close").alias("spot")).join(names, "universe").join(stamps, keys)
            .withColumns({"source": F.when(odd == 1, "elsewhere").otherwise("tables"),
                          "quote": F.when(odd == 2, "EUR").otherwise("USD"),
                          "interval": F.when(odd == 3, 60).when(F.col("universe") == "events", 3600).otherwise(86400),
                          "as_of": F.when(odd == 4, F.col("as_of") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("as_of")),
                          "assets": F.when(odd == 5, F.slice("assets", 1, 2)).otherwise(F.col("assets")),
                          "spot": F.when(odd == 6, F.col("spot") + 1).otherwise(F.col("spot"))}))
    return C.match_windows(said, about, keys, ("source", "quote", "interval", "as_of", "assets", "spot")).select(
        *keys, F.col("match").alias("status"))


@query("a53_deduplicate", sql("""
 SELECT universe, t0, count(*) runs, CASE WHEN count(DISTINCT status) > 1 THEN 'conflicting_rerun'
        WHEN count(*) > 1 THEN 'equal_rerun' ELSE 'single' END status,
        CASE WHEN count(DISTINCT status) = 1 THEN min(status) END AS content FROM q_art GROUP BY universe, t0"""))
def a53(h):
    return C.deduplicate(_attempts(h), ["universe", "t0"], F.col("status"))


@query("j18_merge_batches", sql("""
 WITH a AS (SELECT universe, t0, status, close FROM q_art WHERE asset = (SELECT min(asset) FROM q_assets z
            WHERE z.universe = q_art.universe)),
 b AS (SELECT universe, t0, status, close + CASE WHEN t0 % 60 = 0 THEN 1 ELSE 0 END AS close FROM a WHERE t0 % 30 = 0),
 w AS (SELECT a.universe, a.t0, a.status, CASE WHEN b.t0 IS NOT NULL AND a.t0 % 210 = 0 THEN 'duplicate_in_batch'
              WHEN b.close <> a.close THEN 'conflict' ELSE 'kept' END AS merge FROM a LEFT JOIN b USING (universe, t0))
 SELECT universe, t0, merge, CASE WHEN merge = 'kept' THEN status END AS status FROM w"""))
def j18(h):
    """A batch and a later one that repeats a part of it, here and there changed or twice."""
    a = _attempts(h).join(h.assets.filter("ordinal = 0").select("universe", "asset"), ["universe", "asset"], "left_semi") \
        .select("universe", "t0", "status", "close")
    b = a.filter("t0 % 30 = 0").withColumn("close", F.col("close") + F.when(F.col("t0") % 60 == 0, 1).otherwise(0))
    b = b.unionByName(b.filter("t0 % 210 = 0"))
    return C.merge_batches(a, b, ["universe", "t0"], ["status", "close"]).select("universe", "t0", "merge", "status")


@query("j19_catalog_outputs", sql("""
 SELECT e.universe, e.t0, COALESCE(s.status, CASE WHEN e.eligible THEN 'missing' ELSE 'ineligible' END) status
 FROM q_events e LEFT JOIN (SELECT DISTINCT universe, t0, 'scored' AS status FROM q_scores) s USING (universe, t0)
 WHERE e.k = 3"""))
def j19(h):
    done = h.scores.filter("status = 'scored'").select("universe", "t0", "status").distinct()
    return (h.events.filter("k = 3").join(done, ["universe", "t0"], "left")
            .select("universe", "t0", F.coalesce("status", F.when(
                F.col("eligible"), "missing").otherwise("ineligible")).alias("status")))


part("q_tsrc", f"""
 SELECT universe, t0, tier, asset, day, a_vol a, a_mdd, 'model' AS method, m_vol p, m_mdd pd FROM q_roll WHERE NOT ({FAILED})
 UNION ALL SELECT universe, t0, tier, asset, day, a_vol, a_mdd, 'dynamic_naive', vol255, NULL FROM q_roll
 UNION ALL SELECT universe, t0, tier, asset, day, a_vol, a_mdd, 'historical_30', vol30, mdd30 FROM q_roll""")
part("q_tier", f"""
 SELECT c.universe, c.t0, c.tier, c.method, c.s chosen, a.s actual, c.s = a.s AS exact,
        len(list_intersect(a.s, c.s)) common, len(c.s) selected, x.mae vol_mae, x.recall top3_recall,
        d.mdd_mae, d.day
 FROM ({top2('p', 'universe, t0, tier, method', 'q_tsrc')}) c
 JOIN ({top2('a_vol', 'universe, t0, tier')}) a USING (universe, t0, tier)
 JOIN ({rank_scores('q_tsrc', 'universe, t0, tier, method')}) x USING (universe, t0, tier, method)
 JOIN (SELECT universe, t0, tier, method, avg(abs(pd - a_mdd)) mdd_mae, max(day) AS day FROM q_tsrc
       GROUP BY universe, t0, tier, method) d USING (universe, t0, tier, method)""")
part("q_sum", """
 SELECT universe, tier, method, count(*) n_scored, count(*) FILTER (exact) exact_hits,
        avg(exact::INT) exact_rate, avg(common) mean_hits, avg(vol_mae) vol_mae, avg(mdd_mae) mdd_mae,
        avg(top3_recall) top3_recall, count(mdd_mae) n_mdd, count(*) FILTER (selected > 2) over_two,
        any_value(len(range(255, n - 30, 30))) n_scheduled
 FROM q_tier JOIN q_spans USING (universe) GROUP BY universe, tier, method""")


def _tier(h):
    return h._once("tier_scores", lambda: C.tier_scores(h.rolling, F.expr(FAILED)))


def _scheduled(h):
    """The number of planned origins, whatever became of them."""
    return windows.rolling_origins(h.spans).groupBy("universe").agg(F.count("*").alias("n_scheduled"))


def _summary(h):
    return C.method_summary(_tier(h), _scheduled(h))


part("q_pair", f"""
 WITH m AS (SELECT DISTINCT universe, asset FROM q_roll WHERE tier = 'small'),
 p AS (SELECT a.universe, a.asset f, b.asset s FROM m a JOIN m b ON b.universe = a.universe AND a.asset < b.asset),
 t AS (SELECT universe, s, count(*) hits FROM ({top2('a_vol', 'universe, t0, tier')}) WHERE tier = 'small'
       AND len(s) = 2 GROUP BY universe, s)
 SELECT universe, f AS first, s AS second, hits FROM (
  SELECT p.universe, p.f, p.s, COALESCE(t.hits, 0) hits, row_number() OVER (PARTITION BY p.universe
         ORDER BY COALESCE(t.hits, 0) DESC, p.f, p.s) rn FROM p
  LEFT JOIN t ON t.universe = p.universe AND t.s = [p.f, p.s]) WHERE rn = 1""")


@query("a65_j22_tier_scores", sql(f"""
 WITH o AS (SELECT universe, unnest(range(255, n - 30, 30)) t0 FROM q_spans),
 w AS (SELECT o.universe, o.t0, s.tier, k.method FROM o JOIN (SELECT DISTINCT universe, tier FROM q_assets) s USING (universe)
       CROSS JOIN (VALUES ('model'), ('dynamic_naive'), ('historical_30')) k(method)),
 f AS (SELECT a.universe, a.t0, a.s = [q.first, q.second] AS exact, len(list_intersect(a.s, [q.first, q.second])) common
       FROM ({top2('a_vol', 'universe, t0, tier')}) a JOIN q_pair q USING (universe) WHERE a.tier = 'small')
 SELECT universe, t0, tier, method, CASE WHEN q.selected IS NULL THEN 'failed' ELSE 'scored' END AS status,
        COALESCE(exact, FALSE) AS exact, CAST(COALESCE(common, 0) AS BIGINT) common, CAST(COALESCE(selected, 0) AS BIGINT) selected, {r('vol_mae')} vol_mae, {r('mdd_mae')} mdd_mae,
        {r('top3_recall')} top3_recall FROM w LEFT JOIN q_tier q USING (universe, t0, tier, method)
 UNION ALL SELECT universe, t0, 'small', 'fixed_pair', 'scored', exact, CAST(common AS BIGINT), 2, NULL, NULL, NULL FROM f"""))
def a65(h):
    """Every planned origin with every method; a failed one has a row without scores."""
    rows = C.whole_plan(_tier(h), windows.rolling_origins(h.spans), h.assets).unionByName(
        C.fixed_pair_scores(h.rolling).withColumn("status", F.lit("scored")), allowMissingColumns=True)
    return rows.select("universe", "t0", "tier", "method", "status", F.coalesce("exact", F.lit(False)).alias("exact"),
                       F.coalesce("common", F.lit(0)).cast("long").alias("common"),
                       F.coalesce("selected", F.lit(0)).cast("long").alias("selected"),
                       rd("vol_mae").alias("vol_mae"), rd("mdd_mae").alias("mdd_mae"),
                       rd("top3_recall").alias("top3_recall"))


@query("a18_g19_method_summary", sql(f"""
 SELECT universe, tier, method, n_scheduled, n_scored, n_scheduled - n_scored n_failed, exact_hits,
        {r('exact_rate')} exact_rate, {r('mean_hits')} mean_hits, {r('vol_mae')} vol_mae, {r('mdd_mae')} mdd_mae,
        {r('top3_recall')} top3_recall, n_mdd, over_two, n_scored = n_scheduled complete FROM q_sum"""))
def a18(h):
    s = _summary(h)
    return s.select("universe", "tier", "method", "n_scheduled", "n_scored", "n_failed", "exact_hits",
                    *[rd(c).alias(c) for c in ("exact_rate", "mean_hits", "vol_mae", "mdd_mae",
                                               "top3_recall")],
                    "n_mdd", "over_two", (F.col("n_failed") == 0).alias("complete"))


@query("a18_histograms", sql("""
 SELECT universe, tier, method, selected, count(*) n FROM q_tier GROUP BY ALL"""))
def a18_hist(h):
    return _tier(h).groupBy("universe", "tier", "method",
                            F.col("selected").cast("long").alias("selected")).agg(
        F.count("*").alias("n"))


FIELDS = ("exact", "common", "vol_mae", "mdd_mae", "top3_recall")
part("q_pdiff", " UNION ALL ".join(f"""
 SELECT a.universe, a.tier, a.t0, a.day, b.method, '{f}' AS field, a.{f}::DOUBLE candidate, b.{f}::DOUBLE reference
 FROM q_tier a JOIN q_tier b USING (universe, t0, tier) WHERE a.method = 'model' AND b.method <> 'model'
  AND a.{f} IS NOT NULL AND b.{f} IS NOT NULL""" for f in FIELDS))


@query("j7_paired_differences", sql(f"""
 SELECT universe, tier, method, field, count(*) n, {r('avg(candidate - reference)')} difference,
        {r('avg(candidate)')} candidate_mean, {r('avg(reference)')} reference_mean
 FROM q_pdiff GROUP BY universe, tier, method, field"""))
def j7(h):
    return C.paired_differences(_tier(h), "model", FIELDS).groupBy(
        "universe", "tier", "method", "field").agg(
        F.count("*").alias("n"), rd(F.avg("difference")).alias("difference"),
        rd(F.avg("candidate")).alias("candidate_mean"),
        rd(F.avg("reference")).alias("reference_mean"))


@query("a56_gates", sql(f"""
 WITH j AS (SELECT a.universe, a.tier, b.method reference, a.exact_rate - b.exact_rate gain,
   a.n_scored = a.n_scheduled AND b.n_scored = b.n_scheduled whole, a.mdd_mae c, b.mdd_mae rf
   FROM q_sum a JOIN q_sum b USING (universe, tier) WHERE a.method = 'model' AND b.method <> 'model')
 SELECT universe, tier, reference, {r('gain')} gain,
        whole AND CASE WHEN tier = 'small' THEN gain > 0 ELSE gain >= -0.02 END passed,
        CASE WHEN NOT whole THEN 'incomplete paired grid' WHEN CASE WHEN tier = 'small' THEN gain > 0
        ELSE gain >= -0.02 END THEN 'passed' ELSE 'point estimate does not meet threshold' END reason,
        {r('(c - rf) / NULLIF(rf, 0)')} relative_change,
        CAST(CASE WHEN rf = 0 THEN c > 0 ELSE c > rf * 1.2 END AS VARCHAR) guard_triggered FROM j"""))
def a56(h):
    return C.gates(_summary(h)).select(
        "universe", "tier", "reference", rd("gain").alias("gain"), "passed", "reason",
        rd("relative_change").alias("relative_change"),
        F.col("guard_triggered").cast("string").alias("guard_triggered"))


@query("a63_observation_change", sql(f"""
 SELECT a.universe, a.tier, {r('(a.mdd_mae - b.mdd_mae) / NULLIF(b.mdd_mae, 0)')} change,
        (a.mdd_mae - b.mdd_mae) / NULLIF(b.mdd_mae, 0) >= 0.2 flagged FROM q_sum a JOIN q_sum b USING (universe, tier)
 WHERE a.method = 'model' AND b.method = 'historical_30'"""))
def a63(h):
    s = _summary(h)
    a = s.filter("method = 'model'").select("universe", "tier", F.col("mdd_mae").alias("c"))
    b = s.filter("method = 'historical_30'").select("universe", "tier", F.col("mdd_mae").alias("o"))
    change = F.try_divide(F.col("c") - F.col("o"), F.col("o"))
    return a.join(b, ["universe", "tier"]).select("universe", "tier", rd(change).alias("change"),
                                                  (change >= 0.2).alias("flagged"))


@query("a57_candidate_selection", sql("""
 SELECT universe, tier, arg_min(method, (vol_mae, method)) chosen FROM q_sum GROUP BY universe, tier"""))
def a57(h):
    """Smallest error wins, the earlier name on a tie."""
    return _summary(h).groupBy("universe", "tier").agg(
        F.min_by("method", F.struct("vol_mae", "method")).alias("chosen"))


@query("o8_best_method", sql("""
 SELECT universe, metric, arg_min(method, (mae, method)) best_mae, arg_max(method, (round(recall, 9), method)) best_recall
 FROM (SELECT universe, method, metric, avg(mae) mae, avg(recall) recall FROM q_scores GROUP BY ALL)
 GROUP BY universe, metric"""))
def o8(h):
    means = h.scores.groupBy("universe", "method", "metric").agg(
        F.avg("mae").alias("mae"), F.avg("recall").alias("recall"))
    return means.groupBy("universe", "metric").agg(
        F.min_by("method", F.struct("mae", "method")).alias("best_mae"),
        F.max_by("method", F.struct(F.round("recall", 9).alias("r"), "method")).alias("best_recall"))


@query("a55_b7_fixed_pair", sql("SELECT * FROM q_pair"))
def a55(h):
    return C.fixed_pair(h.rolling)


@query("a50_transitions", sql("""
 SELECT m.universe, CASE WHEN b.actual = b.chosen AND m.actual = m.chosen THEN 'both_correct'
        WHEN m.actual = m.chosen THEN 'corrected' WHEN b.actual = b.chosen THEN 'broken' ELSE 'both_wrong' END cell,
        array_to_string(m.actual, '|') actual_set, count(*) n
 FROM q_sets m JOIN q_sets b USING (universe, t0) WHERE m.strategy = 'model' AND b.strategy = 'historical_volatility'
 GROUP BY ALL"""))
def a50(h):
    sets = C.set_scores(C.strategy_sets(h.rolling)).select("universe", "t0", "actual", "strategy", "exact")
    m = sets.filter("strategy = 'model'").select("universe", "t0", "actual", F.col("exact").alias("m"))
    b = sets.filter("strategy = 'historical_volatility'").select("universe", "t0", F.col("exact").alias("b"))
    cell = (F.when(F.col("m") & F.col("b"), "both_correct").when(F.col("m"), "corrected")
            .when(F.col("b"), "broken").otherwise("both_wrong"))
    return (m.join(b, ["universe", "t0"]).withColumn("cell", cell)
            .groupBy("universe", "cell", F.array_join("actual", "|").alias("actual_set"))
            .agg(F.count("*").alias("n")))


@query("a51_quartile_regimes", sql("""
 WITH q AS (SELECT universe, quantile_cont(vol30, 0.25) a, quantile_cont(vol30, 0.5) b, quantile_cont(vol30, 0.75) c
            FROM q_roll GROUP BY universe)
 SELECT universe, (vol30 > a)::INT + (vol30 > b)::INT + (vol30 > c)::INT bucket, count(*) n
 FROM q_roll JOIN q USING (universe) GROUP BY ALL"""))
def a51(h):
    from ..operators.diagnostics import quartile_regimes
    return quartile_regimes(h.rolling, ["universe"], "vol30").groupBy("universe", "bucket").agg(
        F.count("*").alias("n"))


@query("a61_recent_rollup", sql("""
 SELECT universe, count(*) n, count(*) FILTER (status = 'scored') scored, min(t0) oldest FROM (
  SELECT *, row_number() OVER (PARTITION BY universe ORDER BY t0 DESC) rn FROM q_led) WHERE rn <= 50
 GROUP BY universe"""))
def a61(h):
    """Roll-up of the last 50 scheduled forecasts of each universe."""
    w = Window.partitionBy("universe").orderBy(F.desc("t0"))
    return (C.ledger(_manifest(h), _attempts(h), ["universe", "t0"])
            .withColumn("rn", F.row_number().over(w)).filter("rn <= 50").groupBy("universe")
            .agg(F.count("*").alias("n"), F.count_if(F.col("status") == "scored").alias("scored"),
                 F.min("t0").alias("oldest")))


@query("f25_alerts", sql("""
 SELECT universe, t0, asset, rk AS rnk, concat_ws('|', CASE WHEN m_mdd > 0.5 THEN 'drawdown_above_threshold' END,
        CASE WHEN rk <= 2 THEN 'volatility_rank' END) reasons, m_mdd > 0.5 OR rk <= 2 alert
 FROM (SELECT *, rank() OVER (PARTITION BY universe, t0 ORDER BY m_vol DESC) rk FROM q_roll)"""))
def f25(h):
    from ..operators.attention import alerts
    rows = h.rolling.select("universe", "t0", "asset", F.col("m_vol").alias("vol"),
                            F.col("m_mdd").alias("mdd"))
    return alerts(rows, ["universe", "t0"], 0.5).select(
        "universe", "t0", "asset", F.col("rank").cast("long").alias("rnk"),
        F.array_join("reasons", "|").alias("reasons"), "alert")


@query("b7_constant_initial", sql(f"""
 SELECT universe, array_to_string(s, '|') assets FROM (SELECT universe, arg_min(s, t0) s
  FROM ({top2('vol30', 'universe, t0')}) GROUP BY universe)"""))
def b7(h):
    return C.first_origin(h.rolling).withColumn("rk", competition_rank(["universe"], "vol30")).filter("rk <= 2") \
        .groupBy("universe").agg(F.array_join(F.array_sort(F.collect_list("asset")), "|")
                                 .alias("assets"))


DRAW = "('0x' || substr(md5(concat_ws('|', {})), 1, 8))::BIGINT"


@query("a41_day_bootstrap", sql(f"""
 WITH d AS (SELECT universe, metric, day, sum(model_error) a, sum(baseline_error) b FROM q_err
            GROUP BY universe, metric, day),
 n AS (SELECT *, row_number() OVER (PARTITION BY universe, metric ORDER BY day) - 1 dn,
              count(*) OVER (PARTITION BY universe, metric) nd FROM d),
 g AS (SELECT universe, metric, nd, rep.rep, i.i, {DRAW.format("'20260926', rep.rep, i.i")} % nd dn
       FROM (SELECT DISTINCT universe, metric, nd FROM n WHERE nd >= 2) k, range(2000) rep(rep), range(3000) i(i)
       WHERE i.i < nd),
 v AS (SELECT g.universe, g.metric, g.rep, any_value(g.nd) nd, 1 - sum(n.a) / NULLIF(sum(n.b), 0) skill
       FROM g JOIN n ON n.universe = g.universe AND n.metric = g.metric AND n.dn = g.dn GROUP BY 1, 2, 3)
 SELECT universe, metric, count(skill) replicates, CAST(any_value(nd) AS BIGINT) n_days,
        {r('quantile_cont(skill, 0.025)')} low, {r('quantile_cont(skill, 0.975)')} high
 FROM v GROUP BY universe, metric"""))
def a41(h):
    """Skill interval from 2000 redraws of whole days."""
    reps = resample.day_bootstrap(_errors(h), ["universe", "metric"], F.col("model_error"),
                                  F.col("baseline_error"))
    skill = reps.withColumn("value", 1 - F.col("value"))
    return resample.interval(skill, ["universe", "metric"]).select(
        "universe", "metric", "replicates", F.col("n_days").cast("long").alias("n_days"),
        rd("low").alias("low"), rd("high").alias("high"))


@query("a44_simultaneous_band", sql(f"""
 WITH d AS (SELECT universe, asset, day, sum(m_vol - a_vol) a, count(*) b FROM q_roll GROUP BY universe, asset, day),
 n AS (SELECT *, row_number() OVER (PARTITION BY universe, asset ORDER BY day) - 1 dn,
              count(*) OVER (PARTITION BY universe, asset) nd FROM d),
 g AS (SELECT universe, nd, rep.rep, {DRAW.format("'20260926', rep.rep, i.i")} % nd dn
       FROM (SELECT DISTINCT universe, nd FROM n WHERE nd >= 2) k, range(2000) rep(rep), range(3000) i(i)
       WHERE i.i < nd),
 v AS (SELECT g.universe, n.asset, g.rep, sum(n.a) / sum(n.b) x FROM g JOIN n ON n.universe = g.universe
       AND n.nd = g.nd AND n.dn = g.dn GROUP BY 1, 2, 3),
 p AS (SELECT universe, asset, avg(m_vol - a_vol) mu FROM q_roll GROUP BY universe, asset),
 s AS (SELECT universe, asset, stddev_pop(x) sd FROM v GROUP BY universe, asset),
 m AS (SELECT universe, rep, max(abs(x - mu) / sd) m FROM v JOIN p USING (universe, asset)
       JOIN s USING (universe, asset) WHERE sd > 0 GROUP BY universe, rep)
 SELECT universe, {r('quantile_cont(m, 0.95)')} factor FROM m GROUP BY universe"""))
def a44(h):
    gap = h.rolling.withColumn("d", F.col("m_vol") - F.col("a_vol"))
    reps = resample.day_bootstrap(gap, ["universe", "asset"], F.col("d"), F.lit(1))
    points = gap.groupBy("universe", "asset").agg(F.avg("d").alias("estimate"))
    return resample.simultaneous_band(reps, points, ["universe"], "asset").select(
        "universe", rd("factor").alias("factor"))
