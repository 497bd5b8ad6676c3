"""SQL statements of the shared tables, for the side-by-side check in another engine."""

from __future__ import annotations

import re

from ..operators.shocks import K_GRID
from .hub import DAMPING, MODEL, STUDY_K

PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    PARTS[name] = body


def sql(final: str) -> str:
    """``final`` preceded by the shared parts it mentions, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in PARTS.items():
            key = name.split("(")[0]
            if name not in needed and re.search(rf"\b{key}\b", text):
                if re.search(rf"\b{key}\b", body) and "(" not in name:
                    raise ValueError(f"part {name} refers to itself")
                visit(body) if "(" not in name else visit(re.sub(rf"\b{key}\b", "", body))
                needed.append(name)
    visit(final)
    ordered = [n for n in PARTS if n in needed]
    if not ordered:
        return final
    shared = ",\n".join(f"{n} AS {'' if '(' in n else 'MATERIALIZED '}({PARTS[n]})"
                        for n in ordered)
    own = final.strip()
    joint = ",\n" + own[5:] if own.startswith("WITH ") else "\n" + own
    return "WITH RECURSIVE " + shared + joint


def r(expr: str, digits: int = 6) -> str:
    """Rounded, and never a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


part("q_ticks", """
 SELECT 'events' universe, event_type asset, CAST(floor(epoch(ts) / 3600) AS BIGINT) cell,
        value price, 1.0::DOUBLE volume, value amount, event_id seq FROM events
 UNION ALL
 SELECT 'lineitem', l_returnflag || l_linestatus, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT),
        l_extendedprice / l_quantity, l_quantity, l_extendedprice,
        (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576
 FROM lineitem
 UNION ALL
 SELECT 'orders', o_orderpriority, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT),
        o_totalprice, 1.0, o_totalprice, o_orderkey FROM orders""")
part("q_cells", """
 SELECT universe, asset, cell, arg_min(price, seq) open, max(price) high, min(price) low,
        arg_max(price, seq) AS close, sum(volume) volume, sum(amount) amount
 FROM q_ticks WHERE price > 0 GROUP BY universe, asset, cell""")
part("q_extents", """
 SELECT universe, asset, min(cell) c_first, max(cell) c_last FROM q_cells GROUP BY ALL""")
part("q_spans", """
 SELECT universe, max(c_first) lo, min(c_last) hi, count(*) asset_count,
        min(c_last) - max(c_first) + 1 n FROM q_extents GROUP BY universe""")
part("q_assets", """
 SELECT universe, asset, CAST(row_number() OVER (PARTITION BY universe ORDER BY asset) - 1 AS INT)
        ordinal, CASE WHEN row_number() OVER (PARTITION BY universe ORDER BY asset) - 1
        < ceil(count(*) OVER (PARTITION BY universe) / 2.0) THEN 'major' ELSE 'small' END tier
 FROM q_extents""")
part("q_spine", """
 SELECT universe, asset, lo, unnest(range(c_first, hi + 1)) cell
 FROM q_extents JOIN q_spans USING (universe)""")
part("q_bars", """
 SELECT universe, asset, cell - lo idx, cell, COALESCE(open, filled) open, COALESCE(high, filled) high,
        COALESCE(low, filled) low, filled AS close, COALESCE(volume, 0.0) volume,
        COALESCE(amount, 0.0) amount, synthetic,
        make_timestamp(((cell + 1) * CASE universe WHEN 'events' THEN 3600 ELSE 86400 END
                        * 1000000)::BIGINT) ts
 FROM (SELECT s.universe, s.asset, s.cell, s.lo, c.open, c.high, c.low, c.volume, c.amount,
              c.close IS NULL synthetic,
              last_value(c.close IGNORE NULLS) OVER (PARTITION BY s.universe, s.asset
                                                     ORDER BY s.cell) filled
       FROM q_spine s LEFT JOIN q_cells c USING (universe, asset, cell)) WHERE cell >= lo""")
part("q_rets", """
 SELECT *, ln(close) - ln(lag(close) OVER w) r, ln(close / lag(close, 5) OVER w) r5
 FROM q_bars WINDOW w AS (PARTITION BY universe, asset ORDER BY idx)""")
part("q_signal", """
 SELECT *, CASE WHEN count(r5) OVER w = 60 THEN stddev_pop(r5) OVER w END sigma
 FROM q_rets WINDOW w AS (PARTITION BY universe, asset ORDER BY idx
                          ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
part("q_cand", f"""
 SELECT universe, asset, k, idx, ts, r5, sigma
 FROM q_signal, (VALUES {', '.join(f'({k})' for k in K_GRID)}) g(k)
 WHERE sigma > 0 AND abs(r5) > k * sigma""")
part("q_keep(universe, asset, k, idx)", """
 SELECT universe, asset, k, min(idx) FROM q_cand GROUP BY ALL
 UNION ALL
 SELECT c.universe, c.asset, c.k, min(c.idx) FROM q_keep p JOIN q_cand c
   ON c.universe = p.universe AND c.asset = p.asset AND c.k = p.k AND c.idx >= p.idx + 30
 GROUP BY c.universe, c.asset, c.k, p.idx""")
part("q_trig", """
 SELECT universe, k, idx, ts, asset, CASE WHEN r5 > 0 THEN 1 ELSE -1 END direction,
        abs(r5) / sigma magnitude
 FROM q_cand JOIN q_keep USING (universe, asset, k, idx)""")
part("q_anchor(universe, k, t0)", """
 SELECT universe, k, min(idx) FROM q_trig GROUP BY ALL
 UNION ALL
 SELECT t.universe, t.k, min(t.idx) FROM q_anchor p JOIN q_trig t
   ON t.universe = p.universe AND t.k = p.k AND t.idx > p.t0 + 10
 GROUP BY t.universe, t.k, p.t0""")
part("q_event", """
 SELECT a.universe, a.k, a.t0, min(o.ts) ts, string_agg(o.asset, '|' ORDER BY o.asset) origins,
        CASE WHEN min(o.direction) = max(o.direction) THEN min(o.direction) ELSE 0 END direction,
        max(o.magnitude) magnitude,
        (SELECT count(DISTINCT t.asset) FROM q_trig t WHERE t.universe = a.universe AND t.k = a.k
         AND t.idx BETWEEN a.t0 - 10 AND a.t0 + 10) systemic_assets,
        (SELECT count(*) FROM q_trig t WHERE t.universe = a.universe AND t.k = a.k
         AND t.idx BETWEEN a.t0 AND a.t0 + 10) n_members, any_value(s.n) n
 FROM q_anchor a JOIN q_trig o ON o.universe = a.universe AND o.k = a.k AND o.idx = a.t0
 JOIN q_spans s ON s.universe = a.universe GROUP BY a.universe, a.k, a.t0""")
part("q_events", """
 SELECT *, CASE WHEN t0 + 10 < n THEN systemic_assets >= 3 END systemic,
        t0 >= 255 AND t0 + 30 < n eligible,
        concat_ws('|', CASE WHEN t0 < 255 THEN 'insufficient_history_256' END,
                  CASE WHEN t0 + 30 >= n THEN 'incomplete_future_30' END) reasons
 FROM q_event""")
part("q_study", f"""
 SELECT *, strftime(ts, '%Y-%m-%d') AS day,
        CASE WHEN universe = 'events' THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y') END period
 FROM q_events WHERE k = {STUDY_K} AND eligible""")
part("q_st", f"SELECT * FROM q_trig WHERE k = {STUDY_K}")
# Long windows: offset o from the origin, for event origins and for rolling origins.
part("q_win", """
 SELECT e.universe, e.t0, b.asset, CAST(b.idx - e.t0 AS INT) o, b.close, b.r
 FROM q_study e JOIN q_rets b ON b.universe = e.universe AND b.idx BETWEEN e.t0 - 255 AND e.t0 + 30""")
part("q_beta", """
 SELECT w.universe, w.t0, w.asset,
        CASE WHEN min(d.r) < max(d.r) THEN covar_pop(w.r, d.r) / var_pop(d.r) END beta
 FROM q_win w JOIN q_assets a ON a.universe = w.universe AND a.ordinal = 0
 JOIN q_win d ON d.universe = w.universe AND d.t0 = w.t0 AND d.o = w.o AND d.asset = a.asset
 WHERE w.o BETWEEN -254 AND 0 GROUP BY ALL""")
part("q_spot", "SELECT universe, t0, asset, close spot FROM q_win WHERE o = 0")
part("q_step", f"""
 SELECT w.universe, w.t0, w.asset, 'historical_30' AS method, w.o + 30 step, w.r x
 FROM q_win w WHERE w.o BETWEEN -29 AND 0
 UNION ALL
 SELECT w.universe, w.t0, w.asset, 'no_propagation', w.o + 30,
        CASE WHEN list_contains(string_split(e.origins, '|'), w.asset) THEN w.r ELSE 0.0 END
 FROM q_win w JOIN q_study e USING (universe, t0) WHERE w.o BETWEEN -29 AND 0
 UNION ALL
 SELECT w.universe, w.t0, w.asset, 'driver_beta', d.o + 30, b.beta * d.r
 FROM q_spot w JOIN q_beta b USING (universe, t0, asset)
 JOIN q_assets a ON a.universe = w.universe AND a.ordinal = 0
 JOIN q_win d ON d.universe = w.universe AND d.t0 = w.t0 AND d.asset = a.asset
 WHERE d.o BETWEEN -29 AND 0
 UNION ALL
 SELECT w.universe, w.t0, w.asset, '{MODEL}', 1 - w.o, {DAMPING} * w.r
 FROM q_win w WHERE w.o BETWEEN -29 AND 0""")
part("q_path", """
 SELECT s.universe, s.t0, s.asset, s.method, s.step, p.spot,
        p.spot * exp(sum(s.x) OVER (PARTITION BY s.universe, s.t0, s.asset, s.method
                                    ORDER BY s.step)) AS close
 FROM q_step s JOIN q_spot p USING (universe, t0, asset)
 UNION ALL
 SELECT w.universe, w.t0, w.asset, 'actual', w.o, p.spot, w.close
 FROM q_win w JOIN q_spot p USING (universe, t0, asset) WHERE w.o >= 1""")
part("q_risk_all", """
 SELECT universe, t0, asset, method, max((peak - close) / peak) mdd,
        CASE WHEN min(lr) = max(lr) THEN 0.0 ELSE stddev_pop(lr) END * sqrt(30) vol
 FROM (SELECT *, greatest(spot, max(close) OVER w) peak,
              ln(close) - ln(COALESCE(lag(close) OVER w, spot)) lr
       FROM q_path WINDOW w AS (PARTITION BY universe, t0, asset, method ORDER BY step))
 GROUP BY ALL""")
part("q_actual", "SELECT universe, t0, asset, mdd, vol FROM q_risk_all WHERE method = 'actual'")
part("q_risk", "SELECT * FROM q_risk_all WHERE method <> 'actual'")
part("q_scored", """
 SELECT e.universe, e.t0, a.asset, a.ordinal, a.tier FROM q_study e JOIN q_assets a USING (universe)
 WHERE e.systemic IS NOT NULL
   AND (e.systemic OR NOT list_contains(string_split(e.origins, '|'), a.asset))""")
part("q_pairs", """
 SELECT universe, t0, asset, tier, ordinal, method, metric,
        CASE metric WHEN 'max_drawdown' THEN p.mdd ELSE p.vol END p,
        CASE metric WHEN 'max_drawdown' THEN a.mdd ELSE a.vol END a
 FROM q_risk p JOIN q_actual a USING (universe, t0, asset) JOIN q_scored USING (universe, t0, asset),
      (VALUES ('max_drawdown'), ('volatility')) m(metric)""")


def ranked(source: str, keys: str, k: int = 3) -> str:
    """Subquery: cutoff weights and average ranks of p and a within ``keys``."""
    return f"""
 SELECT *, CASE WHEN p > pc THEN 1.0 WHEN p = pc THEN (kk - pab) / pti::DOUBLE ELSE 0.0 END wp,
        CASE WHEN a > ac THEN 1.0 WHEN a = ac THEN (kk - aab) / ati::DOUBLE ELSE 0.0 END wa
 FROM (SELECT *, count(*) FILTER (p > pc) OVER (PARTITION BY {keys}) pab,
              count(*) FILTER (p = pc) OVER (PARTITION BY {keys}) pti,
              count(*) FILTER (a > ac) OVER (PARTITION BY {keys}) aab,
              count(*) FILTER (a = ac) OVER (PARTITION BY {keys}) ati
       FROM (SELECT *, max(CASE WHEN prn = kk THEN p END) OVER (PARTITION BY {keys}) pc,
                    max(CASE WHEN arn = kk THEN a END) OVER (PARTITION BY {keys}) ac
             FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY p DESC) prn,
                          row_number() OVER (PARTITION BY {keys} ORDER BY a DESC) arn,
                          rank() OVER (PARTITION BY {keys} ORDER BY p)
                          + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2.0 rp,
                          rank() OVER (PARTITION BY {keys} ORDER BY a)
                          + (count(*) OVER (PARTITION BY {keys}, a) - 1) / 2.0 ra,
                          least({k}, count(*) OVER (PARTITION BY {keys})) kk
                   FROM {source})))"""


def rank_scores(source: str, keys: str, k: int = 3) -> str:
    return f"""
 SELECT {keys}, count(*) asset_count, avg(abs(p - a)) mae, sum(wp * wa) / any_value(kk) recall,
        any_value(kk) / count(*)::DOUBLE chance,
        max(pti) predicted_tied, max(ati) actual_tied,
        bool_or(pab < kk AND pab + pti > kk) predicted_crosses,
        bool_or(aab < kk AND aab + ati > kk) actual_crosses,
        CASE WHEN min(p) = max(p) AND min(a) = max(a) THEN 'constant_prediction_and_actual'
             WHEN min(p) = max(p) THEN 'constant_prediction'
             WHEN min(a) = max(a) THEN 'constant_actual' END reason,
        CASE WHEN min(p) < max(p) AND min(a) < max(a)
             THEN greatest(least(corr(rp, ra), 1.0), -1.0) END spearman
 FROM ({ranked(source, keys, k)}) GROUP BY {keys}"""


part("q_scores", rank_scores("q_pairs", "universe, t0, method, metric"))
part("q_rwin", """
 SELECT o.universe, o.t0, b.asset, CAST(b.idx - o.t0 AS INT) o, b.close, b.r
 FROM (SELECT universe, unnest(range(255, n - 30, 30)) t0 FROM q_spans) o
 JOIN q_rets b ON b.universe = o.universe AND b.idx BETWEEN o.t0 - 255 AND o.t0 + 30""")
part("q_rpath", f"""
 SELECT universe, t0, asset, 'actual' AS method, o step, close,
        first_value(close) OVER (PARTITION BY universe, t0, asset ORDER BY o) spot
 FROM q_rwin WHERE o BETWEEN 0 AND 30
 UNION ALL
 SELECT universe, t0, asset, 'past', o + 30, close,
        first_value(close) OVER (PARTITION BY universe, t0, asset ORDER BY o)
 FROM q_rwin WHERE o BETWEEN -30 AND 0
 UNION ALL
 SELECT universe, t0, asset, 'mirror', step, spot * exp(sum(x) OVER (PARTITION BY universe, t0, asset
        ORDER BY step)), spot
 FROM (SELECT w.universe, w.t0, w.asset, 1 - w.o step, {DAMPING} * w.r x, s.close spot FROM q_rwin w
       JOIN q_rwin s ON s.universe = w.universe AND s.t0 = w.t0 AND s.asset = w.asset AND s.o = 0
       WHERE w.o BETWEEN -29 AND 0
       UNION ALL SELECT universe, t0, asset, 0, 0.0, close FROM q_rwin WHERE o = 0)""")
part("q_rrisk", """
 SELECT universe, t0, asset, method, any_value(spot) spot, max((peak - close) / peak) mdd,
        arg_max(close, step) / any_value(spot) - 1 ret, CASE WHEN min(lr) = max(lr) THEN 0.0 ELSE stddev_pop(lr) END * sqrt(30) vol
 FROM (SELECT *, max(close) OVER w peak, ln(close) - ln(lag(close) OVER w) lr
       FROM q_rpath WINDOW w AS (PARTITION BY universe, t0, asset, method ORDER BY step))
 GROUP BY universe, t0, asset, method""")
part("q_roll", """
 SELECT x.universe, x.t0, x.asset, x.spot, v.vol255, p.vol vol30, p.mdd mdd30, m.mdd m_mdd,
        m.vol m_vol, x.mdd a_mdd, x.vol a_vol, m.ret m_ret, x.ret a_ret, b.ts, a.ordinal, a.tier,
        strftime(b.ts, '%Y-%m-%d') AS day, CASE WHEN x.universe = 'events'
        THEN strftime(b.ts, '%Y-%m') ELSE strftime(b.ts, '%Y') END period
 FROM (SELECT * FROM q_rrisk WHERE method = 'actual') x
 JOIN (SELECT * FROM q_rrisk WHERE method = 'past') p USING (universe, t0, asset)
 JOIN (SELECT * FROM q_rrisk WHERE method = 'mirror') m USING (universe, t0, asset)
 JOIN (SELECT universe, t0, asset, CASE WHEN min(r) = max(r) THEN 0.0 ELSE stddev_pop(r) END
              * sqrt(30) vol255 FROM q_rwin WHERE o BETWEEN -254 AND 0 GROUP BY ALL) v
   USING (universe, t0, asset)
 JOIN q_bars b ON b.universe = x.universe AND b.asset = x.asset AND b.idx = x.t0
 JOIN q_assets a ON a.universe = x.universe AND a.asset = x.asset""")
