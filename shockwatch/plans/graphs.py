"""Follow-up graph, fingerprints and nearest events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cluster, graph
from .core import rd
from .oracle import part, r, sql
from .registry import query

OBSERVED = 10

part("q_fol", """
 SELECT universe, t0, asset, CAST(min(idx) - t0 AS INT) delay, arg_min(direction, idx) direction,
        arg_min(magnitude, idx) magnitude
 FROM (SELECT e.universe, e.t0, t.idx, t.asset, t.direction, t.magnitude FROM q_study e JOIN q_st t
       ON t.universe = e.universe AND t.idx > e.t0 AND t.idx <= e.t0 + 30
       WHERE NOT list_contains(string_split(e.origins, '|'), t.asset)) GROUP BY ALL""".replace(
    "GROUP BY ALL", "GROUP BY universe, t0, asset"))
part("q_org", """
 SELECT universe, t0, unnest(string_split(origins, '|')) source FROM q_study""")
part("q_slot", """
 SELECT o.universe, o.t0, o.source asset, 0 delay, t.direction, t.magnitude
 FROM q_org o JOIN q_st t ON t.universe = o.universe AND t.idx = o.t0 AND t.asset = o.source
 UNION ALL SELECT universe, t0, asset, delay, direction, magnitude FROM q_fol""")
part("q_obs", """
 SELECT o.universe, o.t0, o.source, f.asset target, f.delay, f.magnitude
 FROM q_org o JOIN q_fol f USING (universe, t0)""")
part("q_edge", """
 SELECT s.universe, s.asset source, t.asset target, count(o.t0) n, avg(o.delay) mean_delay,
        median(o.magnitude) median_magnitude,
        (SELECT count(*) FROM q_org g WHERE g.universe = s.universe AND g.source = s.asset) source_events
 FROM q_assets s JOIN q_assets t ON t.universe = s.universe
 LEFT JOIN q_obs o ON o.universe = s.universe AND o.source = s.asset AND o.target = t.asset
 GROUP BY s.universe, s.asset, t.asset""")


def pair_distance(minutes: str) -> str:
    """Distance of slots ``a`` and ``b`` of one asset, both as seen after ``minutes``; averaged over assets."""
    return f"""CASE
        WHEN NOT COALESCE(a.delay <= {minutes}, false) AND NOT COALESCE(b.delay <= {minutes}, false) THEN 0.0
        WHEN NOT COALESCE(a.delay <= {minutes}, false) OR NOT COALESCE(b.delay <= {minutes}, false) THEN 1.0
        ELSE ((a.direction <> b.direction)::INT + abs(ln(1 + a.magnitude) - ln(1 + b.magnitude))
              / (1 + abs(ln(1 + a.magnitude) - ln(1 + b.magnitude)))
              + abs(a.delay - b.delay) / 30.0) / 3.0 END"""


def dist(minutes: int) -> str:
    """Distance of every query/library pair, both censored at ``minutes``."""
    return f"""
 SELECT q.universe, q.t0, l.t0 neighbour, round(avg(CASE
        WHEN a.delay IS NULL AND b.delay IS NULL THEN 0.0
        WHEN a.delay IS NULL OR b.delay IS NULL THEN 1.0
        ELSE ((a.direction <> b.direction)::INT + abs(ln(1 + a.magnitude) - ln(1 + b.magnitude))
              / (1 + abs(ln(1 + a.magnitude) - ln(1 + b.magnitude)))
              + abs(a.delay - b.delay) / 30.0) / 3.0 END), 12) distance
 FROM q_study q JOIN q_study l ON l.universe = q.universe AND l.t0 <> q.t0
 JOIN q_assets s ON s.universe = q.universe
 LEFT JOIN q_slot a ON a.universe = q.universe AND a.t0 = q.t0 AND a.asset = s.asset AND a.delay <= {minutes}
 LEFT JOIN q_slot b ON b.universe = q.universe AND b.t0 = l.t0 AND b.asset = s.asset AND b.delay <= {minutes}
 GROUP BY q.universe, q.t0, l.t0"""


def _follow(h):
    return h._once("follow", lambda: graph.follow_ups(h.study, h.study_triggers))


def _slots(h):
    return h._once("slots", lambda: graph.slots(h.study, h.study_triggers, follow=_follow(h)))


def _prints(h, minutes=30):
    return graph.fingerprints(graph.censor(_slots(h), minutes), h.study, h.assets)


def _period_prints(h):
    return h._once("prints", lambda: _prints(h).join(h.study.select("universe", "t0", "period"),
                                                     ["universe", "t0"]))


@query("j9_follow_ups", sql(f"""
 SELECT universe, t0, asset, delay, direction, {r('magnitude')} magnitude FROM q_fol"""))
def j9(h):
    return graph.follow_ups(h.study, h.study_triggers).select(
        "universe", "t0", "asset", "delay", "direction", rd("magnitude").alias("magnitude"))


@query("j10_origin_mismatch", sql("""
 SELECT e.universe, count(*) events, count(*) FILTER (e.origins <> s.seen) mismatched FROM q_study e
 JOIN (SELECT universe, idx t0, string_agg(asset, '|' ORDER BY asset) seen FROM q_st GROUP BY ALL) s
   USING (universe, t0) GROUP BY e.universe"""))
def j10(h):
    bad = graph.origin_mismatch(h.study, h.study_triggers).select("universe", "t0") \
        .withColumn("bad", F.lit(1))
    return (h.study.select("universe", "t0").join(bad, ["universe", "t0"], "left")
            .groupBy("universe").agg(F.count("*").alias("events"),
                                     F.count("bad").alias("mismatched")))


@query("d11_fingerprint_slots", sql(f"""
 SELECT e.universe, e.t0, a.asset, s.delay IS NOT NULL present,
        {r('COALESCE(s.magnitude, 0)')} magnitude, COALESCE(s.delay, -1) delay,
        COALESCE(s.direction, 0) direction
 FROM q_study e JOIN q_assets a USING (universe)
 LEFT JOIN q_slot s ON s.universe = e.universe AND s.t0 = e.t0 AND s.asset = a.asset"""))
def d11(h):
    s = F.col("s")
    names = h.assets.select("universe", "asset", "ordinal")
    return (_prints(h).select("universe", "t0", F.explode("fp").alias("s"))
            .select("universe", "t0", s["ordinal"].alias("ordinal"), s["present"].alias("present"),
                    rd(F.coalesce(s["magnitude"], F.lit(0.0))).alias("magnitude"),
                    F.coalesce(s["delay"], F.lit(-1)).alias("delay"),
                    F.coalesce(s["direction"], F.lit(0)).alias("direction"))
            .join(names, ["universe", "ordinal"]).drop("ordinal"))


@query("a28_a29_edges", sql(f"""
 SELECT universe, source, target, n, {r('mean_delay')} mean_delay,
        {r('median_magnitude')} median_magnitude, source_events,
        {r('CASE WHEN source <> target AND source_events > 0 THEN n / source_events::DOUBLE END')} rate
 FROM q_edge"""))
def a28(h):
    return _edges(h).select("universe", "source", "target", "n", rd("mean_delay").alias("mean_delay"),
                            rd("median_magnitude").alias("median_magnitude"), "source_events",
                            rd("rate").alias("rate"))


def _edges(h):
    obs = graph.observations(h.study, _follow(h))
    return graph.edge_table(obs, graph.opportunities(h.study), h.assets)


@query("a30_delay_distributions", sql(f"""
 WITH e AS (SELECT universe, 'equal_edge' AS kind, mean_delay::DOUBLE x FROM q_edge WHERE n > 0
            UNION ALL SELECT universe, 'pooled', delay::DOUBLE FROM q_obs)
 SELECT universe, kind, count(*) n, {r('avg(x)')} mean_delay, {r('quantile_cont(x, 0.9)')} p90,
        {r('quantile_cont(x, 0.99)')} p99, {r('avg((x <= 30)::INT)')} share_le_30
 FROM e GROUP BY ALL"""))
def a30(h):
    """Means of edges against pooled observations; both have few distinct values."""
    edge = _edges(h).filter("n > 0").select("universe", F.lit("equal_edge").alias("kind"),
                                            F.col("mean_delay").alias("x"))
    pooled = graph.observations(h.study, _follow(h)).select(
        "universe", F.lit("pooled").alias("kind"), F.col("delay").cast("double").alias("x"))
    return edge.unionByName(pooled).groupBy("universe", "kind").agg(
        F.count("*").alias("n"), rd(F.avg("x")).alias("mean_delay"),
        rd(F.percentile("x", 0.9)).alias("p90"), rd(F.percentile("x", 0.99)).alias("p99"),
        rd(F.avg((F.col("x") <= 30).cast("int"))).alias("share_le_30"))


@query("w12_timelines", sql("""
 SELECT s.universe, s.t0, s.delay, string_agg(s.asset, '|' ORDER BY a.ordinal) assets
 FROM q_slot s JOIN q_assets a ON a.universe = s.universe AND a.asset = s.asset
 GROUP BY s.universe, s.t0, s.delay"""))
def w12(h):
    return graph.timelines(_slots(h), h.assets)


@query("o4_strongest_sequences", sql(f"""
 SELECT universe, t0, breadth, {r('magnitude')} magnitude, place FROM (
  SELECT e.universe, e.t0, f.breadth, e.magnitude, row_number() OVER (PARTITION BY e.universe
         ORDER BY f.breadth DESC, e.magnitude DESC, e.t0) place
  FROM q_study e JOIN (SELECT universe, t0, count(*) breadth FROM q_fol GROUP BY ALL) f
    USING (universe, t0)) WHERE place <= 3"""))
def o4(h):
    return graph.strongest_sequences(h.study, _follow(h)).select(
        "universe", "t0", "breadth", rd("magnitude").alias("magnitude"),
        F.col("place").cast("long").alias("place"))


@query("o6_strongest_edges", sql(f"""
 SELECT universe, source, target, n, {r('mean_delay')} mean_delay, best = 1 overall FROM (
  SELECT *, row_number() OVER (PARTITION BY universe, source ORDER BY n DESC, mean_delay, target) place,
         row_number() OVER (PARTITION BY universe ORDER BY n DESC, mean_delay, source, target) best
  FROM q_edge WHERE n > 0) WHERE place = 1"""))
def o6(h):
    w = Window.partitionBy("universe").orderBy(F.desc("n"), "mean_delay", "source", "target")
    return (graph.strongest_edges(_edges(h)).withColumn("overall", F.row_number().over(w) == 1)
            .select("universe", "source", "target", "n", rd("mean_delay").alias("mean_delay"),
                    "overall"))


@query("j15_o3_f11_nearest", sql(f"""
 SELECT universe, t0, neighbour, {r('distance', 9)} distance, place FROM (
  SELECT *, row_number() OVER (PARTITION BY universe, t0 ORDER BY distance, neighbour) place
  FROM ({dist(OBSERVED)})) WHERE place <= 3"""))
def j15(h):
    """Three nearest past events seen through their first ten bars."""
    prints = _prints(h, OBSERVED)
    return graph.nearest_events(prints, prints, 3).select(
        "universe", "t0", "neighbour", rd("distance", 9).alias("distance"),
        F.col("place").cast("long").alias("place"))


@query("c1_j14_f10_pair_summary", sql(f"""
 WITH d AS (SELECT d.*, a.period FROM ({dist(30)}) d JOIN q_study a USING (universe, t0)
            JOIN q_study b ON b.universe = d.universe AND b.t0 = d.neighbour AND b.period = a.period)
 SELECT e.universe, e.period, e.t0, {r('avg(d.distance)', 9)} mean_distance,
        COALESCE(arg_min(d.neighbour, (d.distance, d.neighbour)), -1) nearest,
        {r('min(d.distance)', 9)} nearest_distance
 FROM q_study e LEFT JOIN d ON d.universe = e.universe AND d.t0 = e.t0 GROUP BY e.universe, e.period, e.t0"""))
def c1(h):
    return graph.pair_summary(_period_prints(h)).select(
        "universe", "period", "t0", rd("mean_distance", 9).alias("mean_distance"), "nearest",
        rd("nearest_distance", 9).alias("nearest_distance"))


@query("a47_adjusted_rand", sql(f"""
 WITH c AS (SELECT universe, direction, systemic, count(*) c FROM q_study GROUP BY ALL),
 j AS (SELECT universe, sum(c * (c - 1) / 2.0) joint, sum(c) n FROM c GROUP BY universe),
 a AS (SELECT universe, sum(c * (c - 1) / 2.0) l FROM (SELECT universe, direction, sum(c) c FROM c
       GROUP BY ALL) GROUP BY universe),
 b AS (SELECT universe, sum(c * (c - 1) / 2.0) r FROM (SELECT universe, systemic, sum(c) c FROM c
       GROUP BY ALL) GROUP BY universe)
 SELECT universe, CAST(n AS BIGINT) n, {r('''(joint - l * r / (n * (n - 1) / 2))
        / NULLIF((l + r) / 2 - l * r / (n * (n - 1) / 2), 0)''')} ari
 FROM j JOIN a USING (universe) JOIN b USING (universe)"""))
def a47(h):
    """Agreement of two labelings of the events: shock direction against the systemic flag."""
    return cluster.adjusted_rand(h.study, ("universe",), "direction", "systemic").select(
        "universe", "n", rd("ari").alias("ari"))
