"""Streaming operators, run over the tables as replayed streams and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import materialize
from ..sources.tables import INTERVALS
from ..streaming import claims, freshness, live, merging, prints, runtime
from .core import MDD31, SNAP, rd
from .graphs import _slots, pair_distance
from .oracle import part, r, sql
from .registry import query

DELAY = {"events": "1 hour", "lineitem": "1 day", "orders": "1 day"}
STEP = dict(DELAY)
STEP_MS = {u: s * 1000 for u, s in INTERVALS.items()}
SECONDS = "CASE universe WHEN 'events' THEN 3600 ELSE 86400 END"


def _each(run):
    """``run(universe)`` of every universe, put together: a watermark is per query, and clocks differ by years."""
    out = None
    for universe in INTERVALS:
        rows = run(universe)
        out = rows if out is None else out.unionByName(rows)
    return out


def _bars(h, universe):
    return h.bars.filter(F.col("universe") == universe).select("universe", "asset", "idx", "ts", "close")


def _size(h, universe):
    return h.spans.filter(F.col("universe") == universe).first()["asset_count"]


@query("t1_closed_bars", sql(f"""
 WITH w AS (SELECT 'events' universe, floor(epoch_us(max(ts)) / 1000) / 1000 - 3600 AS mark FROM events
            UNION ALL SELECT universe, max(cell) * 86400 - 86400 FROM q_cells WHERE universe <> 'events' GROUP BY universe)
 SELECT universe, asset, (cell + 1) * {SECONDS} end_s, {r('open', 8)} AS open, {r('high', 8)} high, {r('low', 8)} low,
        {r('close', 8)} AS close, {r('volume')} volume, {r('amount', 2)} amount FROM q_cells JOIN w USING (universe)
 WHERE (cell + 1) * {SECONDS} <= mark"""))
def t1(h):
    """Bars from raw ticks; those still open under the watermark are held back."""
    def run(universe):
        if universe == "events":
            source = h.table("events").filter("value > 0").select(
                F.lit(universe).alias("universe"), F.floor(F.unix_timestamp("ts") / 3600).alias("cell"),
                F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
                F.lit(1.0).alias("volume"), F.col("value").alias("amount"), F.col("event_id").alias("seq"))
        else:
            source = h.ticks.filter((F.col("universe") == universe) & (F.col("price") > 0)).withColumn(
                "ts", F.timestamp_seconds(F.col("cell") * 86400))
        feed = runtime.Replay(source, "t1-in", order="cell")
        rows, _ = runtime.drain(live.closed_bars(feed.stream, STEP[universe], DELAY[universe]), "t1", [feed])
        return rows.withColumn("universe", F.lit(universe))
    return _each(run).select("universe", "asset", F.unix_timestamp("ts").alias("end_s"),
                             *[rd(c, 8).alias(c) for c in ("open", "high", "low", "close")],
                             rd("volume").alias("volume"), rd("amount", 2).alias("amount"))


LATE = 3


@query("t2_gaps_and_late", sql(f"""
 WITH c AS (SELECT universe, cell, count(*) n FROM q_cells GROUP BY ALL)
 SELECT universe, CASE WHEN c.n = asset_count THEN 'complete' ELSE 'incomplete' END status, count(*) AS times, {LATE}::BIGINT late_rows
 FROM c JOIN q_spans USING (universe) JOIN (SELECT universe, max(cell) top FROM q_cells GROUP BY ALL) USING (universe)
 WHERE cell + 1 <= top - 1 GROUP BY ALL"""))
def t2(h):
    """Times at which not every asset reported stay incomplete; rows for long closed times are counted, not used."""
    def run(universe):
        cells = h.cells.filter(F.col("universe") == universe).select(
            "universe", "asset", F.col("cell").alias("idx"), F.timestamp_seconds(F.col("cell") * INTERVALS[universe]).alias("ts"))
        ends = cells.groupBy("universe").agg(F.min("idx").alias("_low"), F.max("idx").alias("idx"))
        late = ends.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(LATE - 1)))).select(
            "universe", F.lit("late").alias("asset"), "idx",
            F.timestamp_seconds((F.col("_low") + F.col("_i")) * INTERVALS[universe]).alias("ts"))
        feed = runtime.Replay(cells.unionByName(late), "t2-in")
        rows, reports = runtime.drain(live.completeness(feed.stream, DELAY[universe], _size(h, universe), STEP[universe]),
                                      "t2", [feed])
        dropped = sum(s["numRowsDroppedByWatermark"] for p in reports for s in p["stateOperators"])
        return rows.groupBy("universe", "status").agg(F.count("*").alias("times")).withColumn(
            "late_rows", F.lit(dropped).cast("long"))
    return _each(run)


@query("t3_live_snapshots", sql(f"""
 WITH s AS ({SNAP}), m AS ({MDD31})
 SELECT universe, asset, idx, {r('vol30')} vol30, {r('ret30')} ret30, {r('m.mdd30')} mdd30,
        {r('CASE WHEN base > 0 THEN recent / base END')} ratio,
        CASE WHEN base IS NULL OR base = 0 OR recent IS NULL THEN 'unavailable' WHEN recent / base >= 1.2
        THEN 'above_usual' ELSE 'near_usual' END state
 FROM s JOIN q_spans USING (universe) LEFT JOIN m USING (universe, asset, idx) WHERE idx < n - 2"""))
def t3(h):
    """Stateful snapshots, published per bar once all assets of the universe are in and the bar is closed."""
    clean = lambda c: rd(F.nanvl(F.col(c), F.lit(None).cast("double")))
    return _each(lambda u: _published(h, u, "t3")).select(
        "universe", "asset", "idx", *[clean(c).alias(c) for c in ("vol30", "ret30", "mdd30", "ratio")], "state")


def _published(h, universe, label):
    feed = runtime.Replay(_bars(h, universe), f"{label}-in")
    rows = live.published(live.snapshots(feed.stream, DELAY[universe]), _size(h, universe), STEP[universe])
    return runtime.drain(rows, label, [feed])[0]


@query("t12_sliding_returns", sql(f"""
 WITH s AS ({SNAP})
 SELECT universe, asset, idx, {r('recent', 8)} recent, {r('base', 8)} base FROM s JOIN q_spans USING (universe)
 WHERE idx < n - 2 AND base IS NOT NULL"""))
def t12(h):
    """Return dispersion over 10 and 120 bars that end together."""
    return _each(lambda u: _published(h, u, "t12")).filter("base is not null and not isnan(base)").select(
        "universe", "asset", "idx", rd("recent", 8).alias("recent"), rd("base", 8).alias("base"))


REPEATED = 3


@query("t5_unique_windows", sql(f"""
 WITH a AS (SELECT m.universe, m.t0, s.ordinal, CASE WHEN ((m.t0 - 255) // 30 + s.ordinal) % 4 = 0 THEN 'failed' ELSE 'ok' END status
            FROM q_man m JOIN q_assets s USING (universe))
 SELECT universe, t0, arg_min(status, ordinal) FILTER (ordinal <> 2) outcome, 1::BIGINT claims,
        count(*) FILTER (ordinal <> 2) - 1 + CASE WHEN t0 < 255 + 30 * {REPEATED} THEN 1 ELSE 0 END repeats,
        count(*) FILTER (ordinal = 2) stale FROM a GROUP BY universe, t0"""))
def t5(h):
    """Every origin asked for once per asset, some in vain: the first attempt stands, also when it failed.

    The third asset asks too late after the window's last bar. The first windows are asked for again when
    the feed ends, and find in the book what became of them; half of the claims there were entered under
    another checkpoint, as after a restart.
    """
    path = runtime.folder(h.spark, "t5-book")

    def run(universe):
        asked = (_bars(h, universe).filter("idx >= 255 and (idx - 255) % 30 = 0")
                 .join(h.assets.select("universe", "asset", "ordinal"), ["universe", "asset"])
                 .withColumn("status", F.when(((F.col("idx") - 255) / 30 + F.col("ordinal")) % 4 == 0, "failed").otherwise("ok"))
                 .select("universe", F.concat_ws("-", "universe", "idx").alias("window_id"), F.col("ts").alias("as_of"),
                         (F.col("ts") + F.when(F.col("ordinal") == 2, F.expr("interval 10 minutes")).otherwise(
                             F.make_dt_interval(secs=F.col("ordinal")))).alias("requested_at"),
                         F.col("ordinal").cast("long").alias("attempt"), "status", "idx"))
        again = asked.filter((F.col("attempt") == 0) & (F.col("idx") < 255 + 30 * REPEATED)).withColumn("status", F.lit("ok"))
        middle = asked.agg((F.max("idx") / 2).alias("m")).first()["m"] or 0
        for name, part in (("before", asked.filter(F.col("idx") <= middle)),
                           ("after", asked.filter(F.col("idx") > middle).unionByName(again))):
            feed = runtime.Replay(part, "t5-in", slices=1)
            book = claims.ClaimBook(h.spark, path, f"{universe}-{name}")
            runtime.drain(claims.decided_attempts(feed.stream.drop("idx")), "t5", [feed], each_batch=book, clock="processing")
        return book.attempts(h.spark).filter(F.col("universe") == universe)
    count = lambda condition: F.count_if(condition)
    return _each(run).groupBy("universe", F.substring_index("window_id", "-", -1).cast("long").alias("t0")).agg(
        F.max(F.when(F.col("accepted"), F.col("outcome"))).alias("outcome"), count(F.col("accepted")).alias("claims"),
        count(F.col("reason") == "repeat").alias("repeats"), count(F.col("reason") == "stale").alias("stale"))


STALE_BARS = 2


@query("t4_staleness", sql(f"""
 WITH c AS (SELECT DISTINCT universe, asset, cell FROM q_cells),
 g AS (SELECT universe, asset, cell, cell - lag(cell) OVER w gap, lead(cell) OVER w - cell ahead,
              max(cell) OVER (PARTITION BY universe) top FROM c WINDOW w AS (PARTITION BY universe, asset ORDER BY cell))
 SELECT universe, asset, cell * {SECONDS} at_s, 0.0::DOUBLE age_s, false stale FROM g WHERE gap IS NULL OR gap > {STALE_BARS}
 UNION ALL
 SELECT universe, asset, (cell + {STALE_BARS}) * {SECONDS}, ({STALE_BARS} * {SECONDS})::DOUBLE, true FROM g
 WHERE ahead > {STALE_BARS} OR ahead IS NULL AND cell + {STALE_BARS} < top - 1"""))
def t4(h):
    """Feeds of single assets: stale when no bar came for two steps, fresh again with the next one."""
    def run(universe):
        cells = h.cells.filter(F.col("universe") == universe).select(
            "universe", F.concat_ws("|", "universe", "asset").alias("feed"), F.col("cell").alias("idx"),
            F.timestamp_seconds(F.col("cell") * INTERVALS[universe]).alias("ts"))
        feed = runtime.Replay(cells, "t4-in")
        rows = freshness.freshness(feed.stream, STALE_BARS * INTERVALS[universe] * 1000, DELAY[universe])
        return runtime.drain(rows, "t4", [feed])[0]
    return _each(run).select(F.substring_index("feed", "|", 1).alias("universe"), F.substring_index("feed", "|", -1).alias("asset"),
                             F.unix_timestamp("at").alias("at_s"), F.floor("age_s").cast("double").alias("age_s"), "stale")


@query("t6_retention", sql("""
 SELECT universe, t0 FROM (SELECT universe, t0, row_number() OVER (PARTITION BY universe ORDER BY t0 DESC) rn
  FROM q_man) WHERE rn <= 8"""))
def t6(h):
    """State trimmed to the newest eight windows; what it holds after the last batch."""
    made = (h.bars.filter("idx >= 255 and (idx - 255) % 30 = 0")
            .select("universe", "idx", F.col("idx").alias("t0")).distinct())
    feed = runtime.Replay(made, "t6-in")
    rows, _ = runtime.drain(live.retained(feed.stream), "t6", [feed], clock="processing")
    last = rows.groupBy("universe").agg(F.max("version").alias("version"))
    return rows.join(last, ["universe", "version"]).select("universe", "t0")


part("q_live_ev", """
 SELECT universe, k, t0, origins, direction, magnitude, systemic_assets, systemic_assets >= 3 systemic FROM q_events
 WHERE t0 + 10 <= n - 2""")


@query("t7_online_shocks", sql(f"""
 SELECT universe, k, t0, origins, direction, {r('magnitude')} magnitude, systemic_assets, systemic FROM q_live_ev"""))
def t7(h):
    """Triggers and events as the bars arrive; equals the batch catalog up to the watermark."""
    def run(universe):
        feed = runtime.Replay(_bars(h, universe), "t7-in", slices=2)
        events = merging.online_events(live.online_triggers(feed.stream, DELAY[universe]), STEP_MS)
        return runtime.drain(events, "t7", [feed])[0]
    return _each(run).select("universe", "k", "t0", "origins", "direction", rd("magnitude").alias("magnitude"),
                             "systemic_assets", "systemic")


@query("t8_pending_truth", sql("""
 SELECT m.universe, m.t0, CASE WHEN m.t0 + 30 <= m.n - 1 THEN 'scored' ELSE 'pending_truth' END status,
        s.asset_count * least(30, m.n - 1 - m.t0) closes FROM q_man m JOIN q_spans s USING (universe) WHERE m.t0 < m.n - 1"""))
def t8(h):
    """Forecasts become scorable only when the whole horizon has closed; the others wait with what they have."""
    def run(universe):
        stamps = _bars(h, universe).filter("idx >= 255 and (idx - 255) % 30 = 0").select(
            "universe", "asset", "idx", F.col("idx").alias("t0"), F.col("ts").alias("as_of"))
        left, right = runtime.Replay(stamps, "t8-origins"), runtime.Replay(_bars(h, universe), "t8-bars")
        rows = live.pending_truth(left.stream.drop("idx"), right.stream, f"{30 * INTERVALS[universe]} SECONDS", DELAY[universe])
        return runtime.drain(rows, "t8", [left, right])[0]
    per = _each(run).groupBy("universe", "t0", "asset").agg(F.count("close").alias("c"))
    return (per.groupBy("universe", "t0").agg(F.min("c").alias("low"), F.sum("c").cast("long").alias("closes"))
            .filter("closes > 0")
            .select("universe", "t0", F.when(F.col("low") == 30, "scored").otherwise("pending_truth").alias("status"), "closes"))


@query("t9_recovery_tracker", sql("""
 WITH b AS (SELECT *, max(CASE WHEN NOT ratio <= 1.2 THEN h END) OVER (PARTITION BY universe, t0, tier ORDER BY h) b FROM q_curve),
 s AS (SELECT universe, t0, tier, h, CASE WHEN ratio <= 1.2 THEN h - COALESCE(b, -1) ELSE 0 END streak FROM b)
 SELECT universe, t0, tier, h, streak, streak >= 10 confirmed,
        max((streak >= 10)::INT) OVER (PARTITION BY universe, t0, tier ORDER BY h) = 1 had_confirmed FROM s"""))
def t9(h):
    from .after import _curves
    curves = _curves(h).select("universe", "t0", "tier", "h", "ratio")
    feed = runtime.Replay(curves, "t9-in", order="h")
    rows, _ = runtime.drain(live.recovery_tracker(feed.stream), "t9", [feed], clock="processing")
    return rows.select("universe", "t0", "tier", "h", "streak", "confirmed", "had_confirmed")


@query("t10_progressive_nearest", sql(f"""
 WITH m AS (SELECT unnest(range(1, {graph.FOLLOW + 1})) AS minutes),
 d AS (SELECT q.universe, m.minutes, q.t0, l.t0 neighbour, round(avg({pair_distance('m.minutes')}), 12) distance
  FROM q_study q JOIN q_study l ON l.universe = q.universe AND l.t0 <> q.t0 JOIN q_spans n ON n.universe = q.universe
  JOIN m ON q.t0 + m.minutes <= n.n - 2 JOIN q_assets s ON s.universe = q.universe
  LEFT JOIN q_slot a ON a.universe = q.universe AND a.t0 = q.t0 AND a.asset = s.asset
  LEFT JOIN q_slot b ON b.universe = q.universe AND b.t0 = l.t0 AND b.asset = s.asset
  GROUP BY ALL)
 SELECT universe, minutes, t0, neighbour, {r('distance', 9)} distance, place FROM (
  SELECT *, row_number() OVER (PARTITION BY universe, minutes, t0 ORDER BY distance, neighbour) place FROM d) WHERE place <= 3"""))
def t10(h):
    """Events matched against the stored library after every minute of follow-ups, as triggers and bars arrive.

    Prints are assembled on the stream; a batch of them meets the library as it looked after as many
    minutes. A batch writes to a folder of its number, so a repeated batch replaces its own rows.
    """
    minutes = F.explode(F.sequence(F.lit(1), F.lit(graph.FOLLOW)))
    seen_then = _slots(h).withColumn("minutes", minutes).filter("delay <= minutes")
    apart = F.concat_ws("@", "universe", "minutes")  # prints of different minutes are never compared
    library = materialize(graph.fingerprints(
        seen_then.withColumn("universe", apart), h.study.withColumn("minutes", minutes).withColumn("universe", apart),
        h.assets.withColumn("minutes", minutes).withColumn("universe", apart)), "t10-library")
    declared = {u: [a["asset"] for a in h.assets.filter(F.col("universe") == u).orderBy("ordinal").collect()] for u in INTERVALS}
    target = runtime.folder(h.spark, "t10")

    def run(universe):
        blank = {"asset": "string", "direction": "int", "magnitude": "double", "origins": "array<string>"}

        def rows(df, kind, idx, *own):
            return df.filter(F.col("universe") == universe).select(
                "universe", F.lit(kind).alias("kind"), F.col(idx).alias("idx"), "ts",
                *[F.col(c).cast(t).alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in blank.items()])

        source = rows(h.study, "event", "t0", "origins").unionByName(
            rows(h.study_triggers, "trigger", "idx", "asset", "direction", "magnitude")).unionByName(
            rows(h.bars, "clock", "idx").distinct())
        feed = runtime.Replay(source, "t10-in", slices=1)

        def match(batch, number):
            stored = materialize(batch.withColumn("universe", apart), "t10-batch")
            if stored.isEmpty():
                return
            graph.nearest_events(stored, library.filter(F.col("universe").startswith(f"{universe}@")), 3).write.mode(
                "overwrite").parquet(f"{target}/feed={universe}/batch={number}")

        runtime.drain(prints.growing_prints(feed.stream, declared, STEP_MS, DELAY[universe]), "t10-run", [feed], each_batch=match)

    for universe in INTERVALS:
        run(universe)
    return h.spark.read.schema("universe string, t0 bigint, neighbour bigint, distance double, place int").parquet(target).select(
        F.substring_index("universe", "@", 1).alias("universe"), F.substring_index("universe", "@", -1).cast("long").alias("minutes"),
        "t0", "neighbour", rd("distance", 9).alias("distance"), F.col("place").cast("long").alias("place"))
