"""Stateful operators on small feeds: gaps, late rows, restarts and repeated batches."""

from __future__ import annotations

import time
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockwatch.operators import graph
from shockwatch.session import materialize
from shockwatch.streaming import claims, freshness, live, merging, prints, runtime

BARS = "universe string, asset string, idx bigint, ts timestamp, close double"


def bars(spark, idx, asset="A"):
    rng = np.random.default_rng(5)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 2000)))
    rows = [("u", asset, int(i), float(price[i % 2000])) for i in idx]
    return spark.createDataFrame(rows, "universe string, asset string, idx bigint, close double").select(
        "universe", "asset", "idx", F.timestamp_seconds((F.col("idx") + 1000) * 3600).alias("ts"), "close")


def snapshots(spark, *slices):
    """The feed arrives in one slice per run; every run goes on from the checkpoint."""
    feed = runtime.Replay(slices[0].limit(0).unionByName(slices[0]), "snap", slices=1)
    out, _ = runtime.drain(live.snapshots(feed.stream, "1 hour"), "snap", [feed])
    return out


def test_replay_keeps_a_universe_spread_over_tasks(spark):
    """The slices are staged by the tasks that read the rows, not by one task for the universe."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        feed = runtime.Replay(bars(spark, range(200)).repartition(4, "idx"), "spread", slices=1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    staged = spark.read.parquet(f"{feed.base}/staged")
    assert staged.count() == 200 and len(staged.inputFiles()) > 1


def test_drawdown_and_returns_of_a_gapless_feed(spark):
    df = bars(spark, range(200))
    close = np.array([r.close for r in df.orderBy("idx").collect()])
    rows = {r.idx: r for r in snapshots(spark, df).collect()}
    for i in (30, 77, 199):
        frame = close[i - 30:i + 1]
        peak = np.maximum.accumulate(frame)
        assert rows[i].mdd30 == pytest.approx(((peak - frame) / peak).max())
        assert rows[i].ret30 == pytest.approx(close[i] / close[i - 30] - 1)
    r = np.diff(np.log(close))
    assert rows[199].recent == pytest.approx(r[-10:].std()) and rows[199].base == pytest.approx(r[-120:].std())
    assert rows[50].state == "unavailable" and rows[150].state in ("near_usual", "above_usual")


def test_nothing_is_computed_across_a_gap(spark):
    df = bars(spark, [*range(150), *range(700, 850)])
    rows = {r.idx: r for r in snapshots(spark, df).collect()}
    assert rows[149].state != "incomplete"
    assert all(rows[i].state == "incomplete" for i in range(700, 820)) and rows[820].state in ("near_usual", "above_usual")
    assert rows[729].ret30 is None or np.isnan(rows[729].ret30)
    close = {r.idx: r.close for r in df.collect()}
    assert rows[730].ret30 == pytest.approx(close[730] / close[700] - 1)


def test_restart_late_rows_and_repeats(spark):
    """Three runs on one checkpoint equal one run; a bar for an index already passed is reported as late."""
    whole = snapshots(spark, bars(spark, range(300))).select("idx", "vol30", "ratio").orderBy("idx").collect()
    feed = runtime.Replay(bars(spark, range(300)), "snap-in", slices=3)
    parts, _ = runtime.drain(live.snapshots(feed.stream, "1 hour"), "snap", [feed])
    assert parts.select("idx", "vol30", "ratio").orderBy("idx").collect() == whole
    again = bars(spark, range(300)).withColumn("order", F.col("idx")).unionByName(
        bars(spark, [5, 6]).withColumn("order", F.lit(299).cast("long")))
    feed = runtime.Replay(again, "late-in", slices=3, order="order")
    rows, _ = runtime.drain(live.snapshots(feed.stream.drop("order"), "1000 hours"), "late", [feed])
    assert sorted(r.idx for r in rows.filter("state = 'late'").collect()) == [5, 6]
    assert rows.filter("state <> 'late'").count() == 300
    assert live.published(rows, 1).filter("state = 'late'").count() == 0


def test_triggers_restart_after_a_gap(spark):
    df = bars(spark, range(120)).unionByName(bars(spark, range(500, 560)).withColumn("close", F.col("close") * 50))
    feed = runtime.Replay(df, "trig-in", slices=2)
    rows, _ = runtime.drain(live.online_triggers(feed.stream, "1 hour"), "trig", [feed])
    assert rows.filter("idx >= 500").count() == 0  # the jump over the hole is no return


def attempts(spark, rows):
    """(window, last bar, asked at, number, status) as a stream's rows; ``idx`` orders the feed."""
    return spark.createDataFrame([("u", *r, i) for i, r in enumerate(rows)],
                                 "universe string, window_id string, a long, b long, attempt long, status string, idx long").select(
        "universe", "window_id", F.timestamp_seconds("a").alias("as_of"), F.timestamp_seconds("b").alias("requested_at"),
        "attempt", "status", "idx")


def claim(spark, book, rows, **how):
    feed = runtime.Replay(attempts(spark, rows), "claims-in", slices=how.pop("slices", 1))
    runtime.drain(claims.decided_attempts(feed.stream.drop("idx"), **how), "claims", [feed], each_batch=book, clock="processing")


def entered(book, spark):
    return sorted((r.window_id, r.attempt, r.accepted, r.outcome, r.reason) for r in book.attempts(spark).collect())


def test_a_failed_first_attempt_stands(spark):
    """Failures are kept and never tried again; stale requests claim nothing; the order is that of asking."""
    book = claims.ClaimBook(spark, runtime.folder(spark, "book"), "one")
    claim(spark, book, [("w1", 10, 12, 1, "ok"), ("w1", 10, 11, 0, "failed"), ("w1", 10, 13, 2, "ok"),
                        ("w2", 10, 191, 0, "ok"), ("w2", 10, 190, 1, "failed"), ("w3", 10, 500, 0, "ok"), ("w4", None, 5, 0, "ok")])
    assert entered(book, spark) == [
        ("w1", 0, True, "failed", None), ("w1", 1, False, "failed", "repeat"), ("w1", 2, False, "failed", "repeat"),
        ("w2", 0, False, None, "stale"), ("w2", 1, True, "failed", None), ("w3", 0, False, None, "stale"),
        ("w4", 0, False, None, "stale")]


def test_repeats_are_refused_after_expiry_and_after_a_restart(spark):
    """The second batch comes after the claim left the state; the second run has another checkpoint."""
    book = claims.ClaimBook(spark, runtime.folder(spark, "book"), "one")
    claim(spark, book, [("w1", 10, 11, 0, "failed"), ("w1", 10, 20, 1, "ok")], slices=2, ttl_ms=1)
    again = claims.ClaimBook(spark, book.path, "two")
    claim(spark, again, [("w1", 10, 30, 2, "ok"), ("w1", 10, 31, 3, "ok"), ("w2", 10, 30, 0, "ok")])
    want = [("w1", 0, True, "failed", None), *[("w1", i, False, "failed", "repeat") for i in (1, 2, 3)], ("w2", 0, True, "ok", None)]
    assert entered(again, spark) == want
    batch = again.attempts(spark).filter("run = 'two'").drop("run", "batch", "day")
    number = again.attempts(spark).filter("run = 'two'").first().batch
    decided = materialize(batch.withColumn("accepted", F.col("attempt").isin(0, 2)), "again").select(
        *[c.split()[0] for c in claims.DECIDED.split(", ")])
    again(decided, number)  # the same batch once more
    assert entered(again, spark) == want


def changes(rows):
    return [(r.feed, r.at.timestamp(), r.age_s, r.stale, r.error) for r in sorted(rows.collect(), key=lambda r: (r.feed, r.at))]


def test_gaps_of_a_replayed_feed(spark):
    stamps = [("a", t, None) for t in (0, 60, 120, 600, 660, 900)] + [("b", 0, None), ("b", 30, "timeout"), ("b", 60, None), ("b", 890, None)]
    df = spark.createDataFrame([(f, t, e, t) for f, t, e in stamps], "feed string, t long, error string, idx long").select(
        F.lit("u").alias("universe"), "feed", F.timestamp_seconds(F.col("t") + 10_000).alias("ts"), "error", "idx")
    feed = runtime.Replay(df, "fresh-in", slices=3)
    rows, _ = runtime.drain(freshness.freshness(feed.stream, delay="0 seconds"), "fresh", [feed])
    assert [(f, round(at - 10_000, 3), *r) for f, at, *r in changes(rows)] == [
        ("a", 0, 0, False, None), ("a", 300.001, 180.001, True, None), ("a", 600, 0, False, None),
        ("a", 840.001, 180.001, True, None), ("a", 900, 0, False, None),
        ("b", 0, 0, False, None), ("b", 30, 30, True, "timeout"), ("b", 60, 0, False, None), ("b", 240.001, 180.001, True, None),
        ("b", 890, 0, False, None)]


def test_a_silent_feed_turns_stale_by_its_own_timer(spark, monkeypatch):
    """A running query on the processing clock, at its cadence: fresh, silent, stale, and back."""
    monkeypatch.setattr(runtime, "MIN_CADENCE", 1)
    with pytest.raises(ValueError, match="cadence"):
        runtime.cadence(0)
    base = runtime.folder(spark, "silent")
    schema = "feed string, ts timestamp"

    def poll():
        spark.createDataFrame([("a", datetime.now(timezone.utc))], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def seen():
        return changes(spark.read.schema(freshness.CHANGES).parquet(f"{base}/out"))

    def until(n):
        for _ in range(240):
            if len(seen()) >= n:
                return seen()
            time.sleep(0.25)
        raise AssertionError(seen())

    poll()
    spark.createDataFrame([], freshness.CHANGES).write.parquet(f"{base}/out")
    with runtime.stateful(spark, 2):
        query = freshness.freshness(spark.readStream.schema(schema).parquet(f"{base}/in"), limit_ms=15_000).writeStream.format(
            "parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(
            **runtime.cadence(1)).start()
    try:
        first = until(1)
        if not first[0][3]:  # a slow start may find the bar stale already
            first = until(2)
        assert first[-1][3] and first[-1][2] > 15 and first[-1][4] is None
        poll()
        back = until(len(first) + 1)[len(first)]
        assert not back[3] and back[2] <= 15
        starts = [datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00")) for p in query.recentProgress]
        assert len({int(t.timestamp()) for t in starts}) == len(starts)  # one batch at most in each second of the clock
    finally:
        query.stop()


def left_in_state(reports):
    return sum(s["numRowsTotal"] for s in reports[-1]["stateOperators"])


def test_state_of_vanished_assets_goes(spark):
    """One asset ends early; behind the watermark by the idle time, it leaves the state, and the other stays."""
    df = bars(spark, range(150)).unionByName(bars(spark, range(20), asset="B"))
    held = {}
    for idle in (None, 50 * 3600 * 1000):
        feed = runtime.Replay(df, "idle-in", slices=3)
        rows, reports = runtime.drain(live.snapshots(feed.stream, "1 hour", idle), "idle", [feed])
        assert rows.count() == 170
        held[idle is None] = reports[-1]["stateOperators"][0]["customMetrics"].get("numValueStateVars"), left_in_state(reports)
    assert held[False][1] < held[True][1] + 4  # one tail and one timer against two tails
    feed = runtime.Replay(df, "idle-in", slices=3)
    rows, _ = runtime.drain(live.online_triggers(feed.stream, "1 hour", idle_ms=50 * 3600 * 1000), "idle", [feed])
    feed = runtime.Replay(df, "idle-in", slices=3)
    same, _ = runtime.drain(live.online_triggers(feed.stream, "1 hour"), "idle", [feed])
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, same.collect()))


def test_state_of_finished_curves_goes(spark):
    """A curve's state goes with its last point; that of an unfinished one stays until its time is up."""
    rows = [("u", 1, "major", h, 1.0) for h in range(121)] + [("u", 2, "major", h, 1.5) for h in range(60)]
    df = spark.createDataFrame([(*r, r[3]) for r in rows], "universe string, t0 long, tier string, h int, ratio double, idx long")
    feed = runtime.Replay(df, "curve-in", slices=2)
    got, reports = runtime.drain(live.recovery_tracker(feed.stream.drop("idx")), "curve", [feed], clock="processing")
    assert got.count() == 181 and got.filter("t0 = 1 and confirmed").count() == 112
    feed = runtime.Replay(df.filter("t0 = 1"), "curve-in", slices=2)
    _, finished = runtime.drain(live.recovery_tracker(feed.stream.drop("idx")), "curve", [feed], clock="processing")
    assert left_in_state(finished) == 0 < left_in_state(reports)


def test_prints_of_every_minute_equal_batch(spark):
    """Triggers of three assets, ties and border-crossing follow-ups included; prints grow minute by minute."""
    rng = np.random.default_rng(3)
    hits = sorted({(int(i), a) for a in "ABC" for i in rng.choice(200, 12, replace=False)})
    triggers = spark.createDataFrame([("u", i, a, 1 if i % 3 else -1, 3.0 + i / 100) for i, a in hits],
                                     "universe string, idx long, asset string, direction int, magnitude double")
    t0s = sorted({i for i, _ in hits if i < 160})[::2] + [29, 30]
    events = [("u", t, [a for i, a in hits if i == t]) for t in dict.fromkeys(t0s) if any(i == t for i, _ in hits)]
    event_rows = spark.createDataFrame(events, "universe string, t0 long, origins array<string>")
    stamp = lambda c: F.timestamp_seconds((F.col(c) + 1000) * 3600).alias("ts")
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    source = event_rows.select("universe", F.lit("event").alias("kind"), F.col("t0").alias("idx"), stamp("t0"), none("asset", "string"),
                               none("direction", "int"), none("magnitude", "double"), "origins").unionByName(
        triggers.select("universe", F.lit("trigger").alias("kind"), "idx", stamp("idx"), "asset", "direction", "magnitude",
                        none("origins", "array<string>"))).unionByName(
        spark.range(230).select(F.lit("u").alias("universe"), F.lit("clock").alias("kind"), F.col("id").alias("idx"), stamp("id"),
                                none("asset", "string"), none("direction", "int"), none("magnitude", "double"),
                                none("origins", "array<string>")))
    feed = runtime.Replay(source, "prints-in", slices=3)
    stream = prints.growing_prints(feed.stream, {"u": ["A", "B", "C"]}, {"u": 3_600_000}, "1 hour")
    got, reports = runtime.drain(stream, "prints", [feed])
    assets = spark.createDataFrame([("u", a, i) for i, a in enumerate("ABC")], "universe string, asset string, ordinal int")
    slots = graph.slots(event_rows, triggers)
    made = {(r.t0, r.minutes): [tuple(s) for s in r.fp] for r in got.collect()}
    assert len(made) == got.count() == 30 * len(events)
    for minutes in (1, 7, 29, 30):
        for r in graph.fingerprints(graph.censor(slots, minutes), event_rows, assets).collect():
            assert made[(r.t0, minutes)] == [(s.ordinal, s.present, s.direction, s.magnitude, s.delay) for s in r.fp]
    assert left_in_state(reports) <= 12  # the last stretches only


def merged_brute(hits):
    """Events of one universe's triggers (idx, asset, direction, magnitude), one after the other."""
    out, blocked = [], -1
    for idx in sorted({h[0] for h in hits}):
        if idx > blocked:
            origins = sorted(h for h in hits if h[0] == idx)
            signs, near = {h[2] for h in origins}, {h[1] for h in hits if abs(h[0] - idx) <= 10}
            out.append((idx, "|".join(h[1] for h in origins), signs.pop() if len(signs) == 1 else 0, max(h[3] for h in origins),
                        len(near), len(near) >= 3))
            blocked = idx + 10
    return out


@pytest.mark.parametrize(("chunk", "every"), [(16, 0.5), (16, 0.04), (64, 0.9)])
def test_online_merge_over_chunk_borders(spark, chunk, every):
    """Dense and sparse triggers, a chain of blocked bars over many borders, empty chunks between."""
    rng = np.random.default_rng(7)
    hits = [(int(i), a, int(rng.choice([-1, 1])), float(rng.integers(30, 90)) / 10) for i in range(420) for a in "ABCD"
            if rng.random() < every / 4 and not 200 <= i < 280]
    rows = [("u", 3, *h) for h in hits] + [("u", 4, 440, "A", 1, 9.0), ("u", 3, 440, "A", 1, 9.0)]
    df = spark.createDataFrame(rows, "universe string, k int, idx long, asset string, direction int, magnitude double").select(
        "universe", "k", "idx", F.timestamp_seconds((F.col("idx") + 1000) * 3600).alias("ts"), "asset", "direction", "magnitude")
    feed = runtime.Replay(df, "merge-in", slices=4)
    stream = merging.online_events(feed.stream.withWatermark("ts", "1 hour"), {"u": 3_600_000}, chunk)
    got, reports = runtime.drain(stream, "merge", [feed])
    found = sorted((r.t0, r.origins, r.direction, r.magnitude, r.systemic_assets, r.systemic) for r in got.collect())
    assert found == [e for e in merged_brute(hits + [(440, "A", 1, 9.0)]) if e[0] + 10 <= 439]
    assert all(r.ts.timestamp() == (r.t0 + 1000) * 3600 for r in got.collect())
    rows_held = max(s["numRowsTotal"] for p in reports for s in p["stateOperators"][:1] + p["stateOperators"][-1:])
    assert rows_held < 3 * len(hits) + 400  # triggers, their timers and a row a chunk, of one slice at most


def test_slices_arrive_one_by_one(spark):
    feed = runtime.Replay(bars(spark, range(90)), "slices", slices=3)
    seen = []
    runtime.drain(feed.stream, "slices-run", [feed], each_batch=lambda batch, n: seen.append(
        (batch.agg(F.min("idx"), F.max("idx")).first())))
    assert [tuple(r) for r in seen if r[0] is not None] == [(0, 29), (30, 59), (60, 89)]


def test_missing_folder_is_an_error(spark, monkeypatch):
    from shockwatch import session

    class Context:
        master, applicationId = "yarn", "app"  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
