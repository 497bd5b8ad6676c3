"""Helpers that split hot groups must give the same rows as the plain computation."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shockwatch.operators import grid
from shockwatch.operators.bandjoin import band_join
from shockwatch.operators.halo import chunk_window, drop_halo, with_halo
from shockwatch.operators.quantiles import exact_quantiles
from shockwatch.operators.scan import assign_anchors
from shockwatch.operators.windows import evenly_spaced, market_windows, rolling_origins, rolling_windows


def greedy(marks, span):
    out, free = {}, -1
    for m in sorted(set(marks)):
        if m >= free:
            free = m + span
        out[m] = free - span
    return out


@pytest.mark.parametrize("span, chunk", [(11, 16), (30, 32), (30, 1024)])
def test_anchors_match_the_sequential_rule(spark, span, chunk):
    rng = random.Random(span * chunk)
    data, want = [], {}
    for key in range(12):
        marks = sorted(rng.sample(range(500), rng.choice((1, 5, 60, 400))))
        want[key] = greedy(marks, span)
        data += [(key, m, f"p{m}") for m in marks]
    df = spark.createDataFrame(data, "k int, idx bigint, tag string")
    got = assign_anchors(df, ["k"], span, payload=["tag"], chunk=chunk).collect()
    assert {(r.k, r.idx): r.anchor for r in got} == {(k, m): a for k, w in want.items() for m, a in w.items()}
    assert all(r.tag == f"p{r.idx}" for r in got)


def test_halo_equals_one_long_window(spark, rows):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("u", a, i, float(v)) for a in "AB" for i, v in enumerate(rng.random(300))],
                               "universe string, asset string, idx bigint, v double")
    plain = Window.partitionBy("universe", "asset").orderBy("idx")
    want = df.withColumn("s", F.stddev_pop("v").over(plain.rowsBetween(-20, -1))) \
        .withColumn("m", F.max("v").over(plain.rowsBetween(0, 10)))
    w = chunk_window(("universe", "asset"))
    got = drop_halo(with_halo(df, back=20, fwd=10, chunk=32)
                    .withColumn("s", F.stddev_pop("v").over(w.rowsBetween(-20, -1)))
                    .withColumn("m", F.max("v").over(w.rowsBetween(0, 10))))
    assert rows(want, "asset", "idx", "s", "m") == rows(got, "asset", "idx", "s", "m")


def test_band_join_matches_brute_force(spark):
    rng = random.Random(2)
    a = [("u", rng.randrange(300)) for _ in range(60)]
    b = [("u", rng.randrange(300)) for _ in range(80)]
    left = spark.createDataFrame(sorted(set(a)), "g string, l bigint")
    right = spark.createDataFrame(b, "g string, r bigint")
    got = sorted((r.l, r.r) for r in band_join(left, right, ["g"], -7, 13, "l", "r").collect())
    assert got == sorted((x, y) for _, x in set(a) for _, y in b if -7 <= y - x <= 13)
    near = {r.l for r in band_join(left, right, ["g"], -1, 1, "l", "r", how="left_semi").collect()}
    far = {r.l for r in band_join(left, right, ["g"], -1, 1, "l", "r", how="left_anti").collect()}
    want = {x for _, x in a if any(abs(y - x) <= 1 for _, y in b)}
    assert near == want and far == {x for _, x in a} - want


def test_anchors_over_ten_thousand_chunks(spark):
    rng = random.Random(1)
    data, want = [], {}
    for key, n in ((0, 40_000), (1, 300), (2, 12_000)):
        marks = sorted(rng.sample(range(160_000), n))
        want[key] = greedy(marks, 11)
        data += [(key, m) for m in marks]
    df = spark.createDataFrame(data, "k int, idx bigint")
    got = {(r.k, r.idx): r.anchor for r in assign_anchors(df, ["k"], 11, chunk=16).collect()}
    assert got == {(k, m): a for k, w in want.items() for m, a in w.items()}


@pytest.mark.parametrize("slices", [2, 64])
def test_exact_quantiles(spark, slices):
    rng = np.random.default_rng(7)
    groups = {"smooth": rng.normal(size=501), "heavy": np.r_[np.full(400, 3.0), rng.normal(size=200)],
              "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("two", None)],
                               "g string, v double")
    qs = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    for r in exact_quantiles(df, ["g"], "v", qs, slices).collect():
        assert r.value == pytest.approx(np.quantile(groups[r.g], r.q)), (r.g, r.q)
    assert exact_quantiles(df, ["g"], "v", qs, slices).count() == len(groups) * len(qs)


def test_dense_grid(spark, rows):
    cells = spark.createDataFrame([("u", "A", 2, 1.0), ("u", "A", 5, 2.0), ("u", "B", 3, 9.0), ("u", "B", 9, 8.0)],
                                  "universe string, asset string, cell bigint, close double")
    for c in ("open", "high", "low", "volume", "amount"):
        cells = cells.withColumn(c, F.col("close"))
    ext = cells.groupBy("universe", "asset").agg(F.min("cell").alias("first"), F.max("cell").alias("last"))
    spans = grid.common_interval(ext)
    assert spans.first().asDict() == {"universe": "u", "lo": 3, "hi": 5, "asset_count": 2, "n": 3}
    got = rows(grid.densify(cells, spans), "asset", "idx", "close", "volume", "synthetic")
    assert got == [("A", 0, 1.0, 0.0, True), ("A", 1, 1.0, 0.0, True), ("A", 2, 2.0, 2.0, False),
                   ("B", 0, 9.0, 9.0, False), ("B", 1, 9.0, 0.0, True), ("B", 2, 9.0, 0.0, True)]


def test_next_position_across_empty_chunks(spark, rows):
    df = spark.createDataFrame([("u", "A", p) for p in (1, 2, 50, 51, 400)], "universe string, asset string, cell bigint")
    got = rows(grid.next_position(df, "cell", "nxt", chunk=16), "cell", "nxt")
    assert got == [(1, 2), (2, 50), (50, 51), (51, 400), (400, None)]


def test_continuity_and_alignment(spark, rows):
    df = spark.createDataFrame([("u", "A", 1), ("u", "A", 1), ("u", "A", 4), ("u", "B", 1), ("u", "B", 2)],
                               "universe string, asset string, cell bigint")
    assert rows(grid.continuity(df), "asset", "cell", "issue") == [("A", 1, "duplicate")]
    single = df.dropDuplicates()
    assert rows(grid.continuity(single), "asset", "cell", "missing") == [("A", 1, 2)]


@pytest.mark.parametrize("n, k", [(5, 8), (8, 8), (9, 8), (300, 8), (17, 3), (1000, 2)])
def test_evenly_spaced(spark, n, k):
    df = spark.range(n).withColumn("g", F.lit(1))
    got = sorted(r.id for r in evenly_spaced(df, ["g"], ["id"], k).collect())
    want = list(range(n)) if n <= k else sorted({i * (n - 1) // (k - 1) for i in range(k)})
    assert got == want


@pytest.mark.parametrize("chunk", [40, 4096])
def test_market_windows_are_slices(spark, chunk):
    n, look, ahead = 130, 20, 5
    df = spark.createDataFrame([("u", a, i, float(i + k)) for k, a in ((0, "A"), (1000, "B")) for i in range(n)],
                               "universe string, asset string, idx bigint, close double")
    origins = spark.createDataFrame([("u", t) for t in (3, 19, 39, 40, 41, 79, 124, 125, 129)], "universe string, t0 bigint")
    for r in market_windows(origins, df, look, ahead, chunk).collect():
        base = 0 if r.asset == "A" else 1000
        assert r.hist == [float(i + base) for i in range(max(0, r.t0 - look + 1), r.t0 + 1)]
        full = r.t0 + ahead < n
        assert r.fut == ([float(r.t0 + j + base) for j in range(1, ahead + 1)] if full else [])
        assert r.status == ("no_history" if r.t0 < look - 1 else "ready" if full else "pending_truth")


@pytest.mark.parametrize(("chunk", "stride", "length"), [(16, 3, 70), (8, 5, 41), (64, 4, 200), (16, 20, 15), (16, 3, 9), (16, 3, 0)])
def test_rolling_windows_need_no_plan(spark, chunk, stride, length):
    look, ahead = 7, 4
    rows = [("u", a, i, float(i + 1000 * k)) for k, a in enumerate("AB") for i in range(length)] + [("v", "C", i, float(i)) for i in range(33)]
    bars = spark.createDataFrame(rows, "universe string, asset string, idx bigint, close double")
    spans = bars.groupBy("universe").agg((F.max("idx") + 1).alias("n"))
    planned = market_windows(rolling_origins(spans, stride, look, ahead), bars, look, ahead, chunk)
    got = rolling_windows(bars, stride, look, ahead, chunk).select(*planned.columns)
    assert sorted(got.collect()) == sorted(planned.collect())
    assert {r.status for r in got.collect()} <= {"ready"}
