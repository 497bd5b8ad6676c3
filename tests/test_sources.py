"""Files in, rows or reasons out."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from shockwatch.sources import artifacts, klines, sinks
from shockwatch.streaming import runtime

START = 1_735_689_600_000_000


def csv_text(rows=3, bad=None):
    lines = [f"{START + i * 60_000_000},10,12,9,11,5,{START + (i + 1) * 60_000_000 - 1},55,1,0,0,0" for i in range(rows)]
    if bad:
        lines.append(bad)
    return "\n".join(lines) + "\n"


def test_kline_scan(spark, tmp_path):
    (tmp_path / "BTCUSDT-1m-2025-01.csv").write_text(csv_text(3, "12345,10,12,9,11,5,0,55,1,0,0,0"))
    (tmp_path / "ETHUSDT-1m-2025-01.csv").write_text(csv_text(2, f"{START},x,12,9,11,5,{START + 59_999_999},55,1,0,0,0"))
    bars = klines.parse(klines.scan(spark, str(tmp_path)))
    got = {(r.asset, r.reason): r.n for r in bars.groupBy("asset", "reason").agg(F.count("*").alias("n")).collect()}
    assert got == {("BTC", None): 3, ("BTC", "bad_stamp"): 1, ("ETH", None): 2, ("ETH", "not_finite"): 1}
    assert {r.status for r in klines.month_status(bars).collect()} == {"incomplete"}


def test_kline_columns_and_close_stamp(spark, tmp_path):
    good = csv_text(1).strip()
    lines = [good + ",13", ",".join(good.split(",")[:7]), good.replace(str(START + 59_999_999), str(START + 60_000_000)), ""]
    (tmp_path / "BTCUSDT-1m-2025-01.csv").write_text("\n".join(lines) + "\n")
    got = sorted(r.reason for r in klines.parse(klines.scan(spark, str(tmp_path))).collect())
    assert got == ["bad_close_stamp", "wrong_columns", "wrong_columns", "wrong_columns"]


def test_complete_month(spark, tmp_path):
    (tmp_path / "BTCUSDT-1m-2025-01.csv").write_text(csv_text(31 * 1440))
    row = klines.month_status(klines.parse(klines.scan(spark, str(tmp_path)))).first()
    assert (row.asset, row.month, row.rows, row.status) == ("BTC", "2025-01", 44640, "complete")


def test_zip_in_batches_of_lines(spark):
    def pack(text, kind=zipfile.ZIP_DEFLATED):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", kind) as z:
            z.writestr("BTCUSDT-1m-2025-01.csv", text)
        return bytearray(raw.getvalue())
    text = csv_text(5000)
    late = pack(text, zipfile.ZIP_STORED)
    late[late.rindex(b",55,1,0,0,0")] ^= 1  # the checksum no longer fits, in the last line
    files = spark.createDataFrame([("good", pack(text)), ("windows", pack(text.replace("\n", "\r\n"))), ("late", late),
                                   ("wide", pack(text + "\u00e9")), ("none", pack(""))], "path string, content binary")
    lines = klines.unzip(files, 700)
    got = {}
    for row in lines.collect():
        got.setdefault(row.path, []).append(row)
    for path in ("good", "windows"):
        assert [r.value for r in got[path]] == text.splitlines() and all(r.error is None for r in got[path])
    assert [r.error.split(":")[0] for r in got["late"] + got["wide"]] == ["BadZipFile", "UnicodeDecodeError"]
    assert "none" not in got  # an empty member has no lines
    counts = {r.reason: r["count"] for r in klines.parse(klines.from_lines(lines)).groupBy("reason").count().collect()}
    assert counts == {None: 10_000}


def test_zip_members(spark):
    def pack(names):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for n in names:
                z.writestr(n, csv_text(2))
        return bytearray(raw.getvalue())
    files = spark.createDataFrame([("a", pack(["BTCUSDT-1m-2025-01.csv"])), ("b", pack(["x.csv", "y.csv"])), ("c", bytearray(b"junk"))],
                                  "path string, content binary")
    lines = klines.unzip(files)
    assert sorted(r.path for r in klines.broken(lines).collect()) == ["b", "c"]
    bars = klines.parse(klines.from_lines(lines))
    assert [(r.asset, r.month, r.reason) for r in bars.collect()] == [("BTC", "2025-01", None)] * 2


def test_file_verification(spark, tmp_path):
    (tmp_path / "data").mkdir()
    facts = []
    for name, text in (("a.csv", "1\n2\n"), ("b.csv", "1\n"), ("c.csv", "zz\n"), ("d.csv", "0\n")):
        (tmp_path / "data" / name).write_text(text)
        facts.append({"asset": name[0], "filename": name, "sha256": hashlib.sha256(text.encode()).hexdigest(),
                      "bytes": len(text), "rows": text.count("\n")})
    facts[1]["sha256"] = "0" * 64
    facts[2]["rows"] = 9
    facts[3]["filename"] = "gone.csv"
    (tmp_path / "manifest.json").write_text(json.dumps({"month": "2025-01", "status": "verified", "results": facts}))
    man = artifacts.manifest(spark, str(tmp_path / "manifest.json"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "data"))
    got = {r.filename: r.status for r in artifacts.verify_files(artifacts.file_facts(files), man).collect()}
    assert got == {"a.csv": "verified", "b.csv": "hash_mismatch", "c.csv": "row_count_mismatch",
                   "d.csv": "unlisted", "gone.csv": "missing"}


def test_checksum_lines(spark):
    df = spark.createDataFrame([("a" * 64 + "  x.zip",), ("nonsense",)], "value string")
    assert [(r.filename, r.sha256) for r in artifacts.checksums(df).collect()] == [("x.zip", "a" * 64)]


def test_unreadable_artifacts_stay(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"task_id": "t1",\n "status": "scored"}')
    (tmp_path / "bad.json").write_text('{"task_id": ')
    rows = artifacts.scan_artifacts(spark, str(tmp_path), "task_id STRING, status STRING").collect()
    assert sorted((r.task_id or "", r.parse_error is None) for r in rows) == [("", False), ("t1", True)]


def live_row(minute, **changes):
    row = [str(60_000 * minute), "1", "2", "1", "2", "3", str(60_000 * minute + 59_999), "6", "1", "0", "0", "0"]
    for at, value in changes.items():
        row[int(at[1:])] = value
    return row


def outcomes(polls_rows):
    return sorted(((r.asset, r.reason, r.end_ms) for r in polls_rows.collect()), key=str)


def test_live_polls_keep_every_row_and_reason(spark):
    polls = {
        "GOOD": [live_row(0), live_row(1), live_row(2)], "SHORT": [live_row(0), live_row(1)[:3]],
        "LONG": [live_row(0) + ["0"]], "TEXT": [live_row(0, c1="x"), live_row(1)], "GAP": [live_row(0), live_row(2)],
        "OFF": [live_row(0, c0="1")], "NAN": [live_row(0, c2="NaN")], "WICK": [live_row(0, c4="5")], "EMPTY": []}
    df = spark.createDataFrame([(a, json.dumps(v)) for a, v in polls.items()] + [("JUNK", "[[1, "), ("NULL", None)],
                               "asset string, value string")
    got = outcomes(klines.live_rows(df, F.lit(180_000)))
    assert {g for g in got if g[0] == "GOOD"} == {("GOOD", None, 60_000 * i) for i in (1, 2, 3)}
    reasons = {a: {r for x, r, _ in got if x == a} for a in {g[0] for g in got}}
    assert reasons == {"GOOD": {None}, "SHORT": {"wrong_columns"}, "LONG": {"wrong_columns"}, "TEXT": {"not_finite"},
                       "GAP": {"gap"}, "OFF": {"bad_stamp"}, "NAN": {"not_finite"}, "WICK": {"ohlc_containment"},
                       "EMPTY": {"empty_poll"}, "JUNK": {"unreadable"}, "NULL": {"unreadable"}}
    late = outcomes(klines.live_rows(df.filter("asset = 'GOOD'"), F.lit(120_000)))
    assert {e: r for _, r, e in late} == {60_000: None, 120_000: None, 180_000: "open_bar"}


def test_second_exchange_sets_its_open_bar_aside(spark):
    def row(t, **changes):
        out = [t, "1", "2", "1", "2", "1.5", "4", 3]
        for at, value in changes.items():
            out[int(at[1:])] = value
        return out
    polls = {"GOOD": [row(0), row(60), row(120)], "GAP": [row(0), row(180), row(240)], "HALF": [row(0.5), row(60)],
             "SEVEN": [row(0)[:7], row(60)], "NULLS": [row(0, c1=None), row(60)], "ONE": [row(0)]}
    df = spark.createDataFrame([(a, json.dumps(v)) for a, v in polls.items()], "asset string, value string")
    rows = klines.second_exchange(df, F.timestamp_seconds(F.lit(600)))
    got = {a: [r.reason for r in rows.filter(F.col("asset") == a).orderBy("ts").collect()] for a in polls}
    assert got == {"GOOD": [None, None, "open_bar"], "GAP": ["gap"] * 3, "HALF": ["bad_stamp"] * 2,
                   "SEVEN": ["wrong_columns"] * 2, "NULLS": ["not_finite"] * 2, "ONE": ["open_bar"]}
    good = rows.filter("asset = 'GOOD' and reason is null").first()
    assert good.amount == 6.0 and good.amount_is_estimate


def test_write_once_and_catalog(spark, tmp_path):
    ev = spark.createDataFrame([("u", 5, ["A", "B"], 0, 7.5, None, False, ["incomplete_future_30"]), ("u", 9, ["A"], 1, 6.5, True, True, [])],
                               "universe string, t0 bigint, origins array<string>, direction int, magnitude double, "
                               "systemic boolean, eligible boolean, reasons array<string>")
    path = str(tmp_path / "catalog")
    sinks.write_catalog(ev, path)
    back = sinks.read_catalog(spark, path).orderBy("t0").collect()
    assert back[0].origins == ["A", "B"] and back[0].systemic_flag is None and back[1].reasons == []
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(ev, path)


def test_repeated_jobs_write_once(spark, tmp_path):
    path = str(tmp_path / "frozen")
    rows = spark.createDataFrame([(1, "a", None), (2, None, 0.5), (2, None, 0.5)], "t0 bigint, m string, v double")
    assert sinks.write_once(rows, path) and not sinks.write_once(rows.repartition(3), path)
    with pytest.raises(sinks.ResultExists):
        sinks.write_once(rows.distinct(), path)
    with pytest.raises(sinks.ResultExists):
        sinks.write_once(rows.withColumnRenamed("v", "w"), path)
    with pytest.raises(sinks.ResultExists):
        sinks.write_once(rows.withColumn("more", F.lit(1)), path)
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "frozen" / "_SUCCESS").unlink()  # a job that died before its commit
    assert sinks.write_once(rows.limit(1), path) and spark.read.parquet(path).count() == 1


def test_journal_holds_every_entry_once(spark, tmp_path):
    path, schema = str(tmp_path / "journal"), "t0 bigint, status string"
    first = spark.createDataFrame([(1, "ok"), (2, "failed")], schema)
    assert sinks.append_journal(first, path, "run/1") and not sinks.append_journal(first, path, "run/1")
    assert sinks.append_journal(first, path, "run/2")
    assert sinks.read_journal(spark, path, schema).count() == 4
    (tmp_path / "journal" / "entry=run%2F2" / "_SUCCESS").unlink()
    assert sinks.read_journal(spark, path, schema).count() == 2
    assert sinks.append_journal(first.limit(1), path, "run/2")
    assert sinks.read_journal(spark, path, schema).count() == 3


def test_prediction_stream_alignment(spark, rows):
    origins = spark.createDataFrame([(1,), (2,), (3,)], "t0 bigint")
    preds = spark.createDataFrame([(1,), (2,), (2,), (7,)], "t0 bigint")
    got = rows(artifacts.align_stream(preds, origins, ["t0"]), "t0", "status")
    assert got == [(1, "matched"), (2, "duplicate"), (3, "missing"), (7, "surplus")]


def test_cadence():
    assert runtime.cadence() == {"processingTime": "300 seconds"}
    with pytest.raises(ValueError):
        runtime.cadence(59)
