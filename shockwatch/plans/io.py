"""Sources and sinks, exercised on files that Spark writes from the bars of the tables."""

from __future__ import annotations

import io as _io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import comparison
from ..schema import KLINE_COLUMNS
from ..session import run_dir
from ..sources import artifacts, klines, sinks
from ..sources.tables import INTERVALS
from . import hub as H
from .core import rd
from .oracle import part, r, sql
from .registry import query

DIRS = r"asset=([^/]+)/month=([^/]+)/"
DIGITS = (15, 16)  # the sample's days begin before 2001-09-09, when stamps got their sixteenth digit


def _folder(h, label: str) -> str:
    return f"{run_dir(h.spark)}/{label}-{uuid.uuid4().hex}"


def _kline_columns(h, universe="events"):
    """Bars of a universe in the twelve-column archive layout, as text."""
    step = INTERVALS[universe] * 1_000_000
    bars = h.bars.filter(F.col("universe") == universe)
    start = (F.unix_micros("ts") - step).cast("string")
    text = lambda c: F.col(c).cast("string")
    return bars.select(
        start.alias("open_us"), text("open").alias("open"), text("high").alias("high"),
        text("low").alias("low"), text("close").alias("close"), text("volume").alias("volume"),
        (F.unix_micros("ts") - 1).cast("string").alias("close_us"), text("amount").alias("quote_amount"),
        F.lit("0").alias("trades"), F.lit("0").alias("taker_base"), F.lit("0").alias("taker_quote"),
        F.lit("0").alias("ignored"), "asset", "idx",
        F.date_format(F.timestamp_micros(F.unix_micros("ts") - step), "yyyy-MM").alias("month"))


def _kline_files(h, universe, faulty=False):
    """CSV files per asset and month; every 29th bar and its neighbours are damaged if ``faulty``."""
    rows, path = _kline_columns(h, universe), _folder(h, "klines")
    line = F.concat_ws(",", *KLINE_COLUMNS)
    if faulty:
        swap = lambda name, value: F.concat_ws(",", *[value if c == name else F.col(c) for c in KLINE_COLUMNS])
        line = (F.when(F.col("idx") % 29 == 0, F.concat(line, F.lit(",0")))
                .when(F.col("idx") % 29 == 1, F.concat_ws(",", *KLINE_COLUMNS[:5]))
                .when(F.col("idx") % 29 == 2, swap("open", F.lit("x")))
                .when(F.col("idx") % 29 == 3, swap("open_us", (F.col("open_us").cast("long") + 1).cast("string")))
                .when(F.col("idx") % 29 == 4, swap("close_us", F.col("open_us"))).otherwise(line))
    rows.select(line.alias("line"), "asset", "month").repartition("asset", "month").write.partitionBy(
        "asset", "month").text(path)
    return path


def _klines(h, faulty=False):
    """Parsed files of every universe."""
    out = None
    for universe, seconds in INTERVALS.items():
        rows = klines.parse(klines.scan(h.spark, _kline_files(h, universe, faulty), DIRS), seconds * 1_000_000, DIGITS)
        rows = rows.withColumn("universe", F.lit(universe))
        out = rows if out is None else out.unionByName(rows)
    return out


part("q_kl", """
 SELECT strftime(ts - CASE universe WHEN 'events' THEN INTERVAL 1 HOUR ELSE INTERVAL 1 DAY END, '%Y-%m') AS month, * FROM q_bars""")
REASON = "CASE WHEN (volume = 0) <> (amount = 0) THEN 'zero_volume_mismatch' ELSE 'valid' END"


@query("s1_kline_csv", sql(f"""
 SELECT universe, asset, month, CASE idx % 29 WHEN 0 THEN 'wrong_columns' WHEN 1 THEN 'wrong_columns' WHEN 2 THEN 'not_finite'
        WHEN 3 THEN 'off_grid' WHEN 4 THEN 'bad_close_stamp' ELSE {REASON} END AS reason, count(*) n,
        {r('sum(CASE WHEN idx % 29 > 4 THEN close END)', 4)} close_sum,
        {r('sum(CASE WHEN idx % 29 > 4 THEN amount END)', 2)} amount_sum FROM q_kl GROUP BY ALL"""))
def s1(h):
    """Files with long, short, non-numeric, off-grid and wrongly closed lines; each keeps its reason."""
    fine = F.col("reason").isNull() | (F.col("reason") == "zero_volume_mismatch")
    return _klines(h, True).groupBy("universe", "asset", "month", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(
        F.count("*").alias("n"), rd(F.sum(F.when(fine, F.col("close"))), 4).alias("close_sum"),
        rd(F.sum(F.when(fine, F.col("amount"))), 2).alias("amount_sum"))


@query("s2_month_status", sql("""
 SELECT universe, asset, month, count(*) AS rows, CAST(day(last_day(strptime(month, '%Y-%m'))) *
        CASE universe WHEN 'events' THEN 24 ELSE 1 END AS BIGINT) expected,
        CASE WHEN count(*) = day(last_day(strptime(month, '%Y-%m'))) * CASE universe WHEN 'events' THEN 24 ELSE 1 END
        THEN 'complete' ELSE 'incomplete' END status
 FROM q_kl WHERE (volume = 0) = (amount = 0) GROUP BY universe, asset, month"""))
def s2(h):
    """Strict month check of every universe."""
    out = None
    for universe, seconds in INTERVALS.items():
        bars = klines.parse(klines.scan(h.spark, _kline_files(h, universe), DIRS), seconds * 1_000_000, DIGITS)
        rows = klines.month_status(bars, 86400 // seconds, seconds * 1_000_000).withColumn("universe", F.lit(universe))
        out = rows if out is None else out.unionByName(rows)
    return out.select("universe", "asset", "month", "rows", "expected", "status")


def _archives(h, universe="events"):
    """One zip per asset-month (a group is one month of one asset), with its plain CSV text."""
    names = list(KLINE_COLUMNS)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        text = pdf.sort_values("open_us")[names].to_csv(index=False, header=False, lineterminator="\n")
        raw, name = _io.BytesIO(), f"{key[0].upper().replace(' ', '_')}USDT-1m-{key[1]}.csv"
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(name), text)
        return pd.DataFrame([(f"/{name}.zip", raw.getvalue(), text.encode())],
                            columns=["path", "content", "csv"])
    return _kline_columns(h, universe).groupBy("asset", "month").applyInPandas(
        pack, "path string, content binary, csv binary")


@query("s3_zip_archives", sql(f"""
 WITH a AS (SELECT universe, asset, month, count(*) n, sum(close) s, CAST(month[6:7] AS INT) % 4 = 0 broken
            FROM q_kl GROUP BY universe, asset, month)
 SELECT universe, month, broken, CASE WHEN broken THEN 0 ELSE sum(n) END::BIGINT AS n, CASE WHEN broken THEN count(*) ELSE 0 END AS archives_refused,
        CASE WHEN broken THEN 0.0 ELSE {r('sum(s)', 3)} END close_sum FROM a GROUP BY universe, month, broken"""))
def s3(h):
    """Archives of every universe; those of each fourth month are cut short and must be reported."""
    out = None
    month = F.regexp_extract("path", r"(\d{4}-\d{2})", 1)
    for universe, seconds in INTERVALS.items():
        damaged = F.substring(month, 6, 2).cast("int") % 4 == 0
        files = _archives(h, universe).withColumn("content", F.when(
            damaged, F.expr("substring(content, 1, 40)")).otherwise(F.col("content")))
        lines = klines.unzip(files)
        good = klines.parse(klines.from_lines(lines, r"([^/]*)USDT-1m-(\d{4}-\d{2})\.csv"), seconds * 1_000_000, DIGITS).groupBy(
            "month").agg(F.lit(False).alias("broken"), F.count("*").alias("n"), F.lit(0).cast("long").alias("archives_refused"),
                         rd(F.sum("close"), 3).alias("close_sum"))
        lost = klines.broken(lines).groupBy(month.alias("month")).agg(
            F.lit(True).alias("broken"), F.lit(0).cast("long").alias("n"), F.count("*").alias("archives_refused"),
            F.lit(0.0).alias("close_sum"))
        rows = good.unionByName(lost).withColumn("universe", F.lit(universe))
        out = rows if out is None else out.unionByName(rows)
    return out


PROMISED = {"events": 720, "lineitem": 31, "orders": 31}


@query("s6_s7_file_verification", sql("""
 SELECT universe, replace(upper(asset), ' ', '_') || 'USDT-1m-' || month || '.csv' filename, CASE WHEN count(*) = CASE universe WHEN 'events'
        THEN 720 ELSE 31 END THEN 'verified' ELSE 'row_count_mismatch' END status FROM q_kl GROUP BY universe, asset, month"""))
def s6(h):
    """Hashes and lengths against a checksum list; the manifest promises the rows of a whole month."""
    out = None
    for universe, rows in PROMISED.items():
        files = _archives(h, universe).select(F.regexp_replace("path", "\\.zip$", "").alias("path"),
                                              F.col("csv").alias("content"))
        facts = artifacts.file_facts(files)
        lines = facts.select(F.concat("sha256", F.lit("  "), "filename").alias("value"))
        listed = artifacts.checksums(lines).join(facts.select("filename", "bytes"), "filename") \
            .withColumn("rows", F.lit(rows))
        found = artifacts.verify_files(facts, listed).select(F.lit(universe).alias("universe"), "filename", "status")
        out = found if out is None else out.unionByName(found)
    return out


BLOCK = 24
#: What is wrong with the polls of every seventh block, at its first bar (a gap: after its sixth).
FAULTS = {1: "wrong_columns", 2: "not_finite", 3: "gap", 4: "wrong_columns", 5: "bad_stamp", 6: "unreadable"}


def _polls(h, universe, row, stamp):
    """Landed polls of a universe: one JSON array of 24 bars per asset and block, some damaged.

    ``row`` is the array of a bar's texts, ``stamp`` the name of the cell that is moved off.
    """
    fault = (F.floor(F.col("idx") / BLOCK) % 7).cast("int")
    first = F.pmod(F.col("idx"), F.lit(BLOCK)) == 0
    size = F.size(row)
    texts = (F.when(first & (fault == 1), F.slice(row, 1, 3)).when(first & (fault == 4), F.concat(row, F.array(F.lit("0"))))
             .when(first & (fault == 2), F.concat(F.slice(row, 1, 1), F.array(F.lit("x")), F.slice(row, F.lit(3), size - 2)))
             .when(first & (fault == 5), F.concat(F.array(stamp), F.slice(row, F.lit(2), size - 1))).otherwise(row))
    bars = h.bars.filter((F.col("universe") == universe) & ~((fault == 3) & (F.pmod(F.col("idx"), F.lit(BLOCK)) == 5)))
    packed = (bars.groupBy("universe", "asset", F.floor(F.col("idx") / BLOCK).alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct("idx", texts.alias("v")))).alias("_rows")))
    text = F.to_json(F.transform("_rows", lambda x: x["v"]))
    return packed.select("universe", "asset", F.when(F.col("block") % 7 == 6, F.substring(text, 1, 25)).otherwise(
        text).alias("value"))


def _last_end(h, universe):
    """End of the last bar but one, in seconds: what the feed's own clock says is closed."""
    return h.bars.filter(F.col("universe") == universe).groupBy("universe").agg(
        (F.unix_timestamp(F.max("ts")) - INTERVALS[universe]).alias("_closed"))


part("q_poll", f"""
 SELECT *, count(*) OVER p size FROM (
  SELECT *, idx // {BLOCK} AS block, idx % {BLOCK} pos, (idx // {BLOCK}) % 7 fault, max(ts) OVER (PARTITION BY universe) top
  FROM q_bars) WHERE NOT (fault = 3 AND pos = 5) WINDOW p AS (PARTITION BY universe, asset, block)""")


def _poll_sql(open_rule, amount):
    """Rows of each outcome; a poll takes the reason of its first faulty row that is not open."""
    reason = ("CASE WHEN pos = 0 AND fault IN (1, 4) THEN 'wrong_columns' WHEN pos = 0 AND fault = 5 THEN 'bad_stamp' "
              "WHEN fault = 3 AND pos = 6 THEN 'gap' WHEN pos = 1 AND fault IN (1, 5) THEN 'gap' "
              "WHEN pos = 0 AND fault = 2 THEN 'not_finite' END")
    return sql(f"""
 WITH x AS (SELECT *, {open_rule} AS waits, {reason} bad FROM q_poll),
 y AS (SELECT *, arg_min(bad, pos) FILTER (bad IS NOT NULL AND NOT waits) OVER (PARTITION BY universe, asset, block) spoiled FROM x),
 z AS (SELECT universe, asset, block, close, {amount} amount, CASE WHEN fault = 6 THEN 'unreadable' WHEN spoiled IS NOT NULL THEN spoiled
       WHEN waits THEN 'open_bar' ELSE 'valid' END reason FROM y),
 u AS (SELECT universe, asset, block, reason, CASE WHEN any_value(reason) = 'unreadable' THEN 1 ELSE count(*) END n,
       sum(CASE WHEN reason = 'valid' THEN close END) c, sum(CASE WHEN reason = 'valid' THEN amount END) a FROM z GROUP BY ALL)
 SELECT universe, reason, CAST(sum(n) AS BIGINT) n, {r('sum(c)', 3)} close_sum, {r('sum(a)', 2)} amount_sum FROM u GROUP BY ALL""")


def _outcomes(rows):
    good = F.col("reason").isNull()
    return rows.groupBy("universe", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(
        F.count("*").alias("n"), rd(F.sum(F.when(good, F.col("close"))), 3).alias("close_sum"),
        rd(F.sum(F.when(good, F.col("amount"))), 2).alias("amount_sum"))


@query("s4_live_polls", _poll_sql("ts = top", "amount"))
def s4(h):
    """Polls with short, long, non-numeric, off-grid and missing rows and broken text, by outcome."""
    out = None
    for universe, seconds in INTERVALS.items():
        text = lambda c: c.cast("string")
        start = F.unix_millis("ts") - seconds * 1000
        row = F.array(text(start), *[text(F.col(c)) for c in ("open", "high", "low", "close", "volume")],
                      text(F.unix_millis("ts") - 1), text(F.col("amount")), *[F.lit("0")] * 4)
        polls = _polls(h, universe, row, text(start + 1)).join(_last_end(h, universe), "universe")
        rows = klines.live_rows(polls, F.col("_closed") * 1000, seconds * 1000)
        out = rows if out is None else out.unionByName(rows)
    return _outcomes(out)


@query("s5_second_exchange", _poll_sql(
    "ts = top OR pos = max(pos) OVER (PARTITION BY universe, asset, block)",
    "CASE WHEN volume > 0 THEN (amount / volume) * volume ELSE 0.0 END"))
def s5(h):
    """The same for the exchange whose last row is open; at zero volume its vwap is the close."""
    out = None
    for universe, seconds in INTERVALS.items():
        text = lambda c: c.cast("string")
        vwap = F.when(F.col("volume") > 0, F.col("amount") / F.col("volume")).otherwise(F.col("close"))
        start = F.unix_timestamp("ts") - seconds
        row = F.array(text(start), *[text(F.col(c)) for c in ("open", "high", "low", "close")], text(vwap),
                      text(F.col("volume")), F.lit("0"))
        polls = _polls(h, universe, row, text(start + F.lit(0.5))).join(_last_end(h, universe), "universe")
        rows = klines.second_exchange(polls, F.timestamp_seconds("_closed"), seconds)
        out = rows if out is None else out.unionByName(rows)
    return _outcomes(out)


@query("s8_forecast_artifacts", sql("""
 SELECT universe, CASE WHEN status = 'failed' THEN 'parse_error' ELSE status END status, count(*) n FROM q_art GROUP BY ALL"""))
def s8(h):
    """JSON artifacts in which failed attempts left broken text behind."""
    from .compare import _attempts
    path = _folder(h, "artifacts")
    body = F.to_json(F.struct("universe", "t0", "asset", "status"))
    broken = F.when(F.col("status") == "failed", F.substring(body, 1, 20)).otherwise(body)
    _attempts(h).select(broken.alias("value"), "universe").write.partitionBy("universe").text(path)
    rows = artifacts.scan_artifacts(h.spark, path, "t0 BIGINT, asset STRING, status STRING", False) \
        .withColumn("universe", F.regexp_extract("path", "universe=([^/]+)/", 1))
    status = F.when(F.col("parse_error").isNotNull(), "parse_error").otherwise(F.col("status"))
    return rows.groupBy("universe", status.alias("status")).agg(F.count("*").alias("n"))


@query("s9_prediction_stream", sql("""
 WITH p AS (SELECT universe, t0, count(*) n FROM q_art GROUP BY ALL)
 SELECT COALESCE(m.universe, p.universe) universe, COALESCE(m.t0, p.t0) t0, CASE WHEN m.t0 IS NULL THEN 'surplus'
        WHEN p.n IS NULL THEN 'missing' WHEN p.n > 1 THEN 'duplicate' ELSE 'matched' END status
 FROM q_man m FULL JOIN p ON p.universe = m.universe AND p.t0 = m.t0"""))
def s9(h):
    from .compare import _attempts, _manifest
    path = _folder(h, "stream")
    _attempts(h).select("universe", "t0", "asset", "status").write.json(path)
    got = h.spark.read.schema("universe STRING, t0 BIGINT, asset STRING, status STRING").json(path)
    return artifacts.align_stream(got, _manifest(h), ["universe", "t0"])


@query("s10_catalog_csv", sql(f"""
 SELECT universe, t0, origins, direction, {r('magnitude')} magnitude, CAST(systemic AS VARCHAR) systemic, eligible, reasons
 FROM q_events WHERE k = {H.STUDY_K}"""))
def s10(h):
    path = _folder(h, "catalog")
    sinks.write_catalog(h.events.filter(F.col("k") == H.STUDY_K), path)
    return sinks.read_catalog(h.spark, path).select(
        "universe", "t0", F.array_join("origins", "|").alias("origins"), "direction",
        rd("magnitude_sigma").alias("magnitude"), F.col("systemic_flag").cast("string").alias("systemic"),
        "eligible", F.array_join("reasons", "|").alias("reasons"))


@query("s11_write_once", sql("SELECT universe, method, metric, count(*) n, 1 AS refused FROM q_scores GROUP BY ALL"))
def s11(h):
    """A frozen result is written once; the same rows again are no second result, other rows are refused."""
    path = _folder(h, "frozen")
    sinks.write_once(h.scores, path)
    if sinks.write_once(h.scores, path):
        raise RuntimeError("a repeat of the same result was written")
    try:
        sinks.write_once(h.scores.unionByName(h.scores), path)
        refused = 0
    except sinks.ResultExists:
        refused = 1
    return h.spark.read.schema(h.scores.schema).parquet(path).groupBy("universe", "method", "metric").agg(
        F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query("s12_journal", sql("""
 SELECT universe, status, 2 * count(*) entries FROM q_led GROUP BY universe, status"""))
def s12(h):
    """The ledger appended by two jobs, one of them repeated: a journal keeps each job once."""
    from .compare import _attempts, _manifest
    path = _folder(h, "journal")
    rows = comparison.ledger(_manifest(h), _attempts(h), ["universe", "t0"])
    for job in ("first", "second", "first"):
        sinks.append_journal(rows, path, job)
    return sinks.read_journal(h.spark, path, rows.schema).groupBy("universe", "status").agg(
        F.count("*").alias("entries"))


@query("s13_report_views", sql(f"""
 SELECT e.universe, e.t0, e.origins, {r('e.magnitude')} magnitude, s.method, {r('s.mae')} mae, {r('s.recall')} recall
 FROM q_study e JOIN q_scores s USING (universe, t0) WHERE s.metric = 'volatility'"""))
def s13(h):
    """Report extracts published as views and joined in SQL."""
    radar, scores = sinks.publish_views({"radar": h.study, "scores": h.scores})
    return h.spark.sql(f"""
        SELECT e.universe, e.t0, array_join(e.origins, '|') AS origins, round(e.magnitude, 6) AS magnitude,
               s.method, round(s.mae, 6) AS mae, round(s.recall, 6) AS recall
        FROM {radar} e JOIN {scores} s USING (universe, t0) WHERE s.metric = 'volatility'""")
