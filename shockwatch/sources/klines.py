"""Exchange kline files and landed live rows."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import bar_reason
from ..schema import KLINE_COLUMNS

FILE_PATTERN = r"([A-Z0-9]+)USDT-1m-(\d{4}-\d{2})\.csv"
MINUTE_US = 60_000_000


def scan(spark: SparkSession, path: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """Lines of headerless 12-column CSV files, their cells, asset and month from the file path."""
    uri = F.col("_metadata.file_path")
    # the path comes as a URI, in which a plus stands for itself; most paths have nothing to decode
    name = F.when(F.contains(uri, F.lit("%")), F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))).otherwise(uri)
    lines = (spark.read.option("recursiveFileLookup", "true").text(path)
             .select("value", F.regexp_extract(name, pattern, 1).alias("asset"),
                     F.regexp_extract(name, pattern, 2).alias("month")))
    return cells(lines)


def cells(lines: DataFrame) -> DataFrame:
    """The text cells of ``value`` as kline columns, and ``fields``, how many the line really has.

    A line is split once, behind a generator: filters on the cells are not pushed below it, where
    every condition would split the line anew. An empty cell is null.
    """
    rest = [c for c in lines.columns if c != "value"]
    split = lines.select(*rest, F.explode(F.array(F.split("value", ",", -1))).alias("_c"))
    return split.select(*rest, F.size("_c").alias("fields"),
                        *[F.nullif(F.get("_c", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(KLINE_COLUMNS)])


def parse(rows: DataFrame, step_us: int = MINUTE_US, digits: tuple[int, ...] = (16,)) -> DataFrame:
    """Typed bars with ``reason``: wrong columns, malformed numbers, stamps off the grid, bad bars.

    A stamp has 16 digits (microseconds, or as ``digits`` says) and lies on a whole interval; the close stamp is the last
    microsecond of the same interval. ``ts`` is the bar end.
    """
    num = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("open", "high", "low", "close", "volume")}
    num["amount"] = F.expr("try_cast(quote_amount AS DOUBLE)")
    stamps = {c: F.expr(f"try_cast({c} AS BIGINT)") for c in ("open_us", "close_us")}
    # one struct behind a generator: the many conditions of the reason read it, and none converts a text again
    cells_of = F.struct("fields", F.coalesce(F.length("open_us"), F.lit(0)).alias("_digits"),
                        *[c.alias(k) for k, c in stamps.items()], *[c.alias(k) for k, c in num.items()])
    typed = rows.select("asset", "month", F.explode(F.array(cells_of)).alias("_t")).select("asset", "month", "_t.*")
    bad_stamp = ~F.col("_digits").isin(*digits) | F.col("open_us").isNull()
    reason = (F.when(F.col("fields") != len(KLINE_COLUMNS), "wrong_columns").when(bad_stamp, "bad_stamp")
              .when(F.pmod("open_us", F.lit(step_us)) != 0, "off_grid")
              .when(~F.col("close_us").eqNullSafe(F.col("open_us") + step_us - 1), "bad_close_stamp")
              .otherwise(bar_reason()))
    return (typed.withColumn("reason", reason)
            .withColumn("ts", F.timestamp_micros(F.col("open_us") + step_us)).drop("_digits", "fields", "close_us"))


def month_status(bars: DataFrame, bars_per_day: int = 1440, step_us: int = MINUTE_US) -> DataFrame:
    """Per (asset, month): is every slot of the calendar month there exactly once?"""
    start = F.to_timestamp(F.concat("month", F.lit("-01")))
    slot = (F.col("open_us") - F.unix_micros(start)) / step_us
    expected = F.dayofmonth(F.last_day(start)) * bars_per_day
    return (bars.filter("reason is null")
            .withColumn("_slot", slot).withColumn("_want", expected)
            .groupBy("asset", "month")
            .agg(F.count("*").alias("rows"), F.count_distinct("open_us").alias("distinct_rows"),
                 F.min("_slot").alias("first_slot"), F.max("_slot").alias("last_slot"),
                 F.max("_want").cast("long").alias("expected"))
            .withColumn("status", F.when(
                (F.col("rows") == F.col("expected")) & (F.col("distinct_rows") == F.col("expected"))
                & (F.col("first_slot") == 0) & (F.col("last_slot") == F.col("expected") - 1),
                "complete").otherwise("incomplete")))


LINES_PER_BATCH = 65_536


def _only_member(z: zipfile.ZipFile) -> str:
    """The name of the single CSV member, read through once in blocks: bad checksums and bytes show before any line is used."""
    names = [n for n in z.namelist() if not n.endswith("/")]
    if len(names) != 1 or not names[0].endswith(".csv"):
        raise ValueError(f"expected one CSV member, found {names}")
    with z.open(names[0]) as raw:
        while block := raw.read(1 << 20):
            block.decode("ascii")
    return names[0]


def unzip(files: DataFrame, lines_per_batch: int = LINES_PER_BATCH) -> DataFrame:
    """Lines of the single CSV member of each archive, ``path, member, value, error``.

    ``files`` has ``path`` and ``content`` as ``binaryFile`` gives them, from any store Spark reads. An
    archive is one asset-month and is opened inside the task that read it; its text is decoded in
    batches of lines and never held as a whole. A broken archive is one row with its error and gives
    no line, however late the fault is.
    """
    columns = ["path", "member", "value", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    name = _only_member(archive)
                except Exception as exc:  # noqa: BLE001 - a broken archive becomes a row
                    yield pd.DataFrame([(path, None, None, f"{type(exc).__name__}: {exc}")], columns=columns)
                    continue
                with archive, archive.open(name) as raw:
                    text = io.TextIOWrapper(raw, "ascii")
                    while lines := list(itertools.islice(text, lines_per_batch)):
                        yield pd.DataFrame({"path": path, "member": name, "value": [x.rstrip("\n") for x in lines], "error": None})
    return files.select("path", "content").mapInPandas(
        run, "path string, member string, value string, error string")


def from_lines(lines: DataFrame, pattern: str = FILE_PATTERN) -> DataFrame:
    """Kline cells of unzipped text lines, named by their archive member."""
    return cells(lines.filter("error is null").select(
        "value", F.regexp_extract("member", pattern, 1).alias("asset"),
        F.regexp_extract("member", pattern, 2).alias("month")))


def broken(lines: DataFrame) -> DataFrame:
    """Archives that could not be opened or hold other members than one CSV: ``path, error``."""
    return lines.filter("error is not null").select("path", "error")


def _polled(polls: DataFrame, fields: int, bar: Callable[[Column, Column], Column], step: int,
            closed: Callable[[Column], Column], last_open: bool = False) -> DataFrame:
    """Rows of landed polls with ``reason`` (null when good).

    ``bar`` turns the array of a row's texts and the number of its position into a struct with
    ``stamp`` (the interval's start), ``stamp_ok``, prices, volume and amount. A poll is used as a
    whole or not at all: the first faulty row gives its reason to all rows of the poll. A row that
    is still open is set aside without spoiling its poll.
    """
    rows = F.from_json("value", "array<array<string>>")
    typed = F.transform("_all", lambda r, i: F.struct(
        i.alias("pos"), F.size(r).alias("n"), bar(r, i).alias("b")))

    def fault(x: Column) -> Column:
        before = F.get("_rows", x["pos"] - 1)["b"]["stamp"]
        return (F.when(x["n"] != fields, "wrong_columns")
                .when(~F.coalesce(x["b"]["stamp_ok"], F.lit(False)), "bad_stamp")
                .when((x["pos"] > 0) & (x["b"]["stamp"] != before + step), "gap")
                .otherwise(bar_reason(lambda name: x["b"][name])))

    waits = lambda x: closed(x["b"]["stamp"]) == F.lit(False)
    if last_open:
        waits = lambda x: (x["pos"] == F.size("_rows") - 1) | (closed(x["b"]["stamp"]) == F.lit(False))
    judged = polls.withColumn("_all", rows).withColumn("_rows", typed).withColumn("_judged", F.transform(
        "_rows", lambda x: F.struct(x["b"].alias("b"), F.coalesce(waits(x), F.lit(False)).alias("waits"),
                                    fault(x).alias("fault"))))
    spoiled = F.get(F.filter("_judged", lambda x: ~x["waits"] & x["fault"].isNotNull()), F.lit(0))["fault"]
    judged = judged.withColumn("_spoiled", F.when(F.col("_all").isNull(), "unreadable").otherwise(spoiled))
    return (judged.withColumn("_j", F.explode_outer("_judged"))
            .withColumn("reason", F.coalesce("_spoiled", F.when(F.size("_judged") == 0, "empty_poll"),
                                             F.when(F.col("_j.waits"), "open_bar")))
            .drop("_all", "_rows", "_judged", "_spoiled"))


def _number(r: Column, i: int) -> Column:
    return F.get(r, F.lit(i)).try_cast("double")


def live_rows(polls: DataFrame, cutoff_ms: Column, step_ms: int = 60_000) -> DataFrame:
    """Bars of landed polls (``asset, value`` = JSON array of 12-cell kline arrays, in ms), with ``reason``.

    Good rows have a null reason; rows of a refused poll carry why, bars that end after the cutoff are
    ``open_bar``. No poll and no row is lost.
    """
    def bar(r: Column, _: Column) -> Column:
        start, end = (F.get(r, F.lit(i)).try_cast("bigint") for i in (0, 6))
        return F.struct(start.alias("stamp"), ((F.pmod(start, F.lit(step_ms)) == 0) & (end == start + step_ms - 1)).alias(
            "stamp_ok"), *[_number(r, i).alias(n) for i, n in enumerate(
                ("open", "high", "low", "close", "volume"), 1)], _number(r, 7).alias("amount"))

    end = F.col("_j.b.stamp") + step_ms
    return (_polled(polls.withColumn("_cut", cutoff_ms), 12, bar, step_ms, lambda stamp: stamp + step_ms <= F.col("_cut"))
            .select("*", "_j.b.*", end.alias("end_ms"), F.timestamp_millis(end).alias("ts"))
            .drop("_j", "_cut", "value", "stamp", "stamp_ok"))


def second_exchange(polls: DataFrame, closed_cutoff: Column, step_s: int = 60) -> DataFrame:
    """Bars of an exchange that appends its open bar, with ``reason``: the last row is never committed.

    Rows are ``[time_s, open, high, low, close, vwap, volume, count]``. The amount is an
    estimate, vwap times volume, and flagged as such.
    """
    def bar(r: Column, _: Column) -> Column:
        start = F.get(r, F.lit(0)).try_cast("double")
        return F.struct(start.cast("bigint").alias("stamp"), (start == F.floor(start)).alias("stamp_ok"),
                        *[_number(r, i).alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)],
                        _number(r, 6).alias("volume"), (_number(r, 5) * _number(r, 6)).alias("amount"))

    end = F.timestamp_seconds(F.col("_j.b.stamp") + step_s)
    cut = F.unix_timestamp(closed_cutoff)
    return (_polled(polls.withColumn("_cut", cut), 8, bar, step_s, lambda stamp: stamp + step_s <= F.col("_cut"), True)
            .select("*", "_j.b.*", end.alias("ts"), F.lit(True).alias("amount_is_estimate"))
            .drop("_j", "_cut", "value", "stamp", "stamp_ok"))
