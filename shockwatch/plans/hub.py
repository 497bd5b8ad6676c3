"""Tables that many analyses read: bars, triggers, events, windows, risk, scores.

Each is computed once per (application, input folder), written to the shared folder and read
back, so that a secondary analysis starts from the event level and not from ticks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import features, forecasts, grid, scoring, shocks, windows
from ..session import MAX_BROADCAST_ROWS, materialize
from ..sources import tables

STUDY_K = 3
MODEL = "mirror"
DAMPING = 0.8
METHODS = ("historical_30", "no_propagation", "driver_beta", MODEL)
ENSEMBLE_PATHS = 10
_stored: dict[tuple[str, str, str], DataFrame] = {}
_small: dict[tuple[str, str], bool] = {}


def clear() -> None:
    """Forget the stored tables (the benchmark does so before each query)."""
    _stored.clear()
    _small.clear()


class Hub:
    def __init__(self, spark: SparkSession, sf_dir: str):
        # Days, hours and periods are UTC whatever the session was started with.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._signature: str | None = None

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self._inputs(), name)
        if key not in _stored:
            _stored[key] = materialize(build(), name)
        return _stored[key]

    def _inputs(self) -> str:
        """The input folder with the sizes and times of its files: changed input is computed anew."""
        if self._signature is None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.sf_dir)
            found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
            files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)
            self._signature = f"{self.sf_dir} {files}"
        return self._signature

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, name)

    @property
    def ticks(self) -> DataFrame:
        return tables.ticks(self.spark, self.sf_dir)

    @property
    def cells(self) -> DataFrame:
        return self._once("cells", lambda: tables.cells(self.ticks))

    @property
    def extents(self) -> DataFrame:
        return self._once("extents", lambda: self.cells.groupBy("universe", "asset").agg(
            F.min("cell").alias("first"), F.max("cell").alias("last")))

    def _hint(self, df: DataFrame) -> DataFrame:
        """Spans and assets have at most one row per stored extent, which is counted once."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _small:
            _small[key] = self.extents.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
        return F.broadcast(df) if _small[key] else df

    @property
    def spans(self) -> DataFrame:
        return self._hint(grid.common_interval(self.extents))

    @property
    def assets(self) -> DataFrame:
        return self._hint(grid.ordered_assets(self.extents.select("universe", "asset")))

    def _bars(self) -> DataFrame:
        return tables.stamp(grid.densify(self.cells, self.spans))

    @property
    def bars(self) -> DataFrame:
        return self._once("bars", self._bars)

    @property
    def bars_once(self) -> DataFrame:
        """Bars for a plan that reads them once: not written just for that."""
        key = (self.spark.sparkContext.applicationId, self._inputs(), "bars")
        return _stored[key] if key in _stored else self._bars()

    @property
    def signal(self) -> DataFrame:
        return features.shock_signal(self.bars_once)

    @property
    def triggers(self) -> DataFrame:
        return self._once("triggers", lambda: shocks.triggers(self.signal))

    @property
    def events(self) -> DataFrame:
        return self._once("events", lambda: shocks.merge_events(self.triggers, self.spans))

    @property
    def study(self) -> DataFrame:
        """Eligible events of the study threshold, with their period, day and session."""
        return (self.events.filter((F.col("k") == STUDY_K) & F.col("eligible")).drop("k")
                .withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
                .withColumn("period", tables.period(F.col("universe"), F.col("ts"))))

    @property
    def study_triggers(self) -> DataFrame:
        return self.triggers.filter(F.col("k") == STUDY_K).drop("k")

    @property
    def windows(self) -> DataFrame:
        return self._once("windows", lambda: windows.market_windows(self.study, self.bars))

    @property
    def forecasts(self) -> DataFrame:
        """Baseline paths and the mirror model."""
        def build() -> DataFrame:
            base = forecasts.baseline_paths(self.windows, self.study, self.assets).drop("beta")
            return base.unionByName(mirror(self.windows))
        return self._once("forecasts", build)

    @property
    def actual(self) -> DataFrame:
        return self._once("actual", lambda: windows.truth_risk(self.windows, paths.libm_logs))

    @property
    def risk(self) -> DataFrame:
        return self._once("risk", lambda: forecasts.path_risk(self.forecasts).select(
            "universe", "t0", "asset", "method", "mdd", "vol"))

    @property
    def pairs(self) -> DataFrame:
        return self._once("pairs", lambda: scoring.metric_pairs(
            self.risk, self.actual, scoring.scored_universe(self.study, self.assets)))

    @property
    def scores(self) -> DataFrame:
        def build() -> DataFrame:
            usable = scoring.risk_table_status(self.risk, self.spans.select(
                "universe", "asset_count"), ["universe", "t0", "method"])
            return scoring.score_events(self.pairs, usable)
        return self._once("scores", build)

    @property
    def rolling_windows(self) -> DataFrame:
        return self._once("rolling_windows", lambda: windows.market_windows(
            windows.rolling_origins(self.spans), self.bars))

    @property
    def rolling(self) -> DataFrame:
        """One row per (origin, asset): past, realised and predicted volatility and drawdown."""
        def build() -> DataFrame:
            w = self.rolling_windows
            truth = windows.truth_risk(w).withColumnsRenamed({"mdd": "a_mdd", "vol": "a_vol"})
            model = forecasts.path_risk(mirror(w)).select(
                "universe", "t0", "asset", F.col("mdd").alias("m_mdd"), F.col("vol").alias("m_vol"),
                paths.terminal_return(F.col("spot"), F.col("closes")).alias("m_ret"))
            spot, r = F.element_at("hist", -1), paths.log_returns(F.col("hist"))
            past = F.slice("hist", -31, 31)
            stamps = self.bars.select("universe", "asset", F.col("idx").alias("t0"), "ts")
            return (w.select("universe", "t0", "asset", spot.alias("spot"),
                             (F.element_at("fut", -1) / spot - 1).alias("a_ret"),
                             (paths.std_pop(r) * F.sqrt(F.lit(30))).alias("vol255"),
                             (paths.std_pop(paths.log_returns(past)) * F.sqrt(F.lit(30)))
                             .alias("vol30"),
                             paths.max_drawdown(F.element_at(past, 1), F.slice(past, 2, 30))
                             .alias("mdd30"))
                    .join(model, ["universe", "t0", "asset"])
                    .join(truth, ["universe", "t0", "asset"])
                    .join(stamps, ["universe", "t0", "asset"])
                    .join(self.assets, ["universe", "asset"])
                    .withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
                    .withColumn("period", tables.period(F.col("universe"), F.col("ts"))))
        return self._once("rolling", build)


def mirror(windows_df: DataFrame) -> DataFrame:
    """Stand-in for a user model: the last 30 returns, damped, replayed in reverse order."""
    spot = F.element_at("hist", -1)
    recent = F.slice(paths.log_returns(F.col("hist")), -30, 30)
    return windows_df.filter("status <> 'no_history'").select(
        "universe", "t0", "asset", spot.alias("spot"), F.lit(MODEL).alias("method"),
        paths.replay(spot, F.transform(F.reverse(recent), lambda x: x * DAMPING)).alias("closes"),
        F.lit(None).cast("string").alias("error"))


def ensemble(windows_df: DataFrame, n_paths: int = ENSEMBLE_PATHS) -> DataFrame:
    """Ten paths per window: path p replays the 30 returns that end 3p bars before the origin."""
    spot, r = F.element_at("hist", -1), paths.log_returns(F.col("hist"))
    made = F.array(*[F.struct(F.lit(p).alias("path_id"), paths.replay(
        spot, F.slice(r, -(30 + 3 * p), 30)).alias("closes")) for p in range(n_paths)])
    return (windows_df.filter("status <> 'no_history'")
            .select("universe", "t0", "asset", spot.alias("spot"), F.explode(made).alias("_p"))
            .select("universe", "t0", "asset", "spot", "_p.*"))
