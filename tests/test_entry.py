"""The driver contract, and plans that must keep their shape."""

from __future__ import annotations

import __spark_entry__ as entry
from conftest import SF_SMALL

from shockwatch.plans.hub import Hub
from shockwatch.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["universe", "idx", "asset", "rnk", "vol30", "mdd30", "ret30", "grp", "cutoff_tied"]
    assert df.filter("rnk <= 3").count() > 1000


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_tick_aggregation_is_hashed_and_pruned(spark):
    text = plan(tables.cells(tables.ticks(spark, SF_SMALL)))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,0.0)]" in text
    assert "props" not in text and "l_discount" not in text


def test_signal_needs_one_bar_shuffle(spark):
    hub = Hub(spark, SF_SMALL)
    bars = hub.bars
    from shockwatch.operators import features
    text = plan(features.shock_signal(bars))
    assert text.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_normalised_paths_of_every_method(spark):
    rows = entry.queries()["f28_normalised_paths_by_method"](spark, SF_SMALL).groupBy("method").count().collect()
    found = {r.method: r["count"] for r in rows}
    whole = entry.queries()["f28_normalised_paths"](spark, SF_SMALL).groupBy("method").count().collect()
    assert len(found) == 4 and len(set(found.values())) == 1 and "historical_30" in found
    assert {r.method: r["count"] for r in whole} == found


def test_volume_ratios_have_values(spark):
    """A context of 120 hourly or daily bars left no control, so every ratio was null."""
    found = entry.queries()["a34_volume_ratio"](spark, SF_SMALL.replace("sf0.001", "sf0.01"))
    assert found.filter("log_ratio is not null").count() > found.count() // 2
