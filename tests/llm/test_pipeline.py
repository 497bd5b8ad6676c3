"""The pipeline, stage by stage, on the smallest sample."""

from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as entry
from conftest import SF_SMALL

from shockwatch.llm import exact, packing, simhash
from shockwatch.llm.common import store, table


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
    assert {k.split("_")[0] for k in names if k.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_effect(spark):
    docs = table(spark, SF_SMALL, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, SF_SMALL, "labels").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = store(stage(spark, docs, SF_SMALL), "pipeline-test")
        seen.append((name, before, docs))
        if stage is not corpus_pipeline.packing_stage:
            assert docs.columns == before.columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for _, _, d in seen]
    good = {i for i, q in labels.items() if q}
    first = {r.doc_id for r in seen[0][1].collect()}
    assert len(good - ids[0]) <= 0.02 * len(good) and len({i for i, q in labels.items() if not q} & ids[0]) <= 3
    assert ids[0] < first
    texts = [r.text for r in seen[1][2].collect()]
    assert len(texts) == len(set(texts)) == seen[1][1].select("text").distinct().count()
    near = simhash.report(seen[2][1])
    assert ids[2] == {r.component_id for r in near.collect()} and seen[2][2].count() == len(ids[2])
    mixed = seen[3][2]
    assert mixed.count() > 0 and ids[3] <= ids[2]
    rows = seen[4][2].collect()
    assert sum(r.start == 0 for r in rows) == mixed.count()
    assert exact.dedup_report(seen[2][2]).filter("not kept").count() == 0
    filled = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-filled // 4096) + 2
    assert packing.Lengths({}).sorted == []


def test_run_matches_stages(spark):
    assert corpus_pipeline.run(spark, SF_SMALL).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
