"""Exact and near deduplication."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from helpers import DOCS, awkward, documents, prose
from pyspark.sql import functions as F

from shockwatch.llm import components, exact, simhash


def exact_brute(rows):
    groups: dict[str, list] = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_exact_report_equals_brute_force(spark):
    docs = awkward(spark)
    got = sorted((tuple(r) for r in exact.dedup_report(docs).collect()), key=str)
    assert got == exact_brute([(r.doc_id, r.text) for r in docs.collect()])


def test_exact_compares_content_behind_a_shared_digest(spark, monkeypatch):
    """With a digest that collides for every text, groups are still those of the texts."""
    monkeypatch.setattr(exact.F, "sha2", lambda column, bits: F.lit("same"))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.dedup_report(documents(spark, rows)).collect()}
    assert got == {1: (3, 2), 2: (5, 2), 3: (3, 2), 4: (4, 1), 5: (5, 2)}


def test_exact_dedup_keeps_one_row_of_each_text_and_all_columns(spark):
    docs = awkward(spark)
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(t for _, t in rows) == sorted({r.text or "" for r in docs.collect()})
    assert (2, "alpha beta gamma delta") in rows and (4, "") in rows


def test_exact_hot_group_and_empty_table(spark):
    hot = documents(spark, [(i, "copy") for i in range(3000)] + [(5000, "single")])
    assert [r.doc_id for r in exact.deduplicate(hot).orderBy("doc_id").collect()] == [2999, 5000]
    empty = spark.createDataFrame([], DOCS)
    assert exact.dedup_report(empty).count() == 0 and exact.deduplicate(empty).count() == 0


def fingerprint_brute(text: str) -> int:
    import xxhash
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def component_brute(codes: list[int], distance: int) -> list[int]:
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(codes, np.uint64)
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array[i + 1:]) <= distance) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def test_fingerprint_equals_definition(spark):
    docs = awkward(spark)
    got = sorted((str(r.doc_id), r.fingerprint) for r in simhash.report(docs).collect())
    assert got == sorted((str(r.doc_id), format(fingerprint_brute(r.text), "016x")) for r in docs.collect())


def test_fingerprint_blocks_of_a_long_text(monkeypatch):
    words = prose(500, 3).encode().lower().split()
    whole = simhash.fingerprint(words)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(words) == whole == fingerprint_brute(prose(500, 3))


def test_lowercase_and_words_follow_ascii_rules():
    text = "É A B\x0bC\x1cD"
    assert text.encode().lower().split() == ["É".encode(), "a b".encode(), b"c\x1cd"]


@pytest.mark.parametrize("leaf,fanout", [(32, 4), (1024, 16)])
def test_links_connect_exactly_what_brute_force_connects(spark, monkeypatch, leaf, fanout):
    """Random codes, chains of two-bit steps that cross leaves, and a dense ball around one code."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "FANOUT", fanout)
    rng = random.Random(5)
    codes = {rng.getrandbits(64) for _ in range(1500)} | {0, 2**64 - 1}
    for _ in range(60):
        code = rng.getrandbits(64)
        for _ in range(rng.randrange(2, 8)):
            codes.add(code)
            for bit in rng.sample(range(64), rng.choice((1, 2, 3))):
                code ^= 1 << bit
    ball = rng.getrandbits(64)
    codes |= {ball ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(0, 64, 3)}
    codes = sorted(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    found = {r.node: r.component for r in components.components(simhash.links(df, 2)).collect()}
    roots = component_brute(codes, 2)
    want: dict[int, set] = {}
    for code, r in zip(signed, roots):
        want.setdefault(r, set()).add(code)
    got: dict[int, set] = {}
    for code in signed:
        got.setdefault(found.get(code, code), set()).add(code)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_near_duplicates_component_is_the_smallest_id(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "FANOUT", 2)
    base = prose(400, 9)
    words = base.split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1:]) for i in (10, 200, 390)]
    docs = documents(spark, [(50 - i, t) for i, t in enumerate([base, base, *near])] + [
        (100 + i, prose(80, 100 + i)) for i in range(40)] + [(None, base), (None, None), (7, None)])
    rows = docs.collect()
    codes = [fingerprint_brute(r.text) for r in rows]
    roots = component_brute(codes, 2)
    least = {}
    for r, root in zip(rows, roots):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), least.get(root)) for r, root in zip(rows, roots))
    assert sorted((str(r.doc_id), r.component_id) for r in simhash.report(docs).collect()) == want


def test_keep_one_row_per_component(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids and None not in ids
    empty = spark.createDataFrame([], DOCS)
    assert simhash.report(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_component_without_ids_keeps_one_row(spark):
    text, other = prose(400, 3), prose(60, 4)
    rows = [(None, text), (None, text), (None, text + " end"), (None, other), (7, "some other words here"), (None, "some other words here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    for width in (1, 4):
        kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs.repartition(width), distance=64).collect()]
        assert kept == [(7, "some other words here")]
        apart = [(r.doc_id, r.text) for r in simhash.keep_one(docs.filter("doc_id is null").repartition(width), distance=0).collect()]
        assert len(apart) == len(set(apart)) and (None, other) in apart and (None, text) in apart
        alone = simhash.keep_one(docs.filter("doc_id is null").repartition(width), distance=64).collect()
        assert len(alone) == 1


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(2)
    names = rng.sample(range(10**9), 3000)
    edges = [(names[i], names[i + 1]) for i in range(1500)] + [(names[2000], names[i]) for i in range(2001, 2600)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    found = {r.node: r.component for r in components.components(df).collect()}
    assert {found[n] for n in names[:1501]} == {min(names[:1501])}
    assert {found[n] for n in names[2000:2600]} == {min(names[2000:2600])} and len(found) == 2101


def test_no_task_of_near_dedup_holds_two_python_workers(spark, monkeypatch):
    """Idle workers are taken in turn, so a second one per task keeps what later stages remember twice in memory."""
    plans: dict[str, str] = {}
    for module in (simhash, components):
        def store(df, label, write=module.store):
            plans[label] = df._jdf.queryExecution().executedPlan().toString()
            return write(df, label)
        monkeypatch.setattr(module, "store", store)
    kept = simhash.keep_one(documents(spark, [(i, prose(60, i // 2)) for i in range(40)])).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 40, 2))
    assert {"simhash-rows", "simhash-leaves", "simhash-pairs", "cc-links"} <= set(plans)
    assert {label: n for label, plan in plans.items() if (n := plan.count("MapInArrow")) > 1} == {}
    # tables of a few rows come without Python on the executors; simhash-rows reads the documents of this test
    assert [label for label, plan in plans.items() if "ExistingRDD" in plan] == ["simhash-rows"]
