"""Quality classifier and posting-list search."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from helpers import DOCS, awkward, documents, prose

from shockwatch.llm import ann, quality

LABELS = "doc_id long, quality int, toxic int"


def junk(n: int, seed: int) -> str:
    rng = random.Random(seed)
    kind = seed % 3
    words = [rng.choice(prose(30, seed).split()) for _ in range(n)]
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w + "###" for w in words) if kind == 1 else " ".join([words[0]] * n)


def labelled(spark, n: int = 400):
    rows = [(i, prose(60, i) if i % 4 else junk(60, i)) for i in range(n)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(n)]
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def passages_plain(text: str) -> list[tuple[int, int, int]]:
    """(words, distinct words, bytes) per passage by a plain loop."""
    data, out, at = text.encode(), {}, 0
    for word in data.split():
        at = data.index(word, at)
        out.setdefault(at // quality.PASSAGE, []).append(word)
        at += len(word)
    return [(len(w), len(set(w)), sum(map(len, w))) for _, w in sorted(out.items())]


def test_passages_equal_a_plain_loop():
    texts = ["", "one", prose(300, 1), " \n ", junk(200, 3), "é " * 400, prose(5, 2)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    rows, owner = quality.passages(data, bounds)
    for i, text in enumerate(texts):
        mine, want = rows[owner == i], passages_plain(text) or [(0, 0, 0)]
        assert len(mine) == len(want)
        for row, (n, distinct, _) in zip(mine, want):
            assert row[0] == pytest.approx(np.log1p(max(n, 1)) / 5 if n else 0, rel=1e-5)
            assert row[11] == pytest.approx(distinct / max(n, 1), rel=1e-5)


def test_training_rows_keep_all_passages_within_the_bounds(spark, monkeypatch):
    texts = {i: prose(40 + 20 * i, i) for i in range(1, 30)} | {100: prose(40_000, 9)}
    chosen = {i for i in texts if zlib.crc32(str(i).encode()) % 5}
    want = {i: len(passages_plain(texts[i])) for i in chosen}
    bags = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, found, labels: bags.append([len(b) for b in found]) or self)
    docs, labels = documents(spark, list(texts.items())), spark.createDataFrame([(i, i % 2, 0) for i in texts], LABELS)
    quality.train(docs, labels)
    assert sorted(bags[-1]) == sorted(want.values())
    assert (100 in chosen) == (max(bags[-1]) > 64)
    row = quality.FEATURES * 4
    quality.train(docs, labels, most_bytes=16 * row * 3)  # rows of at most three passages, 48 passages in all
    assert 0 < sum(bags[-1]) <= 48 and max(bags[-1]) <= 3
    quality.train(docs, labels, most=5)
    assert len(bags[-1]) == 5


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 5, 2)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    model = quality.Model().fit(bags, labels)

    def loss() -> float:
        total = 0.0
        for bag, y in zip(bags, labels):
            h, _, _, a = model.encode(bag)
            share = np.exp(a - a.max())
            p = 1 / (1 + np.exp(-(share @ h / share.sum() @ model.weights["c"] + model.weights["d"])))
            total -= np.log(p if y else 1 - p)
        return total / len(bags)

    for k, g in model.gradients(bags, labels).items():
        w = model.weights[k]
        at = tuple(np.unravel_index(np.abs(g).argmax(), g.shape)) if g.ndim else ()
        step = np.zeros_like(w)
        step[at] = 1e-6
        model.weights[k] = w + step
        up = loss()
        model.weights[k] = w - step
        down = loss()
        model.weights[k] = w
        assert (up - down) / 2e-6 == pytest.approx(float(np.asarray(g)[at]), rel=1e-3, abs=1e-6)


def test_held_out_accuracy_and_folds(spark):
    docs, labels = labelled(spark)
    rows = quality.report(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    fresh = [r for r in rows if r.held_out]
    assert len(fresh) > 50 and sum(r.predicted == int(r.doc_id % 4 != 0) for r in fresh) >= 0.97 * len(fresh)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_labels_do_not_reach_the_model(spark):
    docs, labels = labelled(spark)
    flipped = labels.selectExpr(
        "doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality", "toxic")
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_long_text_is_read_to_its_end_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(3, quality.FEATURES)).astype(np.float32) + y for y in (0, 1) for _ in range(20)]
    model = quality.Model().fit(bags, np.repeat([0.0, 1.0], 20))
    text = " ".join(prose(500, s) for s in range(20))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = model.scores(data, np.array([0, len(data)]))
    monkeypatch.setattr(quality, "BLOCK", 4096)
    parts = model.scores(data, np.array([0, len(data)]))
    assert abs(parts[0] - whole[0]) < 0.05  # passages may start elsewhere after a cut
    changed = np.frombuffer((text + junk(3000, 1)).encode(), np.uint8)
    assert model.scores(changed, np.array([0, len(changed)]))[0] != parts[0]


def test_short_texts_are_scored_in_small_runs():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(3, quality.FEATURES)).astype(np.float32) + y for y in (0, 1) for _ in range(20)]
    model = quality.Model().fit(bags, np.repeat([0.0, 1.0], 20))
    texts = [prose(400, s) for s in range(150)] + [prose(30_000, 7), ""] + [junk(50, s) for s in range(50)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    runs = [(len(part), len(inner) - 1) for part, inner, _ in quality.blocks(data, bounds)]
    assert len(data) > 3 << 17 and sum(n for _, n in runs) == len(texts)  # no text is cut
    assert max(size for size, n in runs if n > 1) <= 1 << 17
    alone = [model.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert model.scores(data, bounds) == pytest.approx(alone, abs=1e-12)


def test_rejecting_hands_every_text_over_once(spark, monkeypatch):
    docs, labels = labelled(spark, 60)
    handed, scored = [], quality.scored
    monkeypatch.setattr(quality, "scored", lambda df, *args: handed.append(df.columns) or scored(df, *args))
    with_null = docs.unionByName(spark.createDataFrame([(None, None, None, None, None)], DOCS))
    assert quality.keep_good(with_null, labels, 0.0).count() == 61 and handed == [docs.columns]


def test_awkward_rows_empty_tables_and_one_sided_labels(spark):
    docs, labels = labelled(spark)
    rows = quality.report(awkward(spark), labels).collect()
    assert len(rows) == awkward(spark).count() and all(r.score is not None for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 250 < kept.count() < 350
    extra = awkward(spark)
    assert quality.keep_good(extra, labels).schema == extra.schema
    empty = spark.createDataFrame([], DOCS)
    assert quality.report(empty, labels).count() == 0
    assert {r.score for r in quality.report(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    only = quality.report(docs, labels.filter("quality = 1")).collect()
    assert len({r.score for r in only}) == 1 and only[0].score > 0.9


VECTORS = "vec_id long, embedding array<float>, label int"


def nearest_brute(rows, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(
        v).all() and any(v) and len(v) == 8}
    out = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted((-float(good[q] @ x), i) for i, x in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(n: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 3
    share = rng.choice(6, n, p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05])
    x = (centres[share] + rng.normal(size=(n, 8))) * rng.uniform(0.5, 2, (n, 1))
    return [(i, x[i].astype(np.float32).tolist()) for i in range(n)]


def found(df):
    out: dict[int, list] = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_search_recall_scores_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 40)
    monkeypatch.setattr(ann, "BLOCK", 30)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rows = vectors(1500)
    got = found(ann.search(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), lambda c: c % 20 == 0))
    want, x = nearest_brute(rows, 20), dict(rows)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    for q, near in got.items():
        assert [(-s, i) for i, s in near] == sorted((-s, i) for i, s in near) and q not in {i for i, _ in near}
        for i, s in near:
            assert s == pytest.approx(float(np.array(x[q], np.float32).astype(float) @ np.array(x[i], np.float32)), abs=1e-9)


def test_search_awkward_vectors_and_few_candidates(spark):
    rows = [(0, [1.0] * 8), (20, [2.0] * 8), (1, None), (2, []), (3, [0.0] * 8), (4, [float("nan")] * 8), (5, [1.0] * 7),
            (6, [float("inf")] + [1.0] * 7), (7, [None] + [1.0] * 7), (8, [-1.0] * 8), (None, [1.0] * 8), (9, [2.0] * 8),
            (10, [2.0] * 8), (0, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).selectExpr("*", "1 as id", "2 as score", "3 as list")
    got = found(ann.search(df, lambda c: c % 20 == 0))
    assert got == {0: [(9, 16.0), (10, 16.0), (20, 16.0), (8, -8.0)], 20: [(9, 32.0), (10, 32.0), (0, 16.0), (8, -16.0)]}
    assert ann.search(spark.createDataFrame([], VECTORS), lambda c: c % 20 == 0).count() == 0


def test_query_blocks_are_not_broadcast_and_the_driver_gets_the_sample_only(spark, monkeypatch):
    """A query is in a block of every list it reads, so the blocks outgrow their estimate, the size of the queries."""
    x = np.array([v for _, v in vectors(600)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vec array<double>")
    most = np.sqrt((x**2).sum(1)).max()
    lists = ann.Lists(ann.lifted(x, most), 20)
    postings = spark.createDataFrame([], "list long, ids array<long>, vecs array<double>")
    plan = ann.nearest_in_lists(postings, df, lists, np.inf, 20, 8)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") <= plan.count("count(1)")  # lists counted, nothing else
    kept, store = [], ann.store
    monkeypatch.setattr(ann, "store", lambda rows, label: kept.append(store(rows, label)) or kept[-1])
    lowest = [r.id for r in df.orderBy(ann.F.xxhash64("id"), "id").limit(40).collect()]
    assert ann.sampled(df, 600, 40)["id"].tolist() == sorted(lowest) and kept[-1].count() == 40
    assert ann.sampled(df, 600, 590)["id"].nunique() == 590
    again = df.filter("id % 2 = 0").select((ann.F.col("id") * 0).alias("id"), "vec").limit(300)  # one id, 300 times
    assert len(ann.sampled(again.repartition(3), 300, 20)) == 20 and len(ann.sampled(again, 20_000, 200)) == 200


def test_lists_are_balanced_and_every_list_is_reachable():
    x = np.array([v for _, v in vectors(3000, 3)])
    most = np.sqrt((x**2).sum(1)).max()
    lists = ann.Lists(ann.lifted(x, most), 60)
    own = ann.distances(ann.lifted(x, most), lists.centres).argmin(1)
    sizes = np.bincount(own, minlength=len(lists.centres))
    assert sizes.max() <= 4 * 50 and len(lists.centres) >= 30
    query = np.append(x[0], 0.0)
    assert sorted(lists.search(query, 1e9)) == list(range(len(lists.centres)))
    d = ann.distances(query[None], lists.centres)[0]
    near = lists.search(query, 0.2)
    assert d.argmin() in near and all(d[j] <= 1.2 * d.min() + 1e-9 for j in near)
