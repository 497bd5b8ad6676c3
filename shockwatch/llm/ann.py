"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm
(0 for a query): the nearest vector is then the one with the largest product.

* Lists: k-means on a bounded sample (SAMPLE vectors, SAMPLE_BYTES at most), with lists that hold
  over twice their share split and small ones dissolved. Every vector goes to its nearest list and,
  if it lies near the boundary (within BOUNDARY times the nearest distance), to up to REPLICAS
  lists in all. Physically a list is a set of blocks of about BLOCK vectors, so a list a third of all
  vectors fall into is many small rows.
* Search: the centroids form a neighbour graph held in memory; a best-first walk finds the nearest
  centroid and then all that lie within (1 + ratio) times that distance, the lists to be read.
* The ratio is the smallest that reaches RECALL against brute force inside the sample, which is
  harder than the whole table: the more vectors, the nearer the neighbours.
* Queries meet the blocks of their lists in an equi-join of (query block, vector block); a task
  keeps the best of every query it sees and gives them once, and the best of all are ranked in SQL.
* Queries that found fewer than k read all lists.

Scores are inner products of the original vectors in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do those with another number of components than most; rows with a null id take no part;
of repeated ids each counts as one candidate with its best score; ties go to the smaller vec_id; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20
LIST, MOST_LISTS = 256, 4096
REPLICAS, BOUNDARY = 2, 1.1
BLOCK, QUERY_BLOCK = 512, 256
DEGREE = 16
RECALL, PROBES = 0.97, 256
RATIOS = (0.02, 0.04, 0.06, 0.09, 0.12, 0.15, 0.18, 0.22, 0.27, 0.35, 0.5, 0.8, np.inf)
FLUSH = 200_000
SEED = 11


def usable(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(id, vec) rows that take part, with vec as doubles, and their number of components."""
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).filter(
        "id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(vec, x -> x <> 0)")
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 0
    return rows.filter(F.size("vec") == dim), dim


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that brings all to norm ``most``."""
    return np.concatenate([x, np.sqrt(np.maximum(most**2 - (x**2).sum(1, keepdims=True), 0))], 1)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0))


class Lists:
    """Centroids with their neighbour graph: assignment of vectors, search for queries."""

    def __init__(self, sample: np.ndarray, wanted: int):
        rng = np.random.default_rng(SEED)
        share = max(1, len(sample) // max(1, wanted))
        centres = sample[rng.choice(len(sample), min(wanted, len(sample)), False)].copy()
        for turn in range(12):
            own = np.concatenate([distances(sample[i:i + 2048], centres).argmin(1) for i in range(0, len(sample), 2048)])
            sizes = np.bincount(own, minlength=len(centres))
            means = [sample[own == j].mean(0) for j in range(len(centres)) if sizes[j] > (share // 4 if turn < 11 else 0)]
            if turn < 9:  # balance: split what is over twice its share, along the widest direction
                for j in np.flatnonzero(sizes > 2 * share):
                    mine = sample[own == j]
                    axis = mine.var(0).argmax()
                    low = mine[:, axis] <= np.median(mine[:, axis])
                    if low.any() and not low.all():
                        means += [mine[low].mean(0), mine[~low].mean(0)]
            centres = np.stack(means) if means else centres[:1]
        self.centres = centres
        near = distances(centres, centres)
        self.start = int(distances(centres.mean(0)[None], centres).argmin())
        order = np.argsort(near, 1)[:, 1:DEGREE + 1]
        links: list[set[int]] = [set(row.tolist()) for row in order]
        for i, row in enumerate(order.tolist()):  # both ways, and a ring so that every list can be reached
            for j in row:
                links[j].add(i)
            links[i].add((i + 1) % len(links))
        self.links = [np.array(sorted(s), np.int64) for s in links]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) pairs: the nearest list, and near ones for boundary vectors."""
        d = distances(x, self.centres)
        n = min(REPLICAS, d.shape[1])
        nearest = np.argpartition(d, n - 1, 1)[:, :n]
        dist = np.take_along_axis(d, nearest, 1)
        row, col = np.nonzero(dist <= BOUNDARY * dist.min(1, keepdims=True))
        return row, nearest[row, col]

    def search(self, query: np.ndarray, ratio: float) -> list[int]:
        """Lists within (1 + ratio) of the nearest centroid, by a best-first walk over the graph."""
        if np.isinf(ratio):
            return list(range(len(self.centres)))

        def at(nodes: np.ndarray) -> np.ndarray:
            return np.sqrt(((self.centres[nodes] - query) ** 2).sum(1))

        first = float(at(np.array([self.start]))[0])
        seen, best, found, heap = {self.start}, first, {}, [(first, self.start)]
        while heap:
            d, node = heapq.heappop(heap)
            if d > (1 + ratio) * best and len(found) > 2 * DEGREE:
                break
            found[node] = d
            new = [j for j in self.links[node].tolist() if j not in seen]
            if new:
                seen.update(new)
                for dist, j in zip(at(np.array(new)).tolist(), new, strict=True):
                    best = min(best, dist)
                    heapq.heappush(heap, (dist, j))
        return [j for j, d in found.items() if d <= (1 + ratio) * best]

    def calibrate(self, sample: np.ndarray, raw: np.ndarray, k: int, recall: float) -> float:
        """The smallest of RATIOS that finds ``recall`` of the k nearest inside the sample."""
        if len(sample) <= k + 1:
            return float("inf")
        row, lists = self.assign(sample)
        held = np.zeros((len(sample), len(self.centres)), bool)
        held[row, lists] = True
        probes = np.random.default_rng(SEED).choice(len(sample), min(PROBES, len(sample)), False)
        products = raw[probes] @ raw.T
        products[np.arange(len(probes)), probes] = -np.inf
        true = np.argpartition(-products, k - 1, 1)[:, :k]
        queries = np.concatenate([raw[probes], np.zeros((len(probes), 1))], 1)
        for ratio in RATIOS:
            hit = [held[t][:, self.search(q, ratio)].any(1).mean() for q, t in zip(queries, true, strict=True)]
            if np.mean(hit) >= recall:
                return ratio
        return float("inf")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def packed(rows: DataFrame, key: str, per_block: int, ids: str, vectors: str) -> DataFrame:
    """Rows of (key, id, vec) as blocks: key, ids and the flattened vectors of about ``per_block``."""
    counts = rows.groupBy(key).agg(F.ceil(F.count("*") / per_block).cast("int").alias("_blocks"))
    split = rows.join(counts, key).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    return split.groupBy(key, "_block").agg(F.collect_list(F.struct("id", "vec")).alias("_rows")).select(
        key, F.col("_rows.id").alias(ids), F.flatten(F.col("_rows.vec")).alias(vectors))


def nearest_in_lists(postings: DataFrame, queries: DataFrame, lists: Lists, ratio: float, k: int, dim: int) -> DataFrame:
    """query_id, vec_id, score: the candidates of every query worth ranking."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"), dim)
            wide = np.concatenate([x, np.zeros((len(x), 1))], 1)
            for at in range(0, len(x), 64):
                found = [lists.search(q, ratio) for q in wide[at:at + 64]]
                row = np.repeat(np.arange(at, at + len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).astype(np.int64)), batch.column("id").take(pa.array(row)),
                     batch.column("vec").take(pa.array(row))], names=["list", "id", "vec"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def results() -> pa.RecordBatch:
            ids, scores = [v[0] for v in best.values()], [v[1] for v in best.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.fromiter(best, np.int64), [len(i) for i in ids])),
                 pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                ids, vecs, qids, qvecs = (batch.column(c)[row].values.to_numpy(zero_copy_only=False)
                                          for c in ("ids", "vecs", "qids", "qvecs"))
                scores = qvecs.reshape(-1, dim) @ vecs.reshape(-1, dim).T
                for q, line in zip(qids.tolist(), scores, strict=True):
                    known = best.get(q)
                    if known is not None and len(known[0]) >= k:
                        near = np.flatnonzero(line >= known[1][-1])
                        if not len(near):
                            continue
                        near_ids, near_scores = ids[near], line[near]
                    else:
                        near_ids, near_scores = ids, line
                    keep = near_ids != q
                    near_ids, near_scores = near_ids[keep], near_scores[keep]
                    if known is not None:
                        near_ids = np.concatenate([known[0], near_ids])
                        near_scores = np.concatenate([known[1], near_scores])
                    order = np.lexsort((near_ids, -near_scores))
                    near_ids, near_scores = near_ids[order], near_scores[order]
                    _, first = np.unique(near_ids, return_index=True)  # replicas
                    first = np.sort(first)[:k]
                    if len(first):
                        best[q] = (near_ids[first], near_scores[first])
                if len(best) > FLUSH:
                    yield results()
                    best.clear()
        if best:
            yield results()

    asked = queries.mapInArrow(probe, "list long, id long, vec array<double>")
    blocks = packed(asked, "list", QUERY_BLOCK, "qids", "qvecs")
    # The blocks hold a query once for every list it reads, but Spark sizes them as the queries: left to it, it broadcasts them.
    return postings.hint("merge").join(blocks, "list").mapInArrow(scan, "query_id long, vec_id long, score double")


def sampled(rows: DataFrame, n: int, take: int) -> pd.DataFrame:
    """The ``take`` of the ``n`` rows whose ids hash lowest, by id.

    Only rows under a hash that somewhat more are under leave their tasks, and the choice is stored
    before it is fetched, else the driver gets ``take`` rows of every task.
    """
    share = min(1.0, (1.2 * take + 1000) / n)
    few = rows.filter(F.xxhash64("id") < int(share * 2.0**64) - 2**63) if share < 1 else rows
    for some in (few, rows):  # repeated ids may leave too few
        picked = store(some.orderBy(F.xxhash64("id"), "id").limit(take), "ann-sample").toPandas()
        if len(picked) >= min(take, n):
            break
    return picked.sort_values("id")


def search(table: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``is_query`` holds.

    ``is_query`` maps the id column to a condition.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = table.sparkSession
    rows, dim = usable(table, id_column, vector)
    rows = store(rows, "ann-rows")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    n, most = rows.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], schema)
    take = min(SAMPLE, max(k + 2, SAMPLE_BYTES // (8 * dim)))
    raw = np.stack(sampled(rows, n, take)["vec"].to_list())  # bounded by SAMPLE and SAMPLE_BYTES
    sample = lifted(raw, most)
    lists = Lists(sample, min(MOST_LISTS, max(1, n // LIST), max(1, len(sample) // 8)))
    ratio = lists.calibrate(sample, raw, k, RECALL)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, found = lists.assign(lifted(matrix(part.column("vec"), dim), most))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), part.column("id").take(row),
                                                  part.column("vec").take(row)], names=["list", "id", "vec"])

    postings = store(packed(rows.mapInArrow(assign, "list long, id long, vec array<double>"), "list", BLOCK, "ids", "vecs"),
                     "ann-postings")
    queries = rows.filter(is_query(F.col("id"))).dropDuplicates(["id"])
    found = store(nearest_in_lists(postings, queries, lists, ratio, k, dim), "ann-found")
    short = queries.join(found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("_n")).filter(F.col("_n") >= k),
                         F.col("id") == F.col("query_id"), "left_anti").select("id", "vec")
    if not np.isinf(ratio) and not short.isEmpty():
        found = found.unionByName(store(nearest_in_lists(postings, short, lists, np.inf, k, dim), "ann-rest"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
