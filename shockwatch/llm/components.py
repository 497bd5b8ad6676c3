"""Connected components over links, as rounds of joins and groupings.

Large-star and small-star rounds (every node is pointed at the smallest node known in its
neighbourhood) until nothing changes; each round is written to the shared folder, so a lost executor
repeats one round at most. Before the first round each partition replaces its links by a spanning
star of its local components, which leaves the components as they are and shortens the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

BATCH_LINKS = 1 << 18


def local_stars(links: DataFrame) -> DataFrame:
    """(u, v) links, u the smallest node of v's component among the links of the batch."""
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def stars() -> pa.RecordBatch:
            nodes = [x for x in parent if root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], pa.int64()),
                                               pa.array(nodes, pa.int64())], names=["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
            if len(parent) > BATCH_LINKS:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    return links.mapInArrow(contract, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for every node of the links (u, v longs)."""
    edges = store(local_stars(links.filter("u <> v")), "cc-links")
    before = None
    while True:
        # large star: neighbours above a node move to the least of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        # small star: a node and its smaller neighbours move to the least of them
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").select(
            F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v")).distinct()
        edges = store(small, "cc-round")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                         F.count_distinct("v")).first()
        if seen[:2] == before and seen[0] == seen[2]:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        before = seen[:2]
