"""Greedy "keep, then skip" rules over ordered positions, computed in parallel.

Both the cooldown (drop what follows a kept mark within 30 bars) and the event merge (an anchor
absorbs what follows within 10 bars) depend on the mark kept before, so they look sequential.
All that crosses a chunk border is how many bars at its start are still blocked: one of ``span``
values. Every chunk therefore tabulates its exit for each entry. Tables compose: BRANCH consecutive
chunks make one table, the few tables of a key are chained, and entries go down again, first to
groups, then to chunks, which finish on their own. No key is ever collected whole: arrays hold at
most ``chunk`` marks or BRANCH tables, the chain of a key one table per BRANCH chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1024
BRANCH = 128


def _advance(span: int):
    return lambda free, mark: F.when(mark >= free, mark + F.lit(span)).otherwise(free)


def _entries(tables: str, before: Column, blocked: Column) -> Column:
    """Entry of every table of a short ordered list, as structs of its number ``c`` and entry ``e``.

    ``before`` is the number of the last position ahead of the list, ``blocked`` what reaches over it.
    """
    state = "struct<c: bigint, off: bigint, seen: array<struct<c: bigint, e: bigint>>>"

    def chain(acc: Column, step: Column) -> Column:
        entry = F.when(acc["c"] + 1 == step["_c"], acc["off"]).otherwise(F.lit(0).cast("long"))
        return F.struct(
            step["_c"].alias("c"),
            F.element_at(step["_exit"], (entry + 1).cast("int")).alias("off"),
            F.concat(acc["seen"], F.array(F.struct(step["_c"].alias("c"), entry.alias("e"))))
            .alias("seen")).cast(state)

    return F.aggregate(tables, F.struct(before.alias("c"), blocked.alias("off"), F.expr(
        "cast(array() as array<struct<c: bigint, e: bigint>>)").alias("seen")).cast(state), chain, lambda acc: acc["seen"])


def assign_anchors(marks: DataFrame, keys: Sequence[str], span: int, idx: str = "idx",
                   payload: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """``keys, idx, anchor`` and the payload: the kept position that covers each position.

    A position is kept (``anchor = idx``) when it is at least ``span`` after the last kept one.
    With a payload, positions must be unique per key; without, repeats count once.
    """
    if span > chunk:
        raise ValueError("a chunk must be at least as long as the span")
    start = F.col("_c") * F.lit(chunk)
    cell = F.struct(F.col(idx).cast("long").alias("i"), *[F.col(p) for p in payload])
    gather = F.collect_list(cell) if payload else F.collect_set(cell)
    packed = (marks.withColumn("_c", F.floor(F.col(idx) / chunk).cast("long"))
              .groupBy(*keys, "_c").agg(F.array_sort(gather).alias("_m")))

    def leave(entry: Column) -> Column:
        free = F.aggregate("_m", start + entry, lambda acc, m: _advance(span)(acc, m["i"]))
        return F.greatest(free - start - F.lit(chunk), F.lit(0).cast("long"))

    tables = packed.select(*keys, "_c", F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(span - 1).cast("long")), leave).alias("_exit"))
    groups = (tables.withColumn("_g", F.floor(F.col("_c") / BRANCH).cast("long"))
              .groupBy(*keys, "_g").agg(F.array_sort(F.collect_list(F.struct("_c", "_exit"))).alias("_t")))
    head = F.col("_g") * F.lit(BRANCH) - 1

    def through(entry: Column) -> Column:
        """What a whole group leaves blocked behind it."""
        state = "struct<c: bigint, off: bigint>"

        def step(acc: Column, t: Column) -> Column:
            known = F.when(acc["c"] + 1 == t["_c"], acc["off"]).otherwise(F.lit(0).cast("long"))
            return F.struct(t["_c"].alias("c"), F.element_at(t["_exit"], (known + 1).cast("int")).alias("off")).cast(state)

        return F.aggregate("_t", F.struct(head.alias("c"), entry.alias("off")).cast(state), step, lambda acc: F.when(
            acc["c"] == head + BRANCH, acc["off"]).otherwise(F.lit(0).cast("long")))

    composed = groups.select(*keys, "_g", F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(span - 1).cast("long")), through).alias("_exit"))
    tops = (composed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_g").alias("_c"), "_exit"))).alias("_t"))
            .select(*keys, F.explode(_entries("_t", F.lit(-2).cast("long"), F.lit(0).cast("long"))).alias("_e"))
            .select(*keys, F.col("_e.c").alias("_g"), F.col("_e.e").alias("_in")))
    entries = (groups.join(tops, [*keys, "_g"])
               .select(*keys, F.explode(_entries("_t", head, F.col("_in"))).alias("_e"))
               .select(*keys, F.col("_e.c").alias("_c"), F.col("_e.e").alias("_entry")))
    walk = "struct<free: bigint, out: array<bigint>>"

    def place(acc: Column, mark: Column) -> Column:
        free = _advance(span)(acc["free"], mark["i"])
        return F.struct(free.alias("free"), F.concat(acc["out"], F.array(free - span))
                        .alias("out")).cast(walk)

    first = F.struct((start + F.col("_entry")).alias("free"),
                     F.expr("cast(array() as array<bigint>)").alias("out")).cast(walk)
    anchors = F.aggregate("_m", first, place, lambda acc: acc["out"])
    return (packed.join(entries, [*keys, "_c"])
            .withColumn("_a", anchors)
            .select(*keys, F.explode(F.arrays_zip(F.col("_m").alias("m"), F.col("_a").alias("a")))
                    .alias("_p"))
            .select(*keys, F.col("_p.m.i").alias(idx), *[F.col(f"_p.m.{p}") for p in payload],
                    F.col("_p.a").alias("anchor")))
