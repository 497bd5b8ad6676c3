"""Near duplicates by SimHash, linked through a Gray-order hierarchical index.

Fingerprints: the majority of the XXH64 bits of all three-word shingles (fewer words: the whole
sequence; no word: zero). Equal fingerprints are one class. The classes are sorted by Gray rank
(range partitions) and cut into leaves of LEAF classes. A node keeps the bits its classes share as
(mask, pattern); FANOUT consecutive nodes form an upper node, up to a single root.

Linking walks the tree against itself. A pair of nodes carries the differences found so far and the
bits they were found on; going down adds only the bits newly shared by both children, and the whole
pair is dropped once more than ``distance`` differ. Each level is one join by parent. Leaf pairs
that survive are resolved in Arrow batches with two more such levels inside a leaf (groups of
GROUP classes, then classes), and give a spanning forest of their links, never all pairs.

Nothing of the index goes to the driver but one count per range partition.

Defined cases: a null text has no word; null ids belong to their class and are never its smallest
id (a component of null ids only has a null id); equal fingerprints of different texts and repeated
rows are one class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, store, text_of, without
from .components import components

WORDS = 3
LEAF, GROUP, FANOUT = 1024, 16, 16
CHUNK = 1 << 16


def fingerprint(words: list[bytes], size: int = WORDS) -> int:
    """The SimHash of a word sequence as an unsigned 64-bit number."""
    import xxhash
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):  # a long text goes through in blocks of shingles
        part = words[at:at + CHUNK + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False)) if len(words) >= size else [
            b" ".join(part)]
        hashes = np.array([digest(s, 42) for s in shingles], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, text_key (to find a row again) and fp, the fingerprint as a signed long."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # bytes.lower() and bytes.split() know A-Z and \x20 \x09-\x0D only, as wanted
            prints = np.array([fingerprint((t.as_buffer().to_pybytes() if t.is_valid else b"").lower().split(), size)
                               for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(prints.view(np.int64))],
                names=["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"),
                       text_of().alias("text")).mapInArrow(scan, "doc_id long, text_key long, fp long")


def gray_rank(code: Column) -> Column:
    """Position of a code in the Gray sequence, as a long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(2**63)))


def leaves(codes: DataFrame) -> DataFrame:
    """id, mask, pattern and codes (packed) of every leaf, numbered along the Gray order."""
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seq = np.zeros(0, np.int64), 0
        for batch in (*batches, None):
            if batch is not None:
                held = np.concatenate([held, batch.column("fp").to_numpy()])
            while len(held) >= LEAF or batch is None and len(held):
                leaf, held = held[:LEAF], held[LEAF:]
                mask, pattern = shared_bits(leaf[None, :])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition()], pa.int64()), pa.array([seq], pa.int64()), pa.array(mask), pa.array(pattern),
                     pa.array([leaf.tobytes()])], names=["part", "seq", "mask", "pattern", "codes"])
                seq += 1

    def partition() -> int:
        from pyspark import TaskContext
        return TaskContext.get().partitionId()

    spark = codes.sparkSession
    ranked = codes.select("fp", gray_rank(F.col("fp")).alias("_rank"))
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = store(ranked.repartitionByRange(width, "_rank").sortWithinPartitions("_rank").select("fp").mapInArrow(
        group, "part long, seq long, mask long, pattern long, codes binary"), "simhash-leaves")
    first, offsets = 0, []
    for row in cut.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row per partition
        offsets.append((row["part"], first))
        first += row["n"]
    table = rows_of(spark, offsets, "part", "first")
    return cut.join(F.broadcast(table), "part").select(
        (F.col("first") + F.col("seq")).alias("id"), "mask", "pattern", "codes")


def shared_bits(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits that agree along each row, and their values."""
    both, some = np.bitwise_and.reduce(rows, axis=1), np.bitwise_or.reduce(rows, axis=1)
    return ~(both ^ some), both


def upper(nodes: DataFrame) -> DataFrame:
    """The level above: FANOUT consecutive nodes share one parent."""
    return nodes.groupBy(F.floor(F.col("id") / FANOUT).cast("long").alias("id")).agg(
        F.expr("bit_and(mask & pattern)").alias("_one"), F.expr("bit_and(mask & ~pattern)").alias("_zero")).select(
        "id", F.col("_one").bitwiseOR(F.col("_zero")).alias("mask"), F.col("_one").alias("pattern"))


def descend(pairs: DataFrame, nodes: DataFrame, distance: int) -> DataFrame:
    """Children of surviving pairs, with the differences on newly shared bits added."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.floor(F.col("id") / FANOUT).cast("long").alias(name), F.col("id").alias(f"c{name}"),
                            F.col("mask").alias(f"m{name}"), F.col("pattern").alias(f"p{name}"))

    fresh = "ma & mb & ~seen"
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter("ca <= cb").filter(
        f"diff + bit_count((pa ^ pb) & {fresh}) <= {distance}")
    return joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"),
                         F.expr(f"diff + bit_count((pa ^ pb) & {fresh})").alias("diff"),
                         F.expr("seen | (ma & mb)").alias("seen"))


def leaf_links(a: np.ndarray, b: np.ndarray, distance: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes within the distance: group against group first, then code against code."""
    def groups(codes: np.ndarray) -> np.ndarray:
        short = -len(codes) % GROUP
        return np.concatenate([codes, np.repeat(codes[-1:], short)]).reshape(-1, GROUP)

    ga, gb = groups(a.view(np.uint64)), groups(b.view(np.uint64))  # numpy counts the bits of |x| for signed x
    (ma, pa_), (mb, pb) = shared_bits(ga), shared_bits(gb)
    near = np.bitwise_count((pa_[:, None] ^ pb[None, :]) & ma[:, None] & mb[None, :]) <= distance
    left, right = np.nonzero(np.triu(near) if same else near)
    for at in range(0, len(left), 4096):
        i, j = left[at:at + 4096], right[at:at + 4096]
        k, x, y = np.nonzero(np.bitwise_count(ga[i][:, :, None] ^ gb[j][:, None, :]) <= distance)
        u, v = i[k] * GROUP + x, j[k] * GROUP + y
        keep = (u < len(a)) & (v < len(b)) & ((u < v) if same else True)
        yield u[keep], v[keep]


def links(codes: DataFrame, distance: int = 2) -> DataFrame:
    """(u, v): links between different fingerprints that connect all within the distance."""
    spark = codes.sparkSession
    level = leaves(codes)
    stored = store(level, "simhash-tree")
    levels = [stored.drop("codes")]
    n = levels[0].count()
    while n > FANOUT:
        levels.append(store(upper(levels[-1]), "simhash-upper"))
        n = -(-n // FANOUT)
    pairs = rows_of(spark, [(0, 0, 0, 0)], "a", "b", "diff", "seen").withColumn("diff", F.col("diff").cast("int"))
    for nodes in reversed(levels):
        pairs = store(descend(pairs, nodes, distance), "simhash-pairs")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ca, cb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ca", "cb")), strict=True):
                left, right = np.frombuffer(ca, np.int64), np.frombuffer(cb, np.int64)
                names = left if a == b else np.concatenate([left, right])
                parent = np.arange(len(names))
                for us, vs in leaf_links(left, right, distance, a == b):
                    vs = vs if a == b else vs + len(left)
                    for x, y in zip(us.tolist(), vs.tolist(), strict=True):
                        while parent[x] != x:
                            parent[x] = x = parent[parent[x]]
                        while parent[y] != y:
                            parent[y] = y = parent[parent[y]]
                        parent[max(x, y)] = min(x, y)
                child = np.flatnonzero(parent != np.arange(len(names)))
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(names[parent[child]]), pa.array(names[child])],
                                                     names=["u", "v"])

    half = stored.select(F.col("id").alias("a"), F.col("codes").alias("ca"))
    other = stored.select(F.col("id").alias("b"), F.col("codes").alias("cb"))
    work = pairs.select("a", "b").join(half, "a").join(other, "b")
    # stored: read on in Python, its tasks would hold two workers each, which stay for the tasks that follow
    return store(work.mapInArrow(resolve, "u long, v long"), "simhash-links")


def near_duplicates(docs: DataFrame, distance: int = 2, size: int = WORDS, keyed: bool = False) -> DataFrame:
    """Every row: doc_id, text_key, fp, and component_id, the smallest doc_id reachable over links.

    With ``keyed`` also component_key, the smallest fingerprint of the component, known where all its ids are null.
    """
    rows = store(fingerprints(docs, size), "simhash-rows")
    classes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    grouped = components(links(classes.select("fp"), distance))
    linked = grouped.join(classes, F.col("node") == F.col("fp")).select("fp", "component", "least")
    found, given = ["component_id"], {"component_id": F.col("least")}
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    if keyed:
        least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.min("fp").alias("component_key"))
        found, given = [*found, "component_key"], given | {"component_key": F.col("fp")}
    ids = store(linked.join(least, "component").select("fp", *found), "simhash-components")
    named = store(classes.join(ids.withColumn("_in", F.lit(True)), "fp", "left").select(
        "fp", *[F.when(F.col("_in"), F.col(c)).otherwise(given[c]).alias(c) for c in found]),
        "simhash-named")  # stored, so that a hot fingerprint can be split in the last join
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", *found)


def report(docs: DataFrame, distance: int = 2, size: int = WORDS) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return near_duplicates(docs, distance, size).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 2, size: int = WORDS) -> DataFrame:
    """One row of each component, that with the smallest doc_id; all columns as they were.

    Rows that share this id, or the rows of a component without any id, keep the one with the smallest
    text key; the same row stored twice stays once.
    """
    found = store(near_duplicates(docs, distance, size, keyed=True), "simhash-report")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    clash = first.groupBy("component_key").agg(F.min("text_key").alias("_key"), F.count("*").alias("_n"))
    dropped = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_key")
    several = clash.filter("_n > 1")
    dropped = dropped.unionByName(first.join(several.select("component_key", "_key"), "component_key").filter(
        "text_key <> _key").select("doc_id", "text_key")).distinct()
    kept = without(docs, dropped, {"doc_id": F.col("doc_id"), "text_key": F.xxhash64(text_of())})
    if several.isEmpty():
        return kept
    order = Window.partitionBy("doc_id", "_llm_key").orderBy(*[c for c in docs.columns if c != "text"])
    return kept.withColumn("_llm_key", F.xxhash64(text_of())).withColumn(
        "_llm_row", F.row_number().over(order)).filter("_llm_row = 1").drop("_llm_row", "_llm_key")
