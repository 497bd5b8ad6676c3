"""Merkle manifest of a dataset: leaf digests, roots per language, proofs and their check.

A tree has its leaves in order of position; every ``arity`` consecutive nodes (the last run may be
shorter, even one) hash to their parent while several nodes are left. Languages have a tree each, and
their roots, in order of language, are the leaves of the tree of the dataset.

* Positions: rows are dealt by ranges of (tree, order), numbered inside their range, and the offsets
  of ranges added up, so a tree that holds a third of all rows is numbered by many tasks.
* Levels: a tree is cut into blocks of arity^LEVELS leaves, aligned so that no run crosses a border.
  Inside a block the row of a node is that of its first leaf; at level l, lag and lead columns at the
  fixed offsets d * arity^l, masked by slot and run length, are the siblings, and rows of first
  children hash the parent. Siblings reach the other leaves of a node as the last value before them.
  All levels of a block share one shuffle and one sort.
* The first rows of blocks are the leaves of the next tier, 1/arity^LEVELS as many, until one node is
  left; the paths of the tiers are joined by block, a key that holds one block of rows.

Defined cases: null fields are ``-`` in a leaf; a null lang is a language of its own, before all
others; null ids come first; rows with equal ids go by leaf digest, so equal rows are interchangeable;
a lone leaf is its own root; an empty table gives an empty result; texts of any length are hashed
whole; columns other than the five fields are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, store

LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows share an encoding."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """The leaf of a row, with some fields replaced."""
    return digest(*[field(changed.get(name, F.col(name))) for name in FIELDS])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(proof, leaf, lambda below, level: digest(level["left"], below, level["right"]))


def positioned(rows: DataFrame, tree: str, order: list[str], label: str) -> DataFrame:
    """``pos`` (from 0, in order) and ``total`` of every row's tree; the table is stored."""
    spark = rows.sparkSession
    width = max(buckets_for(rows.count()), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = store(rows.repartitionByRange(width, tree, *order).sortWithinPartitions(tree, *order).withColumns(
        {"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), label)
    earlier = Window.partitionBy("_tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranked.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_range")).agg(
        F.count("*").alias("_n"), F.min("_seq").alias("_first")).select(
        "_tree", "_range", F.sum("_n").over(Window.partitionBy("_tree")).alias("total"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ranked.join(ranges, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_range"))).withColumn(
        "pos", F.col("_seq") + F.col("_shift")).drop("_tree", "_range", "_part", "_seq", "_shift")


def climb(nodes: DataFrame, tree: str, arity: int, levels: int) -> DataFrame:
    """Add to tree, pos, total and digest: ``path``, the siblings of ``levels`` levels, and, on first
    rows of blocks, ``top``, the digest above them; ``block`` is the position there."""
    size = arity**levels
    rows = nodes.withColumn("block", F.expr(f"pos div {size}")).withColumn("_node", F.col("digest"))
    block = Window.partitionBy(tree, "block").orderBy("pos")
    for level in range(levels):
        step = arity**level
        near = {f"_lag{d}": F.lag("_node", d * step).over(block) for d in range(1, arity)} | {
            f"_lead{d}": F.lead("_node", d * step).over(block) for d in range(1, arity)}
        slot, count = F.expr(f"pos div {step} % {arity}"), F.expr(f"(total + {step - 1}) div {step}")
        run = F.least(F.lit(arity), count - F.expr(f"pos div {step}") + slot)
        left = F.concat(*[F.when(slot >= d, F.col(f"_lag{d}")).otherwise("") for d in range(arity - 1, 0, -1)])
        right = F.concat(*[F.when(slot + d < run, F.col(f"_lead{d}")).otherwise("") for d in range(1, arity)])
        first = F.expr(f"pos % {step} = 0")
        rows = rows.withColumns(near).withColumns({
            f"_level{level}": F.when(first & (count > 1), F.struct(left.alias("left"), right.alias("right"))),
            "_node": F.when(F.expr(f"pos % {step * arity} = 0"), F.when(count > 1, digest(F.col("_node"), right)).otherwise(
                F.col("_node")))}).drop(*near)
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [f"_level{level}" for level in range(levels)]
    path = F.filter(F.array(*names), lambda level: level.isNotNull()) if names else F.array().cast(PROOF)
    return rows.withColumns({name: F.last(name, ignorenulls=True).over(so_far) for name in names}).withColumns(
        {"path": path, "top": F.col("_node")}).drop("_node", *names)


def grow(nodes: DataFrame, tree: str, arity: int, label: str, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """All nodes with their whole ``path``, and the stored roots: (tree, root)."""
    left = nodes.agg(F.max("total")).first()[0] or 0
    tiers: list[DataFrame] = []
    while not tiers or left > 1:
        wanted = 0
        while wanted < levels and arity**wanted < left:
            wanted += 1
        size = arity**wanted
        tiers.append(climb(nodes, tree, arity, wanted))
        nodes = store(tiers[-1].filter(F.expr(f"pos % {size} = 0")).select(
            tree, F.col("block").alias("pos"), F.expr(f"(total + {size - 1}) div {size}").alias("total"),
            F.col("top").alias("digest")), f"{label}-{len(tiers)}")
        left = -(-left // size)
    out = tiers.pop().select("*").drop("block", "top")
    while tiers:
        above = out.select(F.col(tree).alias("_tree"), F.col("pos").alias("_pos"), F.col("path").alias("_above"))
        here = tiers.pop()
        out = here.join(above, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_pos"))).withColumn(
            "path", F.concat("path", "_above")).drop("_tree", "_pos", "_above", "block", "top")
    return out, nodes.select(tree, F.col("digest").alias("root"))


def manifest(docs: DataFrame, arity: int = 2, levels: int = LEVELS, **carried: Column) -> DataFrame:
    """doc_id, lang, leaf, position (in its language), subroot, root, proof; and the ``carried`` columns.

    ``proof`` holds the siblings (left, right) of every level from the leaf to the root.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
                       F.col("text").cast("string").alias("text"))
    leaves = store(rows.select("doc_id", "lang", leaf_digest().alias("digest"),
                               *[value.alias(name) for name, value in carried.items()]), "merkle-leaves")
    inner, subroots = grow(positioned(leaves, "lang", ["doc_id", "digest"], "merkle-order"), "lang", arity, "merkle", levels)
    named = subroots.select("lang", F.col("root").alias("digest"), F.lit(0).alias("all"))
    outer, roots = grow(positioned(named, "all", ["lang"], "merkle-langs"), "all", arity, "merkle-all", levels)
    root = roots.first()
    above = outer.select(F.col("lang").alias("_lang"), F.col("digest").alias("subroot"), F.col("path").alias("_above"))
    return inner.join(above, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "doc_id", "lang", F.col("digest").alias("leaf"), F.col("pos").alias("position"), "subroot",
        F.lit(root and root["root"]).cast("string").alias("root"), F.concat("path", "_above").alias("proof"), *carried)


def tamper_report(docs: DataFrame, arity: int = 2) -> DataFrame:
    """The manifest, held against leaves some of which were tampered with (see the query's contract)."""
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    found = manifest(docs, arity, tampered=F.when(touched, leaf_digest(n_chars=F.try_add(F.col("n_chars"), F.lit(1)))))
    siblings = F.array_join(F.transform("proof", lambda level: F.concat(level["left"], level["right"])), "")
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return found.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _tree(name: str, source: str, key: str, order: str) -> str:
    """Levels of a tree in SQL: every node of every level, and the siblings of every leaf."""
    return f"""
{name}_leaf AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS pos,
    count(*) OVER (PARTITION BY {key}) AS total FROM {source}),
{name}_node AS (SELECT 0 AS lv, {key} AS k, pos, total, digest FROM {name}_leaf
    UNION ALL
    SELECT lv + 1, k, pos // 2, (total + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name}_node
    WHERE total > 1 GROUP BY lv, k, pos // 2, total),
{name}_path AS (SELECT l.{key} AS k, l.pos, list(CASE WHEN (l.pos >> n.lv) % 2 = 1 THEN s.digest || '|'
        ELSE '|' || coalesce(s.digest, '') END ORDER BY n.lv) AS path
    FROM {name}_leaf l JOIN (SELECT DISTINCT lv, k FROM {name}_node WHERE total > 1) n ON n.k IS NOT DISTINCT FROM l.{key}
    LEFT JOIN {name}_node s ON s.k IS NOT DISTINCT FROM l.{key} AND s.lv = n.lv AND s.pos = xor(l.pos >> n.lv, 1)
    GROUP BY l.{key}, l.pos),
{name}_root AS (SELECT k, digest FROM {name}_node WHERE total = 1)"""


ORACLE_SQL = f"""
WITH RECURSIVE coded AS (SELECT doc_id, lang, n_chars,
    {_field('doc_id')} || {_field('source')} || {_field('lang')} AS head, {_field('text')} AS tail FROM documents),
hashed AS (SELECT doc_id, lang, sha256(head || {_field('n_chars')} || tail) AS digest,
    sha256(head || {_field('(n_chars + 1)')} || tail) AS changed,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: list_transform(range(8), lambda i: (ord(c) >> i) & 1)))),
        lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))), 4294967295) % 7 = 0 AS touched FROM coded),
{_tree('doc', 'hashed', 'lang', 'doc_id NULLS FIRST, digest')},
subroots AS (SELECT k AS lang, digest, 0 AS everything FROM doc_root),
{_tree('all', 'subroots', 'everything', 'lang NULLS FIRST')},
found AS (SELECT l.doc_id, l.digest AS leaf, CASE WHEN l.touched THEN l.changed ELSE l.digest END AS used,
    s.digest AS subroot, (SELECT digest FROM all_root) AS root,
    list_concat(coalesce(p.path, []), coalesce(a.path, [])) AS path
    FROM doc_leaf l JOIN all_leaf s ON s.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN doc_path p ON p.k IS NOT DISTINCT FROM l.lang AND p.pos = l.pos LEFT JOIN all_path a ON a.pos = s.pos),
folded AS (SELECT *, list_reduce(list_prepend(used, path),
    lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root FROM found)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM folded
"""
