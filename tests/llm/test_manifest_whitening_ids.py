"""Merkle manifest, whitening and token files against brute force and the libraries."""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib

import duckdb
import numpy as np
import pytest
from helpers import CLASHES, DOCS, awkward, documents, prose
from pyspark.sql import functions as F

from shockwatch.llm import merkle, token_files, whitening
from shockwatch.llm.queries import tokenizer


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_brute(row, add: int = 0) -> str:
    values = [row.doc_id, row.source, row.lang, row.n_chars if row.n_chars is None else row.n_chars + add, row.text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_brute(leaves: list[str], arity: int) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root and, for every leaf, (left, right) siblings of every level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, q in enumerate(at):
            run = range(q - q % arity, min(q - q % arity + arity, len(nodes)))
            proofs[i].append(([nodes[j] for j in run if j < q], [nodes[j] for j in run if j > q]))
        at = [q // arity for q in at]
        nodes = [sha(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], proofs


def manifest_brute(rows, arity: int = 2):
    langs: dict = {}
    for r in rows:
        langs.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf_brute(r), r))
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree_brute([x[2] for x in sorted(v, key=lambda x: x[:3])], arity) for k, v in langs.items()}
    root, above = tree_brute([trees[k][0] for k in order], arity)
    out = []
    for k, upper in zip(order, above, strict=True):
        for (_, _, leaf, r), proof in zip(sorted(langs[k], key=lambda x: x[:3]), trees[k][1], strict=True):
            touched = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            folded = leaf_brute(r, 1) if touched else leaf
            for left, right in proof + upper:
                folded = sha(*left, folded, *right)
            siblings = sha(*[s for left, right in proof + upper for s in left + right])
            out.append((r.doc_id, leaf, trees[k][0], root, siblings, folded, folded == root))
    return sorted(out, key=str)


def langs_of(spark, sizes: dict, extra: bool = False):
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            rows.append((n * 7 % 1000, f"text {n}", lang, "s", n))
            n += 1
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *[f"'x' as {c}" for c in (*CLASHES, "pos", "total", "path", "digest", "root", "block")]) if extra else df


def test_manifest_of_awkward_rows(spark):
    docs = awkward(spark).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") > 7, "").otherwise("en"))
    got = sorted((tuple(r) for r in merkle.tamper_report(docs).collect()), key=str)
    want = manifest_brute(docs.select("doc_id", "text", "lang", "source", "n_chars").collect())
    assert got == want and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize(("arity", "levels"), [(2, 2), (3, 1), (4, 10)])
def test_manifest_across_blocks(spark, monkeypatch, arity, levels):
    """Trees of many tiers, ragged last runs, one language with most rows, single leaves."""
    docs = langs_of(spark, {"en": 150, "de": 9, "fr": 1, None: 33, "é": 2}, extra=True)
    found = merkle.manifest(docs, arity, levels).collect()
    want = {w[1]: w for w in manifest_brute(docs.collect(), arity)}
    assert len(found) == len(want) == 195
    for r in found:
        siblings = "".join(p["left"] + p["right"] for p in r.proof)
        assert (r.doc_id, r.leaf, r.subroot, r.root, sha(siblings)) == want[r.leaf][:5]
    assert {r.position for r in found if r.lang == "en"} == set(range(150))


def test_manifest_single_leaf_and_empty_table(spark):
    one = merkle.tamper_report(langs_of(spark, {"en": 1})).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")
    empty = merkle.tamper_report(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


def test_manifest_is_the_same_under_another_partitioning(spark):
    docs = langs_of(spark, {"en": 60, "de": 5})
    one, two = ({tuple(r) for r in merkle.tamper_report(d).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two


def test_manifest_sql(spark, tmp_path):
    docs = langs_of(spark, {"en": 37, "de": 4, None: 3, "fr": 1})
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(tuple(r) for r in con.sql(merkle.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in merkle.tamper_report(docs).collect()) == want


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], VECTORS)
    return df.selectExpr("*", *[f"'x' as {c}" for c in ("id", "x", "n", "component", "deviation", "i", "v")])


def whiten_brute(rows):
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows]
    fit = np.unique(np.stack([x for _, x in kept]), axis=0)
    mean = fit.mean(0)
    values, turned = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    return kept, fit, values[::-1], turned[:, ::-1], mean


def held_against(got, rows, most=4):
    kept, fit, values, turned, mean = whiten_brute(rows)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    signs = {}
    for c, found in by.items():
        for i, x in kept:
            want = (x - mean) @ turned[:, c - 1] / math.sqrt(values[c - 1])
            r = found[i]
            signs.setdefault(c, math.copysign(1, want) * math.copysign(1, r.whitened) if abs(want) > 1e-6 else None)
            assert abs(r.whitened - (signs[c] or 1) * want) < 1e-9 or abs(want) < 1e-6
            assert abs(r.explained - values[c - 1] / values.sum()) < 1e-12 and r.n == n and r.identity_error < 1e-9
            assert r.deviation == sum((n * int(v) - s) ** 2 for v, s in zip(x, sums, strict=True))
    return by


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, [3, 2, 1, 0.5, 0.2, 0.1, 0.05]) + 10) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2000, rows[1][1] + 1e-9)]  # a hot vector, one equal on the grid
    awkward_rows = [(1, None), (2, [1.0, None, 3, 4, 5, 6, 7]), (3, [float("nan")] * 7), (4, [float("inf")] * 7), (5, []), (6, [1.0, 2])]
    got = whitening.report(vectors(spark, rows + [(-i, v) for i, v in awkward_rows])).collect()
    assert len(got) == 4 * len(rows)
    assert set(held_against(got, rows)) == {1, 2, 3, 4}


def test_whitening_of_fewer_dimensions_than_components(spark):
    """Rank two in three dimensions: two components, nothing divided by zero."""
    rng = np.random.default_rng(6)
    rows = [(i, [a, b, a]) for i, (a, b) in enumerate(rng.integers(-50, 50, (60, 2)).astype(float))]
    got = whitening.report(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2}
    held_against(got, rows)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25])] * 3, [(1, None)], [(1, [])]])
def test_whitening_without_variance(spark, rows):
    got = whitening.report(vectors(spark, rows))
    assert got.count() == 0
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_factor_and_rotations_keep_small_eigenvalues():
    """A graded matrix: eigenvalues over twenty-four powers of ten keep their digits."""
    rng = np.random.default_rng(1)
    scale = 10.0 ** -np.arange(0, 13)
    core = np.eye(13) + 0.1 * (lambda a: a + a.T)(rng.normal(size=(13, 13)) / 13)
    a = core * np.outer(scale, scale)
    factor = whitening.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a, rtol=1e-13, atol=0)
    values = np.sort((whitening.rotated(factor) ** 2).sum(0))[::-1]
    # reference by exact arithmetic on the determinant and the leading minors' ratio
    assert abs(np.prod(values / scale**2) / np.linalg.det(core) - 1) < 1e-10
    assert np.allclose(values[:3], np.linalg.eigvalsh(a)[::-1][:3], rtol=1e-10)


def test_deviation_beyond_a_long(spark):
    big = [(i, [float(i % 7 * 2**40), float(i)]) for i in range(300)]
    exact = whitening.whiten(vectors(spark, big)).filter("component = 1").collect()
    kept, fit, *_ = whiten_brute(big)
    sums = [int(s) for s in fit.sum(0)]
    want = {i: sum((len(fit) * int(v) - s) ** 2 for v, s in zip(x, sums, strict=True)) for i, x in kept}
    assert {r.vec_id: int(r.deviation) for r in exact} == want and max(want.values()) > 2**63
    assert whitening.report(vectors(spark, big)).filter("deviation is null").count() > 0


def ids_brute(rows, end=2, kind="<u2"):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    made = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        stored = np.array(ids, kind).tobytes()
        made.append(((doc_id is not None, doc_id or 0), zlib.crc32(stored), stored, doc_id, ids))
    out, start = [], 0
    for *_, doc_id, ids in sorted(made, key=lambda m: m[:3]):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def in_order(df):
    return [tuple(r) for r in df.orderBy("start").collect()]


def test_token_files_of_awkward_rows(spark):
    docs = awkward(spark)
    got = in_order(token_files.round_trip(docs, tokenizer("word_bpe_49k.json"), 2, length=16))
    assert got == ids_brute([(r.doc_id, r.text) for r in docs.collect()])


def test_token_files_with_a_hot_id_small_files_and_many_ranges(spark, monkeypatch):
    """Files that end at once, batches of few sequences, an id with a third of all rows over several ranges."""
    for name, value in {"FILE_TOKENS": 300, "BATCH": 3, "INDEX_ROWS": 2, "GROUP": 2}.items():
        monkeypatch.setattr(token_files, name, value)
    monkeypatch.setattr(token_files, "buckets_for", lambda rows: 9)
    rows = [(i * 5 % 120, prose(i % 40, i)) for i in range(120)] + [(60, prose(12, 500 + i)) for i in range(60)] + [(None, "x")] * 5
    folder = f"{token_files.run_dir(spark)}/ids-test-{uuid.uuid4().hex}"
    files = token_files.write(documents(spark, rows, extra=True), folder, tokenizer("word_bpe_49k.json"), 2, length=8)
    assert in_order(token_files.read(spark, files, folder)) == ids_brute(rows)
    hot = files.groupBy("part").agg(F.sum("documents").alias("n")).agg(F.max("n")).first()[0]
    assert hot < 60 and files.count() > 9


def test_sequences_are_views_of_the_file(spark):
    folder = f"{token_files.run_dir(spark)}/ids-test-{uuid.uuid4().hex}"
    rows = [(i, prose(300, i)) for i in range(40)]
    files = token_files.write(documents(spark, rows), folder, tokenizer("word_bpe_49k.json"), 2, length=32).orderBy("part").collect()
    path = folder.removeprefix("file://").removeprefix("file:")
    found = token_files.Sequences([f"{path}/{f.name}.arrow" for f in files])
    assert len(found) == sum(-(-f.tokens // 32) for f in files)
    ids = np.concatenate([found[i][0][found[i][1] == 1] for i in range(len(found))])
    assert zlib.crc32(ids[:ids_brute(rows)[0][2]].astype("<u4").tobytes()) == ids_brute(rows)[0][3] and len(ids) == sum(f.tokens for f in files)
    one, again = found[3][0], found[3][0]
    assert len(one) == 32 and not one.flags.owndata and not one.flags.writeable and np.shares_memory(one, again)
    with pytest.raises(IndexError):
        found[len(found)]


def test_damaged_files_are_noticed(spark):
    folder = f"{token_files.run_dir(spark)}/ids-test-{uuid.uuid4().hex}"
    made = token_files.TokenFile(folder, 4, "<u4")
    made.add(1, np.arange(6, dtype=np.uint32))
    made.index = []  # the document's line is lost
    made.close(0, 0)
    with pytest.raises(ValueError, match="belong to no document"):
        list(token_files.documents(folder, made.name))


def test_token_files_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert token_files.round_trip(empty, tokenizer("word_bpe_49k.json")).count() == 0


def test_wide_ids_where_the_end_id_needs_them(spark):
    rows = [(i, prose(20, i)) for i in range(5)]
    got = in_order(token_files.round_trip(documents(spark, rows), tokenizer("word_bpe_49k.json"), 70_000, length=8))
    assert sorted(got) == sorted(ids_brute(rows, 70_000, "<u4"))


def test_stored_ids_outlive_a_task():
    path = tokenizer("word_bpe_49k.json")
    text = "The same words, again; the SAME words\nand 12 more."
    words = token_files.stored_ids(path, "<u2")
    ids = words.batch([text])
    assert token_files.stored_ids(path, "<u2") is words and words.words.keys() >= {"words,", "again;"}
    assert words.batch([text]) == ids == token_files.StoredIds(path, "<u2").batch([text])
