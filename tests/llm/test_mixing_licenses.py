"""Mixing and license scans."""

from __future__ import annotations

import math
import random
import re
from pathlib import Path

import pytest
from helpers import DOCS, awkward, documents, prose
from pyspark.sql import functions as F

from shockwatch.llm import licenses, mixing


def targets_brute(sizes: dict):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed, free = sum(sizes.values()), {}, set(names)
    while free:
        left, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / share for s in free}
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            free.discard(s)
    return fixed


def sizes_of(rows):
    out: dict = {}
    for r in rows:
        out[r.source] = out.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    return out


def check(docs):
    rows = docs.collect()
    sizes, source = sizes_of(rows), {}
    want = targets_brute(sizes)
    for r in rows:
        source.setdefault(r.doc_id, r.source)
    got = mixing.report(docs.select("doc_id", "text", "source")).collect()
    assert len(got) == len(rows)
    taken: dict = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    return got


def corpus(spark, seed: int, sources: int, n: int = 400):
    rng = random.Random(seed)
    names = [f"s{k}" for k in range(sources)] + [None]
    return documents(spark, [(i, prose(rng.choice((0, 3, 20, 80, 600)), i) if rng.random() > 0.05 else None,
                              names[0] if rng.random() < 0.4 else rng.choice(names)) for i in range(n)])


@pytest.mark.parametrize("seed,sources", [(1, 3), (2, 7), (3, 1)])
def test_targets_and_taken_words(spark, seed, sources):
    check(corpus(spark, seed, sources))


def test_targets_stop_at_three_times_the_source(spark):
    docs = documents(spark, [(i, prose(200, i), "a") for i in range(40)] + [(100, prose(3, 1), "b"), (101, prose(10, 2), "c"),
                                                                            (102, prose(5, 3), None), (103, "", "d")])
    got = {r.doc_id: r for r in check(docs)}
    assert got[100].taken == 3 * got[100].size and got[101].taken == 3 * got[101].size


def test_running_sums_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 20)
    check(corpus(spark, 4, 3))


def test_rates_solve_the_dual(spark):
    """Rates of a source are min(3, exp(l z)) for one l, found here by bisection."""
    docs = corpus(spark, 5, 4)
    rows = mixing.taken_words(docs)
    sizes = rows.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "size").agg(
        F.count("*").alias("documents"))
    aims = mixing.targets(sizes)
    found = {r["rank"]: r for r in mixing.solve(sizes, aims).collect()}
    aim = {r["source"]: r for r in aims.collect()}
    table: dict = {}
    for r in sizes.collect():
        if r["size"]:
            table.setdefault(r.source, []).append((r["size"], r.documents))
    for source, items in table.items():
        mean = sum(s * n for s, n in items) / sum(n for _, n in items)
        low, high = -2000.0, 2000.0
        for _ in range(200):
            middle = (low + high) / 2
            reached = sum(n * s * min(3.0, math.exp(min(50.0, middle * s / mean))) for s, n in items)
            low, high = (middle, high) if reached < aim[source].target else (low, middle)
        assert found[aim[source]["rank"]].tilt == pytest.approx(middle, rel=1e-6, abs=1e-7)


def test_awkward_rows_reruns_and_empty_tables(spark):
    docs = awkward(spark)
    once, again = ([tuple(r) for r in mixing.report(docs).orderBy("doc_id", "size", "taken").collect()] for _ in range(2))
    assert once == again and len(once) == docs.count()
    empty = spark.createDataFrame([], DOCS)
    assert mixing.report(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = mixing.report(documents(spark, [(1, None, "a"), (2, " ", "b")])).collect()
    assert all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in blank)


def test_mix_takes_what_the_report_says(spark):
    docs = corpus(spark, 6, 4)
    report = {r.doc_id: r for r in mixing.report(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    got: dict = {}
    originals = {r.doc_id: r for r in docs.collect()}
    for r in mixed.collect():
        n = len((r.text or "").split())
        got[r.doc_id] = got.get(r.doc_id, 0) + n
        whole = originals[r.doc_id]
        assert r == whole or (whole.text.split()[:n] == r.text.split() and whole.text.startswith(r.text) and r.n_chars == len(r.text))
    assert all(got.get(i, 0) == r.taken for i, r in report.items())
    extra = awkward(spark)
    assert mixing.mix(extra).schema == extra.schema


def test_cut_copy_holds_the_words_it_takes(spark):
    docs = documents(spark, [(i, "\n  " + prose(50 + i, i).replace(" ", "  "), "a" if i % 3 else "b") for i in range(30)])
    report = {r.doc_id: r.taken for r in mixing.report(docs).collect()}
    got: dict = {}
    for r in mixing.mix(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert {i: got.get(i, 0) for i in report} == report and any(n % 50 for n in report.values())
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(whole[r.doc_id].startswith(r.text) for r in mixing.mix(docs).collect())


def test_reruns_agree_under_other_partitionings(spark):
    docs = documents(spark, [(i, prose(20 + i * 7 % 90, i), "abc"[i % 3]) for i in range(400)])
    want = None
    for width in (1, 3, 8):
        rows = sorted(tuple(r) for r in mixing.report(docs.repartition(width)).collect())
        want = want or rows
        assert rows == want


def test_an_unsolved_dual_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    with pytest.raises(ArithmeticError, match="rank"):
        mixing.report(documents(spark, [(i, prose(20 + i * 7 % 90, i), "abc"[i % 3]) for i in range(60)]))


def scan(spark, rows, extra=False):
    return [tuple(r)[2:] for r in licenses.scan(documents(spark, rows, extra)).orderBy("doc_id").collect()]


def test_whole_license_in_other_spelling(spark):
    mit = licenses.MIT_TERMS + licenses.WARRANTY
    other = ("The M.I.T. text follows".replace("The M.I.T. text follows", "MIT LICENCE") + "\n\n  Copyright (c) 2019-2021 Some One"
             " <a@b.org>\n© 2020 Other\nAll rights reserved.\n\n" + mit.replace('"', "''").replace("sublicense", "sub-licence").upper())
    got = scan(spark, [(1, mit), (2, other), (3, mit + " extra"), (4, mit[:-40]), (5, "// " + mit.replace("\n", "\n// "))])
    assert [g[0] for g in got] == ["MIT", "MIT", None, None, "MIT"]


def test_every_known_text_is_found(spark):
    got = scan(spark, list(enumerate(t for _, t in licenses.KNOWN)))
    assert [g[0] for g in got] == [name for name, _ in licenses.KNOWN]


def test_notices_by_line(spark):
    rows = [(1, "Some text here.\nReleased under the MIT licence\nmore"),
            (2, "LICENSED UNDER CC BY-NC 4.0\r\nReleased under the MIT License.\nreleased under the mit license"),
            (3, "We talk about things released under the MIT License. Yes."), (4, None), (5, ""), (6, "copyright law is hard")]
    assert scan(spark, rows, True) == [(None, "MIT", 1), (None, "CC-BY-NC-4.0,MIT", 3), (None, "", 0), (None, "", 0),
                                       (None, "", 0), (None, "", 0)]


def test_scan_rows_and_plan(spark):
    docs = awkward(spark).unionByName(documents(spark, [(2, "Released under the MIT License.")] * 2, True))
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count()
    assert [(r.whole_license, r.notices, r.n_notices) for r in rows if r.notices] == [("MIT", "MIT", 1)] * 2
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    for native in (mixing.report(docs),):
        text = native._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "InArrow" not in text


def test_standard_licenses_beyond_the_sample(spark):
    """Identifiers, names with versions, and the digests of long texts, one license each."""
    lines = {"// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only", "# SPDX-License-Identifier: LGPL-2.1-or-later":
             "LGPL-2.1-or-later", "/* SPDX-License-Identifier: MPL-2.0 */": "MPL-2.0", "SPDX-License-Identifier: BSD-2-Clause":
             "BSD-2-Clause", "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0-or-later",
             "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
             "Released under the GNU Lesser General Public License, version 2.1 or later.": "LGPL-2.1-or-later",
             "This program is licensed under the GPLv2": "GPL-2.0", "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
             "This file is licensed under the Mozilla Public Licence v2.0": "MPL-2.0"}
    got = scan(spark, [(i, f"Some text.\n{line}\nmore") for i, line in enumerate(lines)])
    assert [g[1:] for g in got] == [(name, 1) for name in lines.values()]
    found = licenses.known(spark.createDataFrame([], DOCS)).collect()
    assert len({r._digest for r in found}) == len(found)
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Unlicense"} <= {
        line.split()[0] for line in licenses.DIGESTS.split("\n") if line}


UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org>
"""


def test_whole_long_licenses(spark):
    folder = Path("/usr/share/common-licenses")
    texts = [("Unlicense", UNLICENSE)] + [(name, (folder / file).read_text()) for name, file in (
        ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"),
        ("CC0-1.0", "CC0-1.0")) if (folder / file).exists()]
    assert [g[0] for g in scan(spark, [(i, t) for i, (_, t) in enumerate(texts)])] == [name for name, _ in texts]
