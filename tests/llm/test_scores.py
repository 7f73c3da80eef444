import base64
import os

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from headloom.llm import licence_texts, licenses, quality
from tests.conftest import SF


def test_quality_on_held_out_labels(spark):
    found = quality.op7_quality(spark, SF.replace("0.001", "0.01"))
    truth = spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")
    rows = found.join(truth, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.05


def test_quality_of_short_and_unbroken_texts(spark):
    rng = np.random.default_rng(1)
    poor = [
        "For&&& thstrend&&& ouedst$$$ eres*** onth### ande%%% tion@@@ them&&& of$$$ it*** her%%% arel&&& sted### ing$$$ uble@@@",
        "ab" * 5000,
        base64.b64encode(rng.bytes(9000)).decode(),
    ]
    fine = ["A short note about the river and the old mill.", "one", " "]
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(poor + fine)], "doc_id long, text string")
    kept = {r.doc_id: r.q for r in quality.with_quality(docs.unionByName(more), "q").filter("doc_id < 0").collect()}
    assert [kept[-1 - i] >= quality.THRESHOLD for i in range(6)] == [False] * 3 + [True] * 3, kept


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(5)
    n, k = 20000, len(quality.LABELLERS)
    truth = rng.random(n) < 0.8
    right = np.linspace(0.75, 0.95, k)
    votes = np.where(rng.random((n, k)) < right, np.where(truth[:, None], 1, -1), 0)
    codes, counts = np.unique(((votes + 1) * 3 ** np.arange(k)).sum(1), return_counts=True)
    table, prior, _ = quality.estimate(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
    assert abs(prior - 0.8) < 0.02 and np.abs(table[:, 1, 2] - right).max() < 0.02


def test_quality_whatever_the_ids_and_copies(spark):
    """Null, repeated and absent ids give the scores of distinct ones; a text with thousands of copies doesn't crowd out the sample."""
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text")
    weights, odds, even = quality.train(docs, sample=200)
    assert weights.any()
    want = {r.doc_id: r.q for r in quality.with_quality(docs, "q").select("doc_id", "q").collect()}
    for other in (docs.withColumn("doc_id", F.lit(None).cast("long")), docs.withColumn("doc_id", F.lit(7)), docs.drop("doc_id")):
        again = quality.train(other, sample=200)
        assert (again[0] == weights).all() and (again[1] == odds).all() and again[2] == even
    scored = quality.with_quality(docs.withColumn("id", F.col("doc_id")).withColumn("doc_id", F.lit(None).cast("long")), "q")
    assert {r.id: r.q for r in scored.select("id", "q").collect()} == want
    copies = docs.unionByName(docs.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n"))
    assert quality.train(copies, sample=200)[0].any()


def test_quality_edges(spark, awkward, nothing):
    assert quality.drop_low_quality(awkward).columns == awkward.columns
    assert {r.doc_id for r in quality.drop_low_quality(awkward).collect()} >= {1, 2, 3, 12}
    assert quality.drop_low_quality(nothing).count() == 0


def test_licences(spark, awkward, nothing):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "p/LICENSE", mit), (2, "p/a/x.py", "code"), (3, "p/a/b/y.py", "code\n" + apache + "\n" + "more code " * 20), (4, "q/z", "nothing"), (5, None, None),
        (6, "p/a/b/COPYING", apache), (7, "p/a/b/c/w", "w"), (8, "top", "LICENSED under cc by-nc 4.0!"), (9, "p", ""),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, license int")
    found = {r.doc_id: (r.license, r.via, r.from_dir) for r in licenses.scan(df).collect()}
    assert found[1] == ("MIT", "file", None) and found[2] == ("MIT", "inherited", "p") and found[3] == ("Apache-2.0", "header", None)
    assert found[7] == ("Apache-2.0", "inherited", "p/a/b") and found[5] == (None, None, None) and found[8][:2] == ("CC-BY-NC-4.0", "file")
    assert found[4] == ("CC-BY-NC-4.0", "inherited", "")
    assert licenses.scan(nothing.selectExpr("*", "'a/b' as path")).count() == 0
    assert licenses.scan(awkward.selectExpr("*", "'a/b' as path")).count() == awkward.count()


def test_whole_licences_headers_and_tags(spark):
    texts = dict(licence_texts.TEXTS)
    mit = texts["MIT"].replace("Copyright (c)", "\n\nCopyright (c) 2021 The Example Authors <mail@example.org>\n\n").replace(", ", ",\n")
    gpl = "\n".join("# " + x for x in texts["GPL-3.0"].split(". "))
    code = "\n".join(f"value_{i} = compute_{i}(left_{i}, right_{i})" for i in range(60))
    rows = [
        ("MIT", "file", "a/LICENSE", mit),
        ("GPL-3.0", "header", "b/x.py", "#!/usr/bin/env python\n" + gpl + "\n\nimport os\n" + code),
        ("Apache-2.0", "header", "c/y.c", "// SPDX-License-Identifier: Apache-2.0\n" + code),
        ("BSD-3-Clause", "file", "d/anything", texts["BSD-3-Clause"]),
        ("BSD-2-Clause", "file", "e/COPYING", texts["BSD-2-Clause"]),
        ("ISC", "header", "f/z.js", "/*\n * " + texts["ISC"].replace(". ", ".\n * ") + "\n */\n" + code),
        ("MPL-2.0", "file", "g/LICENSE.txt", "Notes of the project\n" + texts["MPL-2.0"] + "\n" + code),
        (None, None, "h/w.c", "/* SPDX-License-Identifier: Sleepycat */\n" + code),
        (None, None, "i/story", "The author asked for permission is all he said, and a licence to fish in public domain waters. " + code),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, want string, how string, path string, text string")
    found = {r.doc_id: (r.license, r.via) for r in licenses.scan(df).collect()}
    assert found == {i: r[:2] for i, r in enumerate(rows)}


COMMON = "/usr/share/common-licenses"
FULL_TERMS = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no public licence files on this machine")
def test_full_terms_are_named_rightly_or_not_at_all(spark):
    """Held-out texts: whole public licences, and the same without their title, which may be named by none, never by
    another; texts that only mention, quote or follow licences."""
    rows = []
    for file, want in FULL_TERMS.items():
        text = open(f"{COMMON}/{file}", encoding="latin1").read()
        rows += [(f"w/{file}/x", text, {want}), (f"t/{file}/x", "\n".join(text.split("\n")[6:]), {want, None})]
    rows += [
        ("e/1/x", "Eclipse Public License - v 3.0\n\nTHE PROGRAM IS PROVIDED UNDER THIS LICENSE\nsee the GNU General Public License, version 2\nCopyright. All rights reserved.", {None}),
        ("e/2/x", "Licensed under the Apache License, Version 1.0.", {None}), ("e/3/x", "GNU GENERAL PUBLIC LICENSE\nVersion 4, 2031", {None}),
        ("e/4/x", "some of the GNU General Public License as published by the Free Software Foundation", {None}),
        ("e/5/x", "Copyright. All rights reserved.\nPermission to redistribute is granted to members.", {None}), ("e/6/x", "notes\nCopyright. All rights reserved.\nmore", {"Proprietary"}),
        ("e/7/x", "License\n\nReleased under the MIT License.", {"MIT"}), ("e/8/x", "GNU Affero General Public License\n  Version 3, 19 November 2007\n\nthe terms", {"AGPL-3.0"}),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "doc_id long, path string, text string")
    found = {r.path: r.license for r in licenses.scan(df).collect()}
    assert {p: found[p] for p, _, want in rows if found[p] not in want} == {}


def test_a_directory_of_most_rows(spark, monkeypatch):
    """What a hot directory inherits comes by another join, with the same rows."""
    rows = [(i, f"hot/{i}" if i % 3 else f"cold{i}/sub/x", "Released under the MIT License." if i in (1, 3, 10) else "code") for i in range(60)] + [(3, "cold3/LICENSE", "Released under the MIT License.")]
    df = spark.createDataFrame([*rows, (None, None, "code")], "doc_id long, path string, text string")
    seen = []
    for hot in (1, 4, 10**6):
        monkeypatch.setattr(licenses, "HOT", hot)
        seen.append(sorted((tuple(r) for r in licenses.scan(df).collect()), key=str))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 62
    assert sum(r[2] == "MIT" and r[4] == "inherited" for r in seen[0]) == 38


def test_licence_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(licenses.ORACLE_SQL).fetchall(), key=str)
    got = sorted((tuple(r) for r in licenses.op10_licenses(spark, SF).select("doc_id", "path", "license", "score", "via", "from_dir").collect()), key=str)
    assert got == want
