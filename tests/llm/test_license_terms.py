"""Every term weighs by its own document frequency."""

import collections
import math
import pathlib
import re
import textwrap

from pyspark.sql import functions as F

from sparrowdex.llm import license_scan
from sparrowdex.llm.joins import lookup


def slow(lines, templates):
    bag = lambda t: collections.Counter(re.findall(license_scan.TERM, t.lower()))
    every = [bag(x) for x in set(lines)] + [bag(x) for x in templates.values()]
    df = collections.Counter(t for b in every for t in b)
    vector = lambda b: {t: n * (math.log((1 + len(every)) / (1 + df[t])) + 1) for t, n in b.items()}
    out = {}
    for line in lines:
        a = vector(bag(line))
        for name in templates:
            b = vector(bag(templates[name]))
            score = sum(x * b.get(t, 0) for t, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            out[line] = max(out.get(line, 0), score)
    return out


def test_scores_equal_tf_idf_over_all_terms(spark):
    header = "This file is distributed under the terms of the GNU General Public License as published in version 3, see the file for details"
    lines = [header] + [f"This source file is code with a license, see file details number {i} w{i}" for i in range(300)]
    files = spark.createDataFrame([(f"f{i}.txt", x) for i, x in enumerate(lines)], "path string, text string")
    said = slow(lines, license_scan.TEMPLATES)
    got = {r.path: r.score for r in license_scan.scored(files, license_scan.TEMPLATES).collect()}
    assert all(abs(got[f"f{i}.txt"] - said[x]) < 1e-6 for i, x in enumerate(lines))


COMMON = pathlib.Path("/usr/share/common-licenses")
KNOWN = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "MPL-1.1": "MPL-1.1", "GFDL-1.3": "GFDL-1.3"}


def test_real_licence_files_headers_and_ids(spark):
    rows, want = [], {}

    def put(path, text, licence):
        rows.append((path, text))
        want[path] = licence

    for name, licence in KNOWN.items():
        if (COMMON / name).exists():
            put(f"whole/{name}/LICENSE", (COMMON / name).read_text(), licence)
            put(f"flat/{name}/COPYING.txt", " ".join((COMMON / name).read_text().split()), licence) if licence in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0") else None
    t = license_scan.TEMPLATES
    put("mit/LICENSE", "Copyright (c) 2019 Jane Doe and others\n\n" + t["MIT#text"].split("\n\n", 2)[2].replace(". ", ".\n"), "MIT")
    put("isc/LICENSE", t["ISC#text"].replace("<year> <copyright holder>", "2001-2020 A. Person"), "ISC")
    put("bsd2/LICENSE", t["BSD-2-Clause#text"].split("\n\n", 1)[1], "BSD-2-Clause")
    put("agpl/LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\n" + t["GPL-3.0#text"].split("\n\n", 1)[1], "AGPL-3.0")
    for line in ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "LGPL-2.1-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "Zlib", "Unlicense"):
        put(f"spdx/{line}.c", f"/* SPDX-License-Identifier: {line} */\nint main(void);\n", line.removesuffix("-only").removesuffix("-or-later"))
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Apache-2.0", "MPL-2.0"):
        text = t.get(f"{name}#header", t.get(f"{name}#2"))
        put(f"header/{name}.py", "#!/usr/bin/env python\n# Copyright 2020 Somebody\n#\n" + "\n".join(f"# {x}" for x in textwrap.wrap(text, 60)) + "\n\nimport os\n", name)
    put("none/readme.md", "## License\n\nSee the license file.\nCopyright 2020 somebody\nall license terms apply to this code", None)
    put("none/a.txt", "nothing is said here", None)
    got = {r.path: r._own for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want


def own_statements(path, text):
    trigger, out = re.compile(license_scan.TRIGGER), set()
    if trigger.search(text) or re.search(license_scan.LICENCE_FILE, path):
        out = {x for x in text.split("\n") + re.split("\n[ \t\r]*\n", text) if trigger.search(x)}
        if re.search(license_scan.LICENCE_FILE, path):
            out.add(text)
    return out


def test_the_query_equals_a_second_scan(spark):
    """All documents: statements, TF-IDF, cosines and inheritance by plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    files = {r.doc_id: (r.path, r.text or "") for r in license_scan.document_files(docs).collect()}
    bag = lambda t: collections.Counter(re.findall(license_scan.TERM, t.lower()))
    stated = {i: own_statements(p, t) for i, (p, t) in files.items()}
    every = {x: bag(x) for s in stated.values() for x in s}
    models = {n: bag(t) for n, t in license_scan.TEMPLATES.items()}
    n = len(every) + len(models)
    df = collections.Counter(t for b in [*every.values(), *models.values()] for t in b)
    vector = lambda b: {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in b.items()}
    weighed = {name: vector(b) for name, b in models.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = {}
    for x, b in every.items():
        v = vector(b)
        best[x] = max((round(sum(w * m.get(t, 0) for t, w in v.items()) / (norm(v) * norm(m)), 9), tuple(-ord(c) for c in name), name) for name, m in weighed.items()) if v else (0, (), "")
    own = {}
    for i, s in stated.items():
        top = max((best[x] for x in s), default=(0, (), ""))
        if top[0] >= 0.5:
            own[i] = (top[2].partition("#")[0], top[0])
    folder = lambda p: p.rpartition("/")[0]
    given = collections.defaultdict(list)
    for i, (name, score) in own.items():
        if re.search(license_scan.LICENCE_FILE, files[i][0]):
            given[folder(files[i][0])].append((-score, files[i][0], name))
    for r in license_scan.op1(spark, docs).collect():
        at, held = folder(r.path), None
        while held is None and at is not None:
            held = min(given[at]) if at in given else None
            at = folder(at) if at else None
        if r.doc_id in own:
            assert (r.own_license, r.license, r.how) == (own[r.doc_id][0], own[r.doc_id][0], "own") and abs(r.score - own[r.doc_id][1]) < 1e-5
        else:
            assert (r.own_license, r.license, r.license_path) == (None, held and held[2], held and held[1])
    assert own and any(r for r in given.values())


def test_odd_files(spark):
    long = "words of a long text\n" * 60_000 + "Licensed under the Apache License, Version 2.0.\n" + "more\n" * 1000
    rows = [("a/LICENSE", "Released under the MIT License.", 1, "x", "d"), ("a/b.txt", long, 2, None, "d"), ("a/c.txt", "", 3, "y", None), ("a/c.txt", "", 3, "y", None), (None, None, None, None, None)]
    files = spark.createDataFrame(rows, "path string, text string, _own int, row string, dir string")
    out = license_scan.scan(files)
    assert out.columns == ["path", "row", "dir", "_own", "_score", "_license", "_from", "_how"]
    assert sorted((r.path or "", r._license or "", r._how) for r in out.collect()) == [("", "", "none"), ("a/LICENSE", "MIT", "own"), ("a/b.txt", "Apache-2.0", "own"), ("a/c.txt", "MIT", "inherited"), ("a/c.txt", "MIT", "inherited")]
    assert license_scan.scan(files.limit(0)).count() == 0


def test_hot_directories_and_keys(spark):
    table = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "key long, value string")
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 70).cast("long").alias("key"), "id")
    got = {(r.id, r.key, r.value) for r in lookup(rows, table, "key").collect()}
    want = {(i, k := 7 if i % 3 == 0 else None if i % 5 == 0 else i % 70, None if k is None or k > 49 else f"v{k}") for i in range(3000)}
    assert got == want and lookup(rows.limit(0), table, "key").count() == 0
