"""Licence scans: TF-IDF cosine of licence statements to templates, and inheritance from the nearest directory above."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.joins import lookup
from sparrowdex.storage import materialise

#: Notices and titles by which licences are recognised (fixed values: the licences' own customary wording), by SPDX id.
NOTICES = {
    "MIT": ["Released under the MIT License.", "MIT License", "The MIT License (MIT)", "Licensed under the MIT license. See the LICENSE file in the project root for details."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GPLv2 license"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GPLv3 license"],
    "LGPL-2.1": ["This library is free software under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["This library is free software under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted under the 2-Clause BSD License.", "BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted under the 3-Clause BSD License.", "BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
    "ISC": ["ISC License", "Licensed under the ISC license."],
    "Zlib": ["zlib License"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International Public License", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-1.0": ["GNU GENERAL PUBLIC LICENSE Version 1, February 1989"],
    "MPL-1.1": ["MOZILLA PUBLIC LICENSE Version 1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"],
    "GFDL-1.3": ["GNU Free Documentation License Version 1.3, 3 November 2008"],
    "Artistic-1.0": ['The "Artistic License" Preamble', "The Artistic License"],
    "Artistic-2.0": ["The Artistic License 2.0"],
    "EPL-2.0": ["Eclipse Public License - v 2.0"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal"],
}
#: The header that the GNU licences ask for, in its paragraphs (fixed values).
GNU = [
    "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
    "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}Public License for more details.",
    "You should have received a copy of the GNU {name}Public License along with this {thing}. If not, see <https://www.gnu.org/licenses/>.",
]
GNU_NAMES = {"GPL-2.0": ("program", "General "), "GPL-3.0": ("program", "General "), "LGPL-2.1": ("library", "Lesser General "), "LGPL-3.0": ("library", "Lesser General "), "AGPL-3.0": ("program", "Affero General ")}
#: A line with one of these may state a licence.
TRIGGER = "(?i)licen[cs]e|licensed|copyright|spdx|redistribut|public domain"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = "(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
RESULT = ("_own", "_score", "_license", "_from", "_how")


def default_templates() -> dict[str, str]:
    """Templates by name, which is the licence's SPDX id and, after a "#", a variant: notices, titles, headers, SPDX lines and the whole
    texts in the folder licences (the licences' own words)."""
    out: dict[str, str] = {}
    for name, texts in NOTICES.items():
        out |= {f"{name}#{k}" if k else name: t for k, t in enumerate(texts)}
    for name, (thing, kind) in GNU_NAMES.items():
        header = [g.format(thing=thing, name=kind, version=name.rsplit("-", 1)[1].removesuffix(".0")) for g in GNU]
        out |= {f"{name}#header": " ".join(header), f"{name}#first": header[0]}
    for name in NOTICES:
        for suffix in ("", "-only", "-or-later") if name in GNU_NAMES else ("",):
            out[f"{name}#spdx{suffix}"] = f"SPDX-License-Identifier: {name}{suffix}"
    for file in sorted(resources.files("sparrowdex.llm").joinpath("licences").iterdir(), key=lambda f: f.name):
        out[f"{file.name.removesuffix('.txt')}#text"] = file.read_text(encoding="utf-8")
    return out


TEMPLATES = default_templates()


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def statements(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, sid, line): what may state a licence in the whole text: its lines, its paragraphs (lines between blank ones, such as headers),
    and the whole text of licence files. sid is a digest of line."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hit = files.select(F.col(path_col).alias("path"), text.alias("text")).where(F.col("path").isNotNull() & (F.col("text").rlike(TRIGGER) | F.col("path").rlike(LICENCE_FILE)))
    stating = lambda parts: F.filter(parts, lambda x: x.rlike(TRIGGER))
    parts = F.concat(stating(F.split("text", "\n")), stating(F.split("text", "\n[ \t\r]*\n")), F.when(F.col("path").rlike(LICENCE_FILE), F.array("text")).otherwise(F.array().cast("array<string>")))
    return hit.select("path", F.explode(F.array_distinct(parts)).alias("line")).select("path", F.md5("line").alias("sid"), "line")


def scored(files: DataFrame, templates: dict[str, str], path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, license, score): the licence of each file's best statement by TF-IDF cosine; files without a statement have no row.

    A template's name is its licence up to a "#". Inverse document frequencies are ln((1 + N) / (1 + df)) + 1 over all statements and
    templates, where a repeated statement counts once and is scored once; df is counted for every term. files is read once, for its
    statements, which are stored. Only the templates' terms come to the driver and are broadcast; of the others those with over a
    thousandth of all rows, which are fewer than a thousand, are joined by broadcast as well, so no task holds a frequent term, and
    the rest by a shuffle. Equal scores, to nine places, go to the first name.
    """
    spark = files.sparkSession
    found = materialise(statements(files, path_col, text_col), "statements")
    names = sorted(templates)
    table = spark.createDataFrame([(k, templates[n]) for k, n in enumerate(names)], "k int, line string").select("k", F.explode(terms(F.col("line"))).alias("term")).groupBy("term", "k").agg(F.count("*").alias("tf"))
    in_templates: dict[str, dict[int, int]] = {}
    for r in table.collect():
        in_templates.setdefault(r["term"], {})[r["k"]] = r["tf"]
    tf = materialise(found.groupBy("sid").agg(F.min("line").alias("line")).select("sid", F.explode(terms(F.col("line"))).alias("term")).groupBy("sid", "term").agg(F.count("*").alias("tf")), "terms")
    df = materialise(tf.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    rows = df.agg(F.sum("df").alias("n")).first()["n"] or 0
    known = {r["term"]: r["df"] for r in df.where(F.col("term").isin(*in_templates)).collect()}
    total = found.select("sid").distinct().count() + len(names)
    idf = lambda d: F.log((F.lit(1.0) + total) / (F.lit(1.0) + d)) + 1.0
    weighed = spark.createDataFrame([(t, [(k, n) for k, n in sorted(of.items())], len(of) + known.get(t, 0)) for t, of in sorted(in_templates.items())], "term string, of array<struct<k:int,n:long>>, df long").select("term", "of", idf(F.col("df")).alias("idf"))
    norms = {r["k"]: r["s"] ** 0.5 for r in weighed.select(F.inline("of"), "idf").groupBy("k").agg(F.sum(F.pow(F.col("n") * F.col("idf"), 2)).alias("s")).collect()}
    kinds = spark.createDataFrame([(k, n.partition("#")[0], float(norms.get(k, 1.0))) for k, n in enumerate(names)], "k int, license string, of_template double")
    others = df.where(~F.col("term").isin(*in_templates)).select("term", F.lit(None).cast("array<struct<k:int,n:long>>").alias("of"), idf(F.col("df")).alias("idf"), (F.col("df") * 1000 > rows).alias("hot"))
    hot = F.broadcast(weighed.unionByName(others.where("hot").drop("hot")))
    joined = tf.join(hot, "term").unionByName(tf.join(hot.select("term"), "term", "left_anti").join(others.where("not hot").drop("hot"), "term").select("term", "sid", "tf", "of", "idf"))
    w = F.col("tf") * F.col("idf")
    # The statement's own norm goes with its products as that of template -1.
    products = F.concat(F.array(F.struct(F.lit(-1).alias("k"), (w * w).alias("s"))), F.coalesce(F.transform("of", lambda x: F.struct(x["k"].alias("k"), (w * x["n"] * F.col("idf")).alias("s"))), F.array().cast("array<struct<k:int,s:double>>")))
    sums = joined.select("sid", F.inline(products)).groupBy("sid", "k").agg(F.sum("s").alias("s"))
    listed = sums.join(F.broadcast(kinds), "k", "left").groupBy("sid").agg(F.max(F.when(F.col("k") == -1, F.sqrt("s"))).alias("norm"), F.collect_list(F.when(F.col("k") >= 0, F.struct((F.col("s") / F.col("of_template")).alias("s"), F.col("k").alias("k"), F.col("license").alias("license")))).alias("all"))
    best = listed.select("sid", F.array_max(F.transform("all", lambda x: F.struct(F.round(x["s"] / F.col("norm"), 9).alias("score"), (-x["k"]).alias("k"), x["license"].alias("license")))).alias("b"))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("k"), F.lit(names[0].partition("#")[0] if names else None).cast("string").alias("license"))
    held = lookup(found.select("path", "sid"), materialise(best, "best"), "sid")
    return held.groupBy("path").agg(F.max(F.coalesce("b", none)).alias("b")).select("path", "b.license", "b.score")


def directory(path: Column) -> Column:
    """What precedes the last slash; empty at the top."""
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def scan(files: DataFrame, templates: dict[str, str] | None = None, path_col: str = "path", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """files' columns (but the text) with _own, _score, _license, _from and _how; columns of files with these names give way.

    A file's own licence is its best statement's, if the cosine is at least `least`. A file without one inherits from the licence
    file of the nearest directory at or above its own; of several there the best score, then the first path, counts. _how: own, inherited
    or none. Null and empty texts have no statement; a null path is never scanned and inherits nothing. Repeated paths are one file's statements;
    each of their rows stays. A statement that fits several licences equally has the first by name.
    Directories, not files, look up their ancestors, so a directory with most files is looked up once.
    """
    if path_col.lower() in RESULT:
        raise ValueError(f"the path column may not be named {path_col}")
    own = materialise(scored(files, templates or TEMPLATES, path_col, text_col).where(F.col("score") >= least), "own")
    columns = [c for c in files.columns if c != text_col and c.lower() not in RESULT]
    kept = files.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{path_col}`").alias("path")).withColumn("dir", directory(F.col("path")))
    given = own.where(F.col("path").rlike(LICENCE_FILE)).select(directory(F.col("path")).alias("at"), F.struct((-F.col("score")).alias("s"), F.col("path").alias("path"), F.col("license").alias("license")).alias("l")).groupBy("at").agg(F.min("l").alias("l"))
    steps = F.split("dir", "/")
    above = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")), F.array(F.lit(""))))
    dirs = materialise(kept.where("dir is not null").select("dir").distinct().select("dir", F.explode(above).alias("at")), "directories")
    near = lookup(dirs, materialise(given, "given"), "at").where("l is not null").groupBy("dir").agg(F.max_by("l", F.length("at")).alias("l")).select("dir", F.col("l.path").alias("given_path"), F.col("l.license").alias("given"))
    out = lookup(lookup(kept, own.withColumnRenamed("license", "own"), "path"), materialise(near, "near"), "dir")
    how = F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("row.*", F.col("own").alias("_own"), F.col("score").alias("_score"), F.coalesce("own", "given").alias("_license"), F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("given_path")).alias("_from"), how.alias("_how"))


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as a tree of files: source/lang/last digit of the id; a document under 400 characters that states a licence is a LICENSE file."""
    stated = (F.length("text") < 400) & F.col("text").rlike("(?i)licen[cs]e")
    name = F.when(stated, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.pmod("doc_id", F.lit(10)).cast("string"), name).alias("path"), "text")


def op1(spark, docs: DataFrame) -> DataFrame:
    out = scan(document_files(docs))
    return out.select("doc_id", "path", F.col("_own").alias("own_license"), F.round("_score", 6).alias("score"), F.col("_license").alias("license"), F.col("_from").alias("license_path"), F.col("_how").alias("how"))


def op1_sql() -> str:
    """The scan of document_files() in SQL, with the same templates."""
    held = ", ".join(f"({k}, '{n.partition('#')[0]}', '{TEMPLATES[n].replace(chr(39), chr(39) * 2)}')" for k, n in enumerate(sorted(TEMPLATES)))
    return f"""
WITH templates(k, license, line) AS (VALUES {held}),
files AS (SELECT doc_id, concat_ws('/', source, lang, ((doc_id % 10 + 10) % 10)::VARCHAR, CASE WHEN length(text) < 400 AND regexp_matches(text, '(?i)licen[cs]e') THEN 'LICENSE-' || doc_id ELSE 'doc_' || doc_id || '.txt' END) AS path, coalesce(text, '') AS text FROM documents),
statements AS (
  SELECT DISTINCT path, unnest(list_concat(
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{TRIGGER}')),
    list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda x: regexp_matches(x, '{TRIGGER}')),
    CASE WHEN regexp_matches(path, '{LICENCE_FILE}') THEN [text] ELSE [] END)) AS line
  FROM files WHERE regexp_matches(text, '{TRIGGER}') OR regexp_matches(path, '{LICENCE_FILE}')
),
lines AS (SELECT DISTINCT line FROM statements),
tf AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM lines) GROUP BY ALL),
of_template AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM templates) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT term FROM tf UNION ALL SELECT term FROM of_template) GROUP BY term),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM lines) + (SELECT count(*) FROM templates)) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM df),
norms AS (SELECT line, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tf JOIN idf USING (term) GROUP BY line),
template_norms AS (SELECT k, sqrt(sum(tf * idf * tf * idf)) AS norm FROM of_template JOIN idf USING (term) GROUP BY k),
dots AS (SELECT line, o.k, sum(tf.tf * idf * o.tf * idf) AS dot FROM tf JOIN of_template o USING (term) JOIN idf USING (term) GROUP BY ALL),
cosines AS (SELECT line, k, round(dot / n.norm / t.norm, 9) AS score FROM dots JOIN norms n USING (line) JOIN template_norms t USING (k)),
best AS (SELECT path, k, score FROM (SELECT path, k, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, k) AS pos FROM statements JOIN cosines USING (line)) WHERE pos = 1 AND score >= 0.5),
own AS (SELECT path, license, score FROM best JOIN templates USING (k)),
given AS (SELECT * FROM (SELECT regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) AS dir, path AS license_path, license, row_number() OVER (PARTITION BY regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) ORDER BY score DESC, path, license) AS pos FROM own WHERE regexp_matches(path, '{LICENCE_FILE}')) WHERE pos = 1),
dirs AS (SELECT DISTINCT regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) AS dir FROM files),
near AS (SELECT * FROM (SELECT d.dir, license_path, license, row_number() OVER (PARTITION BY d.dir ORDER BY length(g.dir) DESC) AS pos FROM dirs d JOIN given g ON g.dir = '' OR d.dir = g.dir OR starts_with(d.dir, g.dir || '/')) WHERE pos = 1)
SELECT doc_id, f.path, o.license AS own_license, round(o.score, 6) AS score, coalesce(o.license, n.license) AS license,
  CASE WHEN o.license IS NOT NULL THEN f.path ELSE n.license_path END AS license_path,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how
FROM files f LEFT JOIN own o ON o.path = f.path LEFT JOIN near n ON n.dir = regexp_extract(f.path, '(?s)^(.*)/[^/]*$', 1)
"""
