"""URL filters: host and path rules, and trust propagated over the link graph between hosts where no rule fits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.joins import lookup
from sparrowdex.storage import materialise

#: (verdict, rule): a host with all its subdomains, and a beginning of the path.
RULES = [("allow", "example.com/en/7"), ("block", "com/en/"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LINK = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?([^\"'\\s>]+)"


def host(url: Column) -> Column:
    """What follows the first ://, up to a slash, question mark, hash or the end, A-Z in lower case; empty without it or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(h: Column, p: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, the first of equals; nulls where none does."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted. A page that repeats a link counts once for it. Links without a host stay on their host and
    give no edge."""
    links = pages.select(host(F.col(f"`{url_col}`")).alias("src"), F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), F.lit(LINK), F.lit(1)), lambda x: x.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")))).alias("href"))
    to = links.select("src", host(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))).alias("dst"))
    return to.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6, fold: int = 16) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from trusted seeds along links, and from blocked seeds against them.

    seeds (host, trust, distrust): weights from 0 to 1. Score = (1 - damping) * sum over k of damping^k times the
    seeds moved k links on, a host's score dealt to its links by their counts; hosts without links pass nothing on. A round is one
    join on the host and one sum with partial sums on the map side; the rounds end when what still moves is below tolerance, as a share of the seeds, of trust and of distrust
    alike. As damping is left of it in a round at most, this is reached after log(tolerance) / log(damping) rounds (86); if it is not, that is
    an error. rounds, if given, ends the sum there whatever still moves. Every fold rounds the sum is stored as one table.
    """
    if not 0 <= damping < 1 or not 0 < tolerance < 1:
        raise ValueError("damping must be in 0..1 and tolerance between 0 and 1")
    both = edges.select(F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    links = both.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    graph = materialise(both.join(links, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("w")), "graph")
    now = seeds.select(F.lit(0).alias("kind"), "host", (F.col("trust") * (1 - damping)).alias("r")).unionByName(seeds.select(F.lit(1).alias("kind"), "host", (F.col("distrust") * (1 - damping)).alias("r"))).where("r > 0")
    kinds = lambda step: {r["kind"]: r["s"] for r in step.groupBy("kind").agg(F.sum("r").alias("s")).collect()}
    last = materialise(now, "seeds")
    moved, given = [last], kinds(last)
    most = math.ceil(math.log(tolerance) / math.log(damping)) + 1 if damping else 1
    for _ in range(most if rounds is None else rounds):
        step = graph.join(last.select("kind", F.col("host").alias("a"), "r"), ["kind", "a"]).groupBy("kind", F.col("b").alias("host")).agg(F.sum(F.col("w") * F.col("r") * damping).alias("r")).where(F.col("r") > 0)
        last = materialise(step, "step")
        if all(s < tolerance * given[k] for k, s in kinds(last).items()):
            break
        moved.append(last)
        if len(moved) > fold:
            moved = [materialise(reduce(DataFrame.unionByName, moved).groupBy("kind", "host").agg(F.sum("r").alias("r")), "sum")]
    else:
        if rounds is None:
            raise RuntimeError("propagate: what still moves is not below tolerance")
    every = reduce(DataFrame.unionByName, moved)
    return every.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("r")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("r")).otherwise(0.0)).alias("distrust"))


RESULT = ("_host", "_path", "_rule", "_verdict", "_trust", "_distrust")


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url", html_col: str = "html", margin: float = 0.0, **params) -> DataFrame:
    """pages' columns (but html) with _host, _path, _rule, _verdict, _trust and _distrust; columns of pages with these names give way.

    Where no rule fits, a host is blocked if its distrust is over its trust by more than margin. A host's seed weights are
    the shares of its pages with a rule that are allowed and blocked, so every rule seeds the hosts it speaks of. Hosts that neither a rule nor a link
    reaches, and urls without a host, are allowed. Repeated pages are judged alike and their links count repeatedly. Pages of a host with very many
    stay where they are when they get its score.
    """
    columns = [c for c in pages.columns if c != html_col and c.lower() not in RESULT]
    h, p = host(F.col(f"`{url_col}`")), path(F.col(f"`{url_col}`"))
    split = pages.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), h.alias("host"), p.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", rule).withColumn("ruled", verdict)
    seeds = ruled.where("ruled is not null and host <> ''").groupBy("host").agg(F.avg((F.col("ruled") == "allow").cast("double")).alias("trust"), F.avg((F.col("ruled") == "block").cast("double")).alias("distrust"))
    scores = materialise(propagate(host_edges(pages, url_col, html_col), seeds, **params), "scores")
    scored = lookup(ruled, scores, "host").fillna(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") - F.col("trust") > margin, "block").otherwise("allow")
    return scored.select("row.*", *(F.col(c).alias("_" + c) for c in ("host", "path", "rule")), F.coalesce("ruled", method).alias("_verdict"), F.col("trust").alias("_trust"), F.col("distrust").alias("_distrust"))


def op7(spark, pages: DataFrame) -> DataFrame:
    return judged(pages.select("page_id", "url", "html")).select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"), F.round("_trust", 9).alias("trust"), F.round("_distrust", 9).alias("distrust"))


_URL_HOST = "translate(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rules_sql(rules: list[tuple[str, str]] = RULES) -> tuple[str, str]:
    rule = verdict = ""
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN"
        rule, verdict = f"{rule} {fits} '{text}'", f"{verdict} {fits} '{kind}'"
    return f"CASE{rule} END", f"CASE{verdict} END"


#: The same sums by a recursion, a round a step: at most 200 rounds, of which those up to the tolerance count.
OP7_SQL = f"""
WITH RECURSIVE split AS (SELECT page_id, {_URL_HOST.format("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
ruled AS (SELECT page_id, host, path, {_rules_sql()[0]} AS rule, {_rules_sql()[1]} AS ruled FROM split),
links AS (SELECT host AS src, unnest(list_distinct(list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1), lambda x: regexp_matches(x, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//')))) AS href FROM split),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {_URL_HOST.format("CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END")} AS dst FROM links) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
both_ways AS (SELECT 0 AS kind, src AS a, dst AS b, n FROM edges UNION ALL SELECT 1, dst, src, n FROM edges),
graph AS (SELECT kind, a, b, n / (sum(n) OVER (PARTITION BY kind, a))::DOUBLE AS w FROM both_ways),
seeds AS (SELECT host, avg((ruled = 'allow')::INT) AS trust, avg((ruled = 'block')::INT) AS distrust FROM ruled WHERE ruled IS NOT NULL AND host <> '' GROUP BY host),
walk AS (
  SELECT 0 AS k, kind, host, r FROM (SELECT 0 AS kind, host, trust * {1 - 0.85!r}::DOUBLE AS r FROM seeds UNION ALL SELECT 1, host, distrust * {1 - 0.85!r}::DOUBLE FROM seeds) WHERE r > 0
  UNION ALL SELECT k + 1, walk.kind, b, sum(w * r * 0.85::DOUBLE) FROM walk JOIN graph ON graph.kind = walk.kind AND a = host WHERE k < 200 GROUP BY k + 1, walk.kind, b
), sums AS (SELECT k, kind, sum(r) AS s FROM walk GROUP BY k, kind),
stop AS (SELECT min(k) AS k FROM (SELECT sums.k, bool_and(sums.s < 1e-6 * given.s) AS done FROM sums JOIN sums given ON given.k = 0 AND given.kind = sums.kind WHERE sums.k > 0 GROUP BY sums.k) WHERE done),
scores AS (SELECT host, sum(CASE WHEN kind = 0 THEN r ELSE 0 END) AS trust, sum(CASE WHEN kind = 1 THEN r ELSE 0 END) AS distrust FROM walk WHERE k < coalesce((SELECT k FROM stop), 1000) GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust FROM ruled LEFT JOIN scores USING (host)
"""
