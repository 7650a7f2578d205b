"""Quality rules as a decision list learned from labelled text statistics, applied as Spark conditional expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statistics that rules may test, as columns of rates().
FEATURES = ["n_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate"]
SPACE = "\\x20\\x09-\\x0D"
P = "_qr_"


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_digits, each named with the prefix P; columns
    of docs whose names have it too give way.

    Words are runs of other than ASCII white space. Null text counts as empty, with all counts zero. All of it is
    array and regular expression functions on the row: no shuffle, and n log n in the words of a text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if not c.lower().startswith(P)))
    words = docs.withColumn(P + "w", F.array_remove(F.split(text, f"[{SPACE}]+"), ""))
    lines = words.withColumn(P + "l", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    w = F.col(P + "w")
    windows = F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    hashed = lines.withColumn(P + "h", windows)
    h = F.col(P + "h")
    twice = F.size(F.array_distinct(h)) < F.size(h)
    ordered = hashed.withColumn(P + "s", F.when(twice, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col(P + "s")
    same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    places = ordered.withColumn(P + "p", F.when(s.isNotNull(), F.sort_array(F.transform(same, lambda x: x["i"]))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    covered = F.aggregate(P + "p", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])
    lines_ = F.col(P + "l")
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_lines": F.size(lines_),
        "n_dup_lines": F.size(lines_) - F.size(F.array_distinct(lines_)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_upper": F.regexp_count(text, F.lit("\\p{Lu}")),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")),
    }
    return places.select(*(F.col(f"`{c}`") for c in docs.columns), F.monotonically_increasing_id().alias(P + "row"), *(c.cast("long").alias(P + n) for n, c in counts.items()))


def where(rows: DataFrame, condition: Column) -> DataFrame:
    """rows under a condition on the statistics. Naming the row number keeps the optimizer from moving the condition below the
    projections, where it would be put in full inside every lambda and computed anew for each word."""
    return rows.where((F.col(P + "row") >= 0) & condition)


def rates() -> dict[str, Column]:
    """What the rules test, from the counts of statistics()."""
    n = {x: F.col(P + x).cast("double") for x in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits")}
    per = lambda a, b: n[a] / F.greatest(n[b], F.lit(1.0))
    return {"n_words": n["n_words"], "word_length": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "upper_rate": per("n_upper", "word_chars"), "digit_rate": per("n_digits", "word_chars")}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, FEATURES.index(self.feature)] >= self.threshold if self.above else x[:, FEATURES.index(self.feature)] < self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] >= F.lit(self.threshold) if self.above else values[self.feature] < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


def covers(rule: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.holds(x)
    return out


def grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: int, banned: frozenset[tuple[str, bool]] = frozenset()) -> tuple[Test, ...]:
    """Add the test of the highest gain in information until no good row is covered; banned (feature, above) pairs may not come first."""
    rule: list[Test] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best = (1e-9, None)
        for k, name in enumerate(FEATURES):
            v, b = x[inside, k], bad[inside]
            values = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, cuts)), np.quantile(v[b], np.linspace(0, 1, cuts))])) if b.any() else v[:0]
            for a, c in zip(values, values[1:], strict=False):
                at = float(a + c) / 2
                for above in (True, False):
                    if not rule and (name, above) in banned:
                        continue
                    m = v >= at if above else v < at
                    p, n = (b & m).sum(), (~b & m).sum()
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0
                    if gain > best[0]:
                        best = (gain, Test(name, above, at))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def prune(rule: tuple[Test, ...], x: np.ndarray, bad: np.ndarray) -> tuple[Test, ...]:
    """The shortest beginning of the rule with the best (p - n) / (p + n) on rows held back."""

    def worth(r: tuple[Test, ...]) -> float:
        m = covers(r, x)
        p, n = (bad & m).sum(), (~bad & m).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (worth(r), -len(r)), default=())


def cover(x: np.ndarray, bad: np.ndarray, fold: np.ndarray, rules: int = 16, tests: int = 4, cuts: int = 33, precision: float = 0.95, support: int = 3) -> list[tuple[Test, ...]]:
    """Sequential covering: each rule is grown on fold rows, pruned on the others, kept if precise on all and on the others alone, and its rows leave both.

    A rule that is not precise enough is left out and the search goes on from the next best first test; it ends when every feature has
    failed in both directions since the last rule that was kept.
    """
    out: list[tuple[Test, ...]] = []
    left, banned = np.ones(len(x), bool), set()
    while len(out) < rules and (bad & left).sum() >= support and (~bad & left).any():
        grown = grow(x[left & fold], bad[left & fold], tests, cuts, frozenset(banned))
        if not grown:
            break
        rule = prune(grown, x[left & ~fold], bad[left & ~fold])
        m = covers(rule, x) & left
        # Rows held back were not searched, so chance finds no rule in them.
        if rule and all((bad & m & part).sum() >= max(least, precision * (m & part).sum()) for part, least in ((left, support), (~fold, 2))):
            out.append(rule)
            left &= ~m
            banned.clear()
        else:
            banned.add((grown[0].feature, grown[0].above))
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labels: int = 20_000, **params) -> list[tuple[Test, ...]]:
    """Rules, each a conjunction of thresholds, under which documents are of label 0.

    Fitted on at most most_labels labelled rows, those of the smallest hash of their id, whose statistics alone come to
    the driver; no other row is computed. Labels of null and rows that fail the base are left out; without rows of both labels
    there are no rules. Repeated labels count repeatedly.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("learn_id"), F.col(label_col).cast("int").alias("learn_y"))
    total = known.count()
    chance = min(1.0, 1.2 * most_labels / max(1, total))
    known = known.withColumn("learn_r", F.xxhash64(F.col("learn_id"), F.lit(42)))
    known = known.where(F.col("learn_r") <= F.lit(int(-(2**63) + chance * (2**64 - 2**11)))) if chance < 1 else known
    drawn = known.orderBy("learn_r", "learn_id", "learn_y").limit(most_labels)
    rows = docs.select(F.col(id_col).alias("learn_doc"), F.col(text_col)).join(F.broadcast(drawn), F.col("learn_doc") == F.col("learn_id"))
    values = rates()
    data = where(statistics(rows, text_col), ~base_failed()).select("learn_y", (F.pmod(F.xxhash64("learn_id"), F.lit(3)) > 0).alias("learn_g"), "learn_id", *(values[f].alias(f) for f in FEATURES)).collect()
    if not data:
        return []
    data.sort(key=lambda r: tuple(r))
    x = np.array([[r[f] for f in FEATURES] for r in data], float)
    return cover(x, np.array([r["learn_y"] == 0 for r in data]), np.array([r["learn_g"] for r in data]), **params)


def base_failed() -> Column:
    return (F.col(P + "n_words") < 50) | (F.col(P + "n_repeat_words") * 100 > F.col(P + "n_words") * 50)


def decision(rules: list[tuple[Test, ...]]) -> Column:
    """The number of the first rule that holds, from 1, or 0: a chain of conditions in the order of the list."""
    values, out = rates(), None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column(values)
        for t in rule[1:]:
            holds = holds & t.column(values)
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, rules: list[tuple[Test, ...]], text_col: str = "text") -> DataFrame:
    """docs with the statistics, base_failed, rule and kept, named with the prefix P."""
    return statistics(docs, text_col).withColumn(P + "base_failed", base_failed()).withColumn(P + "rule", decision(rules)).withColumn(P + "kept", ~F.col(P + "base_failed") & (F.col(P + "rule") == 0))


def kept_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    return where(judged(docs, learn(docs, labels, **params)), F.col(P + "kept")).select(*(F.col(f"`{c}`") for c in docs.columns if not c.lower().startswith(P)))


def op5(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = docs.select("doc_id", "text")
    # Naming the row number in each column keeps callers' filters above the statistics, as in where().
    held = lambda n: F.when(F.col(P + "row") >= 0, F.col(P + n)).alias(n)
    return judged(rows, learn(rows, labels)).select("doc_id", *(held(n) for n in [*names, "rule"]))
