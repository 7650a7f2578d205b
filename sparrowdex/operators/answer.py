"""Prompts, answers by a pluggable generator, and caches keyed by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowdex.functions import text as X

SYSTEM = "Answer the question from the numbered context only. Name the files that you used."
MAX_TOKENS, MOST_SOURCES = 200, 3


#: Characters of a stored block of a file.
BLOCK = 4096


def blocks(files: DataFrame) -> DataFrame:
    """(path, block, text): the files cut into blocks of BLOCK characters, numbered from 0; an empty file has one, a null text none. One pass, no shuffle."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return files.where("text is not null").select("path", F.posexplode(F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut)).alias("block", "text"))


def write_blocks(files: DataFrame, path: str) -> None:
    """blocks() in ranges of (path, block), so that a reader of some skips the pages without them, and a long file is several tasks' work."""
    blocks(files).repartitionByRange("path", "block").sortWithinPartitions("path", "block").write.parquet(path)


def touched(found: DataFrame) -> DataFrame:
    """found with a row for each block that its span touches, and for its file's first, which tells whether there is the file."""
    of = lambda x: F.floor(x / BLOCK).cast("int")
    inside = F.sequence(of(F.col("first")), of(F.greatest(F.col("first"), F.col("last") - 1)))
    return found.withColumn("block", F.explode(F.array_union(F.array(F.lit(0)), inside)))


def of_spans(held: DataFrame, found: DataFrame, most: int = 1000) -> DataFrame:
    """The blocks that found's spans touch, where they are no more than `most` different ones: the scan then skips pages without one."""
    rows = touched(found).select("path", "block").distinct().limit(most + 1).collect()
    if len(rows) > most:
        return held
    paths, numbers = sorted({r["path"] for r in rows if r["path"] is not None}), sorted({r["block"] for r in rows})
    return held.where(F.col("path").isin(*paths) & F.col("block").isin(*numbers)) if paths else held.where(F.lit(False))


def with_text(found: DataFrame, held: DataFrame) -> DataFrame:
    """found with the text of its spans, from blocks (path, block, text); rows of files that are not there go. found's rows are distinct."""
    parts = touched(found).join(held.select("path", "block", F.col("text").alias("_text")), ["path", "block"])
    each = parts.groupBy(*found.columns).agg(F.array_sort(F.collect_list(F.struct("block", "_text"))).alias("_parts"))
    base = F.floor(F.col("first") / BLOCK).cast("int")
    near = F.filter("_parts", lambda x: x["block"] >= base)
    return each.withColumn("text", X.piece(F.array_join(F.transform(near, lambda x: x["_text"]), ""), F.col("first") - base * BLOCK, F.col("last") - base * BLOCK)).drop("_parts")


def prompts(found: DataFrame, held: DataFrame, questions: DataFrame, k: int = MOST_SOURCES) -> DataFrame:
    """(question_id, question, prompt): the first k spans' text in rank order, then the question. found (question_id, path, first, last, rank), held the blocks of its files."""
    top = with_text(found.where(F.col("rank") <= k).select("question_id", "path", "first", "last", "rank"), held)
    part = F.concat(F.lit("["), (F.col("rank") - 1).cast("string"), F.lit("] ("), F.col("path"), F.lit(")\n"), F.col("text"), F.lit("\n\n"))
    parts = top.select("question_id", F.struct("rank", part.alias("part")).alias("p")).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "").alias("parts"))
    return questions.join(parts, "question_id", "left").select("question_id", "question", F.concat(F.lit("context: \n"), F.coalesce("parts", F.lit("")), F.lit("Question: "), F.col("question"), F.lit("\n\nAnswer: ")).alias("prompt"))


def first_line(system: str, prompt: str) -> str:
    """A deterministic stand-in for a model: the first line of the best chunk."""
    body = prompt.partition("[0] (")[2].partition(")\n")[2]
    return body.split("\n", 1)[0]


def generate(prompted: DataFrame, generator: Callable[[str, str], str] = first_line, system: str = SYSTEM) -> DataFrame:
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda p: generator(system, p))

    return prompted.withColumn("answer", run(F.col("prompt")))


def split_by_cache(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(requests that the cache answers, those that it does not)."""
    keys = cache.select(key).distinct()
    return requests.join(keys, key, "left_semi"), requests.join(keys, key, "left_anti")
