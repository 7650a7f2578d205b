"""The driver's tables as the engine's inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.storage import ship


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents as files of five kinds."""
    kinds = [".py", ".md", ".txt", ".rst"]
    ext = F.lit(".yaml")
    for i, e in reversed(list(enumerate(kinds))):
        ext = F.when(F.col("doc_id") % 5 == i, e).otherwise(ext)
    return docs.select("doc_id", F.concat(F.lit("corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext).alias("path"), "text")


def questions(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def gold(file_table: DataFrame, asked: DataFrame, block_chars: int = 1_000_000) -> DataFrame:
    """(question_id, path, g_first, g_last): where a question's text first stands in a file, in characters, half open.

    The questions are a stated query set: they are sent to executors as an automaton of all their texts, in blocks of at most
    block_chars characters (a longer question is a block of its own); each text is read once per block, however many
    questions that has, and there is no shuffle. Null and empty questions and null texts match nothing.
    """
    spark = file_table.sparkSession
    ship(spark)
    items = asked.where("question_id is not null and question <> ''").select("question_id", "question")
    blocks = -(-(items.agg(F.sum(F.length("question")).alias("n")).first()["n"] or 0) // block_chars) or 1
    kind = dict(asked.dtypes)["question_id"]
    rows = file_table.where("text is not null").select("path", "text")
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("question"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([(r["question_id"], r["question"]) for r in block.collect()])
        id_type = pa.string() if kind == "string" else pa.int64()

        def run(batches: Iterator[pa.RecordBatch], sent=sent, id_type=id_type) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            ids: dict[str, list] = {}
            for q, text in sent.value:
                ids.setdefault(text, []).append(q)
            automaton = ahocorasick.Automaton()
            for text in ids:
                automaton.add_word(text, text)
            automaton.make_automaton()
            for b in batches:
                found: list[tuple] = []
                for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist() if ids else [], strict=False):
                    last: dict[str, int] = {}
                    for at, q in automaton.iter(text):
                        last.setdefault(q, at + 1)
                    found += [(i, path, at - len(q), at) for q, at in last.items() for i in ids[q]]
                kinds = [id_type, pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*found, strict=True)) or [[]] * 4, kinds, strict=True)], names=["question_id", "path", "g_first", "g_last"])

        part = rows.mapInArrow(run, f"question_id {kind if kind == 'string' else 'long'}, path string, g_first int, g_last int")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("question_id").cast(kind), "path", "g_first", "g_last")
