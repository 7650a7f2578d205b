"""Files as a source, and JSON datasets, results and caches as sources and sinks."""

from __future__ import annotations

import json
import re
import uuid
import warnings
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparrowdex import schemas
from sparrowdex.functions import text as X
from sparrowdex.storage import exists, is_folder, listing, partitions, qualified, ship


def _opened(name: str) -> tuple[FileSystem, str]:
    """Arrow's file system of a path in full, and the path in it."""
    scheme, _, way = name.partition(":")
    return (LocalFileSystem(), way) if scheme == "file" else FileSystem.from_uri(name.replace("s3a:", "s3:", 1))


def _hidden(spark, names: list[str]) -> DataFrame:
    """(path, content) of files that Spark's reader leaves out; workers open them by Arrow's file systems."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, at = _opened(name)
                with fs.open_input_stream(at) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read()], pa.binary())], names=["path", "content"])

    rows = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), partitions(spark))))
    return rows.mapInArrow(run, "path string, content binary")


def files(spark, root: str, prefix: str = "data/raw", seen: Observation | None = None) -> DataFrame:
    """(path, text) of the files below root that are not skipped by kind and are valid UTF-8; paths are prefix and the way from root.

    Files and folders whose names begin with "_" or "." and empty files are read like any other. root may be relative. seen, if given, counts
    files, skipped (by kind) and unreadable (not UTF-8) ones when the result is first computed. Names are listed on the
    driver, as Spark's own reader does; contents are read by executors only.
    """
    full, names = listing(spark, root)
    below = len(full) + 1
    left_out = [n for n, size in names if not size or any(x[:1] in ("_", ".") or x.endswith("._COPYING_") for x in n[below:].split("/"))]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_plain(full)).select("path", "content")
    if left_out:
        known = raw.select("path").join(F.broadcast(spark.createDataFrame([(n,) for n in left_out], "path string")), "path", "left_semi")
        twice = {r["path"] for r in known.collect()}
        raw = raw.unionByName(_hidden(spark, [n for n in left_out if n not in twice]))
    way = F.concat(F.lit(prefix + "/"), F.substring("path", below + 1, 1 << 30))
    held = raw.select(way.alias("path"), F.expr("try_validate_utf8(cast(content as string))").alias("text")).withColumn("route", X.route(F.col("path")))
    if seen:
        skipped = F.col("route") == "skip"
        held = held.observe(seen, F.count("*").alias("files"), F.count_if(skipped).alias("skipped"), F.count_if(~skipped & F.col("text").isNull()).alias("unreadable"))
    rows = held.where((F.col("route") != "skip") & F.col("text").isNotNull()).drop("route")
    return rows.withColumn("text", F.when(F.col("path").endswith(".py"), F.regexp_replace("text", "\r\n?", "\n")).otherwise(F.col("text")))


def write_files(rows: DataFrame, root: str) -> int:
    """Write each row of (path, text) as a file of that path below root, in UTF-8, by the tasks that hold the rows; the number of files.

    A null text is an empty file; a null path is an error. A file is put in place by a rename, so a task that runs again, or
    twice at once, leaves whole files. Paths are taken to be distinct: of rows with one path any one stays.
    """
    spark = rows.sparkSession
    ship(spark)
    full = qualified(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for b in batches:
            for path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = _opened(f"{full}/{path}")
                folder, _, name = at.rpartition("/")
                if folder not in made:
                    fs.create_dir(folder)
                    made.add(folder)
                new = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(new) as f:
                    f.write((text or "").encode())
                fs.move(new, at)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    named = F.coalesce("path", F.raise_error(F.lit("a file has no path")).cast("string")).alias("path")
    return rows.select(named, F.col("text").cast("string")).mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0


def _plain(path: str) -> str:
    """path with the characters escaped that would make a pattern of it."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _one(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _questions(spark, path: str, name: str, document: str, line: str) -> tuple[DataFrame, int | None]:
    """(place and the fields of each question, k) of a document of these, or of a folder of JSON lines that write_lines made."""
    if is_folder(spark, path):
        lines = spark.read.schema(f"place long, k int, q {line}").option("mode", "FAILFAST").json(path)
        k = lines.select("k").first()
        return lines.select(F.coalesce("place", F.raise_error(F.lit("a line has no place")).cast("long")).alias("place"), "q.*"), k and k["k"]
    doc = _one(spark, path, document)
    k = doc.select("k").first() if "k" in doc.columns else None
    return doc.select(F.posexplode(name).alias("place", "q")).select(F.col("place").cast("long").alias("place"), "q.*"), k and k["k"]


def dataset(spark, path: str) -> DataFrame:
    """(place, question_id, question, sources, answer) of a dataset, place from 0; missing ids are new, a missing question is an error.

    path is one JSON document, which one task reads, or a folder of JSON lines, which as many tasks read as it has blocks.
    """
    rows, _ = _questions(spark, path, "rag_questions", schemas.DATASET, schemas.QUESTION)
    asked = F.when(F.col("question").isNull(), F.raise_error(F.lit("a question has no text"))).otherwise(F.col("question"))
    return rows.select("place", F.coalesce("question_id", F.expr("uuid()")).alias("question_id"), asked.alias("question"), "sources", "answer")


def results(spark, path: str) -> tuple[DataFrame, int]:
    """((place, question_id, question, path, first, last, rank), k) of a document or a folder like dataset()'s: a question without sources has one row of null rank."""
    rows, k = _questions(spark, path, "search_results", schemas.RESULTS, schemas.RESULT)
    each = rows.select("place", "question_id", "question", F.posexplode_outer("retrieved_sources").alias("at", "s"))
    return each.select("place", "question_id", "question", F.col("s.file_path").alias("path"), F.col("s.first_character_index").alias("first"), F.col("s.last_character_index").alias("last"), (F.col("at") + 1).alias("rank")), k or 0


def write_lines(rows: DataFrame, path: str, k: int | None = None) -> None:
    """rows (place, question_id, question, ...) as a folder of JSON lines that dataset() and results() read: written by executors, whatever their number. An earlier folder is replaced."""
    rows.select("place", F.lit(k).cast("int").alias("k"), F.struct(*(c for c in rows.columns if c != "place")).alias("q")).write.mode("overwrite").json(path)


def document(rows: DataFrame, name: str, **more) -> str:
    """One JSON document {name: rows, ...} in the order of the rows: a result for people and other tools, as large as its questions."""
    lines = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct(*rows.columns))).collect()]
    return json.dumps({name: lines} | more, indent=2, ensure_ascii=False)


def write_document(rows: DataFrame, name: str, path: str, **more) -> None:
    """document() in a local file of just this name."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(document(rows, name, **more), encoding="utf-8")


def cache(spark, path: str, schema: str) -> DataFrame:
    """The cache table; an empty one, with a warning where there is something, if it cannot be read."""
    none = spark.createDataFrame([], schema)
    if not exists(spark, path):
        return none
    try:
        rows = spark.read.schema(schema).parquet(path)
        rows.agg(*(F.max(F.hash(c)) for c in rows.columns)).collect()  # damage shows only when columns are read
        return rows
    except (PySparkException, Py4JError) as e:
        warnings.warn(f"the cache {path} cannot be read and counts as empty: {str(e)[:200]}", stacklevel=2)
        return none
