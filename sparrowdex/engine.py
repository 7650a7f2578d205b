"""The engine as an object: index a corpus, search it, answer from it, evaluate results.

A published index is a folder of Parquet tables under home, named by a fresh id; the file CURRENT names the one in
use and is replaced by a rename. Caches and embeddings lie inside that folder, so a new index never meets old ones.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable
from functools import cached_property

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparrowdex import schemas, validate
from sparrowdex.functions import text as X
from sparrowdex.operators import answer as answers
from sparrowdex.operators import chunking, encode, evaluate, index, rank
from sparrowdex.operators.order import numbered
from sparrowdex.sources import corpus
from sparrowdex.storage import children, drop_path, exists, is_folder, materialise, qualified, read_text, write_text

CURRENT, PREFIX = "CURRENT", "index-"


class Engine:
    """home: a folder that the driver and all executors share. encoder: makes a model of token vectors; generator: (system, prompt) -> answer, named model."""

    def __init__(self, spark: SparkSession, home: str, encoder: Callable = encode.HashedWords, generator: Callable[[str, str], str] = answers.first_line, model: str = "first-line", system: str = answers.SYSTEM):
        self.spark, self.home, self.encoder, self.generator, self.model, self.system = spark, home.rstrip("/"), encoder, generator, model, system
        #: Counts of the last index call (files, skipped, unreadable) and of the last call with a cache (questions, hits).
        self.seen: dict[str, int] = {}
        self.cache_use: dict[str, int] = {}

    # -- index

    def index(self, root: str, max_chunk_size: int = chunking.CAP, embeddings: bool = False, prefix: str = "data/raw") -> str:
        """Index the files below root and publish; the folder of the new index. The index before it stays for readers that still use it, older ones go."""
        size = validate.chunk_size(max_chunk_size)
        at = f"{self.home}/{PREFIX}{uuid.uuid4().hex}"
        seen = Observation("files")
        corpus.files(self.spark, root, prefix, seen).write.parquet(f"{at}/files")
        self.seen = seen.get
        if self.seen["unreadable"]:
            warnings.warn(f"{self.seen['unreadable']} files are not UTF-8 and were left out", stacklevel=2)
        files = self.spark.read.parquet(f"{at}/files")
        answers.write_blocks(files, f"{at}/text_blocks")
        chunks = chunking.chunk(files.withColumn("doc_id", F.lit(0)), most=size).drop("doc_id")
        order = [F.col("path").endswith(".py").desc(), F.col("path"), F.col("first"), F.col("last")]
        ordered = numbered(index.chunk_terms(chunks), order, "chunk_id").withColumn("chunk_id", F.col("chunk_id") - 1)
        terms = materialise(ordered, "terms")
        if terms.isEmpty():
            drop_path(self.spark, at)
            raise ValueError(f"no chunk was made from {root}")
        index.publish(terms, at, stem=True)
        if embeddings:
            self._embed(at)
        before = read_text(self.spark, f"{self.home}/{CURRENT}")
        write_text(self.spark, f"{self.home}/{CURRENT}", at.rsplit("/", 1)[1])
        for name in children(self.spark, self.home):
            if name.startswith(PREFIX) and name not in (before, at.rsplit("/", 1)[1]):
                drop_path(self.spark, f"{self.home}/{name}")
        self.__dict__.pop("tables", None)
        return at

    def _embed(self, at: str) -> None:
        chunks = self.spark.read.parquet(f"{at}/chunks")
        encode.embed(chunks.select("chunk_id", "text"), self.encoder, "chunk_id").write.parquet(f"{at}/vectors")
        vectors = self.spark.read.parquet(f"{at}/vectors")
        first = vectors.first()
        info = {"model_name": getattr(self.encoder, "name", str(self.encoder)), "max_length": 256, "stride": 32, "pooling": "mean", "window_aggregation": "mean", "normalized": True, "num_chunks": vectors.count(), "dimension": len(first["embedding"])}
        write_text(self.spark, f"{at}/vectors.json", json.dumps(info, indent=2))

    @property
    def at(self) -> str:
        name = read_text(self.spark, f"{self.home}/{CURRENT}")
        if name is None:
            raise FileNotFoundError(f"there is no index in {self.home}")
        return f"{self.home}/{name}"

    @cached_property
    def tables(self) -> tuple[str, index.Index]:
        at = self.at
        return at, index.Index.read(self.spark, at)

    def table(self, name: str) -> DataFrame:
        at = self.tables[0]
        if not exists(self.spark, f"{at}/{name}"):
            raise FileNotFoundError(f"the index has no {name}; index the corpus with embeddings" if name == "vectors" else f"the index has no {name}")
        return self.spark.read.parquet(f"{at}/{name}")

    # -- search

    def found(self, questions: DataFrame, k: int, hybrid: bool = False) -> DataFrame:
        """(question_id, path, first, last, rank) of the k best chunks for questions (question_id, question): min(k, chunks) rows each."""
        ix = self.tables[1]
        terms = rank.small(rank.question_terms(questions, stem=True))
        if hybrid:
            scored = materialise(rank.scores(rank.narrowed(ix, terms), terms, boosted=True), "scored")
            asked = encode.embed(questions, self.encoder, "question_id", "question").withColumnRenamed("embedding", "vector")
            top = rank.hybrid(scored, rank.cosine(self.table("vectors"), asked), k)
        else:
            top = rank.search(ix, terms, questions, k, boosted=True)
        return rank.located(ix, rank.small(top)).select("question_id", "path", "first", "last", "rank")

    def nested(self, questions: DataFrame, k: int, hybrid: bool = False) -> DataFrame:
        """(question_id, retrieved_sources): spans best first, with the cache in hybrid mode."""
        if not hybrid:
            return self._sources(self.found(questions, k))
        keyed = materialise(questions.withColumn("key", X.search_key(F.lit(k), F.col("question"))), "requests")
        cache = self._cache("search_cache", schemas.SEARCH_CACHE)
        hits, misses = answers.split_by_cache(keyed, cache)
        self._counted(keyed, hits)
        fresh = misses.groupBy("key").agg(F.min("question_id").alias("question_id"), F.first("question").alias("question"))
        new = self.spark.createDataFrame([], schemas.SEARCH_CACHE)
        if not fresh.isEmpty():
            new = materialise(self._sources(self.found(fresh.select("question_id", "question"), k, True)).join(fresh.select("question_id", "key"), "question_id").select("key", F.col("retrieved_sources").alias("sources")), "fresh")
            self._remember("search_cache", new)
        return hits.join(cache, "key").unionByName(misses.join(new, "key")).select("question_id", F.col("sources").alias("retrieved_sources"))

    @staticmethod
    def _sources(found: DataFrame) -> DataFrame:
        span = F.struct(F.col("path").alias("file_path"), F.col("first").alias("first_character_index"), F.col("last").alias("last_character_index"))
        rows = found.select("question_id", F.struct("rank", span.alias("span")).alias("r"))
        return rows.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["span"]).alias("retrieved_sources"))

    def _cache(self, name: str, schema: str) -> DataFrame:
        """A cache of one row per key; what cannot be read is an empty cache."""
        return corpus.cache(self.spark, f"{self.tables[0]}/{name}", schema).dropDuplicates(["key"])

    def _counted(self, requests: DataFrame, hits: DataFrame) -> None:
        """What the last cached call found: questions asked, and those that the cache answered."""
        self.cache_use = {"questions": requests.count(), "hits": hits.count()}

    def _remember(self, name: str, rows: DataFrame) -> None:
        """Append to a cache; failing to is a warning, as answers do not depend on it."""
        try:
            rows.write.mode("append").parquet(f"{self.tables[0]}/{name}")
        except (PySparkException, Py4JError) as e:
            warnings.warn(f"the {name} was not written: {e}", stacklevel=2)

    def _asked(self, *queries: str) -> DataFrame:
        return self.spark.createDataFrame([(str(i), q) for i, q in enumerate(queries)], "question_id string, question string")

    def search(self, query: str, k: int = 5, hybrid: bool = False) -> DataFrame:
        """(path, first, last, rank) of the best chunks for one query, best first."""
        q, k = validate.query(query), validate.count(k)
        return self.nested(self._asked(q), k, hybrid).select(F.posexplode("retrieved_sources").alias("at", "s")).select(F.col("s.file_path").alias("path"), F.col("s.first_character_index").alias("first"), F.col("s.last_character_index").alias("last"), (F.col("at") + 1).alias("rank")).orderBy("rank")

    def search_batch(self, questions: DataFrame, k: int = 5, hybrid: bool = False) -> DataFrame:
        """questions with retrieved_sources; none for a question of an empty index."""
        return questions.join(self.nested(questions.select("question_id", "question"), validate.count(k), hybrid), "question_id", "left")

    def search_dataset(self, dataset_path: str, k: int = 5, save_directory: str = "data/output/search_results", hybrid: bool = False) -> str:
        """Search every question of a dataset; the path of the results, which have the dataset's name: a document for one, a folder of JSON lines for a folder."""
        out = self._output(dataset_path, save_directory)
        asked = materialise(corpus.dataset(self.spark, dataset_path).select("place", "question_id", "question"), "questions")
        return self._save(self.search_batch(asked, k, hybrid), out, dataset_path, k)

    def _is_folder(self, path: object) -> bool:
        return isinstance(path, str) and bool(path.strip()) and is_folder(self.spark, path)

    def _output(self, source: str, folder: str, what: str = "dataset") -> str:
        """Where results for a document or a folder of lines go."""
        if not self._is_folder(source):
            return str(validate.output(source, folder, what))
        validate.save_folder(folder)
        full, to = qualified(self.spark, source), qualified(self.spark, folder)
        if full.rpartition("/")[0] == to:
            raise ValueError(f"the save directory cannot be that of the {what}, which would be overwritten")
        return f"{to}/{full.rpartition('/')[2]}"

    def _save(self, rows: DataFrame, out: str, source: str, k: int) -> str:
        """rows written in the form of their source; only a document passes through the driver. A folder of lines of that name is replaced."""
        if is_folder(self.spark, source):
            corpus.write_lines(materialise(rows, "lines"), out, k)
        else:
            corpus.write_document(rows.orderBy("place").drop("place"), "search_results", out, k=k)
        return out

    # -- answers

    def answer(self, query: str, k: int = 3, hybrid: bool = False) -> str:
        asked = self._asked(validate.query(query))
        found = materialise(self.found(asked, validate.count(k), hybrid), "found")
        made = answers.generate(answers.prompts(found, answers.of_spans(self.table("text_blocks"), found), asked, k), self.generator, self.system)
        return made.first()["answer"]

    def answer_batch(self, results: DataFrame, k: int, cached: bool = False) -> DataFrame:
        """(place, question_id, question, retrieved_sources, answer) of results (place, question_id, question, path, first, last, rank), from the first k sources of each, which are those kept."""
        questions = results.select("place", "question_id", "question").distinct()
        found = results.where(F.col("rank") <= k).select(F.col("place").alias("question_id"), "path", "first", "last", "rank")
        prompted = answers.prompts(found, answers.of_spans(self.table("text_blocks"), found), questions.select(F.col("place").alias("question_id"), "question"), k)
        prompted = materialise(prompted.withColumn("key", X.answer_key(F.col("question"), F.lit(k), F.lit(self.model), F.lit(answers.MAX_TOKENS), F.lit(self.system), F.col("prompt"))), "prompts")
        kept = questions.join(self._sources(found).withColumnRenamed("question_id", "place"), "place", "left").withColumn("retrieved_sources", F.coalesce("retrieved_sources", F.array().cast(f"array<{schemas.SPAN}>")))
        if not cached:
            made = answers.generate(prompted, self.generator, self.system).select(F.col("question_id").alias("place"), "answer")
            return kept.join(made, "place")
        cache = self._cache("answer_cache", schemas.ANSWER_CACHE)
        hits, misses = answers.split_by_cache(prompted, cache)
        self._counted(prompted, hits)
        fresh = misses.dropDuplicates(["key"]).join(kept.select(F.col("place").alias("question_id"), F.col("retrieved_sources").alias("sources")), "question_id")
        new = materialise(answers.generate(fresh, self.generator, self.system).select("key", "sources", "answer"), "fresh")
        self._remember("answer_cache", new)
        made = hits.join(cache.select("key", "answer"), "key").unionByName(misses.join(new.select("key", "answer"), "key"))
        return kept.join(made.select(F.col("question_id").alias("place"), "answer"), "place")

    def answer_dataset(self, results_path: str, save_directory: str = "data/output/answers", cached: bool = False) -> str:
        """Answer every question of results from its first sources, at most three and no more than the first question has; the path of the answers, in the results' form."""
        out = self._output(results_path, save_directory, "results file")
        rows, k = corpus.results(self.spark, results_path)
        first = rows.where("place = 0").agg(F.max("rank").alias("n")).first()["n"] or 0
        return self._save(self.answer_batch(materialise(rows, "results"), min(answers.MOST_SOURCES, first), cached), out, results_path, k)

    # -- evaluation

    def evaluate(self, results_path: str, dataset_path: str, k: int = 10) -> DataFrame:
        """(k, recall, num_questions) for 1..k, of two documents or two folders of lines, k no more than the sources of the first question. Questions meet by their text; those without gold spans are left out."""
        validate.count(k)
        if not (self._is_folder(results_path) and self._is_folder(dataset_path)):
            validate.other_files(results_path, dataset_path)
        elif qualified(self.spark, results_path) == qualified(self.spark, dataset_path):
            raise ValueError("the results and the dataset must be different folders")
        rows, _ = corpus.results(self.spark, results_path)
        return recall_of(rows, corpus.dataset(self.spark, dataset_path), k)


def recall_of(rows: DataFrame, dataset: DataFrame, k: int) -> DataFrame:
    """The report of Engine.evaluate() for results and a dataset as corpus reads them."""
    first = rows.where("place = 0").agg(F.max("rank").alias("n")).first()["n"] or 0
    if first < k:
        warnings.warn(f"the results have {first} sources each, so k is {first}", stacklevel=3)
    k = max(1, min(k, first))
    dataset = materialise(dataset, "dataset")
    gold = dataset.select(F.col("place").alias("question_id"), F.inline("sources")).select("question_id", F.col("file_path").alias("path"), F.col("first_character_index").alias("g_first"), F.col("last_character_index").alias("g_last"))
    # Results of one question text stand behind each other, in the order of the file.
    once = dataset.select(F.col("place").alias("asked"), "question")
    found = numbered(rows.where("rank is not null").join(once, "question").select(F.col("asked").alias("question_id"), "path", "first", "last", "place", F.col("rank").alias("_r")), [F.col("place"), F.col("_r")], "rank", ("question_id",))
    report = evaluate.recall(found.select("question_id", "path", "first", "last", "rank"), gold, k)
    return rows.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("k")).join(report, "k", "left").select("k", F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("num_questions", F.lit(0)).alias("num_questions")).orderBy("k")
