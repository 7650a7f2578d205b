"""Ranking: BM25 with the boost of rarer file types, exact cosine, fusion of ranks, best k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowdex.functions import scoring as S
from sparrowdex.functions import text as X
from sparrowdex.functions.stem import with_stems
from sparrowdex.operators.index import Index, boost_of, kind_of
from sparrowdex.operators.order import numbered
from sparrowdex.storage import materialise

#: Terms of one call's questions that are sent as a filter, so that scans skip row groups; more are joined.
MOST_TERMS = 1000
#: Rows (question, term) of one call that are sent with their weights; with more, all postings of their terms are scored and joined.
MOST_ASKED = 20_000
#: Zones of highest bound that are scored first, to learn which score the k best must reach.
SEEDS = 32


def question_terms(questions: DataFrame, stem: bool = False) -> DataFrame:
    """(question_id, term, qtf): a bag, so two words of one stem count twice."""
    pairs = questions.select("question_id", F.explode(X.query_terms(F.col("question"))).alias("term"))
    return (with_stems(pairs, "term") if stem else pairs).groupBy("question_id", "term").agg(F.count("*").alias("qtf"))


def boosts(chunks: DataFrame, share: DataFrame | None = None) -> DataFrame:
    """chunks with boost. share: the share of .py chunks, where it is known."""
    share = chunks.agg(F.avg(F.col("path").endswith(".py").cast("double")).alias("share")) if share is None else share
    return chunks.crossJoin(share).withColumn("boost", boost_of(kind_of(F.col("path")), F.col("share"))).drop("share")


def narrowed(index: Index, qterms: DataFrame, most: int = MOST_TERMS) -> Index:
    """The index without terms that no question has, where they have no more than `most`."""
    named = [r["term"] for r in qterms.select("term").distinct().limit(most + 1).collect()]
    return index if len(named) > most else index.of_terms(named)


def scores(index: Index, qterms: DataFrame, boosted: bool = False) -> DataFrame:
    """(question_id, chunk_id, score) of all chunks that share a term with the question, to 6 places.

    The questions' weighed terms are stored first: their true size then decides whether they are sent to the postings or both are shuffled.
    """
    weight = materialise(qterms.join(index.term_stats.select("term", "idf"), "term").select("question_id", "term", (F.col("idf") * F.col("qtf")).alias("weight")), "weights")
    return _summed(index.postings.join(weight, "term"), index, boosted)


def _summed(hits: DataFrame, index: Index, boosted: bool) -> DataFrame:
    hits = hits.crossJoin(F.broadcast(index.stats.select("avgdl", "py_share")))
    w = S.bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("weight"))
    boost = boost_of(F.col("kind"), F.col("py_share")) if boosted else F.lit(1.0)
    out = hits.groupBy("question_id", "chunk_id").agg(F.sum(w).alias("w"), F.first(boost).alias("boost"))
    return out.select("question_id", "chunk_id", F.round(F.col("w") * F.col("boost"), 6).alias("score"))


def bounds(index: Index, weights: DataFrame) -> DataFrame:
    """(question_id, zone, bound, work): what no chunk of the zone can exceed before the boost, and how many postings it takes to score them.

    weights (question_id, term, weight). Only the blocks' terms, zones and highest weights are read.
    """
    known = index.blocks.select("term", "zone", "n", "most").join(F.broadcast(weights), "term")
    return known.groupBy("question_id", "zone").agg(F.sum(F.greatest(F.lit(0.0), F.col("weight") * F.col("most"))).alias("bound"), F.sum("n").alias("work"))


def of_zones(index: Index, weights: DataFrame, zones: DataFrame, boosted: bool) -> DataFrame:
    """scores() of the chunks of zones (question_id, zone): the entries of other blocks are not unpacked."""
    hits = index.blocks.select("term", "zone", "entries").join(F.broadcast(weights), "term").join(zones.select("question_id", "zone"), ["question_id", "zone"])
    return _summed(hits.select("question_id", "weight", F.inline("entries")), index, boosted)


def reaching(index: Index, weights: DataFrame, k: int, boosted: bool = False) -> DataFrame:
    """bounds() of the zones that may hold one of a question's k best.

    The zones of highest bound are scored first; the k-th best score there is one that the k best of all reach. A zone is left out
    only if its bound, with the boost and what rounding may add, is below that.
    """
    spark = weights.sparkSession
    zones = small(bounds(index, weights))
    seeds = best(zones.where("bound > 0"), SEEDS, "bound", tie="zone")
    seen = best(of_zones(index, weights, seeds, boosted).where("score > 0"), k).where(F.col("rank") == k)
    least = [(r["question_id"], r["score"]) for r in seen.select("question_id", "score").collect()]
    known = spark.createDataFrame(least, T.StructType([weights.schema["question_id"], T.StructField("least", T.DoubleType())]))
    top = F.lit(S.BOOST if boosted else 1.0)
    return zones.join(F.broadcast(known), "question_id", "left").where((F.col("bound") > 0) & (F.col("least").isNull() | (F.col("bound") * top * (1 + 1e-9) + 1e-6 >= F.col("least")))).drop("least")


def weighed(index: Index, qterms: DataFrame, most: int = MOST_ASKED) -> tuple[Index, DataFrame] | None:
    """The index of the questions' terms, and (question_id, term, weight) sent with the plan; None for more rows than `most`."""
    asked = qterms.select("question_id", "term", "qtf").limit(most + 1).collect()
    if len(asked) > most:
        return None
    terms = sorted({r["term"] for r in asked})
    index = index.of_terms(terms) if len(terms) <= MOST_TERMS else index
    stats = index.term_stats if len(terms) <= MOST_TERMS else index.term_stats.join(F.broadcast(qterms.sparkSession.createDataFrame([(t,) for t in terms], "term string")), "term")
    idf = {r["term"]: r["idf"] for r in stats.select("term", "idf").collect()}
    rows = [(r["question_id"], r["term"], idf[r["term"]] * r["qtf"]) for r in asked if r["term"] in idf]
    return index, qterms.sparkSession.createDataFrame(rows, T.StructType([qterms.schema["question_id"], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))


def top(index: Index, qterms: DataFrame, k: int, boosted: bool = False) -> DataFrame:
    """(question_id, chunk_id, score, rank) of each question's k best chunks with a score above 0, equal to best(scores(...)).

    Of a published index only the zones that may hold one are scored. qterms is read once or twice.
    """
    sent = weighed(index, qterms) if index.blocks is not None else None
    if sent is None:
        return best(scores(narrowed(index, qterms), qterms, boosted).where("score > 0"), k)
    index, weights = sent
    return best(of_zones(index, weights, reaching(index, weights, k, boosted), boosted).where("score > 0"), k)


def search(index: Index, qterms: DataFrame, questions: DataFrame, k: int, boosted: bool = False) -> DataFrame:
    """top(), for questions of fewer than k such chunks filled up as padded() does."""
    found = small(top(index, qterms, k, boosted))
    counts = found.groupBy("question_id").agg(F.count("*").alias("n"))
    lacking = small(questions.select("question_id").distinct().join(counts, "question_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("question_id"))
    if lacking.isEmpty():
        return found
    few = F.broadcast(lacking)
    scored = materialise(scores(narrowed(index, part := qterms.join(few, "question_id")), part, boosted), "scored")
    rest = padded(scored, questions.join(few, "question_id"), index.chunks, k)
    return found.join(few, "question_id", "left_anti").unionByName(rest.select(*found.columns))


def small(rows: DataFrame, most: int = MOST_ASKED) -> DataFrame:
    """rows computed once: up to `most` of them sent with later plans, more in a stored table."""
    held = rows.limit(most + 1).collect()
    return rows.sparkSession.createDataFrame(held, rows.schema) if len(held) <= most else materialise(rows, "rows")


def located(index: Index, found: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """found, computed already, with path, first and last of its chunks: at most `most` different ones are looked up in the row groups that hold them."""
    ids = [r["chunk_id"] for r in found.select("chunk_id").distinct().limit(most + 1).collect()]
    spans = index.chunks.select("chunk_id", "path", "first", "last")
    return found.join(spans if len(ids) > most else spans.where(F.col("chunk_id").isin(*ids) if ids else F.lit(False)), "chunk_id")


def best(scored: DataFrame, k: int, by: str = "score", key: str = "question_id", tie: str = "chunk_id") -> DataFrame:
    """The k best rows per question with rank from 1; equal scores by id. The limit is applied before rows are shuffled."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(by).desc(), F.col(tie)))).where(F.col("rank") <= k)


def padded(scored: DataFrame, questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best of all chunks, those that share no term scoring 0: min(k, chunks) rows for each question.

    Only questions with fewer than k positive scores are padded, from the first chunks by id: as many as such a question has matches, and k more.
    """
    positive = scored.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0).alias("p"))
    lacking = questions.select("question_id").distinct().join(positive, "question_id", "left").where(F.coalesce("p", F.lit(0)) < k).select("question_id", F.coalesce("n", F.lit(0)).alias("n"))
    most = lacking.agg(F.max("n").alias("n")).first()["n"]
    if most is None:
        return best(scored, k)
    first = chunks.select("chunk_id").orderBy("chunk_id").limit(most + k)
    zeros = lacking.select("question_id").crossJoin(first).join(scored.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return best(scored.unionByName(zeros), k)


def cosine(vectors: DataFrame, queries: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(question_id, id, cosine) of unit vectors, every pair of a stated query and a row; queries (question_id, vector)."""
    return vectors.crossJoin(queries).select("question_id", id_col, F.round(S.dot(F.col("embedding"), F.col("vector")), 6).alias("cosine"))


def ranked(rows: DataFrame, by: str, name: str, key: str = "question_id", tie: str = "chunk_id") -> DataFrame:
    """rows with their rank among all of the question's, however many chunks there are."""
    return numbered(rows, [F.col(by).desc(), F.col(tie)], name, (key,))


def hybrid(bm25: DataFrame, cosines: DataFrame, k: int) -> DataFrame:
    """The k best by reciprocal rank fusion of boosted BM25 and cosine; both ranks run over all chunks, those without a shared term score 0."""
    both = cosines.join(bm25, ["question_id", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    r = ranked(ranked(both, "score", "r_bm25"), "cosine", "r_cos")
    return best(r.withColumn("fused", F.round(S.fused(F.col("r_bm25"), F.col("r_cos")), 9)), k, "fused")


def results(top: DataFrame, index_chunks: DataFrame, question: Column | None = None) -> DataFrame:
    """(question_id, retrieved_sources): spans best first."""
    span = F.struct(F.col("path").alias("file_path"), F.col("first").alias("first_character_index"), F.col("last").alias("last_character_index"))
    rows = top.join(index_chunks, "chunk_id").select("question_id", F.struct("rank", span.alias("span")).alias("r"))
    return rows.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["span"]).alias("retrieved_sources"))
