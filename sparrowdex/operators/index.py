"""The inverted index: terms of chunks, postings, document frequencies and lengths."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowdex.functions import scoring as S
from sparrowdex.functions import text as X
from sparrowdex.functions.stem import with_stems
from sparrowdex.storage import drop_path

#: Chunks of a zone, as a power of two, where ids count from 0.
ZONE_BITS = 4


def chunk_terms(chunks: DataFrame, least: int = S.MIN_TOKENS) -> DataFrame:
    """chunks of at least that many tokens, with terms: those of the text and of the path, without stop words."""
    code = F.col("path").endswith(".py")
    return chunks.withColumn("raw", X.tokens(F.col("text"), code)).where(F.size("raw") >= least).withColumn("terms", X.without_stop_words(F.concat("raw", X.tokens(F.col("path"), code)))).drop("raw")


def kind_of(path: Column) -> Column:
    """1 for Python files, 2 for other kinds whose chunks may count more, else 0."""
    return F.when(path.endswith(".py"), 1).when(X.suffix(path).isin(*X.BOOSTED_DOCS), 2).otherwise(0).cast("byte")


def boost_of(kind: Column, share: Column) -> Column:
    """Files of the kind that has under 0.3 of the chunks count 1.2 times; share: that of .py chunks."""
    rare = F.when(share < S.MIN_RATIO, kind == 1).when(1 - share < S.MIN_RATIO, kind == 2).otherwise(False)
    return F.when(rare, S.BOOST).otherwise(1.0)


@dataclass
class Index:
    """chunks (chunk_id, path, first, last) by chunk_id, postings (chunk_id, term, tf, dl, kind), term_stats (term, df, idf), stats (n, avgdl, py_share, avg_idf).

    A published index also has blocks (term, zone, n, most, entries), by term and zone: a zone is a run of chunks, and most is the highest weight,
    before idf and boost, that one of the block's n entries (chunk_id, tf, dl, kind) has.
    """

    chunks: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    stats: DataFrame
    blocks: DataFrame | None = None

    @classmethod
    def read(cls, spark, path: str) -> Index:
        chunks, blocks, term_stats, stats = (spark.read.parquet(f"{path}/{n}") for n in ("chunks", "blocks", "term_stats", "stats"))
        return cls(chunks, flat(blocks), term_stats, stats, blocks)

    def of_terms(self, terms: list[str]) -> Index:
        """Only what concerns these terms: scans then skip the row groups without one."""
        asked = F.col("term").isin(*terms) if terms else F.lit(False)
        blocks = self.blocks.where(asked) if self.blocks is not None else None
        return replace(self, postings=self.postings.where(asked) if blocks is None else flat(blocks), term_stats=self.term_stats.where(asked), blocks=blocks)


def flat(blocks: DataFrame) -> DataFrame:
    return blocks.select("term", F.inline("entries")).select("chunk_id", "term", "tf", "dl", "kind")


def _counted(terms: Column) -> Column:
    """array<struct<term, tf>> of an array of terms: runs of the sorted terms, so a chunk is counted where it is."""
    run = F.array_sort(terms)

    def of_sorted(t: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i) != F.get(t, i - 2)))
        return F.get(F.transform(F.array(heads), lambda h: F.transform(h, lambda at, k: F.struct(F.element_at(t, at).alias("term"), (F.coalesce(F.get(h, k + 1), F.size(t) + 1) - at).cast("long").alias("tf")))), F.lit(0))

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(terms) > 0, F.get(F.transform(F.array(run), of_sorted), F.lit(0))).otherwise(empty)


def postings_of(terms: DataFrame, stem: bool = False) -> DataFrame:
    """(chunk_id, term, tf, dl, kind) of terms (chunk_id, path, terms): a map, no shuffle; stemmed, a chunk may have several rows of one term."""
    pairs = terms.select("chunk_id", F.size("terms").alias("dl"), kind_of(F.col("path")).alias("kind"), F.inline(_counted(F.col("terms"))))
    return (with_stems(pairs, "term") if stem else pairs).select("chunk_id", "term", "tf", "dl", "kind")


def _once(postings: DataFrame) -> DataFrame:
    return postings.groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"), F.first("kind").alias("kind"))


def totals(terms: DataFrame) -> DataFrame:
    """One row (n, avgdl, py_share); a chunk without terms counts."""
    return terms.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"), F.avg(F.col("path").endswith(".py").cast("double")).alias("py_share"))


def unfloored(postings: DataFrame, total: DataFrame) -> DataFrame:
    """(term, df, idf0): inverse document frequencies before the floor."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(total.select("n"))).select("term", "df", S.idf(F.col("df"), F.col("n")).alias("idf0"))


def floored(raw: DataFrame, mean: DataFrame) -> DataFrame:
    """(term, df, idf): negative ones become a share of the mean."""
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf0") < 0, S.EPSILON * F.col("avg_idf")).otherwise(F.col("idf0")).alias("idf"))


def average(raw: DataFrame) -> DataFrame:
    return raw.agg(F.avg("idf0").alias("avg_idf"))


def build(terms: DataFrame, stem: bool = False) -> Index:
    """terms (chunk_id, path, first, last, terms), all computed when asked for. The length of a chunk counts its terms; a chunk without terms counts in n."""
    postings, total = postings_of(terms, stem), totals(terms)
    postings = _once(postings) if stem else postings
    raw = unfloored(postings, total)
    mean = average(raw)
    return Index(terms.select("chunk_id", "path", "first", "last"), postings, floored(raw, mean), total.crossJoin(mean))


def blocks_of(postings: DataFrame, avgdl: DataFrame, zone: Column) -> DataFrame:
    """(term, zone, n, most, entries) of stored postings, in ranges of (term, zone): a term of all chunks is dealt over as many tasks as it needs.

    A zone has a bounded number of chunks, and so has a block; its rows are put together where the range has brought them.
    """
    dealt = postings.withColumn("zone", zone).repartitionByRange("term", "zone")
    once = dealt.groupBy("term", "zone", "chunk_id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"), F.first("kind").alias("kind"))
    weighed = once.crossJoin(F.broadcast(avgdl)).withColumn("w", S.bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.lit(1.0)))
    held = weighed.groupBy("term", "zone").agg(F.count("*").alias("n"), F.max("w").alias("most"), F.array_sort(F.collect_list(F.struct("chunk_id", "tf", "dl", "kind"))).alias("entries"))
    return held.sortWithinPartitions("term", "zone")


def publish(terms: DataFrame, path: str, stem: bool = False, zone: Column | None = None) -> Index:
    """build() as tables below path, each from those already written.

    terms is read several times, so give a stored table. zone: the run of chunks that a chunk is in, of some 16 (ids are taken to count
    from 0 without it). Blocks lie in the order of their terms and zones, chunks in that of their ids, so a search reads the row groups
    of its terms and of the chunks that it finds. A column text of terms goes into the chunks.
    """
    spark = terms.sparkSession

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    put(terms.select("chunk_id", "path", "first", "last", *[c for c in terms.columns if c == "text"]).repartitionByRange("chunk_id").sortWithinPartitions("chunk_id"), "chunks")
    total = put(totals(terms), "totals")
    postings = put(postings_of(terms, stem), "postings")
    blocks = put(blocks_of(postings, total.select("avgdl"), F.shiftright("chunk_id", ZONE_BITS) if zone is None else zone), "blocks")
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    raw = put(df.crossJoin(F.broadcast(total.select("n"))).select("term", "df", S.idf(F.col("df"), F.col("n")).alias("idf0")), "frequencies")
    mean = average(raw)
    put(floored(raw, mean).repartitionByRange("term").sortWithinPartitions("term"), "term_stats")
    put(total.crossJoin(mean), "stats")
    for name in ("frequencies", "totals", "postings"):
        drop_path(spark, f"{path}/{name}")
    return Index.read(spark, path)
