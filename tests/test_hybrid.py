"""Hybrid search over all chunks without their ranks being stored."""

import random

import pytest
from pyspark.sql import functions as F

from sparrowdex.operators import index, order, rank, scan, vectors
from sparrowdex.plans import catalogue
from sparrowdex.storage import materialise, shared_path

SF = "/root/testdata/sf0.001"
QUESTIONS = [(1, "rare1 rare2 everywhere"), (2, "nothing known"), (3, "common1 rare7 everywhere"), (4, "no vector"), (5, None)]


def test_hybrid_equals_ranks_of_all_chunks(spark, monkeypatch):
    """Many chunks tie at no score or at their document's cosine; one question has no terms, one no vector, and some documents have none."""
    monkeypatch.setattr(vectors, "ROWS", 50)
    monkeypatch.setattr(scan, "QUESTIONS", 2)
    rng = random.Random(9)
    rows = [((d << 32) + 700 * c, f"f/{d}.{'py' if d % 5 == 0 else 'md'}", 0, 10, rng.choices(["everywhere", "common1"] + [f"rare{j}" for j in range(60)], k=rng.randint(0, 5))) for d in range(400) for c in range(rng.randint(1, 4))]
    terms = materialise(spark.createDataFrame(rows, "chunk_id long, path string, first int, last int, terms array<string>").repartition(3), "terms")
    held = spark.createDataFrame([(d, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(3)]) for d in range(0, 350)], "doc_id long, embedding array<float>")
    questions = spark.createDataFrame(QUESTIONS, "question_id long, question string")
    queries = held.where("doc_id in (1, 2, 3, 5)").select(F.col("doc_id").alias("question_id"), F.col("embedding").alias("vector"))
    asked = materialise(rank.question_terms(questions), "asked")
    built = index.build(terms)
    cosines = rank.cosine(held, queries, "doc_id").join(terms.select("chunk_id", F.shiftright("chunk_id", 32).alias("doc_id")), "doc_id").select("question_id", "chunk_id", "cosine")
    want = rank.hybrid(rank.scores(built, asked, True), cosines, 10)
    got = vectors.hybrid(scan.publish(terms, shared_path(spark, "statistics")), asked, held, queries, 10)
    pick = lambda df: sorted((r.question_id, r["rank"], r.chunk_id, r.fused) for r in df.collect())
    assert pick(got) == pick(want) and len({r[0] for r in pick(got)}) == 4


def test_hybrid_stores_no_ranks(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("ranks of all pairs are stored")

    for module, f in ((rank, "numbered"), (order, "materialise"), (rank, "scores"), (index, "publish")):
        monkeypatch.setattr(module, f, refuse)
    assert catalogue.queries()["hybrid_topk"](spark, SF).count() > 0


@pytest.mark.parametrize("k", [1, 10])
def test_rows_beyond_the_depth_of_both_orders_cannot_be_among_the_first(k):
    depth = 60 + 2 * k
    assert round(2 / (60 + depth + 1), 9) < round(1 / (60 + k), 9)
