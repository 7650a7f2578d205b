"""The layout of a published index, pruned search in it, and stems as columns."""

import random

import pytest
from pyspark.sql import functions as F

from sparrowdex.functions.stem import AFTER_1A, ALONE, SPECIAL, stem, with_stems
from sparrowdex.operators import index, rank
from sparrowdex.plans import fixtures
from sparrowdex.storage import materialise, shared_path


def terms_frame(spark, n=4000):
    """One term in every chunk, some in a few, with repeats, ties and chunks without terms."""
    rng = random.Random(7)
    rows = []
    for k in range(n):
        words = ["everywhere"] * rng.randint(1, 3) + [f"common{rng.randint(0, 5)}"] + rng.choices([f"rare{j}" for j in range(400)], k=rng.randint(0, 6))
        rows.append((k, f"f/{k}.{'py' if k % 5 == 0 else 'md' if k % 5 == 1 else 'yaml'}", 0, 10, [] if k % 97 == 0 else words))
    return materialise(spark.createDataFrame(rows, "chunk_id long, path string, first int, last int, terms array<string>"), "terms")


@pytest.fixture(scope="module")
def published(spark):
    """Small partitions stay apart, as large ones do."""
    terms = terms_frame(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return terms, index.publish(terms, shared_path(spark, "ix"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_term_of_every_chunk_is_dealt_over_files(spark, published):
    _, ix = published
    blocks = ix.blocks.withColumn("file", F.input_file_name())
    per_file = {r.file: r.n for r in blocks.groupBy("file").agg(F.sum("n").alias("n")).collect()}
    assert len(per_file) >= 3 and max(per_file.values()) <= 2 * sum(per_file.values()) / len(per_file)
    hot = blocks.where("term = 'everywhere'")
    assert hot.select("file").distinct().count() > 1 and hot.agg(F.max("n")).first()[0] <= 1 << index.ZONE_BITS


@pytest.mark.parametrize("stem_too", [False, True])
def test_blocks_hold_the_postings(spark, published, stem_too):
    terms, ix = published
    ix = index.publish(terms, shared_path(spark, "ix"), stem=True) if stem_too else ix
    want = {}
    for r in terms.collect():
        for t in r.terms:
            key = (r.chunk_id, stem(t) if stem_too else t)
            want[key] = want.get(key, 0) + 1
    assert {(r.chunk_id, r.term): r.tf for r in ix.postings.collect()} == want
    built = index.build(terms, stem_too)
    for name in ("term_stats", "stats"):
        near = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
        assert near(getattr(ix, name).collect()) == near(getattr(built, name).collect())
    assert ix.blocks.where(F.size("entries") != F.col("n")).count() == 0


QUESTIONS = [(1, "rare1 rare2 everywhere"), (2, "everywhere"), (3, "common1 rare7"), (4, "nothing known"), (5, "rare3 common2 everywhere rare4 rare3"), (6, None)]


@pytest.mark.parametrize("boosted", [False, True])
def test_pruned_search_equals_scoring_all(spark, published, boosted):
    _, ix = published
    asked = materialise(rank.question_terms(spark.createDataFrame(QUESTIONS, "question_id long, question string")), "asked")
    for k in (1, 3, 50):
        want = rank.best(rank.scores(ix, asked, boosted).where("score > 0"), k)
        got = rank.top(ix, asked, k, boosted)
        assert sorted(map(tuple, got.select("question_id", "rank", "chunk_id", "score").collect())) == sorted(map(tuple, want.select("question_id", "rank", "chunk_id", "score").collect()))


def test_few_postings_are_scored_for_small_k(spark, published, monkeypatch):
    monkeypatch.setattr(rank, "SEEDS", 2)
    _, ix = published
    asked = materialise(rank.question_terms(spark.createDataFrame([(1, "rare1 rare2 everywhere")], "question_id long, question string")), "asked")
    sent = rank.weighed(ix, asked)
    every = rank.bounds(*sent).agg(F.sum("work")).first()[0]
    scored = rank.reaching(*sent, 1).agg(F.sum("work")).first()[0]
    assert every > 4000 and scored * 5 < every


def test_more_questions_than_are_sent(spark, published, monkeypatch):
    """The join of all postings gives the same rows."""
    _, ix = published
    asked = materialise(rank.question_terms(spark.createDataFrame(QUESTIONS, "question_id long, question string")), "asked")
    want = sorted(map(tuple, rank.top(ix, asked, 3).select("question_id", "rank", "chunk_id", "score").collect()))
    monkeypatch.setattr(rank, "weighed", lambda *a: None)
    assert sorted(map(tuple, rank.top(ix, asked, 3).select("question_id", "rank", "chunk_id", "score").collect())) == want


def test_search_fills_up_from_the_first_chunks(spark, published):
    _, ix = published
    questions = spark.createDataFrame([(1, "nothing known"), (2, "rare1"), (3, "")], "question_id long, question string")
    rows = rank.search(ix, materialise(rank.question_terms(questions), "asked"), questions, 70).collect()
    got = {q: [r for r in sorted(rows, key=lambda r: r["rank"]) if r.question_id == q] for q in (1, 2, 3)}
    assert all([r["rank"] for r in x] == list(range(1, 71)) for x in got.values())
    assert [r.chunk_id for r in got[1]] == list(range(70)) == [r.chunk_id for r in got[3]] and got[2][0].score > 0 == got[2][69].score


def test_located_reads_what_it_names(spark, published):
    _, ix = published
    found = spark.createDataFrame([(1, 5), (2, 3999), (3, 5)], "question_id long, chunk_id long")
    for most in (1, 10):
        assert sorted((r.question_id, r.path) for r in rank.located(ix, found, most).collect()) == [(1, "f/5.py"), (2, "f/3999.yaml"), (3, "f/5.py")]


WORDS = """caresses ponies ties caress cats gas this kiwis dying skies inning proceed agreed feed plastered bled motoring sing hopping hoping tanned falling hissing fizzed failing filing
conflated troubled sized happy sky by say cry relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism
decisiveness hopefulness callousness formaliti sensitiviti sensibiliti geologi triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable
defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generate communal arsenal youth boyish saying
yes y's dogs' john's's 'quoted' bed luxuriated exceedingly succeeds eedly feedly übergang niño a_b_ing 123ing ing ed s ss us eed""".split()


def test_stems_of_a_column_equal_those_of_words(spark):
    words = sorted({*WORDS, *SPECIAL, *ALONE, *AFTER_1A, *(w for w, _ in fixtures.STEM_SAMPLE)})
    rows = with_stems(spark.createDataFrame([(w, w, "x") for w in [*words, None, ""]], "word string, stem string, _stem_x string"), "stem")
    assert rows.columns == ["word", "stem", "_stem_x"]
    got = {r.word: r.stem for r in rows.collect()}
    assert got.pop(None) is None and got.pop("") == "" and got == {w: stem(w) for w in words}


def test_stems_of_the_published_sample():
    assert all(stem(w) == s for w, s in fixtures.STEM_SAMPLE)
    assert [stem(w) for w in "hopping hoping relational generate skies happy cry".split()] == ["hop", "hope", "relat", "generat", "sky", "happi", "cri"]
