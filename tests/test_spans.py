"""Spans read from blocks of files equal slices of whole files."""

import random

from sparrowdex.operators import answer

SIZE = answer.BLOCK


def test_blocks_join_to_the_files(spark):
    texts = {"a": "", "b": "x" * SIZE, "c": "é\U0001f600\n\r" * (SIZE + 1), "d": "y" * (SIZE + 1), "n": None}
    rows = answer.blocks(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()
    for path, text in texts.items():
        parts = [r.text for r in sorted((r for r in rows if r.path == path), key=lambda r: r.block)]
        assert "".join(parts) == (text or "") and all(len(p) == SIZE for p in parts[:-1]) and len(parts) == (0 if text is None else max(1, -(-len(text) // SIZE)))


def test_spans_equal_slices(spark, tmp_path):
    rng = random.Random(3)
    texts = {f"f{n}": "".join(rng.choice("aé\n\U0001f600z") for _ in range(size)) for n, size in enumerate([0, 5, SIZE - 1, SIZE, SIZE + 1, 5 * SIZE + 7])}
    at = str(tmp_path / "blocks")
    answer.write_blocks(spark.createDataFrame(list(texts.items()), "path string, text string"), at)
    held = spark.read.parquet(at)
    spans = [(p, a, b) for p, t in texts.items() for a, b in [(0, len(t)), (0, 0), (len(t), len(t) + 9), (3 * SIZE, 3 * SIZE + 2), (9 * SIZE, 10 * SIZE), (SIZE - 1, SIZE + 1), *((rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)) for _ in range(20))]]
    rows = list(dict.fromkeys((p, a, max(a, b)) for p, a, b in [*spans, ("missing", 0, 5)]))
    found = spark.createDataFrame([(n, p, a, b, 1) for n, (p, a, b) in enumerate(rows)], "question_id int, path string, first int, last int, rank int")
    want = {n: texts[p][a:b] for n, (p, a, b) in enumerate(rows) if p in texts}
    for most in (0, 1000):
        got = answer.with_text(found, answer.of_spans(held, found, most)).collect()
        assert {r.question_id: r.text for r in got} == want and len(got) == len(want)


def test_few_spans_name_only_their_blocks(spark):
    held = answer.blocks(spark.createDataFrame([(f"f{n}", "x" * (20 * SIZE)) for n in range(10)], "path string, text string"))
    found = spark.createDataFrame([("q", "f3", 7 * SIZE - 2, 7 * SIZE + 2, 1)], "question_id string, path string, first int, last int, rank int")
    assert sorted((r.path, r.block) for r in answer.of_spans(held, found).collect()) == [("f3", 0), ("f3", 6), ("f3", 7)]
    assert answer.of_spans(held, found.limit(0)).count() == 0
