"""The engine end to end on a small corpus: index, search, answers, evaluation, command line, HTTP."""

import json
import math
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

from sparrowdex import __main__ as cli
from sparrowdex import storage, validate
from sparrowdex.engine import Engine
from sparrowdex.functions.stem import stem
from sparrowdex.functions.text import STOP_WORDS
from sparrowdex.operators import encode, rank
from sparrowdex.operators.order import numbered
from sparrowdex.sources import corpus
from pyspark.sql import functions as F

TOPICS = ["scheduler queue priority preemption", "tokenizer vocabulary merges bytes", "cache block eviction paging", "attention kernel softmax tiles"]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    raw = base / "raw"
    (raw / "docs").mkdir(parents=True)
    for i, topic in enumerate(TOPICS):
        lines = [f"Line {n} of part {i} says how {topic} are configured and measured in practice." for n in range(30)]
        (raw / "docs" / f"part{i}.md").write_text("\n".join(lines), encoding="utf-8")
    (raw / "run.py").write_text("import os\n\n\ndef launchServer(max_tokens, queue):\n    return [os.path.join(queue, str(n)) for n in range(max_tokens) if n and queue]\n", encoding="utf-8")
    (raw / "bad.txt").write_bytes(b"\xff\xfe not text at all, but enough words to make a chunk if it were read")
    (raw / "image.png").write_bytes(b"png")
    engine = Engine(spark, str(base / "home"))
    engine.index(str(raw), embeddings=True)
    return base, engine


def test_index_tables(world):
    _, engine = world
    chunks = engine.table("chunks").orderBy("chunk_id").collect()
    assert [r.chunk_id for r in chunks] == list(range(len(chunks)))
    assert [r.path for r in chunks][0] == "data/raw/run.py"
    assert {r.path for r in chunks} == {"data/raw/run.py"} | {f"data/raw/docs/part{i}.md" for i in range(4)}
    files = {r.path: r.text for r in engine.table("files").collect()}
    assert all(files[r.path][r["first"] : r["last"]].strip() == r.text for r in chunks)
    assert json.loads(open(engine.at + "/vectors.json").read())["num_chunks"] == len(chunks)


def test_search_equals_brute_force(world):
    _, engine = world
    chunks = engine.table("chunks").orderBy("chunk_id").collect()

    def words(text, code):
        import re

        if code:
            text = re.sub("(?<=[A-Z])(?=[A-Z][a-z])", " ", re.sub("(?<=[a-z])(?=[A-Z])", " ", text))
        return re.findall("[a-z0-9_]+" if code else "[a-záéíóúñ0-9]+", text.lower())

    bags = [[stem(w) for w in words(c.text, c.path.endswith(".py")) + words(c.path, c.path.endswith(".py")) if w not in STOP_WORDS] for c in chunks]
    n, avg = len(bags), sum(map(len, bags)) / len(bags)
    df = {t: sum(t in b for b in bags) for b in bags for t in b}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    share = sum(c.path.endswith(".py") for c in chunks) / n
    assert share < 0.3
    for query in ("How is the tokenizer vocabulary merged?", "launchServer max_tokens", "nothing here matches zebra"):
        q = [stem(t) for t in dict.fromkeys(words(query, True) + words(query, False)) if t not in STOP_WORDS]
        score = [round(sum(idf[t] * b.count(t) * 3 / (b.count(t) + 2 * (0.7 + 0.3 * len(b) / avg)) for t in q if t in idf) * (1.2 if c.path.endswith(".py") else 1.0), 6) for c, b in zip(chunks, bags, strict=True)]
        want = sorted(range(n), key=lambda i: (-score[i], i))[:4]
        got = engine.search(query, 4).collect()
        assert [(r.path, r["first"]) for r in got] == [(chunks[i].path, chunks[i]["first"]) for i in want]


def test_hybrid_search_and_its_cache(world):
    _, engine = world
    first = engine.search("cache block eviction", 3, hybrid=True).collect()
    assert first[0].path.endswith("part2.md")
    assert engine._cache("search_cache", "key string").count() == 1
    assert engine.search("cache block eviction", 3, hybrid=True).collect() == first
    assert engine._cache("search_cache", "key string").count() == 1


def dataset(base, engine):
    folder = base / "datasets"
    folder.mkdir(exist_ok=True)
    path = folder / "asked.json"
    chunks = engine.table("chunks").where("path like '%part1%'").orderBy("first").collect()
    gold = [{"file_path": c.path, "first_character_index": c["first"], "last_character_index": c["last"]} for c in chunks[:1]]
    rows = [{"question_id": "a", "question": "tokenizer vocabulary", "sources": gold, "answer": "x"}, {"question": "scheduler queue"}, {"question_id": "c", "question": "tokenizer merges", "sources": [{"file_path": "none", "first_character_index": 0, "last_character_index": 9}], "answer": ""}]
    path.write_text(json.dumps({"rag_questions": rows}), encoding="utf-8")
    return str(path)


def test_dataset_search_answers_and_recall(world):
    base, engine = world
    asked = dataset(base, engine)
    out = engine.search_dataset(asked, 4, str(base / "results"))
    doc = json.loads(open(out, encoding="utf-8").read())
    assert doc["k"] == 4 and [r["question"] for r in doc["search_results"]] == ["tokenizer vocabulary", "scheduler queue", "tokenizer merges"]
    assert all(len(r["retrieved_sources"]) == 4 for r in doc["search_results"])
    for cached in (False, True, True):
        answered = json.loads(open(engine.answer_dataset(out, str(base / "answers"), cached), encoding="utf-8").read())
        assert [len(r["retrieved_sources"]) for r in answered["search_results"]] == [3, 3, 3]
        files = {r.path: r.text for r in engine.table("files").collect()}
        for r in answered["search_results"]:
            s = r["retrieved_sources"][0]
            assert r["answer"] == files[s["file_path"]][s["first_character_index"] : s["last_character_index"]].split("\n")[0]
    assert engine._cache("answer_cache", "key string").count() == 3
    with pytest.warns(UserWarning, match="k is 4"):
        report = engine.evaluate(out, asked, 10).collect()
    gold = json.loads(open(asked).read())["rag_questions"][0]["sources"][0]
    at = [s == gold for s in doc["search_results"][0]["retrieved_sources"]].index(True) if gold in doc["search_results"][0]["retrieved_sources"] else 99
    assert [(r.k, r.recall, r.num_questions) for r in report] == [(k, 0.5 * (at < k), 2) for k in range(1, 5)]


def test_folders_of_lines_give_what_documents_give(spark, world):
    base, engine = world
    asked = dataset(base, engine)
    folder = str(base / "lines" / "asked")
    corpus.write_lines(corpus.dataset(spark, asked).repartition(3), folder)
    out, out_lines = engine.search_dataset(asked, 4, str(base / "r1")), engine.search_dataset(folder, 4, str(base / "r2"))
    read = [corpus.results(spark, p) for p in (out, out_lines)]
    held = [sorted((r.place, r.question, r.path, r["first"], r["last"], r["rank"]) for r in rows.collect()) for rows, _ in read]
    assert out_lines.endswith("/r2/asked") and held[0] == held[1] and len(held[0]) == 12 and read[0][1] == read[1][1] == 4
    assert engine.search_dataset(folder, 4, str(base / "r2")) == out_lines  # replaces
    answered = [engine.answer_dataset(p, str(base / to)) for p, to in ((out, "a1"), (out_lines, "a2"))]
    doc = {r["question"]: r["answer"] for r in json.loads(open(answered[0], encoding="utf-8").read())["search_results"]}
    assert {r.q.question: r.q.answer for r in spark.read.json(answered[1]).collect()} == doc and len(doc) == 3
    with pytest.warns(UserWarning, match="k is 4"):
        assert engine.evaluate(out_lines, folder).collect() == engine.evaluate(out, asked).collect()
    with pytest.raises(ValueError, match="different"):
        engine.evaluate(folder, folder)
    with pytest.raises(ValueError, match="overwritten"):
        engine.search_dataset(folder, 4, str(base / "lines"))


def test_evaluation_of_nothing_is_zero(world):
    base, engine = world
    empty, asked = base / "empty.json", dataset(base, engine)
    empty.write_text('{"search_results": [], "k": 5}')
    with pytest.warns(UserWarning):
        assert [tuple(r) for r in engine.evaluate(str(empty), asked).collect()] == [(1, 0.0, 2)]


def test_new_index_drops_vectors_and_caches(spark, world):
    base, _ = world
    engine = Engine(spark, str(base / "second"))
    engine.index(str(base / "raw"), embeddings=True)
    engine.search("cache", 1, hybrid=True).collect()
    engine.index(str(base / "raw"))
    with pytest.raises(FileNotFoundError, match="embeddings"):
        engine.search("cache", 1, hybrid=True)
    (base / "nothing").mkdir()
    with pytest.raises(ValueError, match="no chunk"):
        engine.index(str(base / "nothing"))
    assert engine.search("cache", 1).count() == 1


def test_command_line(world, capsys):
    base, engine = world
    a = cli.parser().parse_args(["search", "attention softmax", "--k", "2"])
    cli.run(engine, a)
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 2 and lines[0].startswith("data/raw/docs/part3.md [")
    with pytest.raises(ValueError):
        cli.run(engine, cli.parser().parse_args(["search", " ", "--k", "2"]))
    with pytest.raises(ValueError):
        cli.run(engine, cli.parser().parse_args(["search", "x", "--bonus", "maybe"]))


def test_http(world):
    from sparrowdex.server import make

    _, engine = world
    server = make(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(r) as f:
                return f.status, json.load(f)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert call("/health") == (200, {"status": "ok"})
        own = f"{storage.shared_dir(engine.spark)}/sparrowdex/{engine.spark.sparkContext.applicationId}"
        before = storage.children(engine.spark, own)
        code, out = call("/search", {"query": " scheduler queue ", "k": 2})
        assert code == 200 and out["question"] == "scheduler queue" and len(out["sources"]) == 2
        assert call("/search", {"query": "  "})[0] == 422 and call("/search", {"query": "x", "k": 11})[0] == 422
        assert call("/answer", {"query": "attention softmax"})[1]["answer"].startswith("Line")
        assert call("/nowhere")[0] == 404 and call("/search_dataset?k=2", {})[0] == 422
        assert call("/search_dataset?k=2&dataset_path=none&save_directory=x", {})[0] == 400
        assert len(before) and storage.children(engine.spark, own) == before
    finally:
        server.shutdown()
        server.server_close()


def test_hybrid_requests_leave_no_tables(spark, world):
    _, engine = world
    own = f"{storage.shared_dir(spark)}/sparrowdex/{spark.sparkContext.applicationId}"
    before = storage.children(spark, own)
    for n in range(2):
        with storage.temporaries(spark):
            assert engine.search(f"scheduler queue {n}", 2, hybrid=True).count() == 2
            assert len(storage.children(spark, own)) > len(before)
    assert storage.children(spark, own) == before
    with pytest.raises(ZeroDivisionError), storage.temporaries(spark):
        storage.materialise(spark.range(3), "rows")
        1 / 0
    assert storage.children(spark, own) == before


def test_checks(tmp_path):
    with pytest.warns(UserWarning):
        assert validate.chunk_size(100) == 800
    assert validate.chunk_size(1500) == 800 and validate.chunk_size(300) == 300
    for bad in (lambda: validate.chunk_size("5"), lambda: validate.count(0), lambda: validate.count(True), lambda: validate.count(11, 10), lambda: validate.port(70000), lambda: validate.file("", "dataset")):
        with pytest.raises(ValueError):
            bad()
    f = tmp_path / "d.json"
    f.write_text("{}")
    with pytest.raises(ValueError):
        validate.output(str(f), str(tmp_path))
    with pytest.raises(ValueError):
        validate.other_files(str(f), str(f))
    assert validate.output(str(f), str(tmp_path / "out")) == tmp_path / "out" / "d.json"


def test_numbers_over_hot_groups(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("g"), F.pmod(F.hash("id"), F.lit(50)).alias("v"), "id")
    got = numbered(rows, [F.col("v").desc(), F.col("id")], "n", ("g",)).toPandas()
    assert len(got) == 5000
    for _, part in got.groupby("g", dropna=False):
        ordered = part.sort_values(["v", "id"], ascending=[False, True])
        assert list(ordered["n"]) == list(range(1, len(part) + 1))
    assert numbered(rows.where("id < 0"), [F.col("id")], "n").count() == 0


def test_embedding_equals_its_pooling_in_sql(spark):
    model = encode.HashedWords()
    text = " ".join(f"w{i % 50}" for i in range(600))
    got = encode.embed(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")).collect()
    by = {r.id: np.array(r.embedding) for r in got}
    tokens = spark.createDataFrame([(1, model([text])[0].tolist())], "id long, vectors array<array<double>>")
    want = np.array(encode.pooled(tokens).first()["embedding"])
    assert np.allclose(by[1], want, atol=1e-6) and not by[2].any() and not by[3].any()
    near = rank.cosine(spark.createDataFrame([(1, by[1].tolist())], "chunk_id long, embedding array<float>"), spark.createDataFrame([("q", by[1].tolist())], "question_id string, vector array<float>"))
    assert near.first()["cosine"] == pytest.approx(1.0, abs=1e-5)


def test_a_sentence_model_sees_windows(spark, tmp_path, monkeypatch):
    """The adapter's windows and pooling, with a tokenizer of words and a session that returns a vector for each id."""
    import types

    import onnxruntime
    from tokenizers import Tokenizer, models, pre_tokenizers

    from sparrowdex.operators.models import onnx_encoder

    t = Tokenizer(models.WordLevel({"[UNK]": 0} | {f"w{i}": i + 1 for i in range(50)}, "[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "tokenizer.json"))
    table = np.random.default_rng(0).standard_normal((51, 8)).astype(np.float32)
    fake = types.SimpleNamespace(get_inputs=lambda: [types.SimpleNamespace(name="input_ids"), types.SimpleNamespace(name="attention_mask")], run=lambda _, feeds: [table[feeds["input_ids"]] * feeds["attention_mask"][..., None]])
    monkeypatch.setattr(onnxruntime, "InferenceSession", lambda path: fake)
    make = onnx_encoder(str(tmp_path), 256, 32)
    ids = [i % 50 + 1 for i in range(600)]
    got = [encode.window_mean(v, 0, 0) for v in make()([" ".join(f"w{i - 1}" for i in ids), "w3"])]
    assert make.name == tmp_path.name and np.allclose(got[0], encode.window_mean(table[ids], 256, 32), atol=1e-6)
    assert np.allclose(got[1], table[4] / np.linalg.norm(table[4]), atol=1e-6)


def test_a_spark_error_is_answered(world, monkeypatch):
    from pyspark.errors import AnalysisException

    from sparrowdex.server import make

    def lost(*args, **more):
        raise AnalysisException("a table is gone")

    engine = world[1]
    monkeypatch.setattr(engine, "search", lost)
    monkeypatch.setattr(engine, "nested", lost)
    server = make(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/search", json.dumps({"query": "tokenizer"}).encode()))
        assert e.value.code == 500 and "gone" in json.loads(e.value.read())["detail"]
    finally:
        server.shutdown()
        server.server_close()
