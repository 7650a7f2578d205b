"""Files as a source: every name, relative roots, counts; spans of code and text by hand and by a slow reading of the rule."""

import importlib
import inspect
import os
import random
import re
import time

import pytest
from pyspark.sql import Observation

from sparrowdex.operators import chunking
from sparrowdex.operators.chunking import code_spans, text_spans
from sparrowdex.sources import corpus


@pytest.fixture
def root(tmp_path, monkeypatch):
    top = tmp_path / "root" / "root"
    for name, data in {"pkg/__init__.py": b"a = 1\r\nb = 2\r", "_ops.py": b"x = 1\n", "_sub/b.py": b"y = 1\n", ".github/x.md": b"# title", ".hidden.md": b"hidden", "pkg/a b%20é#1.txt": b"odd name", "plain.md": b"", "root/again.md": b"again", "no.txt": b"\xff\xfe", "_no.txt": b"\xff", "p.png": b"x", ".DS_Store": b"x", "a[1].md": b"brackets"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(data)
    monkeypatch.chdir(tmp_path)
    return top


def test_every_name_is_read(spark, root):
    want = {"data/raw/pkg/__init__.py": "a = 1\nb = 2\n", "data/raw/_ops.py": "x = 1\n", "data/raw/_sub/b.py": "y = 1\n", "data/raw/.github/x.md": "# title", "data/raw/.hidden.md": "hidden", "data/raw/pkg/a b%20é#1.txt": "odd name", "data/raw/plain.md": "", "data/raw/root/again.md": "again", "data/raw/a[1].md": "brackets"}
    relative = os.path.relpath(root, spark.sparkContext._jvm.System.getProperty("user.dir"))
    for at in (str(root), str(root) + "/", relative, f"{relative}/../root/"):
        seen = Observation()
        assert {r.path: r.text for r in corpus.files(spark, at, seen=seen).collect()} == want
        assert seen.get == {"files": 13, "skipped": 2, "unreadable": 2}


def test_an_unreadable_cache_is_empty(spark, tmp_path):
    at = str(tmp_path / "cache")
    assert corpus.cache(spark, at, "key string").count() == 0
    spark.createDataFrame([("k",)], "key string").coalesce(1).write.parquet(at)
    assert corpus.cache(spark, at, "key string").count() == 1
    for name in os.listdir(at):
        if name.endswith(".parquet"):
            (tmp_path / "cache" / name).write_bytes(b"PAR1 this is not a table PAR1")
            (tmp_path / "cache" / f".{name}.crc").unlink()
    with pytest.warns(UserWarning, match="cannot be read"):
        assert corpus.cache(spark, at, "key string").count() == 0


@pytest.mark.parametrize(
    ("source", "parts"),
    [
        ("import a\nX = 1\nimport b\n", ["import a\nX = 1\nimport b", "X = 1"]),
        ("# c\n\x0cdef f():\n    return 1\n\x0cclass A:\n    pass\n", ["# c", "def f():\n    return 1", "class A:\n    pass"]),
        ("x = 'a\u2028b'\ny = 2  # two\x85three\nz = 3\n", ["x = 'a\u2028b'", "y = 2", "# two\x85three", "z = 3"]),
        ("@wraps\ndef f():\n    # inside\n    return 1\n# after\n", ["@wraps\ndef f():\n    # inside\n    return 1", "# after"]),
        ("from __future__ import annotations\nimport a\n", ["from __future__ import annotations", "import a"]),
        ("é = 'é'; b = 2\r\nc = 3", ["é = 'é'", "b = 2", "c = 3"]),
        ("", []),
        ("import a\nx = [1,\n2\ndef g():\n    return '''abc\n\nclass K(object):\n    pass\n", ["import a", "x = [1,\n2", "def g():\n    return '''abc", "class K(object):\n    pass"]),
        ("@d\n@e(1)\ndef f():\n  exec 'x'\nif x:\n  y\nelse:\n  z\ntry:\n  raise E, 'x'\nexcept E, e:\n  pass\n# c\n", ["@d\n@e(1)\ndef f():\n  exec 'x'", "if x:\n  y\nelse:\n  z", "try:\n  raise E, 'x'\nexcept E, e:\n  pass", "# c"]),
        ("  odd = 1\r\nimport b\r\n)\r\nz = 'é\r\ny = 2", ["odd = 1", "import b", ")", "z = 'é", "y = 2"]),
        ("s = '''doc\ndef no(): pass\n'''\nx = = 2\nf(a,\n  b)\n\0\n", ["s = '''doc\ndef no(): pass\n'''", "x = = 2", "f(a,\n  b)", "\0"]),
        ("words of prose\nand more of it\n", ["words of prose\nand more of it\n"]),
        ('{"a": 1}\n{"b" 2}\n', ['{"a": 1}\n{"b" 2}\n']),
    ],
)
def test_code_spans(source, parts):
    assert sorted(source[a:b] for a, b in code_spans(source, 800)) == sorted(parts)


@pytest.mark.parametrize("module", ["argparse", "textwrap", "tokenize", "dataclasses", "bisect", "heapq", "shlex", "copy", "csv", "enum"])
def test_a_broken_statement_leaves_the_others_whole(module):
    """Modules that parse: the splitter finds the parser's nodes, and those on either side of a statement that does not parse stay as they are."""
    source = inspect.getsource(importlib.import_module(module))
    nodes = chunking._nodes(source)
    assert chunking._recovered(source) == nodes
    rng = random.Random(len(source))
    for broken in ("x = = 1\n", "print 'a'\n", "def f(:\n    y = (1,\n", "class A(object:\n    pass\n"):
        at = rng.choice([m.start() for m in re.finditer(r"^(?=def |class |import )", source, re.M) if any(a == m.start() for a, _, _ in nodes)])
        n, end = len(broken), at + len(broken.rstrip())
        want = [x for x in nodes if x[1] <= at] + [(at, end, False)] + [(a + n, b + n, i) for a, b, i in nodes if a >= at]
        assert chunking._recovered(source[:at] + broken + source[at:]) == want


def test_broken_code_takes_linear_time():
    start = time.monotonic()
    for text in ("\\\"\"\"" * 100_000 + "\nimport os\nx = = 1", "def f(:\n" * 20_000, "(\n" * 100_000 + "import os\n", "x = = 1\n# c\n" * 10_000, "import os\nx == \n" + "# c\n" * 30_000):
        spans = list(code_spans(text))
        assert all(0 <= a < b <= len(text) for a, b in spans)
    assert time.monotonic() - start < 60


def test_long_code_is_cut_without_loss():
    body = "x" * 7 + "\n" + "y" * 8 + "\n" + "z" * 8
    assert list(code_spans(f"'{body[1:]}", 10)) == list(text_spans(f"'{body[1:]}", 10))  # does not parse
    source = "f(a,\n  bb,\n   cccccccccccccccccccc)"
    spans = list(code_spans(source, 10))
    assert max(b - a for a, b in spans) <= 10 and "".join(source[a:b] for a, b in spans).replace("\n", "") == source.replace("\n", "")


def slow_windows(text, most):
    """Each window by trying every end from the farthest."""
    over, out, first = min(100, most // 2), [], 0
    while text and not (out and out[-1][1] == len(text)):
        last = len(text)
        if first + most < len(text):
            last = next((e for e in range(first + most - 1, first + over, -1) if text[e] == "\n"), first + most)
        out.append((first, last))
        first = last - over
    return out


def test_text_spans():
    rng = random.Random(4)
    assert list(text_spans("aaaa\nbbbbbbbbbb\ncccccccccc\ndd", 20)) == slow_windows("aaaa\nbbbbbbbbbb\ncccccccccc\ndd", 20)
    for _ in range(200):
        text = "".join(rng.choice("ab\n" if rng.random() < 0.1 else "abcdef") for _ in range(rng.choice([0, 1, 19, 20, 21, 300, 2000])))
        most = rng.choice([20, 200, 800])
        assert list(text_spans(text, most)) == slow_windows(text, most)


def test_files_written_by_tasks_are_read_back(spark, tmp_path):
    names = [f"{d}/f{n}{e}" for n, (d, e) in enumerate([("a b%20", ".md"), ("_x", ".txt"), (".y/z", ".py"), ("é#", ".rst")] * 25)]
    rows = spark.createDataFrame([(n, "" if k % 10 == 0 else f"text é {k}\n") for k, n in enumerate(names)] + [("empty.md", None)], "path string, text string").repartition(7)
    root = str(tmp_path / "made")
    assert corpus.write_files(rows, root) == 101
    assert corpus.write_files(rows, root) == 101  # as a task that runs again
    assert {r.path: r.text for r in corpus.files(spark, root, "p").collect()} == {"p/" + r.path: r.text or "" for r in rows.collect()}
    assert corpus.write_files(rows.limit(0), str(tmp_path / "none")) == 0
    with pytest.raises(Exception, match="no path"):
        corpus.write_files(spark.createDataFrame([(None, "x")], "path string, text string"), root)


def test_folders_of_lines_equal_documents(spark, tmp_path):
    span = [{"file_path": "a.md", "first_character_index": 1, "last_character_index": 9}]
    asked = spark.createDataFrame([(n, f"q{n}", f"line\n\"{n}\" é", span * (n % 3)) for n in range(300)], "place long, question_id string, question string, sources array<struct<file_path:string,first_character_index:int,last_character_index:int>>").repartition(5)
    corpus.write_lines(asked, str(tmp_path / "d"))
    corpus.write_document(asked.orderBy("place").drop("place"), "rag_questions", str(tmp_path / "d.json"))
    held = [sorted(map(tuple, corpus.dataset(spark, str(tmp_path / n)).collect())) for n in ("d", "d.json")]
    assert held[0] == held[1] and len(held[0]) == 300
    found = asked.withColumnRenamed("sources", "retrieved_sources")
    corpus.write_lines(found, str(tmp_path / "r"), k=7)
    corpus.write_document(found.orderBy("place").drop("place"), "search_results", str(tmp_path / "r.json"), k=7)
    (a, ka), (b, kb) = (corpus.results(spark, str(tmp_path / n)) for n in ("r", "r.json"))
    order = lambda rows: sorted(map(str, rows.collect()))
    assert ka == kb == 7 and order(a) == order(b) and a.where("rank is null").count() == 100
    assert a.rdd.getNumPartitions() > 1
    corpus.write_lines(asked.limit(0), str(tmp_path / "e"))
    assert corpus.dataset(spark, str(tmp_path / "e")).count() == 0 and corpus.results(spark, str(tmp_path / "e"))[1] == 0
