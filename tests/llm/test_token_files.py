"""Token files against the tokenizers library and plain arrays."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparrowdex.llm import queries, token_files
from sparrowdex.llm.packing import vocabulary
from sparrowdex.storage import shared_path

SF = "/root/testdata/sf0.001"


def reader(data):
    return lambda at, n: data[at : at + n]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**32 - 1)), max_size=1500), max_size=6))
def test_every_token_of_a_segment(docs):
    ids = [np.array(d, "<u4") for d in docs]
    whole = [x for d in docs for x in d]
    data = b"before" + token_files.segment(3, 17, [None if k % 3 == 1 else k - 2 for k in range(len(docs))], ids)
    s = token_files.Segment(reader(data), 6)
    assert (s.part, s.before, s.docs, s.n, s.size) == (3, 17, len(docs), len(whole), len(data) - 6)
    assert s.slice(0, s.n).tolist() == whole
    keys, starts = s.documents()
    assert keys == [None if k % 3 == 1 else k - 2 for k in range(len(docs))] and np.diff(starts).tolist() == [len(d) for d in docs]
    for at in {0, 1, 511, 512, 513, len(whole) // 2, len(whole) - 1} & set(range(len(whole))):
        assert s.token(at) == whole[at]
        assert s.slice(at // 2, at).tolist() == whole[at // 2 : at]
    with pytest.raises(IndexError):
        s.token(len(whole))


def test_a_token_reads_few_bytes():
    ids = np.random.default_rng(1).integers(0, 50257, 300_000)
    data, read = token_files.segment(0, 0, [1], [ids.astype("<u4")]), []

    def counted(at, n):
        read.append(n)
        return data[at : at + n]

    s = token_files.Segment(counted)
    for at in (0, 77_777, 299_999):
        read.clear()
        assert s.token(at) == ids[at] and sum(read) < 100 * len(s.levels)
    assert len(data) < 300_000 * 2.4


def test_widths_are_the_cheapest():
    """Against every way to cut: skewed ids get a short first level."""
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 4, 5000), (rng.pareto(0.4, 5000) * 3).clip(0, 2**32 - 1).astype(np.uint32), np.zeros(10, np.uint32), np.array([2**32 - 1])):
        ids = ids.astype(np.uint32)
        top = max(1, int(ids.max()).bit_length())
        bits = np.array([int(x).bit_length() for x in ids])

        def cost(cuts, bits=bits, top=top, n=len(ids)):
            at, out = 0, 0.0
            for w in cuts:
                out += (n if at == 0 else (bits > at).sum()) * (w + (1 + 32 / 512) * (at + w < top))
                at += w
            return out

        ways = [[top]] + [[a, top - a] for a in range(1, top)] + [[a, b, top - a - b] for a in range(1, top) for b in range(1, top - a)]
        got = token_files.level_widths(ids)
        assert sum(got) == top and cost(got) <= min(map(cost, ways)) + 1e-6


def want_rows(rows):
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    return out


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.queries()["op13_token_files"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and [t for _, t in got.dtypes] == ["bigint"] * 4
    assert sorted(map(tuple, got.collect())) == [r[:4] for r in want_rows([(r.doc_id, r.text) for r in docs.collect()])]


def test_odd_documents_and_random_access(spark):
    """Nulls, an empty and a long text, repeated rows and ids, special strings, clashing names, small segments; every position by random access."""
    rows = [(5, "five"), (3, None), (3, ""), (None, "no id"), (7, "seven " * 3000 + " " * 2000 + "<|endoftext|> é日本"), (-2, "first"), *[(4, "again and again")] * 40]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, part string, at int, value string").repartition(3)
    path = shared_path(spark, "files")
    token_files.write_tokens(docs, path, segment_ids=64, segments=2)
    want = want_rows(rows)
    got = sorted(token_files.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    plain = [r for r in want if r[0] != 3]
    assert [tuple(r) for r in got if r.doc_id != 3] == plain
    assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == 3) == sorted((r[2], r[3]) for r in want if r[0] == 3)
    ids = [i for r in want for i in r[4]]
    held = token_files.directory(spark, path)
    assert held.count() >= 4 and held.agg(F.sum("n")).first()[0] == len(ids)
    places = spark.range(len(ids)).unionByName(spark.createDataFrame([(-1,), (len(ids),), (0,), (None,)], "id long"))
    found = [(r.place, r.id) for r in token_files.tokens_at(places, held, "id", block=100).collect()]
    assert sorted(found) == sorted([*enumerate(ids), (0, ids[0])])


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, start long")
    assert token_files.op13(spark, docs).count() == 0
    assert token_files.op13(spark, spark.createDataFrame([(None, None)], "doc_id long, text string")).collect() == [(None, 0, 1, zlib.crc32(bytes(4)))]
