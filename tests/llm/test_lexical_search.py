"""Ranked search against its SQL and against plain loops."""

import collections
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import oracle
from sparrowdex.llm import lexical_search as L
from sparrowdex.llm import queries
from sparrowdex.llm.blocks import blocks

SF = "/root/testdata/sf0.001"


def plain(docs, items, k=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(i, pattern.findall(t.translate(lower))) for i, t in docs if t]
    held = [(i, w, collections.Counter(w)) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w, _ in held)
    df = collections.Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, w, c in held:
            m = 10 + (90 * len(w) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(pattern.findall((text or "").translate(lower))) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1)))
def test_compressed_values(values):
    data, end = L.shrunk(np.array(values, np.int64))
    assert L.grown(data).tolist() == values and len(end) == len(values)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(0, 6), min_size=1), max_size=6), st.integers(1, 5))
def test_merge_equals_sorting(lists, k):
    """With many ties: the earlier document wins, whatever the bounds leave out."""
    total = collections.Counter()
    for x in lists:
        total.update(x)
    want = sorted(((s, d) for d, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    got = L.merged([(sorted(x), [x[d] for d in sorted(x)], max(x.values())) for x in lists], k)
    assert sorted(got, key=lambda x: (-x[0], x[1])) == want


def test_merge_leaves_lists_out():
    """Once the best are full, a long list of low scores is looked up and no longer walked."""
    class Counted(list):
        read = 0

        def __getitem__(self, i):
            if isinstance(i, int):
                Counted.read += 1
            return list.__getitem__(self, i)

    n = 20_000
    common = Counted(range(n))
    rare = list(range(0, 200, 2))
    got = L.merged([(common, [1] * n, 1), (rare, [100] * len(rare), 100)], 3)
    assert sorted(got, reverse=True)[:3] == [(101, 4), (101, 2), (101, 0)] and Counted.read < n // 10


def test_query_equals_its_sql(spark):
    oracle.same(spark, oracle.connection(SF), SF, queries.queries()["op12_ranked_search"], L.OP12_SQL)


@pytest.mark.parametrize("shard_bytes", [1, 2000, 1 << 20])
def test_odd_documents_and_questions(spark, shard_bytes):
    """Nulls, ties, repeated rows and ids, a long text, clashing names, other scripts; shards and blocks of several sizes."""
    rng = random.Random(4)
    words = "alpha Beta gamma_delta é日本 ÑU 7 x-y ß".split() + [f"w{k}" for k in range(40)]
    docs = [(k if k % 7 else None, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(120)]
    docs += [(900, "same words here"), (900, "same words here"), (901, "same words here"), (902, None), (903, ""), (904, "!!! ???"), (905, "alpha " * 30_000 + "w1")] + [(-1, "copies of a text w3")] * 60
    items = [(1, "ALPHA w3 w3 beta"), (2, "same words HERE"), (3, None), (4, ""), (5, "no such term as zzzz"), (6, " ".join(words)), (7, "é日本 ñu ÑU"), (1, "ALPHA w3 w3 beta"), (None, "copies"), (1, "gamma delta")]
    frame = spark.createDataFrame([(*d, 1, "t", b"d") for d in docs], "doc_id long, text string, score int, term string, data binary").repartition(3)
    asked = spark.createDataFrame([(*i, "d", 3) for i in items], "item_id long, text string, doc_id string, q int")
    shards = L.materialise(L.index(frame, shard_bytes=shard_bytes), "shards")
    want = plain(docs, items)
    for block_terms in (1, 100_000):
        got = L.search(shards, asked, block_terms=block_terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.dtypes[1][1] == "int"
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_nothing_to_search(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.op12(spark, docs.limit(0), items).count() == 0 and L.op12(spark, docs, items.limit(0)).count() == 0
    assert [r.doc_id for r in L.op12(spark, docs, items).collect()] == [1]


def test_blocks_have_a_bound():
    assert list(blocks([3, 3, 9, 1, 1, 1], lambda x: x, 4)) == [[3], [3], [9], [1, 1, 1]] and list(blocks([], len, 1)) == []
