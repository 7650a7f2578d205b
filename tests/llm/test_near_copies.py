"""Near copies of the pipeline are decided by the exact similarity of their sets of shingles."""

import random

import numpy as np

from sparrowdex.llm import components, simhash


def jaccard(a, b):
    x, y = (set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


def edited(words, places):
    return " ".join(f"new{i}" if i in places else w for i, w in enumerate(words))


def test_links_follow_the_exact_similarity(spark):
    rng = random.Random(5)
    rows, stated = [], {}
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        # Runs of 5 changed words take 9 shingles each: 3 runs leave over 0.8, 5 leave about 0.74.
        runs = 3 if k % 2 else 5
        places = {s + i for s in rng.sample(range(10, 290, 10), runs) for i in range(5)}
        a, b = " ".join(words), edited(words, places)
        rows += [(2 * k, a), (2 * k + 1, b)]
        stated[2 * k + 1] = 2 * k if jaccard(a, b) >= 0.8 else 2 * k + 1
    got = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert len(set(stated.values()) & set(range(0, 120, 2))) == 30
    assert {i: got[i] for i in stated} == stated


def test_large_groups_are_judged_in_blocks(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, edited(words, {10 + k})) for k in range(90)] + [(200, "another text of some words that is alone")]
    got = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert got == dict.fromkeys(range(90), 0) | {200: 200}


def test_rows_of_one_id_and_any_column_names(spark):
    words = [f"w{i}" for i in range(200)]
    one, near, other = " ".join(words), edited(words, {7}), " ".join(reversed(words))
    rows = [(1, one, "a"), (1, other, "b"), (1, near, "c"), (2, near, "d"), (3, other, "e"), (4, one, "f"), (4, one, "f"), (None, one, "g"), (None, None, "h"), (9, None, "i")]
    docs = spark.createDataFrame([(*r, "x", 5, 6, None) for r in rows], "doc_id long, text string, _keep string, h string, label int, id int, row string")
    out = simhash.one_per_group(docs)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert [k for k in kept if k[0] == 1] in ([(1, one), (1, other)], [(1, other), (1, one)], sorted([(1, near), (1, other)]))
    assert [k for k in kept if k[0] != 1] == [(0, ""), (0, one), (9, "")]
    assert simhash.one_per_group(docs.limit(0)).count() == 0


def test_a_leaf_that_no_radius_splits_is_cut(spark):
    rng = np.random.default_rng(12)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(6000)}
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 1000)} | {x ^ 1 for x in list(fps)[:200]} | {centre ^ (0b11111 << int(k)) for k in range(0, 55, 3)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    nodes = spark.createDataFrame([(x, k) for k, x in enumerate(fps)], "fp long, node long")
    sizes = simhash.routed(nodes, 4, 3, 64, 2000, 2000).where("home").groupBy("shard").count().agg({"count": "max"}).first()[0]
    assert sizes <= 8 * 64 < len(fps) // 4
    got = {r.u: r.v for r in components.components(simhash.near_edges(nodes, 4, leaf=64, sample=2000, most_sample=2000)).collect()}
    bits, root = np.array(fps, np.int64).view(np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(bits[:k] ^ bits[k]) <= 4):
            a, b = sorted((find(k), find(int(j))))
            root[b] = a
    assert [got.get(k, k) for k in range(len(fps))] == [find(k) for k in range(len(fps))]


def test_components_with_a_hot_node(spark):
    edges = [(0, i) for i in range(1, 6000)] + [(9000, i) for i in range(6000, 9000)] + [(9000, 9001), (5, 9000), (10_000, 10_001)] + [(20_000 + i, 20_001 + i) for i in range(8000)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(1, 9002), 0) | {10_001: 10_000} | dict.fromkeys(range(20_001, 28_001), 20_000)
