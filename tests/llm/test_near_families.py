"""Large families of near copies and rows that are repeated very often."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparrowdex.llm import simhash
from sparrowdex.llm.components import components
from sparrowdex.storage import materialise


def family(spark, n, words=400):
    """n variants of one text, each with two runs of its own words."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for k in range(n):
        own = list(base)
        own[rng.randrange(words)] = f"x{k}"
        rows.append((k, " ".join(own)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_family_is_dealt_about_once(spark, monkeypatch):
    """1,500 variants meet in one group, and the sets that are sent to be judged are not three times their own bytes."""
    docs, seen = family(spark, 1500), {}
    kept = simhash.similar

    def counted(held, judge, block, block_bytes, **more):
        rows = spark.sparkContext.accumulator(0)

        def judged(group):
            rows.add(group.num_rows)
            return judge(group)

        out = kept(held, judged, block, block_bytes, **more)
        seen["sets"], seen["dealt"] = held.count(), rows
        return out

    monkeypatch.setattr(simhash, "similar", counted)
    got = simhash.near_copies(docs).collect()
    assert {r.component for r in got} == {0} and len(got) == 1500
    assert seen["sets"] == 1500 and 1500 <= seen["dealt"].value < 3 * 1500


def test_a_row_repeated_very_often(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join(["new", *words[1:]])
    once = spark.createDataFrame([(1, " ".join(words)), (2, near), (3, "another text that is quite alone here")], "doc_id long, text string")
    many = spark.range(100_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit(near).alias("text"))
    docs = once.unionByName(many)
    got = simhash.near_copies(docs).groupBy("id", "component").count().collect()
    assert {(r.id, r.component, r["count"]) for r in got} == {(1, 1, 1), (2, 1, 100_001), (3, 3, 1)}
    assert simhash.one_per_group(docs).count() == 2


def test_groups_of_several_families_lose_no_link(spark):
    """Groups whose candidates fall into families of all sizes, loners and chains, against all pairs; blocks much smaller than the groups."""
    rng = np.random.default_rng(11)
    sets, label = {}, {}
    for g in range(4):
        for f in range(6):
            base = rng.choice(2**40, 60, replace=False).astype(np.uint64)
            for _ in range(int(rng.integers(1, 25))):
                own = base.copy()
                own[rng.choice(60, int(rng.integers(0, 5)), replace=False)] = rng.choice(2**40, 1)
                node = len(sets)
                sets[node], label[node] = np.unique(own), g
    chain = rng.choice(2**40, 100, replace=False).astype(np.uint64)
    for k in range(0, 40):
        node = len(sets)
        sets[node], label[node] = np.unique(chain[k : k + 60]), 9
    held = materialise(spark.createDataFrame([(n, bytearray(s.tobytes()), label[n]) for n, s in sets.items()], "node long, shingles binary, label long"), "sets")

    def judge(group):
        import pyarrow as pa

        kept = dict(zip(group.column("node").to_pylist(), group.column("shingles").to_pylist(), strict=True))
        node = np.array(sorted(kept), np.int64)
        root = node[simhash.alike([np.frombuffer(kept[x], "<u8") for x in node.tolist()], 0.8)]
        return pa.table({"u": node[node != root], "v": root[node != root]})

    near = [(a, b) for a in sets for b in sets if a < b and label[a] == label[b] and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    want = {r.u: r.v for r in components(spark.createDataFrame(near, "u long, v long")).collect()}
    for block, block_bytes in ((5, 1 << 20), (1000, 2000), (1000, 1 << 20)):
        got = {r.u: r.v for r in components(simhash.similar(held, judge, block, block_bytes)).collect()}
        assert got == want
