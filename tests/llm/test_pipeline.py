"""The pipeline's stages against what its operators say of the same documents."""

import collections
import re

import corpus_pipeline
from sparrowdex.llm import decontaminate, quality_rules, simhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def representatives(texts):
    """The smallest id of each component of near copies: every pair whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] == sets[y] or both and both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {ids[find(x)] for x in range(len(ids))}


def test_near_copies_are_those_that_share_most_shingles(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id is not null").collect()}
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    holders = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    group = {r.id: r.component for r in simhash.near_copies(docs).collect()}
    alike, caught = 0, 0
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                alike, caught = alike + 1, caught + (group[i] == group[j])
    assert caught >= 0.9 * alike > 0
    for i, g in group.items():
        if g != i:
            n = max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in group if j != i and group[j] == g)
            assert n > 0.5, (i, g, n)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        before = {r.doc_id: r for r in docs.collect()}
        if name == "quality rules":
            assert ids == {r.doc_id for r in quality_rules.op5(spark, docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
        elif name == "near-dedup":
            assert ids == representatives({r.doc_id: r.text for r in before.values()}) and len(ids) == kept.count()
        elif name == "decontamination":
            leaks = {r.doc_id for r in decontaminate.op2(spark, docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert ids == set(before) - leaks
        else:
            assert ids == set(before)
            size = collections.Counter()
            for r in kept.collect():
                size[r.sequence_id] += r.length
            assert max(size.values()) <= 2048
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == columns
        docs = kept


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
