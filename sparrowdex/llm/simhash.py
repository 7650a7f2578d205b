"""SimHash near-duplicates by vantage-point trees over parts of the fingerprint.

Fingerprints of ``parts`` disjoint bit parts: two that differ in at most ``radius`` bits differ in at most
``radius // parts`` bits of some part, so one tree per part, searched with that smaller radius, finds every pair.
Hamming distance over a part is a metric, so triangle bounds prune: a point at distance d from a vantage point has
all its neighbours between d - r and d + r, and only points in that ring around a split radius are sent to both shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.components import components
from sparrowdex.llm.joins import lookup
from sparrowdex.storage import materialise, ship

SEED = 42
#: A node of a tree with fewer points of the sample is not split.
FEWEST = 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of lower-cased (A-Z) word shingles, repeats counted; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return int(majority(np.array([digest(s, SEED) for s in shingles], dtype="<u8")))


def majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash that follows from a 64-bit hash."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null text counts as empty; null ids keep their row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, fp long")


def masks(parts: int) -> list[np.uint64]:
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    return [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def grow(sample: np.ndarray, total: int, mask: np.uint64, r: int, leaf: int, seed: int = SEED) -> list[tuple]:
    """A tree as a list of nodes (vantage, split radius, left, right), or None for a leaf; grown on a sample of total points."""
    rng = np.random.default_rng(seed)
    nodes: list = []

    def build(points: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(points) * total <= leaf * max(1, len(sample)) or len(points) < FEWEST:
            return at
        best = None
        for v in rng.choice(points, size=min(12, len(points)), replace=False):
            n = np.bincount(np.bitwise_count((points ^ v) & mask), minlength=66)
            below = np.cumsum(n)
            for mu in np.flatnonzero((below > 0.25 * len(points)) & (below < 0.75 * len(points))):
                ring = n[max(0, mu - r + 1) : mu + r + 1].sum() / len(points)
                cost = ring + abs(below[mu] / len(points) - 0.5)
                if best is None or cost < best[0]:
                    best = (cost, v, int(mu))
        if best is None:
            return at
        _, v, mu = best
        left = np.bitwise_count((points ^ v) & mask) <= mu
        a, b = build(points[left]), build(points[~left])
        nodes[at] = (np.uint64(v), mu, a, b)
        return at

    build(sample)
    return nodes


def route(nodes: list, fps: np.ndarray, mask: np.uint64, r: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indexes at home there, indexes that visit): of two neighbours in different leaves, the nearer to a vantage point visits the other."""

    def walk(at: int, home: np.ndarray, guest: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not len(home) and not len(guest):
            return
        if nodes[at] is None:
            yield at, home, guest
            return
        v, mu, a, b = nodes[at]
        dh = np.bitwise_count((fps[home] ^ v) & mask).astype(np.int16)
        dg = np.bitwise_count((fps[guest] ^ v) & mask).astype(np.int16)
        left = dh <= mu
        yield from walk(a, home[left], guest[dg - r <= mu])
        yield from walk(b, home[~left], np.concatenate([guest[dg + r > mu], home[left & (dh + r > mu)]]))

    every = np.arange(len(fps))
    yield from walk(0, every, every[:0])


def within(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, signs: np.ndarray | None, sign_radius: int) -> np.ndarray:
    """A matrix of whether points a and b link: by fingerprint and, where there are signatures, by those too."""
    near = np.bitwise_count(fps[a, None] ^ fps[None, b]) <= radius
    if signs is not None:
        r, c = np.nonzero(near)
        for at in range(0, len(r), 1 << 18):
            x, y = r[at : at + (1 << 18)], c[at : at + (1 << 18)]
            near[x, y] = np.bitwise_count(signs[a[x]] ^ signs[b[y]]).sum(axis=1, dtype=np.int64) <= sign_radius
    return near


def linked(fps: np.ndarray, home: np.ndarray, radius: int, signs: np.ndarray | None = None, sign_radius: int = 0) -> np.ndarray:
    """For each point the index of a root of its local component; pairs are never listed.

    Points without any neighbour drop out in a blocked count; the rest are joined by a breadth-first search
    that compares each frontier to the points not reached yet.
    """
    n, root = len(fps), np.arange(len(fps))
    there = np.flatnonzero(home)
    hit = np.zeros(n, bool)
    step = max(1, (1 << 21) // max(1, len(there)))
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))
        near = within(fps, rows, there, radius, signs, sign_radius)
        near[there[None, :] == rows[:, None]] = False
        hit[rows] |= near.any(axis=1)
        hit[there] |= near.any(axis=0)
    open_ = np.flatnonzero(hit)
    while len(open_):
        seed, frontier, open_ = open_[0], open_[:1], open_[1:]
        while len(frontier) and len(open_):
            reached = np.zeros(len(open_), bool)
            step = max(1, (1 << 21) // len(open_))
            for at in range(0, len(frontier), step):
                reached |= within(fps, frontier[at : at + step], open_, radius, signs, sign_radius).any(axis=0)
            frontier, open_ = open_[reached], open_[~reached]
            root[frontier] = seed
    return root


def spread(nodes: list, points: np.ndarray, total: int, mask: np.uint64, r: int, block: int) -> dict[int, int]:
    """How many blocks each leaf is cut into that the sample says will be home to over two blocks of points.

    Such leaves are left where many fingerprints agree in almost all bits of the part, so that no radius splits them.
    """
    held = {at: len(home) * total / max(1, len(points)) for at, home, _ in route(nodes, points, mask, r)}
    return {at: -int(-n // block) for at, n in held.items() if n > 2 * block}


def routed(nodes: DataFrame, radius: int, parts: int, leaf: int, sample: int, most_sample: int) -> DataFrame:
    """(shard, fp, node, home[, sign]): every node in each shard where it is at home or that it must visit.

    The trees are shaped by a sample of fingerprints and sent to executors: sample of them, or as many as leaves of about leaf
    fingerprints need, but no more than most_sample. Every fingerprint is routed and compared. A leaf that no radius splits is cut
    into blocks of about 2 leaf points by a hash, and every pair of blocks is a shard of its own, so that no task holds the leaf.
    """
    spark = nodes.sparkSession
    ship(spark)
    signed = "sign" in nodes.columns
    total = nodes.count()
    sample = min(most_sample, max(sample, total * FEWEST // leaf))
    chance = min(1.0, 1.2 * sample / max(1, total))
    drawn = nodes.select("fp", F.xxhash64("fp", "node").alias("h")).where(F.col("h") <= F.lit(int(-(2**63) + chance * (2**64 - 1)) if chance < 1 else 2**63 - 1)).orderBy("h", "fp").limit(sample)
    points = np.array([x["fp"] for x in drawn.collect()], np.int64).view(np.uint64)
    r, m = radius // parts, masks(parts)
    grown = [grow(points, total, x, r, leaf) for x in m]
    trees = spark.sparkContext.broadcast([(t, spread(t, points, total, x, r, 2 * leaf)) for t, x in zip(grown, m, strict=True)])

    def shards(part: int, at: int, idx: np.ndarray, node: np.ndarray, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(shard of each, indexes): points of a leaf that is cut go to the pairs of their block with every block."""
        first = part << 24 | at
        if blocks < 2:
            yield np.full(len(idx), first << 32, np.int64), idx
            return
        own = mixed(node[idx].view(np.uint64), 3) % np.uint64(blocks)
        step = max(1, (1 << 18) // blocks)
        for k in range(0, len(idx), step):
            a, b = np.repeat(own[k : k + step].astype(np.int64), blocks), np.tile(np.arange(blocks), len(own[k : k + step]))
            yield first << 32 | np.minimum(a, b) << 16 | np.maximum(a, b), np.repeat(idx[k : k + step], blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for part in range(parts):
                nodes_of, cut = trees.value[part]
                for at, home, guest in route(nodes_of, fp.view(np.uint64), m[part], r):
                    for idx, is_home in ((home, True), (guest, False)):
                        for shard, i in shards(part, at, idx, node, min(cut.get(at, 1), 1 << 16)) if len(idx) else ():
                            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[i]), pa.array(node[i]), pa.array(np.full(len(i), is_home)), *(c.take(pa.array(i)) for c in b.columns[2:])], names=["shard", "fp", "node", "home", "sign"][: 4 + signed])

    return nodes.select("fp", "node", *["sign"] * signed).mapInArrow(deal, "shard long, fp long, node long, home boolean" + ", sign binary" * signed)


def near_edges(nodes: DataFrame, radius: int = 4, parts: int = 3, leaf: int = 2048, sample: int = 20_000, most_sample: int = 1_000_000, sign_radius: int = 0) -> DataFrame:
    """nodes (fp, node), distinct nodes -> edges (u, v) that connect all nodes whose fingerprints lie within radius bits.

    With a column sign, a binary of whole 64-bit words, a link needs signatures within sign_radius bits besides.
    Edges form a star per shard and local component: no more rows than the shards hold.
    """
    signed = "sign" in nodes.columns

    def link(shard: pa.Table) -> pa.Table:
        fp = shard.column("fp").to_numpy().view(np.uint64)
        node = shard.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        signs = np.frombuffer(b"".join(shard.column("sign").to_pylist()), "<u8").reshape(len(fp), -1)[order] if signed else None
        root = linked(fp[order], shard.column("home").to_numpy()[order], radius, signs, sign_radius)
        u, v = node[order], node[order][root]
        return pa.table({"u": u[u != v], "v": v[u != v]})

    return routed(nodes, radius, parts, leaf, sample, most_sample).groupBy("shard").applyInArrow(link, "u long, v long")


def named_by_least(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """nodes (node, id, ...) with label, the number of the group that label (u, v) ties a node to, and component, the smallest id of the group."""
    tied = materialise(nodes.join(label, nodes.node == label.u, "left").select(*nodes.columns, F.coalesce("v", "node").alias("label")), "tied")
    least = tied.groupBy("label").agg(F.min("id").alias("component"))
    return lookup(tied, materialise(least, "least"), "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, **tree) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over fingerprints at most radius bits apart.

    One row per input row. Documents without a word share the zero fingerprint. Rows with a null id get the
    component of their fingerprint. Repeated rows and exact copies meet in one fingerprint, which is counted on
    the map side, so a hot text costs one row per task; rows of one id with different texts are judged by their texts.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("id")).select("fp", F.col("fp").alias("node"), "id"), "nodes")
    label = components(near_edges(nodes.select("fp", "node"), radius, **tree))
    return lookup(fps, materialise(named_by_least(nodes, label).select("fp", "component"), "named"), "fp").select("id", "fp", "component")


def op9(spark, docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """The sorted set of hashes of n-word shingles; fewer words are one shingle, no words none."""
    if not words:
        return np.zeros(0, "<u8")
    shingles = zip(*(words[i:] for i in range(n)), strict=False) if len(words) >= n else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in shingles), "<u8"))


def same_set(text: str | None, width: int = 5) -> tuple[bytes, np.ndarray]:
    """(digest, sorted hashes) of a text's set of width-word shingles."""
    h = shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), width)
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest(), h


def search_prints(text: str | None, width: int = 5, searches: int = 4, words_of: int = 4) -> tuple[bytes, list[int], bytes]:
    """(digest of same_set(), fingerprints, signature).

    The fingerprints are SimHashes of the set of word pairs under independent hashes: they move little under edits and serve the search. The
    signature holds words_of SimHashes of the set of width-word shingles, in 64 words_of bits, which tell how similar those sets are.
    Zeros where there is no word; fewer words than a shingle's are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h, pairs = shingle_hashes(words, width), shingle_hashes(words, 2)
    key = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
    if not words:
        return key, [0] * searches, bytes(8 * words_of)
    return key, [int(majority(mixed(pairs, 9 + k) if k else pairs)) for k in range(searches)], b"".join(majority(mixed(h, k)).tobytes() for k in range(words_of))


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the index of a root of its component over pairs of Jaccard similarity of at least similarity, counted exactly."""
    n = np.array([len(x) for x in sets], np.int64)
    every, root = np.unique(np.concatenate(sets), return_inverse=True)
    starts, at = np.concatenate([[0], np.cumsum(n)[:-1]]), np.arange(len(sets))
    held, done, mark = np.ones(len(sets), bool), np.arange(len(sets)), np.zeros(len(every), bool)
    for seed in at:
        if not held[seed]:
            continue
        held[seed], queue = False, [seed]
        while queue and held.any():
            x = queue.pop()
            own = root[starts[x] : starts[x] + n[x]]
            mark[own] = True
            both = np.add.reduceat(mark[root], starts, dtype=np.int64)
            mark[own] = False
            new = np.flatnonzero(held & (both / (n + n[x] - both) >= similarity))
            held[new], done[new] = False, seed
            queue += new.tolist()
    return done


def similar(held: DataFrame, judge: Callable[[pa.Table], pa.Table], block: int, block_bytes: int, pivots: int = 4, rounds: int = 2) -> DataFrame:
    """Edges (u, v) whose components are those of all similar pairs within the groups of stored sets (node, shingles, label).

    A group of one block is judged whole. Larger ones are dealt into random blocks, each with a few pivots that all blocks of the group
    share, and so once more those that are not one component yet: a family around a text falls together here, for little more than its own
    bytes a round. What is left apart after that is held against the whole group in pairs of blocks, so no similar pair is lost; that is quadratic only
    in sets that are candidates of each other without being similar.
    """
    spark = held.sparkSession
    size = held.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    groups = materialise(size.select("label", "n", blocks.alias("blocks")), "groups")
    number = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    edges = spark.createDataFrame([], "u long, v long")
    part = lookup(held, groups, "label")
    for k in range(rounds):
        is_pivot = F.pmod(F.xxhash64("node", F.lit(100 + k)), F.col("n")) < pivots
        dealt = part.select("node", "shingles", "label", F.explode(F.when(is_pivot, every(F.col("blocks"))).otherwise(F.array(number(F.col("blocks"), k)))).alias("i"))
        edges = materialise(edges.unionByName(dealt.groupBy("label", "i").applyInArrow(judge, "u long, v long")), "similar")
        if groups.where("blocks > 1").isEmpty():
            return edges
        joined = components(edges)
        of_node = held.select("node", "label").join(joined, F.col("node") == F.col("u"), "left").select("node", "label", F.coalesce("v", "node").alias("component"))
        of_node = materialise(of_node, "components")
        each = of_node.groupBy("label", "component").agg(F.count("*").alias("m"))
        most = each.groupBy("label").agg(F.count("*").alias("components"), F.max(F.struct("m", "component")).alias("top")).where("components > 1").select("label", "top")
        groups = materialise(groups.where("blocks > 1").select("label", "n", "blocks").join(most, "label").select("label", "n", "blocks", F.ceil((F.col("n") - F.col("top.m")) / block).cast("int").alias("apart"), F.col("top.component").alias("top")), "groups")
        if groups.isEmpty():
            return edges
        part = lookup(held, groups, "label").where("blocks is not null")
    apart = F.col("component") != F.col("top")
    rest = part.join(of_node.select("node", "component"), "node")
    whole = rest.select("node", "shingles", "label", F.explode(every(F.col("apart"))).alias("a"), number(F.col("blocks"), 50).alias("b"))
    others = rest.where(apart).select("node", "shingles", "label", number(F.col("apart"), 51).alias("a"), F.explode(every(F.col("blocks"))).alias("b"))
    return edges.unionByName(whole.unionByName(others).groupBy("label", "a", "b").applyInArrow(judge, "u long, v long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 7, parts: int = 4, sign_radius: int = 64, searches: int = 4, similarity: float = 0.8, block: int = 256, block_bytes: int = 16 << 20, **tree) -> DataFrame:
    """(id, h, label, component): component is the smallest id reachable over near copies, which share at least similarity of their width-word
    shingles; label is the number of the group, h the xxhash64 of the text.

    Candidates come from the trees: a search for each of several independent SimHashes of word pairs, each within radius bits, and
    256 bits of SimHash over shingles within sign_radius (sets of Jaccard similarity 0.8 differ in 39 of those on average, with a
    deviation of 6). Among candidates that hang together, every pair is then judged by the exact Jaccard similarity of its sets of
    shingles, as far as it is not in one component already (similar()). A pair that no search finds and no chain of candidates joins is missed. Groups are
    dealt out in blocks of about block texts and block_bytes of shingles, so no task holds a large group; a row that is repeated counts once. Nulls, repeated rows, rows of one id with different texts and texts without
    words are handled as by near_duplicates().
    """
    spark = docs.sparkSession
    ship(spark)
    fps = [f"fp{k}" for k in range(searches)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found, signs = zip(*(search_prints(t.as_py(), width, searches) for t in b.column(2)), strict=True) if b.num_rows else ((), (), ())
            found = np.array(found, np.uint64).reshape(-1, searches).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), *(pa.array(found[:, k]) for k in range(searches)), pa.array(signs, pa.binary())], names=["id", "h", "key", *fps, "sign"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, h = same_set(b.column(1)[i].as_py(), width)
                if key == b.column(2)[i].as_py() and len(h):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([h.tobytes()], pa.binary()), b.column(3).slice(i, 1)], names=["node", "shingles", "label"])

    def judge(group: pa.Table) -> pa.Table:
        kept = dict(zip(group.column("node").to_pylist(), group.column("shingles").to_pylist(), strict=True))
        node = np.array(sorted(kept), np.int64)
        root = node[alike([np.frombuffer(kept[x], "<u8") for x in node.tolist()], similarity)]
        return pa.table({"u": node[node != root], "v": root[node != root]})

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    prints = materialise(text.select("id", "h", "t").mapInArrow(run, "id long, h long, key binary" + "".join(f", {x} long" for x in fps) + ", sign binary"), "prints")
    # Each distinct set of shingles is a node, numbered once and for all by being stored, with one row's text for it.
    nodes = materialise(prints.groupBy("key", *fps, "sign").agg(F.min("id").alias("id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h"))).alias("row")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    # One search after another, so that only one holds memory.
    found = [materialise(near_edges(nodes.select(F.col(x).alias("fp"), "node", "sign"), radius, parts, sign_radius=sign_radius, **tree), "candidates") for x in fps]
    tied = components(reduce(DataFrame.unionByName, found))
    tied = tied.unionByName(tied.select(F.col("v").alias("u"), "v")).distinct()
    asked = nodes.where("id is not null").select("node", "key", "row.id", "row.h").join(tied, F.col("node") == F.col("u")).select("node", "id", "h", "key", F.col("v").alias("label"))
    # Copies of a row are one row before they leave their task.
    texts = text.join(asked, ["id", "h"]).groupBy("node").agg(F.first("t").alias("t"), F.first("key").alias("key"), F.first("label").alias("label"))
    held = materialise(texts.select("node", "t", "key", "label").mapInArrow(sets, "node long, shingles binary, label long"), "shingles")
    label = components(similar(held, judge, block, block_bytes))
    named = materialise(named_by_least(nodes.select("node", "id", "key"), label).select("key", "label", "component"), "named")
    return lookup(prints.select("id", "h", "key"), named, "key").select("id", "h", "label", "component")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id. Rows with a null id stay.

    Of rows that repeat that id in one group, the one of the smallest hash of its text stays; different texts under one id that are
    no near copies of each other are different groups' rows.
    """
    labels = near_copies(docs, id_col, text_col, **params)
    # Groups go by their number: two may have the same smallest id, under different texts.
    first = labels.where("id = component").groupBy("label").agg(F.min(F.struct("id", "h")).alias("first")).select("first.*")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("h"))
    kept = rows.where("id is not null").join(first, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    return kept.select("row.*").unionByName(rows.where("id is null").select("row.*"))
