"""Ranked lexical search: postings in shards, a document-at-a-time merge in each, and the shards' best merged.

A shard is a block of documents, in the order of their ids, with a compressed posting list for every term: gaps between documents,
then occurrences, seven bits to a byte. No task sees more of a term than a shard has of it, so a term in every document is no
hot key. A question's lists are merged by a heap of their next documents; a second heap holds the best so far. Lists whose
highest possible scores together cannot beat the worst of those leave the heap: their documents are only looked up.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.llm.blocks import blocks
from sparrowdex.storage import materialise, ship

#: Terms in UTF-8, after lowering A to Z: all bytes of other characters than ASCII's are term characters.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
SHARD = "shard long, term string, df long, occurrences long, data binary"
_SHARD = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("occurrences", pa.int64()), ("data", pa.binary())])


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


def shrunk(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each value's bytes): seven bits to a byte, the lowest first, the high bit set on all but a value's last byte."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 10)) if len(v) else np.zeros(0, np.int64)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[(end - size)[has] + k] = (v[has] >> np.uint64(7 * k)) & np.uint64(127) | (np.uint64(128) * (size[has] > k + 1).astype(np.uint64))
    return out, end


def grown(data: np.ndarray) -> np.ndarray:
    """The values of shrunk() bytes."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    shift = (np.arange(len(data)) - np.repeat(first, last - first + 1)).astype(np.uint64) * np.uint64(7)
    return np.add.reduceat((data & 127).astype(np.uint64) << shift, first).astype(np.int64) if len(last) else np.zeros(0, np.int64)


class Counts:
    """Documents' terms as numbers, and how often each has them: a shard's documents while it fills."""

    def __init__(self):
        self.number_of: dict[bytes, int] = {}
        self.docs: list[tuple[int | None, int, array, array]] = []

    def add(self, key: int | None, words: list[bytes]) -> None:
        seen, n = Counter(words), self.number_of
        self.docs.append((key, len(words), array("i", [n.setdefault(w, len(n)) for w in seen]), array("i", seen.values())))


def shard_rows(number: int, counts: Counts) -> pa.RecordBatch:
    """A shard of documents that have terms: a row of null term with their ids and lengths, then a row for each term in order."""
    docs, number_of = sorted(counts.docs, key=lambda d: (d[0] is None, d[0] or 0)), counts.number_of
    count = [len(t) for _, _, t, _ in docs]
    names = sorted(number_of)
    rank = np.empty(len(names), np.int64)
    rank[[number_of[w] for w in names]] = np.arange(len(names))
    term = rank[np.concatenate([np.frombuffer(t, np.int32) for _, _, t, _ in docs])]
    order = np.argsort(term, kind="stable")
    term, doc, times = term[order], np.repeat(np.arange(len(docs)), count)[order], np.concatenate([np.frombuffer(t, np.int32) for _, _, _, t in docs]).astype(np.int64)[order]
    df = np.bincount(term, minlength=len(names))
    first = np.cumsum(df) - df
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    # Each term's gaps and then its occurrences, so the place of an entry is its own plus what other terms have put before it.
    place = np.arange(len(term)) + np.repeat(first, df)
    values = np.empty(2 * len(term), np.int64)
    values[place], values[place + np.repeat(df, df)] = gap, times
    data, end = shrunk(values)
    cut = np.concatenate([[0], end[2 * (first + df) - 1]])
    lists = [data[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    ids = np.array([[i or 0, i is None, n] for i, n, _, _ in docs], "<i8")
    columns = [[number] * (1 + len(names)), [None, *(w.decode() for w in names)], [len(docs), *df.tolist()], [int(ids[:, 2].sum()), *np.add.reduceat(times, first).tolist()], [ids.tobytes(), *lists]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SHARD.types, strict=True)], schema=_SHARD)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20) -> DataFrame:
    """The shards of documents with terms (ids are integers), as rows; store them. Nothing is shuffled: a task cuts its documents into
    blocks of shard_bytes of text, a longer text in a block of its own. Repeated rows are documents of their own, null and empty texts have no terms."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, Counts(), 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if words := terms_of(text.as_py()):
                    n = len(text.as_buffer())
                    if size and size + n > shard_bytes:
                        yield shard_rows(number, held)
                        number, held, size = number + 1, Counts(), 0
                    held.add(key, words)
                    size += n
        if held.docs:
            yield shard_rows(number, held)

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, SHARD)


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def merged(lists: Sequence[tuple[list[int], list[int], int]], k: int) -> list[tuple[int, int]]:
    """(score, document) of the k best above 0, any order; lists: (documents ascending, their scores, the highest of those).

    Equal scores go to the earlier document: as documents come in order, one that only equals the worst of k is not taken.
    """
    lists = sorted(lists, key=lambda x: x[2])
    reach = [0]
    for x in lists:
        reach.append(reach[-1] + x[2])
    at, best, least, looked = [0] * len(lists), [], 0, 0
    while looked < len(lists) and reach[looked + 1] <= least:
        looked += 1
    heap = [(lists[j][0][0], j) for j in range(looked, len(lists))]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            j = heap[0][1]
            docs, scores, _ = lists[j]
            score += scores[at[j]]
            at[j] += 1
            if j >= looked and at[j] < len(docs):
                heapq.heapreplace(heap, (docs[at[j]], j))
            else:
                heapq.heappop(heap)
        for j in range(looked - 1, -1, -1):
            if score + reach[j + 1] <= least:
                break
            docs, scores, _ = lists[j]
            at[j] = p = bisect_left(docs, doc, at[j])
            if p < len(docs) and docs[p] == doc:
                score += scores[p]
        if score > least:
            (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (score, -doc))
            if len(best) == k:
                least = best[0][0]
                now = looked
                while now < len(lists) and reach[now + 1] <= least:
                    now += 1
                if now > looked:
                    looked = now
                    heap = [x for x in heap if x[1] >= looked]
                    heapq.heapify(heap)
    return [(score, -doc) for score, doc in best]


def _answers(table: pa.Table, asked: list[tuple], weights: list[int], n: int, length: int, k: int) -> Iterator[tuple]:
    """(question, document id, score) of one shard's best for each question."""
    terms, data = table.column("number").to_pylist(), table.column("data").to_pylist()
    ids = np.frombuffer(data[terms.index(-1)], "<i8").reshape(-1, 3)
    lists = [(t, d) for t, d in zip(terms, data, strict=True) if t >= 0]
    if not lists:
        return
    size = ids[:, 2].astype(object) if 90 * n * int(ids[:, 2].max()) >= 1 << 63 else ids[:, 2]
    m = (10 + (90 * size * n) // length).astype(np.int64)
    values = grown(np.frombuffer(b"".join(d for _, d in lists), np.uint8))
    bounds = np.concatenate([[0], np.cumsum([int((np.frombuffer(d, np.uint8) < 128).sum()) for _, d in lists])]).tolist()
    held = {}
    for (t, _), a, b in zip(lists, bounds[:-1], bounds[1:], strict=True):
        docs, tf = np.cumsum(values[a : (a + b) // 2]), values[(a + b) // 2 : b]
        scores = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
        held[t] = docs.tolist(), scores.tolist(), int(scores.max())
    for q, numbers in asked:
        if found := [held[t] for t in numbers if t in held]:
            yield from ((q, None if ids[d, 1] else int(ids[d, 0]), s) for s, d in merged(found, k))


def search(shards: DataFrame, questions: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_terms: int = 100_000) -> DataFrame:
    """(item_id, rank, doc_id, score): each question's k best documents with a score above 0; equal scores by ascending document id, null ids last.

    shards: a stored index(). Questions are a stated set, sent in blocks of at most block_terms terms (a longer question is a block of its own) with their weights;
    each block is one pass over the shards, which gather their lists of the block's terms. Repeated rows of questions are asked once; rows of
    one id and several texts are questions of their own, and null and empty texts find nothing.
    """
    spark = shards.sparkSession
    ship(spark)
    kind = dict(questions.dtypes)[id_col]
    total = shards.where("term is null").agg(F.sum("df").alias("n"), F.sum("occurrences").alias("l")).first()
    n, length = total["n"] or 0, total["l"] or 0

    def of_block(block: list[tuple]) -> DataFrame:
        number_of: dict[bytes, int] = {}
        asked = [(q, [number_of.setdefault(t, len(number_of)) for t in words]) for q, (_, words) in enumerate(block)]
        names = [t.decode() for t in number_of]
        numbers = spark.createDataFrame([(t, i) for i, t in enumerate(names)] or [("", -2)], "term string, number int")
        hits = shards.join(F.broadcast(numbers), "term", "left").where("number is not null or term is null").withColumn("number", F.coalesce("number", F.lit(-1)))
        df = {r["number"]: r["df"] for r in hits.where("number >= 0").groupBy("number").agg(F.sum("df").alias("df")).collect()}
        sent = spark.sparkContext.broadcast((asked, [weight(df.get(i, 0), n) for i in range(len(names))], n, length, k))

        def run(table: pa.Table) -> pa.Table:
            rows = list(_answers(table, *sent.value))
            return pa.table([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 3)], names=["q", "doc_id", "score"])

        found = hits.select("shard", "number", "data").groupBy("shard").applyInArrow(run, "q long, doc_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= k)
        items = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"q long, item_id {kind}")
        return ranked.join(F.broadcast(items), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

    distinct = questions.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    rows = ((r["item_id"], list(dict.fromkeys(terms_of(r["text"])))) for r in distinct.toLocalIterator())
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in blocks((x for x in rows if x[1] and length), lambda x: len(x[1]), block_terms):
        out = out.unionByName(of_block(block))
    return out


def op12(spark, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(materialise(index(docs), "shards"), benchmark)


OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
tfs AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term, n_docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM asked JOIN weights USING (term) JOIN tfs USING (term), totals GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""
