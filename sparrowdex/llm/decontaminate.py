"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

A passage of m characters that occurs in a text with at most k edits shares at least m + 1 - q (k + 1) of its q-grams
with the text, all on diagonals (text position less passage position) that spread over at most k. Bands of 2 (k + 1)
diagonals that overlap by half hold every such spread, so a band with fewer shared q-grams can be skipped unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.storage import ship

#: Unicode White_Space characters; runs of them count as one blank.
SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Text characters and diagonals that one call of align holds.
CELLS = 1 << 21
#: Pairs of an occurrence of a q-gram in a text and a place of it in a passage that are listed at a time.
HITS = 1 << 22
_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code points of the basic plane in lower case where that is one character, white space as a blank."""
    global _fold
    if _fold is None:
        _fold = np.arange(1 << 16, dtype=np.uint32)
        for i in range(1 << 16):
            if not 0xD800 <= i < 0xE000 and len(low := chr(i).lower()) == 1:
                _fold[i] = ord(low)
        _fold[SPACES] = 32
    return _fold


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points and the place of each in the text: lower case, white space runs as one blank, none at the ends."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(raw < 1 << 16, fold_table()[np.minimum(raw, (1 << 16) - 1)], raw)
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    if len(keep) and blank[0]:
        keep[0] = False
    at = np.flatnonzero(keep)
    if len(at) and blank[at[-1]]:
        at = at[:-1]
    return codes[at], at


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, by doubling."""
    h, size, out, done = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1, None, 0
    mix = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        while True:
            if q & size:
                out, done = (h, size) if out is None else (out[: max(0, len(out) - size)] * mix + h[done : done + max(0, len(out) - size)], done + size)
                if done == q:
                    return out ^ (out >> np.uint64(29))
            h = h[: max(0, len(h) - size)] * (mix + np.uint64(2 * size)) + h[size:]
            size *= 2


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all spans of size from first on, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Passages:
    """Benchmark passages, their q-grams and edit budgets."""

    def __init__(self, items: list[tuple[int, str]], q: int, error: float):
        self.q, self.ids, self.codes, self.budget, self.need = q, [], [], [], []
        hashes, owners, places = [], [], []
        for item, text in sorted(items):
            codes, _ = normalise(text)
            if not len(codes):
                continue
            k = int(error * len(codes))
            while k and len(codes) + 1 - q * (k + 1) < 1:  # a budget beyond which the lemma says nothing
                k -= 1
            g = grams(codes, q) if len(codes) >= q else np.zeros(0, np.uint64)
            if not len(g):
                continue
            hashes.append(g)
            owners.append(np.full(len(g), len(self.ids)))
            places.append(np.arange(len(g)))
            self.ids.append(item)
            self.codes.append(codes)
            self.budget.append(k)
            self.need.append(max(1, len(codes) + 1 - q * (k + 1)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], np.concatenate(owners)[order] if hashes else h, np.concatenate(places)[order] if hashes else h
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hash >> np.uint64(44)] = True
        self.budget, self.need = np.array(self.budget, np.int64), np.array(self.need, np.int64)

    def regions(self, codes: np.ndarray, window: int = 1 << 20) -> list[tuple[int, int]]:
        """(passage, first diagonal of a band) of all bands with enough shared q-grams.

        A text of more than window characters is read in windows that overlap by the longest match, so memory is bounded by the window.
        """
        reach = max(map(len, self.codes), default=0) + int(self.budget.max(initial=0))
        size = max(window, 2 * reach)
        if len(codes) <= size:
            return self._regions(codes, 0)
        out: dict[tuple[int, int], None] = {}
        for at in range(0, max(1, len(codes) - reach), size - reach):
            out |= dict.fromkeys(self._regions(codes[at : at + size], at))
        return list(out)

    def _regions(self, codes: np.ndarray, offset: int) -> list[tuple[int, int]]:
        if len(codes) < self.q or not len(self.hash):
            return []
        g = grams(codes, self.q)
        at = np.flatnonzero(self.bits[g >> np.uint64(44)])
        lo = np.searchsorted(self.hash, g[at], "left")
        n = np.searchsorted(self.hash, g[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return []
        # A passage needs that many places whose q-grams are in the text, wherever and however often; most texts stop here.
        first, which = np.unique(lo, return_inverse=True)
        size = np.zeros(len(first), np.int64)
        size[which] = n
        entry = _spans(first, size)
        enough = np.bincount(self.owner[entry], minlength=len(self.ids)) >= self.need
        keep = enough[self.owner[entry]]
        if not keep.any():
            return []
        return self._bands(at + offset, which, entry[keep], np.repeat(np.arange(len(first)), size)[keep], len(first))

    def _bands(self, at: np.ndarray, which: np.ndarray, entry: np.ndarray, gram: np.ndarray, grams_: int) -> list[tuple[int, int]]:
        """(passage, first diagonal of a band) from occurrences at, of q-grams numbered which, and the index's entries with the numbers of their q-grams.

        Passages are taken apart, and then a text of one passage's occurrences in overlapping halves, until few enough pairs are left to be listed.
        """
        size = np.bincount(gram, minlength=grams_)
        n = size[which]
        if n.sum() > HITS:
            owners = np.unique(self.owner[entry])
            if len(owners) > 1:
                low = self.owner[entry] < owners[len(owners) // 2]
                return self._bands(at, which, entry[low], gram[low], grams_) + self._bands(at, which, entry[~low], gram[~low], grams_)
            at, which = at[n > 0], which[n > 0]
            reach, middle = len(self.codes[owners[0]]) + int(self.budget[owners[0]]), (at[0] + at[-1]) // 2
            if at[-1] - at[0] > 4 * reach:
                parts = [self._bands(at[x], which[x], entry, gram, grams_) for x in (at < middle + reach, at >= middle)]
                return list(dict.fromkeys(parts[0] + parts[1]))
            n = size[which]
        pos = np.repeat(at, n)
        hit = entry[_spans((np.cumsum(size) - size)[which], n)]
        owner, place = self.owner[hit], self.place[hit]
        if not len(hit):
            return []
        diagonal = pos - place
        half = self.budget[owner] + 1
        band = diagonal // half
        out = []
        # Each diagonal lies in the band that starts in its half and in the one before; few bands have hits enough.
        low = band.min() - 1
        key = np.concatenate([owner, owner]) << 40 | np.concatenate([band, band - 1]) - low
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        size = np.diff(starts, append=len(key))
        full = size >= self.need[key[order[starts]] >> 40]
        for a, c in zip(starts[full], size[full], strict=True):
            o = int(key[order[a]] >> 40)
            # A place of the passage counts once in a band.
            if len(np.unique(place[order[a : a + c] % len(place)])) >= self.need[o]:
                out.append((o, int(((key[order[a]] & ((1 << 40) - 1)) + low) * (self.budget[o] + 1))))
        return out


def align(jobs: list[tuple[np.ndarray, np.ndarray, int, int]]) -> list[tuple[int, int, int] | None]:
    """For (text, passage, first diagonal, band width): the least edits, and where the match begins and ends in the text; None beyond the text.

    One banded alignment for all jobs at once, a row per passage character and a column per diagonal; the text's
    ends are free.
    """
    if not jobs:
        return []
    rows, wide, count = max(len(p) for _, p, _, _ in jobs), max(w for *_, w in jobs), len(jobs)
    text, passage = np.full((count, rows + wide), 1 << 30, np.int64), np.full((count, rows), -1, np.int64)
    length, first = np.array([len(p) for _, p, _, _ in jobs]), np.array([d for *_, d, _ in jobs])
    size, width = np.array([len(t) for t, *_ in jobs]), np.array([w for *_, w in jobs])
    for j, (t, p, d, _) in enumerate(jobs):
        a, b = max(0, d), min(len(t), d + rows + wide)
        if b > a:
            text[j, a - d : b - d] = t[a:b]
        passage[j, : len(p)] = p
    far, col = 1 << 30, np.arange(wide)
    # Cell (i, c): i passage characters against the text up to first + c + i.
    ends = first[:, None] + col
    cost = np.where((ends >= 0) & (ends <= size[:, None]) & (col < width[:, None]), 0, far).astype(np.int64)
    begin = np.broadcast_to(ends, cost.shape).copy()
    best = np.full((count, 3), far, np.int64)
    for i in range(rows):
        step = cost + (text[:, i : i + wide] != passage[:, i : i + 1])
        drop = np.concatenate([cost[:, 1:] + 1, np.full((count, 1), far)], axis=1)
        up = drop < step
        cost = np.where(up, drop, step)
        begin = np.where(up, np.concatenate([begin[:, 1:], begin[:, -1:]], axis=1), begin)
        ends = first[:, None] + col + i + 1
        cost = np.where((ends >= 0) & (ends <= size[:, None]) & (col < width[:, None]), cost, far)
        slide = (cost - col) * (1 << 31) + col
        low = np.minimum.accumulate(slide, axis=1)
        source = low & ((1 << 31) - 1)
        cost = np.minimum(cost, (low >> 31) + col)
        begin = np.take_along_axis(begin, np.where(cost < far, source, col), axis=1)
        for j in np.flatnonzero(length == i + 1):
            c = int(cost[j].argmin())
            best[j] = cost[j, c], begin[j, c], ends[j, c]
    return [tuple(int(x) for x in b) if b[0] < far else None for b in best]


def matches(texts: list[str], passages: Passages, at_once: int = 512) -> list[list[tuple[int, int, int, int]]]:
    """For each text (item, start, end, edits) of passages that occur in it within their budgets; of one passage the best place, the first of equals."""
    best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    jobs: list[tuple] = []

    def verify() -> None:
        jobs.sort(key=lambda j: len(j[3]))
        parts: list[list[tuple]] = []
        for j in jobs:  # those of few cells together, long passages apart
            if parts and (len(parts[-1]) + 1) * (len(j[3]) + j[5]) <= CELLS:
                parts[-1].append(j)
            else:
                parts.append([j])
        aligned = [x for part in parts for x in align([(codes, passage, d, w) for *_, passage, d, w, codes in part])]
        for (k, o, at, *_), found in zip(jobs, aligned, strict=True):
            if found and found[2] > found[1] and found[0] <= passages.budget[o]:
                d, b, e = found
                best[k][o] = min(best[k].get(o, (1 << 30, 0, 0)), (d, int(at[b]), int(at[e - 1]) + 1))
        jobs.clear()

    for k, text in enumerate(texts):
        codes, at = normalise(text)
        jobs += [(k, o, at, passages.codes[o], d, int(2 * (passages.budget[o] + 1)), codes) for o, d in passages.regions(codes)]
        if len(jobs) >= at_once:
            verify()
    verify()
    return [[(passages.ids[o], b, e, d) for o, (d, b, e) in sorted(x.items())] for x in best]


def blocks_of(benchmark: DataFrame, item_col: str, passage_col: str, q: int, error: float, block_chars: int) -> Iterator[Broadcast]:
    """The benchmark's passages, sent to executors in blocks of at most block_chars characters (a longer passage is a block of its own)."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(passage_col).alias("t")).where("t is not null and i is not null")
    sized = items.select("i", F.length("t").alias("n"), F.xxhash64("t").alias("h")).distinct()
    blocks = -(-(sized.agg(F.sum("n").alias("s")).first()["s"] or 0) // block_chars) or 1
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).distinct()
        yield spark.sparkContext.broadcast(Passages([(r["i"], r["t"]) for r in block.collect()], q, error))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "text", q: int = 8, error: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, edits): each benchmark passage that a document holds, start and end in code points of its text.

    An edit is a character put in, left out or changed, after folding case and white space; the budget is error
    of the passage's length, less where a passage is too short for its q-grams to tell. Passages shorter than q, null
    texts and null passages match nothing. The benchmark is a stated query set: each of its blocks is held against all rows in
    a pass of its own, so a task holds one block; there is no shuffle and no hot key. Repeated rows each report their matches.
    """
    out = None
    key = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    for passages in blocks_of(benchmark, item_col, passage_col, q, error, block_chars):

        def run(batches: Iterator[pa.RecordBatch], passages=passages) -> Iterator[pa.RecordBatch]:
            p = passages.value
            for b in batches:
                found = [(d, *m) for d, held in zip(b.column(0).to_pylist(), matches(b.column(1).to_pylist(), p), strict=True) for m in held]
                kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*found, strict=True)) or [[]] * 5, kinds, strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

        part = rows.mapInArrow(run, f"doc_id {key}, item_id long, start long, end long, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", passage_col: str = "text", q: int = 8, error: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """docs without those that hold a benchmark passage, as contaminated() finds them. Every row is judged by its own text where it is, whatever its
    id and its other columns; null texts stay. There is no shuffle."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    for passages in blocks_of(benchmark, item_col, passage_col, q, error, block_chars):

        def run(batches: Iterator[pa.RecordBatch], passages=passages) -> Iterator[pa.RecordBatch]:
            p = passages.value
            for b in batches:
                held = matches([t or "" for t in b.column(0).field(at).cast(pa.string()).to_pylist()], p)
                yield b.filter(pa.array([not h for h in held], pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("row.*")


def op2(spark, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
