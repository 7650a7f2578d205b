"""Alignment of two tokenizers over the same bytes, and how often each pair of their tokens meets in the whole corpus.

Documents' tokens stand one behind another as ends in bytes. One count of the ends of A and of B tells at every byte which of them end
there: where both do is a cut between groups, and what lies between two ends of any kind is a link, the bytes that one token of A and one of B share.
Running sums over the links, taken at the documents' ends, give each document's results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.packing import encoder, vocabulary
from sparrowdex.storage import materialise, ship

#: Bytes whose ends are counted at once.
SPAN = 1 << 20


class Vocabulary:
    """A tokenizer's tokens: their number, bytes and lengths."""

    def __init__(self, tokens: list[bytes]):
        self.n, self.tokens, self.length = len(tokens), pa.array(tokens, pa.large_binary()), np.array([len(t) for t in tokens], np.int64)

    def bytes_of(self, ids: np.ndarray) -> memoryview:
        """The tokens' bytes, one behind another."""
        taken = self.tokens.take(pa.array(ids))
        return memoryview(taken.buffers()[2] or b"").cast("B")[: int(self.length[ids].sum())]


class Tokenizers:
    """Ids of space and text by byte-level BPE (A) and of the text by sentencepiece (B), which adds the space; special tokens' strings are plain text."""

    def __init__(self, ranks: str, model: str):
        import public_tokenizers
        import sentencepiece

        self._a = encoder(ranks, public_tokenizers.PATTERN, ())
        self._b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.a = Vocabulary([self._a.encoding.decode_single_token_bytes(i) for i in range(self._a.encoding.n_vocab)])
        self.b = Vocabulary([self._bytes(i) for i in range(self._b.get_piece_size())])
        names = [[f"{i}{end}" for i in range(v.n)] for v, ends in ((self.a, ",|"), (self.b, (",", ";", ""))) for end in ends]
        #: A's ids that go on in their group and that end it, then B's, and B's that end their document.
        self.written = pa.array([x for part in names for x in part], pa.large_string())

    def _bytes(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both tokenizers' ids of each text; none of an empty text, and of one whose bytes they do not give back."""
        a = [np.frombuffer(self._a(f" {t}"), "<u4").astype(np.int64) if t else np.zeros(0, np.int64) for t in texts]
        b = [np.array(x if t else [], np.int64) for t, x in zip(texts, self._b.encode(texts, num_threads=1) if texts else [], strict=True)]
        for ids, v in ((a, self.a), (b, self.b)):
            ends = np.cumsum([int(v.length[x].sum()) for x in ids]).tolist() if ids else []
            whole = v.bytes_of(np.concatenate(ids)) if ids else b""
            for k, (first, last, t) in enumerate(zip([0, *ends[:-1]], ends, texts, strict=True)):
                if t and whole[first:last] != f" {t}".encode():
                    a[k] = b[k] = np.zeros(0, np.int64)
            if v is self.a:
                b = [y if len(x) else x for x, y in zip(a, b, strict=True)]
        return a, b


@lru_cache(maxsize=2)
def tokenizers(ranks: str, model: str) -> Tokenizers:
    return Tokenizers(ranks, model)


@dataclass
class Aligned:
    """Per document: tokens, groups, links and the written groups' digest; and every link's pair, a * B's number of ids + b, in order."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    pairs: np.ndarray


def ends_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, kind) of all ends in order; kind: 1 where a token of A ends, 2 of B, 3 of both."""
    places, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, int(a[-1]) + 1 if len(a) else 0, SPAN):
        here = [np.bincount(x[slice(*np.searchsorted(x, (low, low + SPAN)))] - low, minlength=SPAN) for x in (a, b)]
        kind = here[0] + 2 * here[1]
        at = np.flatnonzero(kind)
        places.append(at + low)
        kinds.append(kind[at])
    return np.concatenate(places), np.concatenate(kinds)


def align(a: list[np.ndarray], b: list[np.ndarray], t: Tokenizers) -> Aligned:
    """Documents' ids by A and B, where both cover the same bytes."""
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
    whole_a, whole_b = (np.concatenate([np.zeros(0, np.int64), *ids]) for ids in (a, b))
    end_a, end_b = np.cumsum(t.a.length[whole_a]), np.cumsum(t.b.length[whole_b])
    place, kind = ends_of(end_a, end_b)
    is_a, is_b, cut = kind & 1, kind >> 1, (kind == 3).astype(np.int64)
    pairs = whole_a[np.cumsum(is_a) - is_a] * t.b.n + whole_b[np.cumsum(is_b) - is_b]
    # A document's bytes end with its last token of A; one without tokens ends where the one before it does.
    last = np.concatenate([[0], end_a])[np.cumsum(n_a)]
    upto = np.searchsorted(place, last, side="right")
    groups, links = np.concatenate([[0], np.cumsum(cut)])[upto], upto
    # A group's ids of A stand before its ids of B: a token comes after all of its own kind before it, and after the other kind's of the groups before its own.
    group = np.cumsum(cut) - cut
    group_a, group_b, n = group[is_a > 0], group[is_b > 0], int(cut.sum())
    all_a, all_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n))]) for g in (group_a, group_b))
    out = np.empty(len(whole_a) + len(whole_b), np.int64)
    out[np.arange(len(whole_a)) + all_b[group_a]] = whole_a + t.a.n * cut[is_a > 0]
    code = whole_b + t.b.n * cut[is_b > 0]
    code[np.cumsum(n_b)[n_b > 0] - 1] += t.b.n
    out[np.arange(len(whole_b)) + all_a[group_b + 1]] = 2 * t.a.n + code
    written = t.written.take(pa.array(out))
    at = np.frombuffer(written.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist() if len(out) else [0] * (len(n_a) + 1)
    data = memoryview(written.buffers()[2] or b"")
    digests = [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]
    return Aligned(n_a, n_b, np.diff(groups, prepend=0), np.diff(links, prepend=0), digests, pairs)


CHUNK = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, links binary, pair array<long>, n array<long>"
_LONGS = pa.list_(pa.int64())
_CHUNK = pa.schema([("chunk", pa.int64()), *((c, _LONGS) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.list_(pa.string())), ("links", pa.binary()), ("pair", _LONGS), ("n", _LONGS)])


def squeezed(values: np.ndarray) -> bytes:
    """Compressed unsigned 32-bit values, their lowest bytes first, as most of the others are zero."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def released(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _chunk(number: int, keys: list[int | None], parts: list[Aligned]) -> pa.RecordBatch:
    """Documents' results and, for every link, its pair's place among the chunk's pairs, the most frequent first."""
    held = pa.array(np.concatenate([p.pairs for p in parts])).dictionary_encode()
    place, pair = np.asarray(held.indices), np.asarray(held.dictionary)
    n = np.bincount(place, minlength=len(pair))
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(pair), np.uint32)
    rank[order] = np.arange(len(pair))
    columns = [number, keys, *(np.concatenate([getattr(p, c) for p in parts]) for c in ("n_a", "n_b", "n_groups", "n_links")), [d for p in parts for d in p.digests], squeezed(rank[place]), pair[order], n[order]]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, _CHUNK.types, strict=True)], schema=_CHUNK)


def aligned_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, model: str | None = None, chunk_bytes: int = 16 << 20, batch_bytes: int = 2 << 20) -> DataFrame:
    """Documents (ids are integers) in chunks of about chunk_bytes of text, aligned batch_bytes at a time, a longer text by itself; store them.

    Nothing is shuffled. A chunk lists each of its pairs once, so what is counted and asked for over the corpus has a pair at most once per chunk, however frequent it is.
    """
    ship(docs.sparkSession)
    ranks, model = ranks or vocabulary("byte_bpe_50k.tiktoken"), model or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = tokenizers(ranks, model), TaskContext.get().partitionId() << 32
        keys: list[int | None] = []
        texts: list[str] = []
        parts: list[Aligned] = []
        size = in_batch = 0

        def close() -> None:
            if texts:
                parts.append(align(*t(texts), t))
                texts.clear()

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                n = len(text) + 100  # a document's results count too
                if in_batch and in_batch + n > batch_bytes:
                    close()
                    in_batch = 0
                if size and size + n > chunk_bytes:
                    close()
                    yield _chunk(number, keys, parts)
                    number, keys, parts, size, in_batch = number + 1, [], [], 0, 0
                keys.append(key)
                texts.append(text)
                size, in_batch = size + n, in_batch + n
        close()
        if keys:
            yield _chunk(number, keys, parts)

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, CHUNK)


def _asked(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.posexplode(F.arrays_zip("pair", "n")).alias("at", "x")).select("chunk", "at", "x.pair", "x.n")


def pair_counts(chunks: DataFrame, n_b: int) -> DataFrame:
    """(pair, a, b, count): how many links of the corpus have each pair of ids; n_b: B's number of ids."""
    return _asked(chunks).groupBy("pair").agg(F.sum("n").alias("count")).select("pair", F.floor(F.col("pair") / n_b).alias("a"), (F.col("pair") % n_b).alias("b"), "count")


def corpus_results(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document of stored chunks, and stored pair_counts(): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The highest count of each id of B is a table as long as its vocabulary and is broadcast; the counts of its pairs meet each chunk once.
    """
    ship(chunks.sparkSession)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    told = counts.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = _asked(chunks).select("chunk", "at", "pair").join(told, "pair").select("chunk", "at", "count", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(found: pa.Table, held: pa.Table) -> pa.Table:
        rows = []
        at = found.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = found.column("count").to_numpy(), found.column("best").to_numpy()
        for r in range(held.num_rows):
            own = {c: held.column(c)[r].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            ends = np.concatenate([[0], np.cumsum(own["n_links"].to_numpy())])
            links = released(held.column("links")[r].as_py(), int(ends[-1]))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[ends]) for x in (best, count)]
            rows.append(pa.table([*(own[c] for c in names[:5]), *map(pa.array, sums), own["groups_sha256"]], names=names))
        return pa.concat_tables(rows) if rows else pa.table([pa.array([], pa.int64())] * 7 + [pa.array([], pa.string())], names=names)

    kept = chunks.select(F.col("chunk").alias("of_chunk"), *names[:5], "groups_sha256", "links")
    return answers.groupBy("chunk").cogroup(kept.groupBy("of_chunk")).applyInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names))


def alignment(docs: DataFrame, model: str | None = None, **params) -> DataFrame:
    import sentencepiece

    model = model or vocabulary("piece_bpe_32k.model")
    chunks = materialise(aligned_chunks(docs, model=model, **params), "aligned")
    n_b = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    return corpus_results(chunks, materialise(pair_counts(chunks, n_b), "pair-counts"))


def op11(spark, docs: DataFrame) -> DataFrame:
    return alignment(docs)
