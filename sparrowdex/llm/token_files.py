"""Token ids in files of directly addressable codes: any token is read by its position, without decoding what lies before it.

An id is cut into chunks of bits, the lowest first. Level 0 holds the first chunk of every id, level k the next chunk of those ids that
are not over yet. Beside each level but the last, a bitmap tells which ids go on, and a directory counts the set bits before every 512th,
so the place of an id's next chunk is a rank: one entry of the directory and the bits behind it.

A file is a row of segments, each with a line end behind it. A segment, all numbers little-endian:

    header     u64 each: magic, bytes in all, part, ids of the part before it, documents, ids, levels, then (chunk bits, ids) of every level
    documents  i64 ids, null bitmap, u64 starts (one more than documents), counted within the segment
    levels     chunks packed bit by bit and 8 bytes of padding; for all but the last level a bitmap and its u32 directory
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.llm.packing import SPECIAL, encoder, vocabulary
from sparrowdex.storage import drop_path, materialise, partitions, shared_path, ship

MAGIC = int.from_bytes(b"DACIDS01", "little")
FIXED, MOST_LEVELS, RANK_BITS, PAD = 7, 32, 512, 8
#: Bytes of a header with as many levels as there can be.
HEADER = 8 * (FIXED + 2 * MOST_LEVELS)


def level_widths(ids: np.ndarray) -> list[int]:
    """Bits of each level's chunks that make the segment smallest, by a dynamic programme over where ids may be cut."""
    bits = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=33)
    longer = len(ids) - np.cumsum(bits)  # ids of more than k bits
    top = max(1, int(np.flatnonzero(bits).max(initial=1)))
    cost, step = [0.0] * (top + 1), [0] * (top + 1)
    for at in range(top - 1, -1, -1):
        here = len(ids) if at == 0 else int(longer[at])
        cost[at], step[at] = min((here * (to - at + (1 + 32 / RANK_BITS) * (to < top)) + cost[to], to) for to in range(at + 1, top + 1))
    out, at = [], 0
    while at < top:
        out.append(step[at] - at)
        at = step[at]
    return out


def packed(values: np.ndarray, width: int) -> bytes:
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes() + bytes(PAD)


def unpacked(chunks: np.ndarray, width: int, bits: np.ndarray) -> np.ndarray:
    """Values of that width that begin at those bits, each from the few bytes that hold it."""
    byte, out = bits >> 3, np.zeros(len(bits), np.uint64)
    for k in range((width + 14) // 8):
        out |= chunks[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (bits & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def segment(part: int, before: int, keys: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The bytes of one segment: documents' ids in order."""
    whole = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    widths = level_widths(whole)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    body = [np.array([k or 0 for k in keys], "<i8").tobytes(), np.packbits(np.array([k is None for k in keys], bool), bitorder="little").tobytes(), starts.tobytes()]
    left, shape = whole, []
    for k, width in enumerate(widths):
        shape += [width, len(left)]
        body.append(packed(left & np.uint32((1 << width) - 1), width))
        if k + 1 < len(widths):
            rest = left >> np.uint32(width)
            on = rest > 0
            bitmap = np.packbits(np.pad(on, (0, -len(on) % RANK_BITS)), bitorder="little")
            counts = np.bitwise_count(bitmap).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.int64)
            body += [bitmap.tobytes(), (np.cumsum(counts) - counts).astype("<u4").tobytes()]
            left = rest[on]
    size = 8 * (FIXED + len(shape)) + sum(map(len, body))
    return np.array([MAGIC, size, part, before, len(keys), len(whole), len(widths), *shape], "<u8").tobytes() + b"".join(body)


class Segment:
    """One segment of a source, read(place, bytes), that is asked for no more bytes than an answer needs."""

    def __init__(self, read, at: int = 0):
        held = read(at, HEADER)
        head = np.frombuffer(held[: len(held) // 8 * 8], "<u8")
        if len(head) < FIXED or int(head[0]) != MAGIC:
            raise ValueError("not a segment of token ids")
        self.read, (self.size, self.part, self.before, self.docs, self.n, levels) = read, map(int, head[1:FIXED])
        shape = head[FIXED : FIXED + 2 * levels].astype(np.int64).reshape(-1, 2)
        place = self.keys_at = at + 8 * (FIXED + 2 * levels)
        self.nulls_at = place + 8 * self.docs
        self.starts_at = self.nulls_at + -(-self.docs // 8)
        place, self.levels = self.starts_at + 8 * (self.docs + 1), []
        for k, (width, count) in enumerate(shape.tolist()):
            bitmap = place + -(-width * count // 8) + PAD
            directory = bitmap + -(-count // RANK_BITS) * (RANK_BITS // 8)
            self.levels.append((width, place, bitmap, directory, k + 1 == levels))
            place = directory + -(-count // RANK_BITS) * 4

    def token(self, at: int) -> int:
        """The id at a place: of each level that it has, its chunk, its bit, and one rank."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = shift = 0
        for width, chunks, bitmap, directory, last in self.levels:
            first = at * width // 8
            word = int.from_bytes(self.read(chunks + first, (width + 14) // 8), "little")
            out |= (word >> (at * width - 8 * first) & (1 << width) - 1) << shift
            shift += width
            block = at // RANK_BITS
            if last or not self.read(bitmap + at // 8, 1)[0] >> at % 8 & 1:
                break
            before = int.from_bytes(self.read(bitmap + block * (RANK_BITS // 8), RANK_BITS // 8), "little") & (1 << at % RANK_BITS) - 1
            at = int.from_bytes(self.read(directory + 4 * block, 4), "little") + before.bit_count()
        return out

    def slice(self, first: int, last: int) -> np.ndarray:
        """The ids from first to last, half open: a run of each level."""
        out, where, shift = np.zeros(last - first, np.uint32), np.arange(last - first), 0
        for width, chunks, bitmap, directory, end in self.levels:
            if last <= first:
                break
            low, high = first * width // 8, last * width // 8 + PAD
            held = np.frombuffer(self.read(chunks + low, high - low), np.uint8)
            out[where] |= unpacked(held, width, np.arange(first, last) * width - 8 * low) << np.uint32(shift)
            shift += width
            if end:
                break
            block = first // RANK_BITS
            bits = np.unpackbits(np.frombuffer(self.read(bitmap + block * (RANK_BITS // 8), -(-last // 8) - block * (RANK_BITS // 8)), np.uint8), bitorder="little")
            skipped = first - block * RANK_BITS
            on = bits[skipped : last - block * RANK_BITS].astype(bool)
            first = int.from_bytes(self.read(directory + 4 * block, 4), "little") + int(bits[:skipped].sum())
            where = where[on]
            last = first + len(where)
        return out

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """(ids, starts) of the documents."""
        keys = np.frombuffer(self.read(self.keys_at, 8 * self.docs), "<i8").tolist()
        null = np.unpackbits(np.frombuffer(self.read(self.nulls_at, self.starts_at - self.nulls_at), np.uint8), bitorder="little")
        return [None if null[k] else x for k, x in enumerate(keys)], np.frombuffer(self.read(self.starts_at, 8 * (self.docs + 1)), "<u8").astype(np.int64)


def _segments(content) -> Iterator[tuple[int, Segment]]:
    """(place, segment) of a whole file."""
    at, view = 0, memoryview(content)
    while at < len(view):
        found = Segment(lambda a, n: view[a : a + n], at)
        yield at, found
        at += found.size + 1


@lru_cache(maxsize=8)
def _opened(path: str):
    """A reader of a file's ranges in a store that Arrow knows."""
    scheme, _, way = path.partition(":")
    fs, at = (LocalFileSystem(), re.sub("^/+", "/", way)) if scheme == "file" else FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
    file = fs.open_input_file(at)
    return lambda first, n: file.read_at(n, first)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, ranks: str | None = None, special: tuple[tuple[str, int], ...] = SPECIAL, segment_ids: int = 1 << 20, segments: int = 16) -> None:
    """Write each document's ids and then end_id to files below path, in ascending order of the documents' ids, which are integers.

    Documents are dealt into ranges of their ids and encoded there, one range per task and part; Spark's text writer puts the segments in place,
    so a lost task leaves nothing behind. Documents of one id may lie in several ranges. Nulls come first, a null or empty text is end_id alone. A segment is full when
    it has segment_ids ids, so it holds a longer document whole; a file has so many segments at most. Other columns are not read.
    """
    import public_tokenizers

    ship(docs.sparkSession)
    vocab, pattern, end = ranks or vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocab, pattern, special), TaskContext.get().partitionId()
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = before = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(part, before, keys, ids)], pa.binary())], names=["value"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if held >= segment_ids:
                    yield full()
                    keys, ids, before, held = [], [], before + held, 0
                keys.append(key)
                ids.append(np.frombuffer(encode(text.as_py() or "") + end, "<u4"))
                held += len(ids[-1])
        if keys:
            yield full()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", segments).text(path)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _placed(rows: DataFrame, count: str) -> DataFrame:
    """rows (part, at, ...) with at counted over all parts; the parts are as many as one job's tasks."""
    parts = rows.groupBy("part").agg(F.max(F.col("at") + F.col(count)).alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("at", F.col("at") + F.col("before")).drop("part", "before")


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in files that write_tokens() wrote."""
    ship(spark)
    kinds = {"doc_id": ("long", pa.int64()), "part": ("long", pa.int64()), "at": ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "ids_crc32": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32()))}
    kinds = {k: v for k, v in kinds.items() if with_ids or k != "ids"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                for _, s in _segments(content.as_buffer() or b""):
                    keys, starts = s.documents()
                    ids = s.slice(0, s.n).astype("<u4")
                    each = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
                    columns = [keys, [s.part] * s.docs, starts[:-1] + s.before, np.diff(starts), [zlib.crc32(x) for x in each], each]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, kinds.values(), strict=False)], names=list(kinds))

    rows = _files(spark, path).mapInArrow(run, ", ".join(f"{k} {t}" for k, (t, _) in kinds.items()))
    return _placed(materialise(rows, "token-rows"), "n_tokens").select("doc_id", F.col("at").alias("start"), *list(kinds)[3:])


def directory(spark, path: str) -> DataFrame:
    """(path, offset, start, n): where each segment lies, and which of all ids it holds, from the segments' headers."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(name, at, s.part, s.before, s.n) for at, s in _segments(content.as_buffer() or b"")]
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "offset", "part", "at", "n"), r, strict=True)) for r in rows], pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("offset", "part", "at", "n"))]))

    held = materialise(_files(spark, path).mapInArrow(run, "path string, offset long, part long, at long, n long"), "directory")
    return _placed(held, "n").select("path", "offset", F.col("at").alias("start"), "n")


def tokens_at(places: DataFrame, segments: DataFrame, place_col: str = "place", block: int = 1 << 20) -> DataFrame:
    """(place, id): the ids at those places among all, of segments as directory() gives them; a place that no segment holds, or null, has no row.

    Places meet segments by the block of ids that they lie in. A worker reads a segment's header once and then, for each place, some ten
    bytes of each level and the bits since the last entry of its directory.
    """
    ship(places.sparkSession)
    asked = places.select(F.col(f"`{place_col}`").cast("long").alias("place")).withColumn("block", F.floor(F.col("place") / block))
    held = segments.where("n > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block))))
    found = asked.join(held, "block").where("place >= start and place < start + n").select("place", "path", "offset", (F.col("place") - F.col("start")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, None
        for b in batches:
            out = []
            for name, offset, k in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "at")), strict=True):
                if last != (name, offset):
                    last, at = (name, offset), Segment(_opened(name), offset)
                out.append(at.token(k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["place", "id"])

    return found.sortWithinPartitions("path", "offset", "at").mapInArrow(run, "place long, id long")


def op13(spark, docs: DataFrame) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_tokens(docs, path)
    out = read_tokens(spark, path)
    drop_path(spark, path)
    return out
