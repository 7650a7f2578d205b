"""Packing token sequences: exact complements first, then best fit, planned on the histogram of lengths.

Lengths are integers up to the capacity, so the histogram, and with it the whole plan, is bounded by the capacity
whatever the number of pieces. The plan lists patterns (lengths that share a sequence) with how often each is used;
pieces then find their place by their rank within their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowdex.storage import materialise, partitions, ship

#: Special tokens of the vocabulary byte_bpe_50k (fixed value).
SPECIAL = (("<|endoftext|>", 50256),)
#: White space of the vocabularies' patterns: Unicode's White_Space, and a run of it that is encoded apart where a text is too much for the pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = re.compile(f"(?<![{WHITE}])[{WHITE}]{{1000,}}")
_encoders: dict[tuple, Encoder] = {}


def vocabulary(name: str) -> str:
    """The path of a vocabulary file of the installed public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes; the special tokens' strings in a text become their ids.

    The pattern's rule for white space is ``\\s+(?!\\S)|\\s+``, for which the library gives up on runs of about a million characters. Texts that
    hold such are cut there: all of a run but its last character is one piece, and so is the last one with what follows.
    """

    def __init__(self, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = dict(special)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.whole = tiktoken.Encoding("whole", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.parts = re.compile("|".join(f"({re.escape(x)})" for x in sorted(self.special, key=len, reverse=True)) or "(?!)")

    def _encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special=set(self.special), disallowed_special=())

    def _cut(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for m in LONG.finditer(text):
            ids += self._encode(text[at : m.start()])
            at = m.end() if m.end() == len(text) else m.end() - 1
            ids += self.whole.encode(text[m.start() : at], disallowed_special=())
        return ids + self._encode(text[at:])

    def __call__(self, text: str) -> bytes:
        try:
            ids = self._encode(text)
        except ValueError:
            ids = [i for part in self.parts.split(text) if part for i in ([self.special[part]] if part in self.special else self._cut(part))]
        return np.array(ids, "<u4").tobytes()


def encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = SPECIAL) -> Encoder:
    if (ranks_path, special) not in _encoders:
        _encoders[ranks_path, special] = Encoder(ranks_path, pattern, special)
    return _encoders[ranks_path, special]


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that holds the rest."""
    first = n if n <= capacity else n % capacity or capacity
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, ranks: str | None = None, with_ids: bool = False, special: tuple[tuple[str, int], ...] = SPECIAL) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and then end_id, cut to the capacity.

    Null and empty texts are one piece of one id; texts of any length are encoded whole, long runs of white space too. ranks: the vocabulary's file of ranks; with the special tokens of the
    vocabulary the ids are those that its tokenizers file gives with add_special_tokens=False. special=() takes their strings for ordinary text.
    """
    import public_tokenizers

    ship(docs.sparkSession)
    path, pattern, end = ranks or vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern, special)
        for b in batches:
            rows: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((key, k, start, n, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32))[: len(names)])
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * len(names), kinds, strict=False)], names=names)

    key = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies), ...]) patterns that use up the counts.

    From the longest length that is left: fill the gap exactly with one length, else with a pair, else with three,
    as far as their counts allow, and use the pattern as often as all its counts allow; where nothing fills the gap,
    the longest length that fits is put in and the rest is a smaller gap.
    """
    c = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        if not 1 <= n <= capacity:
            raise ValueError(f"a length of {n} is not in 1..{capacity}")
        c[n] = k
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def pair(left: np.ndarray, gap: int) -> tuple[int, int] | None:
        """The pair of available lengths with this sum whose longer one is longest."""
        half = gap // 2
        if not half:
            return None
        ok = (left[1 : half + 1] > 0) & (left[gap - 1 : gap - half - 1 : -1] > 0)
        if gap % 2 == 0 and left[half] < 2:
            ok[half - 1] = False
        b = int(ok.argmax())
        return (gap - b - 1, b + 1) if ok[b] else None

    longest = capacity
    while True:
        while longest and not c[longest]:
            longest -= 1
        if not longest:
            return out
        left, gap, used = c.copy(), capacity - longest, [longest]
        left[longest] -= 1
        while gap:
            have = np.flatnonzero(left[1 : gap + 1]) + 1
            if not len(have):
                break
            if left[gap]:
                fill: tuple[int, ...] | None = (gap,)
            else:
                fill = pair(left, gap)
                for x in () if fill else have[::-1]:
                    left[x] -= 1
                    two = pair(left, gap - int(x))
                    left[x] += 1
                    if two:
                        fill = (int(x), *two)
                        break
            for x in fill or (int(have[-1]),):
                used.append(x)
                left[x] -= 1
                gap -= x
        sizes, copies = np.unique(used, return_counts=True)
        times = int((c[sizes] // copies).min())
        c[sizes] -= times * copies
        out.append((times, [(int(n), int(k)) for n, k in zip(sizes[::-1], copies[::-1], strict=True)]))


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, first offset), by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, parts in patterns:
        offset = 0
        for n, copies in parts:
            rows.append((n, taken.get(n, 0), copies, sequence, offset))
            taken[n] = taken.get(n, 0) + times * copies
            offset += n * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def class_ranks(pieces: DataFrame, counts: dict[int, int], keys: list[Column], block: int = 50_000) -> DataFrame:
    """pieces (row, n) with rank, 0-based within their length n.

    Each length is dealt into blocks by a hash, more for a frequent one, ranked within the block and shifted by the
    counts of the blocks before it: no task holds a whole length, however many pieces have it.
    """
    spark = pieces.sparkSession
    least = 2 * partitions(spark)
    total = max(1, sum(counts.values()))
    table = spark.createDataFrame([(n, max(1, -(-k // block), -(-k * least // total))) for n, k in counts.items()] or [(0, 1)], "n long, blocks long")
    dealt = pieces.join(F.broadcast(table), "n").withColumn("block", F.pmod(F.xxhash64(*keys), F.col("blocks"))).drop("blocks")
    before = dealt.groupBy("n", "block").agg(F.count("*").alias("k")).select("n", "block", (F.sum("k").over(Window.partitionBy("n").orderBy("block")) - F.col("k")).alias("before"))
    ranked = dealt.withColumn("at", F.row_number().over(Window.partitionBy("n", "block").orderBy(*keys)))
    return ranked.join(before, ["n", "block"]).select("row", "n", (F.col("before") + F.col("at") - 1).alias("rank"))


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = 2048, keys: list[str] | None = None) -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most capacity, gapless from offset 0; columns of pieces with these names give way.

    pieces is read three times, so give a stored table. keys order pieces of one length (all columns by default);
    rows equal in them are interchangeable. An empty table gives an empty one; a null length or one outside
    1..capacity is an error.
    """
    ship(pieces.sparkSession)
    columns = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = pieces.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{length_col}`").cast("long").alias("n"))
    counts = {r["n"]: r["k"] for r in rows.groupBy("n").agg(F.count("*").alias("k")).collect()}
    if None in counts:
        raise ValueError("a piece has no length")
    table = slots(plan(counts, capacity))
    start = table[:, 0] << 40 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            s = table[np.searchsorted(start, n << 40 | rank, side="right") - 1] if b.num_rows else table[:0]
            nth = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s[:, 3] + nth // s[:, 2]), pa.array(s[:, 4] + nth % s[:, 2] * n)], names=["row", "sequence_id", "offset"])

    ranked = class_ranks(rows, counts, [F.col(f"row.`{k}`") for k in keys or columns])
    schema = T.StructType([ranked.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = 2048, **params) -> DataFrame:
    """Tokenize documents, store the pieces and pack them."""
    return pack(materialise(token_pieces(docs, capacity=capacity, **params), "pieces"), capacity=capacity, keys=["doc_id", "piece", "ids_crc32", "start", "length"])


def op3(spark, docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
