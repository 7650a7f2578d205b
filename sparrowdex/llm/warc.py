"""WARC archives: written with segments, chunked framing and revisits, and put together again when read.

An archive is a folder of gzip files. A record ends with two line ends, which is what Spark's text writer puts after
each row, so a row is a record; the reader gets the same pieces back and finds records by their lengths.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.joins import lookup
from sparrowdex.storage import drop_path, materialise, shared_path, ship

END = "\r\n\r\n"
BEND = END.encode()
DATE = "2026-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def cut(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most size bytes (but never less than one character) that end where a UTF-8 character does."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80 and end > at:
            end -= 1
        if end == at:
            end = at + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cut(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; an error if it is cut short or its sizes are wrong. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def record(headers: dict[str, object], block: bytes) -> str:
    lines = [f"{k}: {v}" for k, v in (headers | {"Content-Length": len(block)}).items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]) + END + block.decode()


def page_records(serial: str, page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment: int, chunk: int) -> Iterator[str]:
    """The records of one page: a revisit, a response, or a response with its continuations."""
    key = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{serial}/{k}')}>"
    target = None if url is None else "".join(f"%{ord(c):02X}" if c in "\r\n%" else c for c in url)
    common = {"WARC-Date": DATE, "WARC-Target-URI": target, "Page-ID": page, "WARC-Payload-Digest": f"sha256:{digest}"}
    if first is not None:
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": key(1), **common, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Refers-To-Page-ID": first, "Content-Type": "application/http; msgtype=response"}, (HTTP + "\r\n").encode())
        return
    block = (HTTP + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload, chunk)
    parts = list(cut(block, segment))
    for k, part in enumerate(parts, 1):
        h: dict[str, object] = {"WARC-Type": "continuation" if k > 1 else "response", "WARC-Record-ID": key(k), **common}
        if len(parts) > 1:
            h["WARC-Segment-Number"] = k
        if k > 1:
            h["WARC-Segment-Origin-ID"] = key(1)
            if k == len(parts):
                h["WARC-Segment-Total-Length"] = len(block)
        yield record(h | {"Content-Type": "application/http; msgtype=response"}, part)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, segment: int = 32_768, chunk: int = 8_192) -> None:
    """Write a record per page to the folder path.

    Of pages with equal payloads of at least least_bytes bytes, those with the smallest id are responses and the others
    revisit it; a null id is always a response. Null html is an empty payload. Blocks over segment bytes are segmented.
    Which page comes first in a group is a minimum with partial minima on the map side.
    """
    ship(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    firsts = materialise(rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    plan = lookup(rows, firsts.drop("n"), "digest", sizes=firsts.select("digest", "n")).select(F.monotonically_increasing_id().cast("string").alias("serial"), "page", "url", "html", "digest", F.when(F.col("first") < F.col("page"), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str] = []
            size = 0
            for row in zip(*(c for c in b.columns), strict=True):
                serial, page, url, text, digest, first = (x.as_py() for x in row)
                new = list(page_records(f"{page}/{serial}/{digest}", page, url, text.encode(), digest, first, segment, chunk))
                out += new
                size += sum(map(len, new))
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    plan.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").text(path)


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) from the pieces between double line ends, by the lengths in the headers.

    Where the last record of a file ends in a line end, the piece after its last double line end is a line end and not empty, so
    the pieces put together hold a double line end too many; between records those are skipped.
    """
    held, headers, need = bytearray(), None, 0
    for piece in pieces:
        held += piece
        held += BEND
        while True:
            if headers is None:
                if held.startswith(BEND):
                    del held[:4]
                    continue
                end = held.find(BEND)
                if end < 0:
                    break
                head = held[:end].decode()
                if not head.startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {head[:80]!r}")
                headers = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
                need = int(headers["Content-Length"])
                del held[: end + 4]
            if len(held) < need + 4:
                break
            if held[need : need + 4] != BEND:
                raise ValueError("a record does not end where its length says")
            yield headers, bytes(held[:need])
            del held[: need + 4]
            headers = None
    if headers is not None or held:
        raise ValueError("an archive ends within a record")


RAW = "record_id string, type string, origin string, segment int, total long, page_id long, url string, refers_to long, digest string, block binary"


def unquoted(url: str | None) -> str | None:
    return None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def fields(h: dict[str, str]) -> dict:
    """A record's own fields, from its headers."""
    number = lambda k: int(h[k]) if k in h else None
    return {"record_id": h["WARC-Record-ID"], "type": h["WARC-Type"], "origin": h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), "segment": number("WARC-Segment-Number"), "total": number("WARC-Segment-Total-Length"), "page_id": number("Page-ID"), "url": unquoted(h.get("WARC-Target-URI")), "refers_to": number("Refers-To-Page-ID"), "digest": h.get("WARC-Payload-Digest", "").removeprefix("sha256:")}


def read_records(spark, path: str) -> DataFrame:
    """Records as stored, segments apart (RAW).

    A gzip file is read by one task as a stream of pieces, of which a record's are held at a time.
    """
    ship(spark)
    kinds = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for h, block in split_records(v.as_py().encode() for b in batches for v in b.column(0)):
            if h["WARC-Type"] in ("response", "revisit", "continuation"):
                rows.append(fields(h) | {"block": block})
                size += len(block)
            if size > 1 << 23:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, kinds)

    return spark.read.option("lineSep", END).text(path).mapInArrow(run, RAW)


def decoded(kind: str, page: int | None, url: str | None, refers: int | None, digest: str, block: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a whole block; an error if the payload is not the one of the digest."""
    if kind == "revisit":
        return page, url, kind, refers, None, digest, None
    head, _, body = block.partition(BEND)
    payload = dechunked(body) if b"\r\nTransfer-Encoding: chunked" in head else body
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"page {page}: the payload does not have its digest")
    return page, url, kind, None, len(payload), digest, payload.decode()


OWN = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])
PART = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def reassembled(spark, path: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]): one row per page, of stored tables; the archive is read once.

    Segments are grouped by the id of their first record and ordered by number; numbers from 1 without a gap and the stated
    total length are verified, then the chunked framing is taken off and the digest compared to the one stored. Damage is an error.
    Revisits have no payload of their own: payload is null, and size and digest are those of the response that they refer to.
    Records that are not segmented are decoded where they are read; only segments are shuffled.
    """
    ship(spark)
    own = pa.schema([f for f in OWN if with_payload or f.name != "payload"])
    both = pa.schema([*own, *PART])
    columns = lambda schema: ", ".join(f"{f.name} {dict(int64='long', int32='int').get(str(f.type), str(f.type))}" for f in schema)
    names = own.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for h, block in split_records(v.as_py().encode() for b in batches for v in b.column(0)):
            if h["WARC-Type"] not in ("response", "revisit", "continuation"):
                continue
            r = fields(h)
            if r["segment"] is None:
                rows.append(dict(zip(OWN.names, decoded(r["type"], r["page_id"], r["url"], r["refers_to"], r["digest"], block), strict=True)))
            else:
                rows.append({"page_id": r["page_id"], "url": r["url"], "record_type": r["type"], "payload_digest": r["digest"], "origin": r["origin"], "segment": r["segment"], "total": r["total"], "block": block})
            size += len(block)
            if size > 1 << 23:
                yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in both.names} for x in rows], both)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in both.names} for x in rows], both)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, url, kind, digest, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = dict(zip(OWN.names, decoded(kind, page, url, None, digest, block), strict=True))
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in names}], own)

    records = materialise(spark.read.option("lineSep", END).text(path).mapInArrow(read, columns(both)), "records")
    parts = records.where("origin is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "block", "record_type", "page_id", "url", "payload_digest"))).alias("s"), F.max("total").alias("total"))
    first = F.get("s", F.lit(0))
    sound = (F.transform("s", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("s"))) & (F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"])) == F.col("total"))
    joined = parts.select(*(first[c].alias(c) for c in ("page_id", "url", "record_type", "payload_digest")), F.when(F.coalesce(sound, F.lit(False)), F.expr("unhex(array_join(transform(s, x -> hex(x.block)), ''))")).otherwise(F.raise_error(F.concat(F.lit("segments are missing of "), "origin"))).alias("block"))
    put = materialise(joined.mapInArrow(decode, columns(own)), "reassembled")
    every = records.where("origin is null").select(*names).unionByName(put)
    key = lambda page: F.concat_ws("/", F.col(page).cast("string"), "payload_digest")
    at = every.where("record_type = 'response' and page_id is not null").select(key("page_id").alias("key"), F.col("payload_bytes").alias("n")).distinct()
    revisits = lookup(every.where("record_type = 'revisit'").withColumn("key", key("refers_to")), at, "key")
    return every.where("record_type <> 'revisit'").unionByName(revisits.select(*(F.col("n").alias("payload_bytes") if c == "payload_bytes" else F.col(c) for c in names)))


def op10(spark, pages: DataFrame) -> DataFrame:
    """Writes and reads the archive, stores what was read and removes the archive."""
    path = shared_path(spark, "warc")
    write_archive(pages, path)
    out = materialise(reassembled(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "pages")
    drop_path(spark, path)
    return out


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
