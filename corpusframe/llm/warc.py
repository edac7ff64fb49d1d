"""WARC archives: writing records, and reading them back with segment reassembly.

Archives are rows of a table in the shared folder (`archive` string, `warc` binary): each row holds the bytes of a WARC
file of bounded size, so that Spark's commit protocol covers them and a lost executor leaves no half-written file.
`read_files` reads ordinary .warc and .warc.gz files with the same parser.

Writing: a payload becomes an HTTP response in chunked transfer framing.  A record longer than `SEGMENT_BYTES` is cut into
a first segment and continuation records, which may stand in other archives.  Of records with equal payloads of at least
`REVISIT_BYTES`, that with the smallest page id is a response and the others are revisits whose WARC-Refers-To is that record's id.  A
record's id follows from its page id and payload; rows that repeat both are stored once more with ids dealt out to them.

Reading: archives are parsed from front to back, gzip members one by one.  Records without segments are decoded where they stand.  Continuations
are grouped by their origin's identifier and ordered by segment number; the total length must agree, else the payload is null and `problem` says why.
Then chunked framing is taken away.  A group is one record, so it is as large as one payload and no larger.

Defined results: a null or empty html is an empty payload.  Rows with the same page id are written one by one; if that id
is the smallest of its group, all of them are responses.  A null page id never is the smallest unless all are null; an empty one is no null.
A record without a sound length, one that is cut off, and a broken gzip member give a row with `problem`; reading goes on behind them.
Columns beside key, payload and url are not read, so their names can't clash.  An empty table gives no record.  A very long payload is one
record of many segments; reading puts it together in one row, so it must fit Spark's 2 GB for a value.  An archive file is one value too.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import column, stored, table

REVISIT_BYTES = 100
#: Small, so that ordinary pages have continuation records and several chunks, as large ones have with the sizes that crawlers use.
SEGMENT_BYTES = 1_024
CHUNK_BYTES = 1_000
ARCHIVE_BYTES = 4_000_000
RECORD = "record_id string, type string, page_id string, refers_to string, digest string, origin string, segment int, total long, block binary, problem string"
UNPACK_BYTES = 1 << 16


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[at : at + size]), p) for at in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The payload; ValueError where the framing is broken.  Chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        eol = framed.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("a chunk's size is cut off")
        said = framed[at:eol].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", said):
            raise ValueError("a chunk's size is no number")
        size = int(said, 16)
        at = eol + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(framed[at : at + size])
        at += size + 2


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def head(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where what follows them begins."""
    end = data.find(b"\r\n\r\n")
    end = len(data) if end < 0 else end
    out = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out, min(len(data), end + 4)


def unpacked(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The gzip members' bytes, some at a time; what is broken gives a problem, and the next member that can be read goes on."""
    view, at, broken = memoryview(data), 0, False
    while 0 <= at < len(data):
        unpack, pos, some = zlib.decompressobj(31), at, False
        try:
            while not unpack.eof and pos < len(data):
                part = view[pos : pos + UNPACK_BYTES]
                out = unpack.decompress(part)
                pos += len(part)
                some = some or bool(out)
                yield out, None
        except zlib.error:
            if some or not broken:
                yield b"", "a gzip member is broken"
            broken = True
            at = data.find(b"\x1f\x8b\x08", at + 1)
            continue
        if not unpack.eof:
            yield b"", "a gzip member is cut off"
        broken = False
        at = pos - len(unpack.unused_data)


def records_in(data: bytes | bytearray, last: bool) -> Iterator[tuple[int, dict[str, str], bytes | None, str | None]]:
    """Where each record ends, its header fields, its block, and what is wrong with it; unless it is the `last` of the data, an unfinished record
    at the end is left for later."""
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if last:
                yield len(data), head(bytes(data[at:]))[0], None, "the header is cut off"
            return
        headers, _ = head(bytes(data[at : end + 4]))
        said = headers.get("content-length", "")
        stop = end + 4 + int(said) if said.isascii() and said.isdigit() else -1
        if not last and stop >= 0 and stop + 9 > len(data):
            return
        problem = None
        if stop < 0:
            problem = "no sound length"
        elif stop > len(data):
            problem = "the block is cut off"
        elif data[stop : stop + 4].strip() or (stop + 4 < len(data) and data[stop + 4 : stop + 9] != b"WARC/"):
            problem = "the length is wrong"
        following = data.find(b"\r\n\r\nWARC/", end) + 4 if problem else stop + 4
        if problem and following < 4:
            following = len(data)
        yield following, headers, None if problem else bytes(data[end + 4 : stop]), problem
        at = data.find(b"WARC/", following)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """The records of an archive: header fields, block, and what is wrong with it."""
    if data[:2] != b"\x1f\x8b":
        yield from (found[1:] for found in records_in(data, True))
        return
    held = bytearray()
    for part, problem in unpacked(data):
        held += part
        done, wanted = 0, len(held) if problem or len(held) >= needed(held) else 0
        if wanted:
            for done, headers, block, wrong in records_in(held, bool(problem)):
                yield headers, block, wrong
            del held[:done]
            if not problem and held.find(b"WARC/") < 0:
                del held[:-4]
        if problem:
            yield {}, None, problem
            held.clear()
    yield from (found[1:] for found in records_in(held, True))


def needed(held: bytearray) -> int:
    """How many bytes the first record takes, as far as its header tells."""
    end = held.find(b"\r\n\r\n")
    said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", held[: end + 2]) if end >= 0 else None
    return end + 4 + int(said[1]) + 9 if said else 0


def segments(headers: dict[str, str], block: bytes, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """A record, or its segments if it is longer than `size`."""
    if len(block) <= size:
        yield record(headers, block)
        return
    parts = [block[at : at + size] for at in range(0, len(block), size)]
    yield record(headers | {"WARC-Segment-Number": "1"}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": headers["WARC-Date"], "WARC-Segment-Origin-ID": headers["WARC-Record-ID"], "WARC-Segment-Number": str(k)}
        yield record(own | ({"WARC-Segment-Total-Length": str(len(block))} if k == len(parts) else {}), part)


def _ident(page: Column, digest: Column) -> Column:
    """What tells a record's id from others of the same page."""
    return F.substring(F.sha2(F.concat_ws(":", F.coalesce(page, F.lit("")), page.isNull().cast("string"), digest), 256), 1, 32)


def urn(page: str | None, ident: str) -> str:
    """A record's id; it names the page."""
    return f"<urn:x-no-page:{ident}>" if page is None else f"<urn:x-page:{quote(page, safe='')}:{ident}>"


def page_of(value: str | None) -> str | None:
    """The page that a record's id names."""
    found = re.fullmatch(r"<?urn:x-page:([^:>]*).*", (value or "").strip())
    return unquote(found[1]) if found else None


def write_archives(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes a record for each row; the stored table of archives (archive string, warc binary)."""
    link = F.coalesce(F.col(url).cast("string"), F.lit("")) if url in pages.columns else F.lit("")
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("string").alias("page_id"), F.col(key).alias("order_key"), link.alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    each = stored(rows.groupBy("digest", "page_id", "order_key").agg(F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("size")), "warc-keys")
    first = F.min(F.when(F.col("order_key").isNotNull(), F.struct("order_key", "page_id")))
    slim = each.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(first.alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first"))
    slim = slim.withColumn("first_id", _ident(F.col("first"), F.col("digest")))
    twice = each.where("n > 1").select(F.col("page_id").alias("twice_id"), F.col("digest").alias("twice_digest"))
    rows = rows.withColumn("ident", _ident(F.col("page_id"), F.col("digest")))
    if not twice.isEmpty():
        same = F.col("page_id").eqNullSafe(F.col("twice_id")) & (F.col("digest") == F.col("twice_digest"))
        again = stored(rows.join(twice, same, "left_semi").withColumn("ident", F.regexp_replace(F.expr("uuid()"), "-", "")), "warc-again")
        chosen = again.groupBy("page_id", "digest").agg(F.min("ident").alias("chosen")).select(F.col("page_id").alias("first"), "digest", "chosen")
        slim = slim.join(chosen, ["first", "digest"], "left").select("digest", "first", F.coalesce("chosen", "first_id").alias("first_id"))
        rows = rows.join(twice, same, "left_anti").unionByName(again)
    rows = rows.join(stored(slim.select("digest", "first", "first_id"), "warc-repeats"), "digest", "left")  # stored, so that its size is known: Spark broadcasts it only if it is small
    moment = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, held = [], 0

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc"]), pa.array([b"".join(buffer)], pa.binary())], names=["archive", "warc"])
            buffer.clear()
            return out

        for batch in batches:
            for page, place, body, digest, first, ident, first_id in zip(*(column(batch, c) for c in ("page_id", "url", "payload", "digest", "first", "ident", "first_id")), strict=True):
                page, body, digest, first = page.as_py(), body.as_py(), digest.as_py(), first.as_py()
                headers = {"WARC-Type": "response", "WARC-Record-ID": urn(page, ident.as_py()), "WARC-Date": moment, "WARC-Target-URI": " ".join(place.as_py().split()) or urn(page, ident.as_py())[1:-1], "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
                if first is not None and first != page:
                    headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": urn(first, first_id.as_py())}
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body)
                for part in segments(headers, block, segment_bytes):
                    buffer.append(part)
                    held += len(part)
                    if held >= ARCHIVE_BYTES:
                        yield full()
                        held = 0
        if buffer:
            yield full()

    return stored(rows.mapInArrow(go, "archive string, warc binary"), "warc-archives", large_rows=True)


def read_records(archives: DataFrame, warc: str = "warc") -> DataFrame:
    """One row for each WARC record, segments and continuations as they stand."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ["record_id", "type", "page_id", "refers_to", "digest", "origin"]
        schema = pa.schema([*((c, pa.string()) for c in texts), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for one in column(batch, "warc"):
                found, held = [], 0

                def rows() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

                for h, block, problem in parse(one.as_py() or b""):
                    ident, kind = h.get("warc-record-id"), h.get("warc-type")
                    number, total = h.get("warc-segment-number", ""), h.get("warc-segment-total-length", "")
                    found.append((ident, kind, page_of(ident), page_of(h.get("warc-refers-to")), h.get("warc-payload-digest"), h.get("warc-segment-origin-id", ident), int(number) if number.isdigit() and len(number) < 10 else None, int(total) if total.isdigit() and len(total) < 19 else None, block, problem))
                    held += len(block or b"")
                    if held > ARCHIVE_BYTES:
                        yield rows()
                        found, held = [], 0
                if found:
                    yield rows()

    return archives.select(F.col(warc).alias("warc")).mapInArrow(go, RECORD)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc and .warc.gz files of a folder."""
    return read_records(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("content").alias("warc")))


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records with `block`; `problem` is set, and the block null, where segments are missing or the length differs."""
    broken = F.col("problem").isNotNull()
    whole = records.where(broken | (F.col("segment").isNull() & ~F.col("type").eqNullSafe("continuation"))).select("record_id", "type", "page_id", "refers_to", "digest", "block", "problem")
    parts = records.where(~broken & F.col("segment").isNotNull() & F.col("origin").isNotNull())
    first = {c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("type", "page_id", "refers_to", "digest")}
    grouped = parts.groupBy("origin").agg(*first.values(), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    complete = (F.element_at("parts", -1)["segment"] == F.size("parts")) & (F.size(F.array_distinct(F.transform("parts", lambda p: p["segment"]))) == F.size("parts"))
    sizes = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + F.octet_length(p["block"]))
    problem = F.when(~complete, "segments are missing or come twice").when(F.col("total").isNull(), "no total length").when(sizes != F.col("total"), "the length differs from the total")
    joined = grouped.withColumn("problem", problem).withColumn("blocks", F.when(F.col("problem").isNull(), F.transform("parts", lambda p: p["block"])))
    cols = ["record_id", "type", "page_id", "refers_to", "digest", "blocks", "problem"]
    whole = whole.withColumn("blocks", F.when(F.col("problem").isNull(), F.array("block"))).select(*cols)
    return whole.unionByName(joined.withColumnRenamed("origin", "record_id").select(*cols))


def decoded(records: DataFrame) -> DataFrame:
    """HTTP framing taken away: record_id, type, page_id, refers_to, payload binary, payload_bytes, payload_digest, problem.
    A revisit has no payload; its length and digest are those that it declares."""
    schema = "record_id string, type string, page_id string, refers_to string, payload binary, payload_bytes long, payload_digest string, problem string"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                payloads, sizes, digests, problems = [], [], [], []
                for kind, blocks, digest, problem in zip(column(batch, "type"), column(batch, "blocks"), column(batch, "digest"), column(batch, "problem"), strict=True):
                    payload = size = None
                    said, problem = (digest.as_py() or "").removeprefix("sha256:"), problem.as_py()
                    own = said or None
                    if problem is None:
                        block = b"".join(blocks.as_py())
                        http, body = head(block) if block[:5] == b"HTTP/" else ({}, 0)
                        try:
                            if kind.as_py() == "revisit":
                                size = int(http.get("content-length", ""))
                            else:
                                payload = dechunked(block[body:]) if http.get("transfer-encoding", "").lower() == "chunked" else block[body:]
                                size, own = len(payload), hashlib.sha256(payload).hexdigest()
                                if said and said != own:
                                    problem = "the payload's digest differs"
                        except ValueError as e:
                            payload, problem = None, str(e) or "broken framing"
                    payloads.append(payload)
                    sizes.append(size)
                    digests.append(own)
                    problems.append(problem)
                yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("record_id", "type", "page_id", "refers_to")] + [pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(problems, pa.string())], names=["record_id", "type", "page_id", "refers_to", "payload", "payload_bytes", "payload_digest", "problem"])

    return records.mapInArrow(go, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    back = decoded(reassembled(read_records(write_archives(pages))))
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
     r AS (SELECT d, min(page_id) AS m FROM p WHERE b >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.b AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN r.m IS NULL OR r.m = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r.m <> p.page_id THEN r.m END AS refers_to
FROM p LEFT JOIN r ON p.d = r.d AND p.b >= 100
"""
