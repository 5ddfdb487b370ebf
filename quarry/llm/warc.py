"""WARC derivative builder: metadata and plain-text conversion records from response records.

Each response gives a conversion record with the visible text of its payload and a metadata record with its source's
headers and digests. Both refer to the response (WARC-Refers-To) and to each other (WARC-Concurrent-To); identifiers
follow from the source's, so that a repeated run makes the same records.

Cases: null html is an empty payload; a null url gives a record without target. A record that isn't a response gives no
derivative; one that can't be read, its compression included, gives a row of type issue, and the records after it are
read. Equal rows give equal records. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.html_blocks import blocks_of
from quarry.session import ship

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
END = b"\r\n"
#: How a gzip member begins; compressed bytes that are read at once.
GZIP, PIECE = b"\x1f\x8b\x08", 1 << 12


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=4)}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {' '.join(str(v).split())}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END * 2 + block + END * 2


def parse_headers(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and headers; a line that begins with white space continues the one before."""
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    out: list[tuple[str, str]] = []
    for x in lines:
        if x[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {x.strip()}")
        elif ":" in x:
            k, v = x.split(":", 1)
            out.append((k.strip(), v.strip()))
    return first, out


def inflated(data: memoryview, at: int) -> tuple[list[bytes], int]:
    """Content of the gzip member at a place and where it ends; -1 where it is damaged: what was before that counts."""
    z, out = zlib.decompressobj(31), []
    while not z.eof and at < len(data):
        part = data[at : at + PIECE]
        try:
            out.append(z.decompress(part))
        except zlib.error:
            return out, -1
        at += len(part) - len(z.unused_data)
    return out, at if z.eof else -1


def segments(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """(content, whether it ends as it should) of a file compressed by record or not, parted where it is damaged.

    After a damaged member, or bytes that belong to none, the next member is looked for.
    """
    if data[:2] != GZIP[:2]:
        yield data, True
        return
    run, at, view, lost = [], 0, memoryview(data), False
    while at >= 0:
        out, end = inflated(view, at)
        if lost and end < 0 and not any(out):  # no member begins here: still the same damage
            at = data.find(GZIP, at + 1)
            continue
        run, lost = run + out, False
        if end >= 0 and data.startswith(GZIP, end):
            at = end
        elif end >= 0 and not data[end:].strip(b"\0\r\n "):
            break
        else:
            yield b"".join(run), False
            run, lost, at = [], True, data.find(GZIP, at + 1 if end < 0 else end)
    if run:
        yield b"".join(run), True


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes | None]]:
    """(headers, block) of every record of a WARC file's content; block is None for a broken one, after which the next is looked for.

    Damage of the compression is a broken record too, without headers where it leaves none.
    """
    for content, sound in segments(data):
        broken = False
        for headers, block in plain_records(content):
            broken = block is None
            yield headers, block
        if not sound and not broken:
            yield [], None


def plain_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes | None]]:
    at = data.find(b"WARC/")
    while at >= 0:
        cut = data.find(END * 2, at)
        _, headers = parse_headers(data[at : cut if cut >= 0 else len(data)])
        size = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isascii() and v.isdigit()), -1)
        end = cut + 4 + size
        if cut < 0 or size < 0 or end > len(data):
            yield headers, None
            at = data.find(b"\nWARC/", at) + 1 or -1
            continue
        yield headers, data[cut + 4 : end]
        at = data.find(b"WARC/", end)


def response(url: str | None, html: str | None, key: str, date: str = DATE) -> bytes:
    """A response record for a page; its identifier follows from key, address and content."""
    payload = (html or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    sha = digest(payload)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url or "", sha)), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha), ("WARC-Block-Digest", digest(block))]
    return record(headers, block)


def decoded(body: bytes, http: list[tuple[str, str]]) -> bytes:
    """An HTTP body without its transfer and content codings; as it is where it doesn't keep to them."""
    h = {k.lower(): v.lower() for k, v in http}
    if h.get("transfer-encoding") == "chunked":
        out, at = [], 0
        while (cut := body.find(END, at)) >= 0:
            try:
                size = int(body[at:cut].split(b";")[0], 16)
            except ValueError:
                return body
            if not size:
                break
            out.append(body[cut + 2 : cut + 2 + size])
            at = cut + 4 + size
        body = b"".join(out)
    if h.get("content-encoding") in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):
            try:
                return zlib.decompressobj(bits).decompress(body)
            except zlib.error:
                continue
    return body


def derive(headers: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The conversion and the metadata record of a response; none for other records."""
    h = {k.lower(): v for k, v in headers}
    cut = block.find(END * 2)
    if h.get("warc-type") != "response" or "warc-record-id" not in h or cut < 0:
        return []
    status, http = parse_headers(block[:cut])
    payload = block[cut + 4 :]
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = kind.lower().partition("charset=")[2].split(";")[0].strip("\"' ") or "utf-8"
    body = decoded(payload, http)
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    plain = "\n".join(blocks_of(page)) if "html" in kind or not kind else page if kind.startswith("text/") else ""
    actual = digest(payload)
    source, uri, date = h["warc-record-id"], h.get("warc-target-uri"), h.get("warc-date", DATE)
    ids = {k: record_id(k, source) for k in ("conversion", "metadata")}
    found = h.get("warc-payload-digest")
    fields = [("source-status", status), *((f"source-http-{k.lower()}", v) for k, v in http), *((f"source-{k.lower()}", v) for k, v in headers if k.lower() not in ("content-length",)), ("source-payload-digest", actual), ("source-payload-length", str(len(payload)))]
    if found:
        fields.append(("source-digest-valid", str(found == actual).lower()))
    bodies = {"conversion": plain.encode(), "metadata": "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()}
    own_digest = {k: digest(b) for k, b in bodies.items()}
    out = []
    for k, other in (("conversion", "metadata"), ("metadata", "conversion")):
        own = [
            ("WARC-Type", k), ("WARC-Record-ID", ids[k]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
            ("WARC-Concurrent-To", ids[other]), ("Content-Type", "text/plain; charset=utf-8" if k == "conversion" else "application/warc-fields"), ("WARC-Block-Digest", own_digest[k]),
        ]
        out.append({"record_type": k, "record_id": ids[k], "refers_to": source, "concurrent_to": ids[other], "target_uri": uri, "source_digest": actual, "block_digest": own_digest[k], "content_length": len(bodies[k]), "record": record(own, bodies[k])})
    return out


def broken(headers: list[tuple[str, str]]) -> dict:
    """The row that reports a record that can't be read; it has no record of its own."""
    h = {k.lower(): v for k, v in headers}
    return {"record_type": "issue", "refers_to": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri")}


FIELDS = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, source_digest string, block_digest string, content_length long, record binary"
SCHEMA = pa.schema([("key", pa.int64())] + [(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in FIELDS.split(", ")])
STEP = 256


def derive_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            rows = []
            for key, data in zip(batch.column(0).slice(a, STEP).to_pylist(), batch.column(1).slice(a, STEP), strict=True):
                for h, b in records(data.as_py() or b""):
                    rows += [{"key": key, **d} for d in (derive(h, b) if b is not None else [broken(h)])]
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def respond_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            part = batch.slice(a, STEP)
            data = [response(u, h, str(k)) for k, u, h in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["key", "data"])


def responses(pages: DataFrame) -> DataFrame:
    """(key, data): a response record for each row of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(respond_all, "key long, data binary")


def derivatives(warcs: DataFrame) -> DataFrame:
    """Derived records of warcs (key, data): data is the content of a WARC file of any number of records."""
    ship(warcs.sparkSession)
    return warcs.select("key", "data").mapInArrow(derive_all, f"key long, {FIELDS}")


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """(key, data, path) of WARC files."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("key"), F.col("content").alias("data"), "path")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select(F.col("key").alias("page_id"), "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "source_digest", "block_digest", "content_length", F.sha1("record").alias("record_sha1"))
