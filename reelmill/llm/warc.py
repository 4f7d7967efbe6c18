"""WARC derivatives: for each response record a metadata record and a plain-text conversion record that refer to it.

A record is bytes: version line, named fields, empty line, block, two empty lines. Derived records keep the source's
target URI and date, name it in WARC-Refers-To (with its URI and date), and carry digests of their own blocks; the
metadata block lists the source's digests, its WARC and HTTP header fields, title and links. Record ids are derived
from the source's id, so a rerun gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import byte_pieces
from reelmill.llm.html_blocks import parse

#: Bytes of pages or records that a task takes from a batch at once.
PIECE_BYTES = 4 << 20
VERSION = "WARC/1.1"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:reelmill:warc")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def _clean(value: str) -> str:
    return " ".join(value.split())


def build(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record of these fields and block; Content-Length and WARC-Block-Digest are added."""
    fields = [*fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return (VERSION + "\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields)).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def _named(fields: list[tuple[str, str]]) -> dict[str, str]:
    return {k.lower(): v for k, v in fields}


def read(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Named fields and block; ValueError if it is no whole record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not gap:
        raise ValueError("no WARC header")
    fields = _fields(head)
    n = _named(fields).get("content-length", "")
    if not n.isdigit() or len(rest) < int(n):
        raise ValueError("block shorter than Content-Length")
    return fields, rest[: int(n)]


def unchunked(payload: bytes) -> bytes:
    """The data of a chunked body; ValueError if it ends before its last chunk or a size is no number."""
    parts, at = [], 0
    while True:
        stop = payload.find(b"\r\n", at)
        size = payload[at:stop].split(b";")[0].strip() if stop >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            raise ValueError("chunked body is cut off" if stop < 0 or not size else "bad chunk size")
        n, at = int(size, 16), stop + 2
        if n == 0:
            return b"".join(parts)
        if at + n > len(payload):
            raise ValueError("chunked body is cut off")
        parts.append(payload[at : at + n])
        at += n + 2


def inflated(body: bytes, coding: str) -> bytes:
    """A body in gzip (of one or more members) or deflate (with a zlib header or, as some servers send it, without)."""
    if coding in ("gzip", "x-gzip"):
        return gzip.decompress(body)
    if coding == "deflate":
        for window in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
            found = zlib.decompressobj(window)
            try:
                data = found.decompress(body)
            except zlib.error:
                continue
            if found.eof:
                return data
        raise ValueError("deflated body is broken or cut off")
    if coding in ("", "identity"):
        return body
    raise ValueError(f"unknown content coding {coding}")


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes]:
    """Status line, fields, payload as sent and payload decoded (chunked, gzip, deflate)."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not gap:
        raise ValueError("no HTTP header")
    fields = _fields(head)
    named, body = _named(fields), payload
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = unchunked(payload)
    for coding in reversed([c.strip() for c in named.get("content-encoding", "").lower().split(",") if c.strip()]):
        body = inflated(body, coding) if body else body
    return head.split(b"\r\n")[0].decode("latin-1"), fields, payload, body


MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
META = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)


def charset_of(kind: str, body: bytes) -> str:
    """By the byte order mark, the content type, the page's own meta element (in its first 1024 bytes), else UTF-8."""
    marked = next((name for mark, name in MARKS if body.startswith(mark)), None)
    said = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", kind, re.I)
    meta = META.search(body[:1024])
    return marked or (said[1] if said else meta[1].decode("latin-1") if meta else "utf-8")


def response(uri: str, date: str, payload: bytes, kind: str = "text/html; charset=utf-8") -> bytes:
    """A response record of an HTTP payload; its id is derived from URI, date and payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", uri, date, digest(payload))), ("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload))]
    return build(fields, block)


def derive(record: bytes | None) -> list[dict]:
    """The metadata and conversion records of a response, as rows; one row with a violation if it can't be read.

    Records of other types give no rows. A block or payload digest in sha1 that does not match the bytes is reported
    (digest_ok false) and kept as it was written.
    """
    try:
        fields, block = read(record or b"")
        named = _named(fields)
        if named.get("warc-type", "").lower() != "response":
            return []
        source, uri, date = named.get("warc-record-id", ""), named.get("warc-target-uri", ""), named.get("warc-date", "")
        if not source:
            raise ValueError("no WARC-Record-ID")
        status, http, payload, body = http_parts(block)
    except (ValueError, EOFError, OSError, zlib.error) as e:
        return [{"violation": str(e) or type(e).__name__}]
    kind = _named(http).get("content-type", "")
    try:
        page = body.decode(charset_of(kind, body), "replace")
    except (LookupError, UnicodeError):
        page = body.decode("utf-8", "replace")
    told = {"block": named.get("warc-block-digest", ""), "payload": named.get("warc-payload-digest", "")}
    ok = all(not d.startswith("sha1:") or d == digest(x) for d, x in ((told["block"], block), (told["payload"], payload)))
    is_html = "html" in kind or not kind
    parsed = parse(page) if is_html else None
    text = "\n".join(b.text for b in parsed.blocks) if parsed else page
    about = [("source-status", status), ("source-content-type", kind), ("source-block-digest", told["block"] or digest(block)), ("source-payload-digest", told["payload"] or digest(payload)), ("source-digests-match", str(ok).lower())]
    about += [("title", parsed.title)] * bool(parsed and parsed.title.strip())
    about += [(f"warc-{k}", v) for k, v in fields] + [(f"http-{k}", v) for k, v in http] + [("outlink", u) for u in (parsed.links if parsed else [])]
    refers = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    made = []
    for what, content, data in (("metadata", "application/warc-fields", "".join(f"{k}: {_clean(v)}\r\n" for k, v in about).encode()), ("conversion", "text/plain; charset=utf-8", text.encode())):
        own = record_id(what, source)
        whole = build([("WARC-Type", what), ("WARC-Record-ID", own), ("WARC-Target-URI", uri), ("WARC-Date", date), *refers, ("Content-Type", content)], data)
        made.append({"record_type": what, "record_id": own, "refers_to": source, "target_uri": uri, "date": date, "content_type": content, "content_length": len(data), "block_digest": digest(data), "source_block_digest": told["block"] or digest(block), "source_payload_digest": told["payload"] or digest(payload), "digest_ok": ok, "outlinks": len(parsed.links) if parsed else 0, "record": whole, "violation": None})
    return made


SCHEMA = "key long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, digest_ok boolean, outlinks long, record binary, violation string"
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
_NAMES, _KINDS = zip(*(x.split() for x in SCHEMA.split(", ")), strict=True)


def derivatives(responses: DataFrame, key_col: str, record_col: str = "record") -> DataFrame:
    """Two rows (metadata, conversion) for each response record, with the whole derived record in `record`.

    Null and malformed records give one row with a violation and nulls; records of other types give none. Repeated rows
    are converted one by one and give the same ids. An empty table gives no rows. Records are complete WARC records:
    gzipped one by one and concatenated, they are a .warc.gz file.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[k]) for n, k in zip(_NAMES, _KINDS, strict=True)], list(_NAMES))

        for batch in byte_pieces(batches, 1, PIECE_BYTES):
            rows, size = [], 0
            for key, record in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made = derive(record.as_py())
                rows += [{"key": key} | r for r in made]
                size += sum(len(r.get("record") or b"") for r in made)
                if size > 8 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return responses.select(F.col(key_col).cast("long").alias("key"), F.col(record_col).alias("record")).mapInArrow(run, SCHEMA)


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """key, record: a WARC response record of every page (null html: empty payload; null url: empty URI)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_pieces(batches, 2, PIECE_BYTES):
            made = [response(u or "", date, (h.as_py() or "").encode()) for u, h in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["key", "record"])

    return pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "key long, record binary")
