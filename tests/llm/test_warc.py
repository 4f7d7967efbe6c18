import base64
import gzip
import hashlib
import time
import zlib

from reelmill.llm import warc as W
from reelmill.llm.html_blocks import parse
from reelmill.llm.queries import op5_warc_derivatives


def test_round_trip_and_links(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<title>T</title><p>A &amp; B<p>C<a href='/y'>d</a>"), (2, None, None), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    rows = W.derivatives(W.page_responses(pages), "key").collect()
    assert len(rows) == 8 and all(r.digest_ok and r.violation is None for r in rows)
    one = {r.record_type: r for r in rows if r.key == 1}
    source = bytes(W.page_responses(pages).filter("key = 1").first().record)
    fields, block = W.read(source)
    named = dict(fields)
    for kind, r in one.items():
        got, data = W.read(bytes(r.record))
        got = dict(got)
        assert got["WARC-Type"] == kind and got["WARC-Refers-To"] == named["WARC-Record-ID"] == r.refers_to
        assert got["WARC-Refers-To-Target-URI"] == got["WARC-Target-URI"] == "http://a/x" and got["WARC-Refers-To-Date"] == named["WARC-Date"]
        assert got["WARC-Block-Digest"] == W.digest(data) == r.block_digest and r.source_payload_digest == named["WARC-Payload-Digest"]
    assert W.read(bytes(one["conversion"].record))[1].decode() == "A & B\nCd"
    about = W.read(bytes(one["metadata"].record))[1].decode()
    assert "title: T\r\n" in about and "outlink: /y\r\n" in about and "http-Content-Type: text/html" in about
    assert len({r.record_id for r in rows if r.key == 2}) == 2


def test_sent_codings_bad_digests_and_violations(spark):
    body = b"<p>zip</p>"
    zipped = gzip.compress(body)
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked
    good = W.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>"), ("WARC-Payload-Digest", "sha1:BAD")], block)
    other = W.build([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:b>")], b"x")
    rows = W.derivatives(spark.createDataFrame([(1, good), (2, other), (3, b"junk"), (4, None), (5, good[:-40])], "k long, record binary"), "k").collect()
    assert [r.record_type for r in rows if r.key == 1] == ["metadata", "conversion"] and not any(r.digest_ok for r in rows if r.key == 1)
    assert W.read(bytes([r for r in rows if r.key == 1][1].record))[1] == b"zip"
    assert [r.key for r in rows if r.violation] == [3, 4, 5] and not [r for r in rows if r.key == 2]
    assert W.derivatives(spark.createDataFrame([], "k long, record binary"), "k").collect() == []


def http(body, *fields):
    return W.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>")], b"HTTP/1.1 200 OK\r\n" + b"".join(f + b"\r\n" for f in fields) + b"\r\n" + body)


def said(record):
    rows = W.derive(record)
    return rows[0]["violation"] or W.read(rows[1]["record"])[1].decode()


def test_codings_that_servers_send():
    page = "<p>Größe</p>".encode()
    raw = zlib.compressobj(wbits=-15)
    assert said(http(zlib.compress(page), b"Content-Encoding: deflate")) == "Größe"
    assert said(http(raw.compress(page) + raw.flush(), b"Content-Encoding: deflate")) == "Größe"
    assert said(http(gzip.compress(page)[:-9], b"Content-Encoding: gzip")).startswith("Compressed file ended")
    assert said(http(zlib.compress(page)[:-5], b"Content-Encoding: deflate")) == "deflated body is broken or cut off"
    assert said(http(page, b"Content-Encoding: br")) == "unknown content coding br"
    for cut in (b"10\r\nabc", b"3\r\nabc\r\n", b"3\r\nabc\r\n5", b""):
        assert said(http(cut, b"Transfer-Encoding: chunked")) == "chunked body is cut off"
    assert said(http(b"zz\r\nabc", b"Transfer-Encoding: chunked")) == "bad chunk size"
    assert said(http(b"3;x=1\r\n<p>\r\n2\r\nok\r\n0\r\n\r\n", b"Transfer-Encoding: chunked")) == "ok"


def test_charsets():
    old = "<html><head><meta http-equiv='Content-Type' content='text/html; charset=ISO-8859-1'></head><p>Größe".encode("latin-1")
    assert said(http(old)) == "Größe" and said(http(old, b"Content-Type: text/html")) == "Größe"
    assert said(http("<meta charset=\"windows-1252\"><p>“x”".encode("cp1252"))) == "“x”"
    assert said(http("<meta charset=latin1><p>é".encode(), b"Content-Type: text/html; charset=UTF-8")) == "é"
    assert said(http("<p>é".encode("utf-16"))) == "é" and said(http(b"<meta charset=nonsense><p>e")) == "e"


def test_many_chunks_take_linear_time():
    def seconds(n):
        body = b"1\r\na\r\n" * n + b"0\r\n\r\n"
        began = time.process_time()
        assert len(W.unchunked(body)) == n
        return time.process_time() - began

    seconds(1000)
    assert seconds(400_000) < 2


def test_columns_that_clash(spark):
    rows = [(1, "http://a", "<p>x</p>", "k", "r", "v", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, record string, violation string, record_type string")
    assert [r.record_type for r in W.derivatives(W.page_responses(pages), "key").collect()] == ["metadata", "conversion"]
    own = spark.createDataFrame([(1, W.response("u", "d", b"<p>x"), "k", "v", 3)], "id long, record binary, key string, violation string, outlinks int")
    assert [(r.key, r.violation) for r in W.derivatives(own, "id").collect()] == [(1, None)] * 2


def test_the_registered_query(spark, sf_dir):
    """Every record against one written out here from the page alone."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op5_warc_derivatives(spark, sf_dir).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == sorted((p, k) for p in pages for k in ("conversion", "metadata"))
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for r in rows:
        raw = (pages[r.page_id].html or "").encode()
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n".encode() + raw
        assert (r.source_block_digest, r.source_payload_digest, r.digest_ok, r.violation) == (sha1(block), sha1(raw), True, None)
        if r.record_type == "conversion":
            data = "\n".join(b.text for b in parse(pages[r.page_id].html).blocks).encode()
            head = [("WARC-Type", "conversion"), ("WARC-Record-ID", r.record_id), ("WARC-Target-URI", r.target_uri), ("WARC-Date", r.date), ("WARC-Refers-To", r.refers_to), ("WARC-Refers-To-Target-URI", r.target_uri), ("WARC-Refers-To-Date", r.date), ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", sha1(data)), ("Content-Length", str(len(data)))]
            whole = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + data + b"\r\n\r\n"
            assert (r.content_length, r.block_digest, r.record_sha256) == (len(data), sha1(data), hashlib.sha256(whole).hexdigest())
    assert len({r.record_id for r in rows}) == len(rows)
    assert all(len({r.refers_to for r in rows if r.page_id == p}) == 1 for p in list(pages)[:50])
