"""Every header of a response record is kept in its metadata record."""

import gzip

from platehouse.llm import warc

HTTP = [("Date", "Mon, 01 Jan 2024 00:00:00 GMT"), ("Server", "ngx"), ("Last-Modified", "yesterday"), ("ETag", '"a:b"'), ("Content-Language", "de"), ("Set-Cookie", "a=1"), ("set-cookie", "b=2"), ("Content-Type", "text/html; charset=latin-1"), ("Location", "http://x/é?a:b"), ("X-Empty", "")]
WARC = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", "http://x/é"), ("WARC-IP-Address", "10.0.0.1"), ("WARC-Truncated", "length"), ("WARC-Identified-Payload-Type", "text/html"), ("WARC-Warcinfo-ID", "<urn:uuid:2>"), ("WARC-Concurrent-To", "<urn:uuid:3>"), ("WARC-Concurrent-To", "<urn:uuid:4>"), ("Content-Type", "application/http; msgtype=response")]


def _metadata(data: bytes) -> list[str]:
    (kind, _, record), _ = warc.derivatives(data)
    assert kind == "metadata"
    return warc.parse(record)[1].decode().split("\r\n")


def test_metadata_keeps_every_source_header():
    block = b"\r\n".join([b"HTTP/1.1 301 Moved Permanently", *(f"{k}: {v}".encode("latin-1") for k, v in HTTP), b"X-Folded: one", b"\ttwo"]) + b"\r\n\r\n<p>\xe9</p>"
    data = warc.record(WARC, block)
    for source in (data, gzip.compress(data)):
        lines = _metadata(source)
        expect = [f"source-http-{k.lower()}: {v}" for k, v in [*HTTP, ("X-Folded", "one two")]] + [f"source-warc-{k.lower()}: {v}" for k, v in [*WARC, ("Content-Length", str(len(block)))]]
        assert [x for x in lines if x.startswith(("source-http-", "source-warc-"))] == expect
        assert "source-http: HTTP/1.1 301 Moved Permanently" in lines and "source-status: 301" in lines and "source-content-type: text/html; charset=latin-1" in lines
    assert warc.parse(warc.derivatives(data)[1][2])[1].decode() == "é"


def test_metadata_of_a_block_without_http_head():
    lines = _metadata(warc.record(WARC[:3], b"plain"))
    assert not any(x.startswith("source-http") for x in lines) and "source-warc-warc-record-id: <urn:uuid:1>" in lines
