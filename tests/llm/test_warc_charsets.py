"""Responses whose headers name odd charsets, statuses and codings; none stops the job."""

import gzip
import zlib

import pytest

from platehouse.llm import warc

PAGE = "<title>é</title><p>naïve ñ</p>"


def _response(head: bytes, payload: bytes) -> bytes:
    block = head + b"\r\n\r\n" + payload
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("Content-Type", "application/http")], block)


def _read(head: bytes, payload: bytes) -> tuple[str, dict[str, str]]:
    (_, _, meta), (_, _, text) = warc.derivatives(_response(head, payload))
    fields = dict(line.split(": ", 1) for line in meta.partition(b"\r\n\r\n")[2].decode().split("\r\n") if ": " in line)
    return text.partition(b"\r\n\r\n")[2].decode().strip(), fields


@pytest.mark.parametrize(("content", "encoding"), [
    ("text/html; charset=undefined", "utf-8"), ("text/html; charset=idna", "utf-8"), ("text/html; charset=nonsense", "utf-8"), ("text/html; charset=rot13", "utf-8"), ("text/html; charset=base64", "utf-8"),
    ("text/html; Charset=ISO-8859-1", "latin-1"), ("text/html; CHARSET = 'windows-1252'", "cp1252"), ('text/html;charset="utf-16"', "utf-16"), ("text/html", "utf-8"), ("text/html; charset=\x00", "utf-8"),
])
def test_charsets(content, encoding):
    text, fields = _read(b"HTTP/1.1 200 OK\r\nContent-Type: " + content.encode(), PAGE.encode(encoding))
    assert "naïve ñ" in text and fields["title"] == "é"


def test_a_page_declares_its_charset():
    page = '<html><head><meta http-equiv="Content-Type" content="text/html; charset=iso-8859-1"></head>' + PAGE
    assert "naïve ñ" in _read(b"HTTP/1.1 200 OK", page.encode("latin-1"))[0]
    assert "naïve ñ" in _read(b"HTTP/1.1 200 OK", ('<META CHARSET=windows-1252>' + PAGE).encode("cp1252"))[0]
    assert "naïve ñ" in _read(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8", ('<meta charset="latin-1">' + PAGE).encode())[0]


@pytest.mark.parametrize(("line", "status"), [(b"HTTP/2 200 OK", "200"), (b"HTTP/1.1 404 Not Found", "404"), (b"HTTP/1.1  301", "301"), (b"HTTP/1.0", ""), (b"HTTP/3 204", "204")])
def test_status(line, status):
    assert _read(line, b"x")[1].get("source-status", "").strip() == status


def test_codings(monkeypatch):
    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: "
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(PAGE.encode()) + raw.flush()
    for coding, payload in ((b"deflate", raw), (b"deflate", zlib.compress(PAGE.encode())), (b"gzip", gzip.compress(PAGE.encode())), (b"gzip", gzip.compress(PAGE[:10].encode()) + gzip.compress(PAGE[10:].encode())), (b"gzip", gzip.compress(PAGE.encode()) + b"\0" * 9)):
        assert "naïve ñ" in _read(head + coding, payload)[0]
    monkeypatch.setattr(warc, "MOST_UNPACKED", 1000)
    bomb = gzip.compress(b"word " * 100_000)
    assert warc.decoded({"content-encoding": "gzip"}, bomb) == bomb
    assert warc.decoded({"content-encoding": "gzip"}, gzip.compress(b"a" * 1000)) == b"a" * 1000
    assert warc.decoded({"content-encoding": "gzip"}, gzip.compress(b"a" * 100)[:-9]) == gzip.compress(b"a" * 100)[:-9]


def test_captures_of_other_pages_have_other_ids():
    ids = {warc.parse_all(warc.response("http://x/", page, "1", "2024-01-01T00:00:00Z"))[0][1] for page in ("a", "b", "b", None, "")}
    assert len(ids) == 3
