"""Pages are read as the standard library's parser reads them, in time linear in their length; only responses count."""

import gzip
import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platehouse.llm import warc


class _Plain(HTMLParser):
    """The same rules on the standard library's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.hidden = [], [], None

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in warc._HIDDEN:
            self.hidden = tag
            self.out.append(" ")
        elif tag in warc._BREAKS:
            self.out.append("\n")
        elif tag == "a" and dict(attrs).get("href"):
            self.links.append(" ".join(dict(attrs)["href"].split()))

    def handle_endtag(self, tag):
        if self.hidden == tag:
            self.hidden = None
        elif not self.hidden and tag in warc._BREAKS:
            self.out.append("\n")

    def handle_comment(self, data):
        if not self.hidden:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


PIECES = ["one", " two ", "\n", "&amp;", "&eacute;", "<p>", "</p>", "<br/>", "<b>", "</b>", "<a href='/x?a=1&amp;b'>", '<a class="k" HREF="y z">', "<a href=q>", "</a>", "<script>if (a < b) x()</script>", "<STYLE>p{}</STYLE>", "<!-- no -->", "<noscript>n</noscript>", "<h1 id=1>", "5 < 6"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_pages_read_as_the_standard_parser_does(pieces):
    page = "".join(pieces)
    plain = _Plain()
    plain.feed(page)
    plain.close()
    text = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\v\xa0]+", " ", "".join(plain.out))).strip()
    assert warc.read_page(page) == (text, plain.links)


@pytest.mark.parametrize("piece", ["<a ", "<", "<script ", "<script>", "<title", "<title>", "<!--", "</", "<a href=", "<a href='", "& ", "<p "])
def test_a_megabyte_of_broken_markup_takes_no_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    warc.read_page(page)
    warc.title_of(page)
    assert time.perf_counter() - began < 1.5


def _response(block, *more, kind="response", rid="<urn:uuid:1>"):
    return warc.record([("WARC-Type", kind), *([("WARC-Record-ID", rid)] if rid else []), ("WARC-Date", "2024-01-01T00:00:00Z"), *more], block)


def _text(data):
    return warc.parse(warc.derivatives(data)[1][2])[1].decode()


def test_only_responses_have_derivatives():
    assert warc.derivatives(_response(b"GET / HTTP/1.1\r\n\r\n", kind="request")) == []


def test_chunked_and_compressed_payloads():
    page = "<p>é one</p>".encode()
    packed = gzip.compress(page)
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (packed[:7], packed[7:])) + b"0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    assert _text(_response(head + b"Content-Encoding: gzip\r\n\r\n" + packed)) == "é one"
    assert _text(_response(head + b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks)) == "é one"
    assert _text(_response(head + b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + page)) == "é one"


def test_records_without_an_id_and_line_ends_in_links():
    one, two = (_response(b"HTTP/1.1 200 OK\r\n\r\n<a href='/x&#13;&#10;title: forged'>" + p, rid="") for p in (b"1", b"2"))
    a, b = warc.derivatives(one), warc.derivatives(two)
    assert len({h["WARC-Record-ID"] for _, h, _ in a + b}) == 4 and "WARC-Refers-To" not in a[0][1]
    assert "outlink: /x title: forged" in warc.parse(a[0][2])[1].decode().split("\r\n")
