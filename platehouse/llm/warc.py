"""WARC derivatives: metadata and plain-text conversion records from response records, each linked to its source."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: line end, version line.
_EOL, _VERSION = b"\r\n", b"WARC/1.1"
#: Elements whose content is no text, and elements that end a line of text.
_HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "head", "template", "noscript")}
_BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer blockquote pre".split())
_NAME, _MARKUP = re.compile(r"/?([a-z][a-z0-9]*)", re.I), re.compile(r"[/!?a-z]", re.I)
_SPACES, _LINES = re.compile(r"[ \t\r\f\v\xa0]+"), re.compile(r" ?\n[ \n]*")
_TITLE, _HREF = re.compile(r"<title\b", re.I), re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: A payload that unpacks to more bytes stays packed, as one that is damaged does: few pages are as large, and bombs are.
MOST_UNPACKED = 256 << 20
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([^\s;\"',]+)", re.I)
_META = re.compile(rb"<meta\s[^>]*?charset\s*=\s*[\"']?([\w.:-]+)", re.I | re.A)


def digest(data: bytes) -> str:
    """The digest as WARC files label it: sha1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, headers and its length, block, two line ends."""
    lines = [_VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return _EOL.join(lines) + _EOL * 2 + block + _EOL * 2


def _fields(lines: list[bytes], encoding: str) -> list[tuple[str, str]]:
    """(name, value) of every header line in order, repeats included; a line that begins with a space goes on the last."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode(encoding, "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}".strip())
        elif text.strip():
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse_all(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Every header (as written, repeats included) and the block of one record, plain or gzipped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, found, rest = data.partition(_EOL * 2)
    first, *lines = head.split(_EOL)
    if not found or not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _fields(lines, "utf-8")
    n = int({k.lower(): v for k, v in headers}["content-length"])
    if len(rest) < n:
        raise ValueError("the record is cut short")
    return headers, rest[:n]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case, the last of repeats) and block of one record, plain or gzipped."""
    headers, block = parse_all(data)
    return {k.lower(): v for k, v in headers}, block


def read_page(page: str) -> tuple[str, list[str]]:
    """The visible text, one line for each block of it, entities resolved and spaces joined; the targets of its links.

    The page is scanned once from its start: markup that never ends is text, a hidden element that never ends hides the rest.
    """
    out, links, at = [], [], 0
    while (start := page.find("<", at)) >= 0:
        out.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            out.append(" ")
            at = end + 3 if end >= 0 else len(page)
            continue
        if not _MARKUP.match(page, start + 1):
            out.append("<")
            at = start + 1
            continue
        end = page.find(">", start)
        if end < 0:
            at = start
            break
        at = end + 1
        name = _NAME.match(page, start + 1)
        kind, opens = name[1].lower() if name else "", page[start + 1] != "/"
        if kind in _HIDDEN and opens:
            close = _HIDDEN[kind].search(page, at)
            out.append(" ")
            at = close.end() if close else len(page)
        elif kind in _BREAKS:
            out.append("\n")
        elif kind == "a" and opens and (href := _HREF.search(page, start, end)):
            links.append(_one_line(entities.unescape(href[1] or href[2] or href[3] or "")))
    out.append(page[at:])
    return _LINES.sub("\n", _SPACES.sub(" ", entities.unescape("".join(out)))).strip(), [x for x in links if x]


def title_of(page: str) -> str:
    """The first title's text; empty where it never ends or there is none."""
    begin = _TITLE.search(page)
    inner = page.find(">", begin.end()) + 1 if begin else 0
    end = re.compile("</title", re.I).search(page, inner) if inner else None
    return _one_line(entities.unescape(page[inner : end.start()])) if end else ""


def decoded(http: dict[str, str], payload: bytes) -> bytes:
    """The payload without chunks and compression that its headers name; as it is where they don't hold."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        parts, at = [], 0
        while (eol := payload.find(_EOL, at)) >= 0:
            try:
                n = int(payload[at:eol].split(b";")[0], 16)
            except ValueError:
                parts = [payload]  # stored without its chunks
                break
            if n == 0:
                break
            parts.append(payload[eol + 2 : eol + 2 + n])
            at = eol + 4 + n
        payload = b"".join(parts) if parts else payload
    for coding in reversed([c.strip() for c in http.get("content-encoding", "").lower().split(",")]):
        if coding in ("gzip", "x-gzip", "deflate"):
            unpacked = next((x for x in (_unpacked(payload, bits) for bits in ((47, -15) if coding == "deflate" else (47,))) if x is not None), None)
            if unpacked is None:
                break
            payload = unpacked
    return payload


def _unpacked(payload: bytes, bits: int) -> bytes | None:
    """The members of a compressed payload, unpacked; None if it is damaged or unpacks to more than MOST_UNPACKED bytes."""
    out, room = [], MOST_UNPACKED
    while payload:
        member = zlib.decompressobj(bits)
        try:
            out.append(member.decompress(payload, room + 1))
        except zlib.error:
            return b"".join(out) if out else None  # what follows the last member is padding
        room -= len(out[-1])
        if room < 0 or not member.eof:
            return None
        payload = member.unused_data
    return b"".join(out)


def charset_of(content_type: str, payload: bytes) -> str:
    """The charset that a response's header names, or else its page's own declaration at the top; UTF-8 if there is none."""
    if named := _CHARSET.search(content_type):
        return named[1]
    declared = _META.search(payload, 0, 1024)
    return declared[1].decode("ascii") if declared else "utf-8"


def text_of(payload: bytes, charset: str) -> str:
    """The payload as text; charsets that are unknown, or that Python has but not for texts of bytes, are read as UTF-8."""
    try:
        return payload.decode(charset, "replace")
    except (LookupError, ValueError):  # UnicodeError is a ValueError
        return payload.decode("utf-8", "replace")


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def response(url: str | None, page: str | None, key: str, date: str) -> bytes:
    """A response record for a page: an HTTP message and the digests of its payload and block."""
    payload = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    target = [("WARC-Target-URI", _one_line(url))] if url else []
    return record([("WARC-Type", "response"), ("WARC-Record-ID", _id("response", key, url or "", digest(payload))), ("WARC-Date", date), *target, ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def derivatives(data: bytes) -> list[tuple[str, dict[str, str], bytes]]:
    """(kind, headers, whole record) of the metadata and of the conversion record of a response; none of other records.

    Both refer to the response by id, date and target; the conversion also to the metadata record made with it. Digests of
    the source are taken over where it has them and made where not. A source without an id is referred to by date and target
    alone, and its bytes tell its derivatives' ids. Text is read from the payload without chunks and compression. A block without an HTTP head is all payload. The
    metadata record holds every header of the source, in order and with repeats: source-warc-<name> of the record,
    source-http-<name> of the HTTP head, whose first line is source-http.
    """
    source_fields, block = parse_all(data)
    source = {k.lower(): v for k, v in source_fields}
    if source.get("warc-type", "").lower() != "response":
        return []
    head, found, payload = block.partition(_EOL * 2)
    if not (found and head.startswith(b"HTTP/")):
        head, payload = b"", block
    first, *lines = head.split(_EOL)
    http_fields = _fields(lines, "latin-1")
    http = {k.lower(): v for k, v in http_fields}
    plain = decoded(http, payload)
    page = text_of(plain, charset_of(http.get("content-type", ""), plain))
    payload_digest, block_digest = source.get("warc-payload-digest") or digest(payload), source.get("warc-block-digest") or digest(block)
    (text, links), title = read_page(page), title_of(page)
    rid = source.get("warc-record-id", "")
    ids = {kind: _id(kind, rid or digest(data)) for kind in ("metadata", "conversion")}
    refers = [("WARC-Refers-To", rid)] * bool(rid) + [(to, source[k]) for k, to in (("warc-target-uri", "WARC-Refers-To-Target-URI"), ("warc-date", "WARC-Refers-To-Date"), ("warc-target-uri", "WARC-Target-URI"), ("warc-date", "WARC-Date")) if k in source]
    fields = [("source-status", (first.decode("latin-1").split() + ["", ""])[1]), ("source-content-type", http.get("content-type", "")), ("source-content-length", str(len(payload))), ("source-payload-digest", payload_digest), ("source-block-digest", block_digest), ("title", title), ("text-length", str(len(text))), *(("outlink", x) for x in links)]
    if first:
        fields.append(("source-http", first.decode("latin-1")))
    fields += [(f"source-{of}-{k.lower()}", v.replace("\r", " ").replace("\n", " ")) for of, found in (("http", http_fields), ("warc", source_fields)) for k, v in found]
    out = []
    for kind, content, body, more in (
        ("metadata", "application/warc-fields", _EOL.join(f"{k}: {v}".encode() for k, v in fields) + _EOL, []),
        ("conversion", "text/plain; charset=utf-8", text.encode(), [("WARC-Concurrent-To", ids["metadata"]), ("WARC-Source-Payload-Digest", payload_digest)]),
    ):
        headers = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), *refers, *more, ("WARC-Block-Digest", digest(body)), ("Content-Type", content)]
        out.append((kind, dict(headers) | {"length": str(len(body)), "source-payload-digest": payload_digest, "source-block-digest": block_digest, "outlinks": str(len(links))}, record(headers, body)))
    return out


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and response record (binary) of each row of pages (page_id, url, html); null html is an empty page.

    Rows alike in page_id, url and html get the same record id, as they are the same capture.
    """

    @F.pandas_udf("binary")
    def build(ids: pd.Series, urls: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([response(u, h, i or "", date) for i, u, h in zip(ids, urls, html, strict=True)], dtype=object)

    return pages.select("page_id", build(F.col("page_id").cast("string"), "url", "html").alias("record"))


def derive(found: DataFrame) -> DataFrame:
    """Two rows for each row of found (page_id, record): the metadata and the conversion record, whole in `record`.

    A null record and one of another type have none; one that is no WARC record is an error, as a damaged file should not pass unseen.
    """
    schema = "page_id long, kind string, record_id string, refers_to string, refers_to_uri string, refers_to_date string, concurrent_to string, source_payload_digest string, source_block_digest string, block_digest string, length long, outlinks long, record binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, data in zip(batch["page_id"], batch["record"], strict=True):
                for kind, h, whole in derivatives(data) if data is not None else []:
                    rows.append((None if pd.isna(page) else int(page), kind, h["WARC-Record-ID"], h.get("WARC-Refers-To"), h.get("WARC-Refers-To-Target-URI"), h.get("WARC-Refers-To-Date"), h.get("WARC-Concurrent-To"), h["source-payload-digest"], h["source-block-digest"], h["WARC-Block-Digest"], int(h["length"]), int(h["outlinks"]), whole))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["page_id"] = out["page_id"].astype("Int64")
            yield out

    return found.select("page_id", "record").mapInPandas(run, schema)


def digests(derived: DataFrame) -> DataFrame:
    """The derived records without their bytes: their size and crc32 instead."""
    return derived.select(*[c for c in derived.columns if c != "record"], F.octet_length("record").cast("long").alias("record_bytes"), F.crc32("record").alias("record_crc32"))


def gzipped(derived: DataFrame) -> DataFrame:
    """The records as gzip members: the members of any number of rows, one after another, are a .warc.gz file."""

    @F.pandas_udf("binary")
    def member(records: pd.Series) -> pd.Series:
        return records.map(lambda r: None if r is None else gzip.compress(r, mtime=0))

    return derived.withColumn("record", member("record"))
