"""WARC derivatives: from each response record a metadata and a plain-text conversion record.

Both refer to the response by WARC-Refers-To, its target and date; the metadata record
carries the response's HTTP headers and digests, the conversion record the page's text.
Records are made one response at a time, so memory is bounded by one page. Responses are read
from WARC files, plain or as gzip members (``read_records``, then ``derive_records``), or made from a
table of pages (``derivatives``). Chunked transfer and gzip or deflate content are undone; the
character set is that of the header, a byte order mark or a meta tag, else UTF-8 with
replacements. Each pass over a page takes time in proportion to it, whatever its tags.

Defined results: null html is an empty payload, which still has both records, with empty
text; a null url leaves the target out; repeated rows get records of equal content and,
their ids being derived from page and content, equal ids. Records other than responses, or without an id,
have no derivatives; a block that is no HTTP message is taken as the page itself; content that
cannot be unpacked is taken as it is; a broken WARC file gives the records before the break and one
of type ``x-broken``, which says where, and has no derivatives.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.common import slices, table

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: Elements that end a line.
BLOCKS = (
    "address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p "
    "pre section table td th tr ul title head body"
).split()
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_NAME = re.compile(r"</?([a-zA-Z][\w-]*)")
_CLOSE_TITLE = re.compile(r"</title\s*>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def _tags(page: str) -> Iterator[tuple[str, re.Match]]:
    """(name, match) of each tag. Nothing after the last > can be one, so each search ends where its tag does."""
    for tag in _TAG.finditer(page, 0, page.rfind(">") + 1):
        name = _NAME.match(tag[0])
        yield (name[1].lower() if name else "", tag)


def plain_text(page: str) -> str:
    """Visible text: block elements end lines, entities are resolved, blank lines go."""
    page, shown, at = _HIDDEN.sub("", page), [], 0
    for name, tag in _tags(page):
        shown += [page[at : tag.start()], "\n" if name in BLOCKS else ""]
        at = tag.end()
    lines = (" ".join(x.split()) for x in html.unescape("".join(shown) + page[at:]).split("\n"))
    return "\n".join(x for x in lines if x)


def page_facts(page: str) -> tuple[str, str, list[str]]:
    """Title, language and links of a page."""
    title = lang = None
    for name, tag in _tags(page):
        if name == "html" and lang is None and not tag[0].startswith("</"):
            found = _LANG.search(tag[0])
            lang = found[1] if found else ""
        if name == "title" and title is None and not tag[0].startswith("</"):
            end = _CLOSE_TITLE.search(page, tag.end())
            title = page[tag.end() : end.start()] if end else ""
    links = [_HREF.search(tag[0]) for name, tag in _tags(_HIDDEN.sub("", page)) if name == "a" and not tag[0].startswith("</")]
    return _one_line(html.unescape(title or "")), lang or "", [_one_line(html.unescape(next(x for x in m.groups() if x is not None))) for m in links if m]


def _unchunked(data: bytes) -> bytes:
    """The body of a chunked message; ValueError if it is none."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if len(data) < end + 2 + size:
            raise ValueError("short chunk")
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size


def _unpacked(data: bytes, coding: str) -> bytes:
    if coding in ("gzip", "x-gzip"):
        return b"".join(gunzip_members(data))
    if coding == "deflate":
        try:
            return zlib.decompress(data)
        except zlib.error:
            return zlib.decompress(data, -15)
    return data


def http_message(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, body) of a response block, the body without its transfer and content codings."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return [], block
    headers = [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if c]
    own = {k.lower(): v.lower() for k, v in headers}
    try:
        if "chunked" in own.get("transfer-encoding", ""):
            body = _unchunked(body)
        for coding in reversed(own.get("content-encoding", "").split(",")):
            body = _unpacked(body, coding.strip())
    except (ValueError, zlib.error):
        pass
    return headers, body


def decoded(headers: list[tuple[str, str]], body: bytes) -> str:
    """The page as text."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "").encode()
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    found = _CHARSET.search(kind) or _CHARSET.search(body[:4096])
    try:
        # Python's name latin-1 is the web's windows-1252.
        name = codecs.lookup(found[1].decode()).name if found else "utf-8"
        return body.decode({"iso8859-1": "cp1252", "ascii": "cp1252"}.get(name, name), "replace")
    except (LookupError, UnicodeError, ValueError):
        return body.decode("utf-8", "replace")


def gunzip_members(data: bytes) -> Iterator[bytes]:
    """The content of each gzip member in turn."""
    while data:
        member = zlib.decompressobj(31)
        yield member.decompress(data) + member.flush()
        if not member.eof:
            raise zlib.error("short gzip member")
        data = member.unused_data


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def response_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(payload), payload)


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as bytes; Content-Length is added."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a WARC file's bytes, plain or as gzip members."""
    if data.startswith(b"\x1f\x8b"):
        for member in gunzip_members(data):
            yield from parse(member)
        return
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers: list[tuple[str, str]] = []
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and headers:  # a folded header goes on
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            else:
                key, _, value = line.partition(":")
                headers.append((key.strip(), value.strip()))
        size = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not size.isdigit() or len(data) < end + 4 + int(size):
            raise ValueError(f"no whole WARC record at byte {at}")
        yield [h for h in headers if h[0].lower() != "content-length"], data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size) + 4


def response_record(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> tuple[list[tuple[str, str]], bytes]:
    """The response record (headers, block) of a fetched page."""
    payload = (page or "").encode()
    block = response_block(payload)
    name = f"{page_id} {url} {digest(payload)}"
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{uuid.uuid5(_SPACE, name).urn}>"), ("WARC-Date", date)]
    if url:
        headers.append(("WARC-Target-URI", _one_line(url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
    return headers, block


def _one_line(x: str) -> str:
    return " ".join(x.split())


#: Header names as the format spells them; files may spell them in other cases.
NAMES = "WARC-Type WARC-Record-ID WARC-Date WARC-Target-URI WARC-Payload-Digest WARC-Block-Digest WARC-Refers-To Content-Type".split()


def _standard(headers: list[tuple[str, str]]) -> dict[str, str]:
    spelled = {n.lower(): n for n in NAMES}
    return {spelled.get(k.lower(), k): v for k, v in headers}


def derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response record."""
    own = _standard(headers)
    fetched, body = http_message(block)
    page = decoded(fetched, body)
    source = own["WARC-Record-ID"]
    dated = [(k, own["WARC-Date"]) for k in ("WARC-Date",) if k in own]
    shared = [*dated, ("WARC-Refers-To", source), *(("WARC-Refers-To-Date", v) for _, v in dated)]
    if "WARC-Target-URI" in own:
        shared += [("WARC-Target-URI", own["WARC-Target-URI"]), ("WARC-Refers-To-Target-URI", own["WARC-Target-URI"])]
    title, lang, links = page_facts(page)
    fields = [("http-" + k.lower(), _one_line(v)) for k, v in fetched]
    fields += [("source-payload-digest", own.get("WARC-Payload-Digest", "")), ("source-block-digest", own.get("WARC-Block-Digest", ""))]
    fields += [("title", title), ("language", lang), *(("outlink", x) for x in links)]
    made = []
    for kind, content, body in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()),
        ("conversion", "text/plain; charset=utf-8", plain_text(page).encode()),
    ):
        name = f"<{uuid.uuid5(_SPACE, kind + source).urn}>"
        extra = [("WARC-Source-Payload-Digest", own["WARC-Payload-Digest"])] if "WARC-Payload-Digest" in own else []
        made.append(([("WARC-Type", kind), ("WARC-Record-ID", name), *shared, ("Content-Type", content), ("WARC-Block-Digest", digest(body)), *extra], body))
    return made


RECORDS = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_digest string, block_digest string, record binary"


_COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]


def _row(headers: list[tuple[str, str]], body: bytes) -> tuple:
    h = dict(headers)
    return (h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI"), h.get("WARC-Date"), h["Content-Type"], h.get("WARC-Source-Payload-Digest"), h["WARC-Block-Digest"], serialize(headers, body))


def _batch(rows: list[tuple], first: tuple[str, pa.DataType] | None = None) -> pa.RecordBatch:
    types = [*([first[1]] if first else []), *[pa.string()] * 8, pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*([first[0]] if first else []), *_COLUMNS])


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(page_id, the columns of ``RECORDS``): two rows per page; ``record`` is the serialized record."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(src.dtypes)["page_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                ids, urls, texts = (part.column(i).to_pylist() for i in range(3))
                rows = [(i, *_row(*made)) for i, url, page in zip(ids, urls, texts, strict=True) for made in derive(*response_record(i, url, page, date))]
                yield _batch(rows, ("page_id", part.schema.field(0).type))

    return src.mapInArrow(build, f"page_id {kind}, {RECORDS}")


def response_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(page_id, headers, block) of the responses that the derivatives of ``derivatives`` refer to."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(src.dtypes)["page_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                ids, urls, texts = (part.column(i).to_pylist() for i in range(3))
                made = [response_record(i, url, page, date) for i, url, page in zip(ids, urls, texts, strict=True)]
                heads = pa.array([h for h, _ in made], pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), heads, pa.array([b for _, b in made], pa.binary())], names=["page_id", "headers", "block"])

    return src.mapInArrow(build, f"page_id {kind}, headers map<string,string>, block binary")


def read_records(files: DataFrame, column: str = "content") -> DataFrame:
    """(headers map, block) of each record in a binary column, as from ``spark.read.format('binaryFile')``.

    A file is one row, so it has to fit into an executor's memory, as files of a crawl do.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for data in batch.column(0):
                records = parse(data.as_py() or b"")
                while True:
                    try:
                        headers, block = next(records)
                    except StopIteration:
                        break
                    except (ValueError, zlib.error) as error:
                        headers, block = [("WARC-Type", "x-broken")], str(error).encode()
                    # Of header names that repeat, the last counts.
                    yield pa.RecordBatch.from_arrays([pa.array([list(dict(headers).items())], kind), pa.array([block], pa.binary())], names=["headers", "block"])

    return files.select(column).mapInArrow(read, "headers map<string,string>, block binary")


def derive_records(records: DataFrame) -> DataFrame:
    """The columns of ``RECORDS``: two rows for each response among records (headers, block)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                headers, block = (batch.column(i)[at].as_py() for i in range(2))
                own = _standard(headers or [])
                if own.get("WARC-Type", "").lower() == "response" and own.get("WARC-Record-ID"):
                    yield _batch([_row(*made) for made in derive(headers, block or b"")])

    return records.select("headers", "block").mapInArrow(build, RECORDS)


def derive_files(spark: SparkSession, path: str) -> DataFrame:
    """The derivatives of all responses in the WARC files at ``path``."""
    return derive_records(read_records(spark.read.format("binaryFile").load(path)))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, the block as text."""
    made = derivatives(table(spark, sf_dir, "pages"))
    return made.select("*", F.expr("substring(string(record), instr(string(record), '\\r\\n\\r\\n') + 4)").alias("tail")).select(*(c for c in made.columns if c != "record"), F.expr("substring(tail, 1, length(tail) - 4)").alias("block"))
