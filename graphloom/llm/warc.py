"""WARC derivatives: linked metadata and plain-text conversion records from responses."""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRLF = b"\r\n"
#: The date of records made from pages, which have none.
DATE = "2024-01-01T00:00:00Z"
#: Elements whose content isn't text of the page; what isn't closed goes to the end of the page, as browsers have it.
HIDDEN = ("script", "style", "noscript", "template")
#: Elements that begin a line.
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td th thead title tr ul".split()
)
_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
# A value in quotes may have closing brackets; the second form is for pages with a quote that is never closed.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in (*HIDDEN, "title")}
_HTML_TYPES = ("", "text/html", "application/xhtml+xml")


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same id for the same parts, so that a task that runs again makes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def to_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None)]
    return CRLF.join(x.encode("utf-8", "replace") for x in lines) + CRLF * 2 + block + CRLF * 2


def _unzipped(data: bytes) -> tuple[bytes, str | None]:
    """All members of a gzip file one after the other, and what is wrong with it: a cut or broken member ends it."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error as x:
            return b"".join(out), f"broken gzip member: {x}"
        if not member.eof:
            return b"".join(out), "cut gzip member"
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out), None


def parse(data: bytes, damage: list[str] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the records of a file, plain or with each record gzipped. Records that are cut or have no
    length, and other bytes that are no record, are passed over up to the next record; damage gets a line for each."""
    wrong = [] if damage is None else damage
    if data[:2] == b"\x1f\x8b":
        data, error = _unzipped(data)
        wrong += [error] if error else []
    at = 0
    while at < len(data):
        if data.startswith(CRLF, at):
            at += 2
            continue
        end = data.find(CRLF * 2, at)
        headers: dict[str, str] = {}
        if end >= 0 and data.startswith(b"WARC/", at):
            last = None
            for line in data[at:end].split(CRLF)[1:]:
                said = line.decode("utf-8", "replace")
                if said[:1] in " \t" and last is not None:  # a header that goes on
                    headers[last] += " " + said.strip()
                    continue
                k, _, v = said.partition(":")
                last = k.strip()
                headers[last] = v.strip()
        n = header(headers, "Content-Length")
        if not n.isdecimal() or end + 4 + int(n) > len(data):
            wrong.append(f"no whole record at byte {at}")
            at = data.find(b"\r\nWARC/", at + 1)
            if at < 0:
                return
            continue
        yield headers, data[end + 4 : end + 4 + int(n)]
        at = end + 4 + int(n)


def header(headers: dict[str, str], name: str, default: str = "") -> str:
    """A header's value; names are the same whatever their case."""
    if name in headers:
        return headers[name]
    return next((v for k, v in headers.items() if k.lower() == name.lower()), default)


def response(url: str, body: bytes, key: str = "") -> tuple[dict[str, str], bytes]:
    """A response record of a page."""
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]) + CRLF * 2 + body
    headers = {
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", key, url), "WARC-Date": DATE, "WARC-Target-URI": url,
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": sha1_digest(body), "WARC-Block-Digest": sha1_digest(block), "Content-Length": str(len(block)),
    }
    return headers, block


@dataclass
class _Page:
    parts: list[str] = field(default_factory=list)
    hrefs: list[str] = field(default_factory=list)
    title: str | None = None


def _scan(page: str) -> _Page:
    """One pass over a page. Comments and hidden elements go, a block begins a line, other tags leave nothing; a tag that
    doesn't end is text. Each part of the page is looked at a bounded number of times."""
    out, at, tag_of = _Page(), 0, _TAG
    say, titled = out.parts.append, False
    while m := _OPEN.search(page, at):
        i = m.start()
        say(page[at:i])
        if page.startswith("<!--", i):
            end = page.find("-->", i + 2)
            say(" ")
            at = len(page) if end < 0 else end + 3
            continue
        if page[i + 1] in "!?":
            end = page.find(">", i)
            at = len(page) if end < 0 else end + 1
            continue
        tag = tag_of.match(page, i)
        if tag is None and tag_of is _TAG:
            tag_of = _BARE_TAG
            tag = tag_of.match(page, i)
        if tag is None:  # no tag ends from here on
            say(page[i:])
            at = len(page)
            break
        closing, name, at = tag[1], tag[2].lower(), tag.end()
        if name in BLOCKS:
            say("\n")
        if closing:
            continue
        if name == "a":
            out.hrefs += [x] if (x := _href(tag[3])) is not None else []
        elif name in HIDDEN:
            say(" ")
            close = _CLOSE[name].search(page, at)
            at = close.end() if close else len(page)
        elif name == "title" and not titled:  # its content has no tags
            titled = True
            if close := _CLOSE[name].search(page, at):
                out.title = page[at : close.start()]
                say(out.title + "\n")
                at = close.end()
    say(page[at:])
    return out


def _href(attributes: str) -> str | None:
    for a in _ATTRIBUTE.finditer(attributes):
        if a[1].lower() == "href":
            return next((x for x in a.groups()[1:] if x is not None), None)
    return None


def _text(page: _Page) -> str:
    lines = (" ".join(x.split()) for x in html_lib.unescape("".join(page.parts)).split("\n"))
    return "\n".join(x for x in lines if x)


def plain_text(page: str) -> str:
    """The text of a page: without scripts, styles and comments, a line for each block, single spaces."""
    return _text(_scan(page))


def _links(page: _Page, base: str) -> list[str]:
    """Absolute targets of the page's links in order, each once."""
    out: dict[str, None] = {}
    for href in page.hrefs:
        target = html_lib.unescape(href).strip()
        try:
            out[urljoin(base, target)] = None
        except ValueError:
            out[target] = None
    return list(out)


def _http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers and payload of an HTTP response; a block without a header part is all payload."""
    head, gap, body = block.partition(CRLF * 2)
    if not gap or not head.startswith(b"HTTP/"):
        return "", {}, block
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, body


def _chunked(body: bytes) -> bytes:
    """A body sent in chunks; one that isn't, or is cut, up to where it stops being so."""
    out, at = [], 0
    while (end := body.find(CRLF, at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return b"".join(out) if out else body
        n = int(size, 16)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def _decoded(http: dict[str, str], body: bytes) -> bytes | None:
    """The content of a payload without its transfer and content encodings; None for an encoding that isn't known or bytes
    that don't have it. Many archives keep such headers with a body that is plain already."""
    if "chunked" in http.get("transfer-encoding", "").lower() and re.match(rb"[0-9a-fA-F]{1,15}[ \t]*(;[^\r\n]*)?\r\n", body):
        body = _chunked(body)
    for kind in reversed([x.strip().lower() for x in http.get("content-encoding", "").split(",")]):
        if kind in ("", "identity"):
            continue
        if kind in ("gzip", "x-gzip"):
            if body[:2] == b"\x1f\x8b":
                body = _unzipped(body)[0]
        elif kind == "deflate":
            for bits in (15, -15):
                try:
                    body = zlib.decompress(body, bits)
                    break
                except zlib.error:
                    pass
        else:
            return None
    return body


def derive(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and, of texts, the conversion record of a response; none of other records.

    Both refer to the response by WARC-Refers-To and keep its target, its date and its payload digest; the metadata block
    names the source's other headers, its HTTP status and type, its title and its links. Payloads are read without their
    chunks and compression (gzip, deflate); text types other than HTML are taken as they are. Other types, contents with
    zero bytes and encodings that aren't known have a metadata record only.
    """
    if header(headers, "WARC-Type").lower() != "response":
        return []
    source, target, date = (header(headers, k) for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    status, http, payload = _http(block)
    kind = http.get("content-type", "").partition(";")[0].strip().lower()
    body = _decoded(http, payload)
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", http.get("content-type", ""), re.I)
    page, said = None, None
    if body is not None and (kind in _HTML_TYPES or kind.startswith("text/")):
        try:
            said = body.decode(charset[1] if charset else "utf-8", "replace")
        except (LookupError, ValueError):
            said = body.decode("utf-8", "replace")
        if "\0" in said:
            said = None
        elif kind in _HTML_TYPES:
            page = _scan(said)
    digest = header(headers, "WARC-Payload-Digest") or sha1_digest(payload)
    title = page.title if page else None
    fields = [("http-status", status), ("http-content-type", http.get("content-type", "")), ("title", " ".join(html_lib.unescape(title or "").split()))]
    fields += [(f"source-{k.lower()}", v) for k, v in headers.items()]
    fields += [("outlink", x) for x in (_links(page, target) if page else ())]
    about = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode("utf-8", "replace")
    made = [("metadata", "application/warc-fields", about)]
    if said is not None:
        made.append(("conversion", "text/plain; charset=utf-8", (_text(page) if page else said).encode("utf-8", "replace")))
    return [({
        "WARC-Type": kind, "WARC-Record-ID": record_id(kind, source), "WARC-Date": date, "WARC-Target-URI": target, "WARC-Refers-To": source,
        "WARC-Refers-To-Payload-Digest": digest, "Content-Type": content, "WARC-Block-Digest": sha1_digest(data), "Content-Length": str(len(data)),
    }, data) for kind, content, data in made]


_RECORDS = pa.schema([("page_id", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_RECORDS_SQL = "page_id long, headers map<string,string>, block binary"


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, headers, block): a response record of each page. A null page is empty, a null address is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [response(u or "", h or b"", "" if i is None else str(i)) for i, u, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(h.items()) for h, _ in made], _RECORDS[1].type), pa.array([x for _, x in made], pa.binary())], schema=_RECORDS)

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("binary")).mapInArrow(run, _RECORDS_SQL)


def read_warc(spark, path: str) -> DataFrame:
    """(page_id, headers, block, damage) of WARC files, each read by one task; page_id is null. Damaged places of a file are
    rows of their own without headers and block, so that nothing is lost unseen."""
    schema = _RECORDS.append(pa.field("damage", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                wrong: list[str] = []
                part: list[tuple] = []
                for h, x in parse(data, wrong):
                    part.append((h, x))
                    if len(part) >= 256:
                        yield rows(part)
                        part = []
                yield rows(part, wrong)

    def rows(found: list[tuple], wrong: list[str] = ()) -> pa.RecordBatch:
        none = [None] * len(wrong)
        n = len(found) + len(wrong)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array([*(list(h.items()) for h, _ in found), *none], schema[1].type), pa.array([*(x for _, x in found), *none], pa.binary()), pa.array([*[None] * len(found), *wrong], pa.string())], schema=schema
        )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORDS_SQL + ", damage string")


def derivatives(records: DataFrame) -> DataFrame:
    """(page_id, headers, block) of the records derived from response records (page_id, headers, block); other records give
    none. Ids may be null or repeat; equal responses give equal records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, heads, blocks = (b.column(k).to_pylist() for k in range(3))
            for i in range(0, len(ids), 256):
                made = [(p, h, x) for p, hs, block in zip(ids[i : i + 256], heads[i : i + 256], blocks[i : i + 256], strict=True) for h, x in derive(dict(hs or ()), block or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in made], pa.int64()), pa.array([list(h.items()) for _, h, _ in made], _RECORDS[1].type), pa.array([x for _, _, x in made], pa.binary())], schema=_RECORDS)

    return records.select("page_id", "headers", "block").mapInArrow(run, _RECORDS_SQL)


def query(spark, sf_dir: str) -> DataFrame:
    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    h = lambda k: F.col("headers")[k]
    return made.select(
        "page_id", h("WARC-Type").alias("record_type"), h("WARC-Record-ID").alias("record_id"), h("WARC-Refers-To").alias("refers_to"), h("WARC-Target-URI").alias("target_uri"), h("WARC-Date").alias("warc_date"),
        h("WARC-Refers-To-Payload-Digest").alias("source_payload_digest"), h("WARC-Block-Digest").alias("block_digest"), h("Content-Length").cast("long").alias("content_length"), F.sha2("block", 256).alias("block_sha256"),
    )
