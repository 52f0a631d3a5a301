"""WARC derivative builder: responses to linked metadata and plain-text conversion records.

A response record (url and body; headers are built where a crawl table has none) gives

* a metadata record: WARC-Concurrent-To and WARC-Refers-To name the response; its block has title, language,
  character set, the plain text's digest and every outlink as ``outlink: <url> <text>`` lines;
* a conversion record: WARC-Refers-To names the response, WARC-Refers-To-Target-URI and WARC-Refers-To-Date repeat
  its address and date, WARC-Source-* headers keep the response's own HTTP headers and digests, its block is the
  page's plain text.

Record ids are version-5 UUIDs of the response's id, so a rerun names records alike. Digests are SHA-1 in base 32.
Records serialise to WARC/1.1 bytes, one gzip member each, and parse back.

Null html is an empty body; a null url is the address "urn:unknown". A null page_id counts by its text "null".
Repeated rows give repeated records. Other columns are ignored. Text is taken whole, whatever its length. Bytes of a page
that aren't UTF-8 are replacement signs, of which its digests are made; a numeric character reference beyond Unicode is
one, too.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
from collections.abc import Iterator, Mapping
from functools import partial
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import table, text_slices

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "tidegauge:warc")
#: Records carry this date where the crawl has none, so that a rerun gives the same bytes.
DATE = "2026-01-01T00:00:00Z"
#: Bytes of pages or blocks handled at a time.
SLICE_BYTES = 8_000_000
_HIDDEN = ("script", "style", "noscript", "template", "svg")
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_OPENER = re.compile(r"<(?:(!--)|(!)|(/?)([A-Za-z][^\s/>]*))")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _HIDDEN} | {"title": re.compile("</title", re.I)}
_VALUE = {name: re.compile(rf"\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I) for name in ("href", "lang", "charset")}
_NAME = re.compile(r"[\w-]+")
#: A reference that goes behind its base's host as it stands.
_ROOTED = re.compile(r"/(?!/)[\w~%/-]*")
_BREAK = re.compile(r"[\r\n]+")


def sha1(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(parts))}>"


#: A decimal reference's leading zeros, and without them one beyond Unicode's last code point.
_ZEROS, _BEYOND = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")


def _decoded(text: str) -> str:
    """Character references as signs; one beyond Unicode is a replacement sign, whatever its length."""
    return entities.unescape(_BEYOND.sub("\ufffd", _ZEROS.sub("&#", text))) if "&" in text else text


def _flat(text: str) -> str:
    return " ".join(_decoded(text).split())


def _value(name: str, attributes: str) -> str | None:
    m = _VALUE[name].search(attributes)
    return m and next(x for x in m.groups() if x is not None)


class Page:
    """What a page shows: ``text``, ``title``, ``language``, ``charset`` and ``links``, (reference, text) in order.

    One pass over the markup, each part of which is looked at a bounded number of times. A tag ends at its next ">"; an
    opener without one is text. Comments and the elements in ``_HIDDEN`` end at their closing mark or with the page.
    """

    def __init__(self, page: str):
        page = page.replace("\0", "\ufffd")
        self.title = self.language = self.charset = None
        self.links: list[tuple[str, str]] = []
        self._link: tuple[str, list[str]] | None = None
        shown: list[str] = []
        at, written, last = 0, 0, page.rfind(">")
        while m := _OPENER.search(page, at):
            begin, stop = m.span()
            comment, declaration, closing, name = m.groups()
            if not comment and begin > last:
                at = stop
                continue
            self._show(shown, page[written:begin])
            if comment:
                end = page.find("-->", stop) + 3
                at, mark = end if end > 2 else len(page), " "
            else:
                at, mark = page.find(">", stop) + 1, " "
                if not declaration:
                    name = name.lower()
                    if name in _HIDDEN and not closing:
                        end = _END[name].search(page, at)
                        at = end.end() if end else len(page)
                    else:
                        mark = "\0" if name in _BLOCKS else ""
                        self._tag(name, bool(closing), page[stop : at - 1], page, at)
            written = at
            shown.append(mark)
            if self._link:
                self._link[1].append(" ")
        self._show(shown, page[written:])
        self._close()
        text = "".join(shown)
        flat = _flat if "&" in text else lambda x: " ".join(x.split())
        self.text = "\n".join(x for x in map(flat, text.split("\0")) if x)

    def _show(self, shown: list[str], text: str) -> None:
        shown.append(text)
        if self._link:
            self._link[1].append(text)

    def _close(self) -> None:
        if self._link:
            self.links.append((self._link[0], _flat("".join(self._link[1]))))
            self._link = None

    def _tag(self, name: str, closing: bool, attributes: str, page: str, at: int) -> None:
        if name == "a":
            self._close()
            if not closing and (ref := _value("href", attributes)) is not None:
                self._link = (_decoded(ref).strip(), [])
        elif closing:
            return
        elif name == "title" and self.title is None:
            end = _END["title"].search(page, at)
            self.title = _flat(page[at : end.start()]) if end else ""
        elif name == "html" and self.language is None:
            self.language = self._named("lang", attributes)
        elif name == "meta" and self.charset is None:
            self.charset = self._named("charset", attributes)

    @staticmethod
    def _named(attribute: str, attributes: str) -> str | None:
        value = _NAME.match((_value(attribute, attributes) or "").strip())
        return value and value[0]


def plain_text(page: str) -> str:
    """Visible text: one line for each block, white space collapsed, empty lines left out."""
    return Page(page).text


def _root(address: str) -> str | None:
    """Scheme and host of a web address."""
    try:
        parts = urlsplit(address)
    except ValueError:
        return None
    return f"{parts.scheme}://{parts.netloc}" if parts.scheme in ("http", "https") and parts.netloc else None


def outlinks(page: str | Page, base: str) -> list[tuple[str, str]]:
    """Absolute address and text of each anchor, in order."""
    out, root = [], _root(base)
    for ref, text in (page if isinstance(page, Page) else Page(page)).links:
        try:
            url = root + ref if root and _ROOTED.fullmatch(ref) else urljoin(base, ref)
        except ValueError:
            url = ref
        out.append(("".join(url.split()), text))
    return out


def response(page_id, url: str | None, page: str | None, http: Mapping[str, str] | None = None, date: str = DATE) -> dict:
    """A response record of a crawl row."""
    body = (page or "").encode("utf-8", "surrogatepass")
    head = http or {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(body))}
    block = b"HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body
    address = url or "urn:unknown"
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", "null" if page_id is None else str(page_id), address), "WARC-Date": date, "WARC-Target-URI": address, "WARC-Payload-Digest": sha1(body), "WARC-Block-Digest": sha1(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return {"headers": headers, "block": block}


def split_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """HTTP headers and body of a response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return [tuple(x.strip() for x in line.split(":", 1)) for line in head.decode("latin-1").split("\r\n")[1:] if ":" in line], body


def derive(record: dict) -> list[dict]:
    """The metadata and conversion records of a response record."""
    (http, body), of = split_http(record["block"]), {"WARC-Date": DATE, "WARC-Target-URI": "urn:unknown", **record["headers"]}
    page = body.decode("utf-8", "replace")
    address = of["WARC-Target-URI"]
    source = of.get("WARC-Record-ID") or record_id("response", sha1(record["block"]), address)
    seen = Page(page)
    text = seen.text.encode("utf-8", "replace")
    text_digest = sha1(text)
    meta_id, conv_id = record_id("metadata", source), record_id("conversion", source)
    fields = [("title", seen.title or ""), ("language", seen.language or ""), ("charset", seen.charset or ""), ("text-digest", text_digest), ("conversion-id", conv_id), *(("outlink", f"{u} {t}".strip()) for u, t in outlinks(seen, address))]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    shared = {"WARC-Date": of["WARC-Date"], "WARC-Target-URI": address, "WARC-Refers-To": source}
    kept = {"WARC-Refers-To-Target-URI": address, "WARC-Refers-To-Date": of["WARC-Date"], "WARC-Source-Payload-Digest": of["WARC-Payload-Digest"] if "WARC-Payload-Digest" in of else sha1(body), "WARC-Source-Block-Digest": of["WARC-Block-Digest"] if "WARC-Block-Digest" in of else sha1(record["block"])} | {f"WARC-Source-HTTP-{k}": v for k, v in http}
    tail = lambda block, digest, kind: {"WARC-Block-Digest": digest, "WARC-Payload-Digest": digest, "Content-Type": kind, "Content-Length": str(len(block))}
    return [
        {"headers": {"WARC-Type": "metadata", "WARC-Record-ID": meta_id, **shared, "WARC-Concurrent-To": source, **tail(meta, sha1(meta), "application/warc-fields")}, "block": meta},
        {"headers": {"WARC-Type": "conversion", "WARC-Record-ID": conv_id, **shared, **kept, **tail(text, text_digest, "text/plain; charset=utf-8")}, "block": text},
    ]


def to_bytes(record: dict, compressed: bool = True) -> bytes:
    """A record as WARC/1.1, as a gzip member of its own unless told otherwise."""
    clean = lambda v: _BREAK.sub(" ", v) if "\n" in v or "\r" in v else v
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in record["headers"].items()).encode("utf-8", "replace") + b"\r\n" + record["block"] + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if compressed else raw


def parse(data: bytes) -> Iterator[dict]:
    """Records of plain or gzip WARC bytes, one at a time."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip()] = v.strip()
        yield {"headers": headers, "block": stream.read(int(headers.get("Content-Length", 0)))}


_COLUMNS = ("record_type", "record_id", "refers_to", "target_uri", "block_digest")
_RECORD = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in _COLUMNS), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("record", pa.binary())])
_DERIVED = pa.schema(list(_RECORD)[1:])
_READ = pa.schema([("file", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_FIELDS = ", ".join([*(f"{c} string" for c in _COLUMNS), "content_length long, headers map<string,string>, record binary"])
KIND = f"page_id long, {_FIELDS}"


def _fields(record: dict, compressed: bool) -> tuple:
    h = record["headers"]
    return h.get("WARC-Type"), h.get("WARC-Record-ID"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Block-Digest"), len(record["block"]), list(h.items()), to_bytes(record, compressed)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return table(dict(zip(schema.names, zip(*rows))) if rows else {c: [] for c in schema.names}, schema)


def _of_pages(batches: Iterator[pa.RecordBatch], responses: bool, compressed: bool) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in text_slices(b, 2, SLICE_BYTES)):
        rows = []
        for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns)):
            made = response(page_id, url, page)
            rows += [(page_id, *_fields(r, compressed)) for r in [made, *derive(made)][0 if responses else 1 :]]
        yield _batch(rows, _RECORD)


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", responses: bool = False, compressed: bool = True) -> DataFrame:
    """The derived records of each page (and its response, if asked for); concatenated ``record`` bytes are a WARC file."""
    valid = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    base = pages.select(F.col(id_col).cast("long"), valid(url_col), valid(html_col))
    return base.mapInArrow(partial(_of_pages, responses=responses, compressed=compressed), KIND)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows, size = [], 0
            for r in parse(batch.column(1)[i].as_py()):
                rows.append((batch.column(0)[i].as_py(), list(r["headers"].items()), r["block"]))
                size += len(r["block"])
                if size >= SLICE_BYTES:
                    yield _batch(rows, _READ)
                    rows, size = [], 0
            yield _batch(rows, _READ)


def read_warc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, headers, block of each record of WARC files (plain or gzip) at any path or glob that Spark reads.

    A file is one task's and must fit its memory (2 GB at most, Spark's limit for a binary file), as crawls cut them;
    its records are read one after another. Anything that isn't a WARC record is an error.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))
    return files.mapInArrow(_parsed, "file string, headers map<string,string>, block binary")


def _of_records(batches: Iterator[pa.RecordBatch], compressed: bool) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in text_slices(b, 1, SLICE_BYTES)):
        made = ({"headers": dict(h), "block": b or b""} for h, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield _batch([_fields(d, compressed) for r in made for d in derive(r)], _DERIVED)


def derive_records(records: DataFrame, compressed: bool = True) -> DataFrame:
    """The derived records of the responses among ``records`` (headers, block); other kinds give none.

    A response without a date, address or id counts by ``DATE``, "urn:unknown" and its block's digest.
    """
    some = records.where(F.element_at("headers", "WARC-Type") == "response").select("headers", F.col("block").cast("binary"))
    return some.mapInArrow(partial(_of_records, compressed=compressed), _FIELDS)
