"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A conversion or metadata record names its response in WARC-Refers-To, keeps the target address, date and the response's
own headers and digests, and has digests of its own block. Records are rows; `serialise` gives the bytes of each as a
gzip member, and `read_responses` parses such files again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.staging import table

FETCHED = "2024-01-01T00:00:00Z"
RESPONSE_SCHEMA = "page_id long, record_id string, target_uri string, date string, http_headers string, payload binary, block_digest string, payload_digest string"
DERIVED_SCHEMA = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length long, block_digest string, source_headers string, source_block_digest string, source_payload_digest string, block string"
)
_DROP = re.compile(r"(?is)<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)|<!\[CDATA\[|\]\]>")
_TITLE = re.compile(r"(?is)<title[^>]*>(.*?)</title>")
_BREAK = re.compile(r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|article|section|nav|footer|header|main|aside|blockquote|pre|title|body|html|head|hr|dd|dt|dl|form|figure|figcaption)\b[^>]*>")
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>?")
_LINK = re.compile(r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """The same for the same parts, so that a task that runs again gives the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def plain_text(markup: str) -> str:
    """Visible text, a line per block."""
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", markup)))
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def title_and_links(markup: str, base: str) -> tuple[str, list[str]]:
    found = _TITLE.search(markup)
    links = []
    for m in _LINK.finditer(_DROP.sub(" ", markup)):
        href = html.unescape(next(x for x in m.groups() if x is not None)).strip()
        try:
            links.append(urljoin(base, href))
        except ValueError:  # an address that can't be resolved stays as written
            links.append(href)
    return " ".join(html.unescape(found[1]).split()) if found else "", links


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = FETCHED) -> DataFrame:
    """A response record per page. A null address or page is empty; repeated rows give equal records."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, url, page in zip(*(batch[c].to_pylist() for c in ("i", "u", "h")), strict=True):
                payload = (page or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                rows.append((i, record_id("response", url or "", str(i), digest(payload)), url or "", date, head, payload, digest(head.encode() + payload), digest(payload)))
            yield _batch(rows, (pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string(), pa.string()), RESPONSE_SCHEMA)

    return pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h")).mapInArrow(run, RESPONSE_SCHEMA)


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record per response record, in the columns of DERIVED_SCHEMA.

    The metadata block is JSON with the response's HTTP headers, title and resolved links; the conversion block is the
    page's text. An empty payload gives an empty text, a null address an empty one; pages of any length are read whole,
    and repeated rows give repeated records. Nothing is dropped and no row needs another."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                page = (r["payload"] or b"").decode("utf-8", "replace")
                title, links = title_and_links(page, r["target_uri"] or "")
                head = [x.partition(":") for x in (r["http_headers"] or "").split("\r\n")[1:] if x]
                known = {"status": (r["http_headers"] or "").partition("\r\n")[0], "headers": {k: v.strip() for k, _, v in head}, "title": title, "links": links}
                for kind, mime, block in (("metadata", "application/json", json.dumps(known, ensure_ascii=False)), ("conversion", "text/plain", plain_text(page))):
                    data = block.encode("utf-8", "replace")
                    rows.append((r["page_id"], kind, record_id(kind, r["record_id"]), r["record_id"], r["target_uri"], r["date"], mime, len(data), digest(data), r["http_headers"], r["block_digest"], r["payload_digest"], data.decode()))
            yield _batch(rows, (pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 5), DERIVED_SCHEMA)

    return records.mapInArrow(run, DERIVED_SCHEMA)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n", mtime=0)


def serialise(records: DataFrame) -> DataFrame:
    """(record_id, member): each derived record as a gzip member; members joined in any order are a WARC file."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                headers = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"])]
                headers += [("WARC-Block-Digest", r["block_digest"]), ("WARC-Source-Block-Digest", r["source_block_digest"]), ("WARC-Source-Payload-Digest", r["source_payload_digest"])]
                headers += [("WARC-Source-HTTP-Headers", json.dumps(r["source_headers"])), ("Content-Type", r["content_type"]), ("Content-Length", str(r["content_length"]))]
                rows.append((r["record_id"], _member(headers, r["block"].encode())))
            yield _batch(rows, (pa.string(), pa.binary()), "record_id string, member binary")

    return records.mapInArrow(run, "record_id string, member binary")


def _record(source) -> tuple[dict[str, str], bytes]:
    """Headers up to the blank line, and the block that they announce."""
    headers = {}
    while line := source.readline().decode("utf-8", "replace").rstrip("\r\n"):
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    return headers, source.read(int(headers.get("content-length", 0)))


def parse(data: bytes):
    """(headers, block) of each record of a WARC file, gzipped or not."""
    source = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := source.readline():
        if line.startswith(b"WARC/"):
            yield _record(source)


BETWEEN = b"\r\n\r\nWARC/"  # the end of a record and the version line of the next
VERSIONS = (b"WARC/1.0", b"WARC/1.1", b"1.0", b"1.1")  # whole in the first line of a file, else without what the reader cut at


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files, of version 1.0 or 1.1, below `path`; page_id is null, and a record without an id
    keeps a null one. Spark's line reader streams and unpacks the files and cuts them before each version line, so a task
    holds records and not files. A block that holds a version line itself is joined again by its content length. Files that
    begin otherwise, and records of another version, are an error."""

    def run(batches):
        def whole():
            held = b""
            for batch in batches:
                for raw in batch["value"].to_pylist():
                    held = held + BETWEEN + raw if held else raw.lstrip(b"\r\n")
                    line, _, rest = held.partition(b"\r\n")
                    if line not in VERSIONS:
                        raise ValueError(f"not a record of WARC 1.0 or 1.1: {line[:40]!r}")
                    headers, block = _record(io.BytesIO(rest))
                    if len(block) >= int(headers.get("content-length", 0)):
                        yield headers, block
                        held = b""
            if held:
                yield _record(io.BytesIO(held.partition(b"\r\n")[2]))

        for h, block in whole():
            if h.get("warc-type") == "response":
                head, _, payload = block.partition(b"\r\n\r\n")
                row = (None, h.get("warc-record-id"), h.get("warc-target-uri", ""), h.get("warc-date"), head.decode("utf-8", "replace") + "\r\n\r\n", payload, h.get("warc-block-digest", digest(block)), h.get("warc-payload-digest", digest(payload)))
                yield _batch([row], (pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string(), pa.string()), RESPONSE_SCHEMA)

    records = spark.read.option("lineSep", BETWEEN.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    return records.where(F.trim(F.col("value").cast("string"), F.lit("\r\n")) != "").mapInArrow(run, RESPONSE_SCHEMA)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))
