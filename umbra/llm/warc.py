"""WARC derivatives: linked metadata and plain-text conversion records.

A response record gives a metadata record (title, links, source headers, as
JSON) and a conversion record (plain text), each with its own id, its digest,
and the id and digests of the response it refers to.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import slices

VERSION = b"WARC/1.1"
#: Elements whose content isn't text, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template")
LINES = "address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol option p pre section table td th title tr ul".split()

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|" + "|".join(rf"<{n}\b[^>]*(?:>.*?(?:</{n}\s*>|\Z)|\Z)" for n in HIDDEN), re.I | re.S)
_LINE = re.compile(rf"</?(?:{'|'.join(LINES)})\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")
_TITLE = re.compile(r"<title\b[^>]*(?:>|\Z)(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_ANCHOR = re.compile(r"<a\b([^>]*)>", re.I)
_HREF = re.compile(r"""(?<![\w-])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def _visible(page: str) -> tuple[str, str]:
    """The page without hidden content, up to its last ``>``, and what follows.
    Each search for a tag's end in the first part succeeds, so that time stays
    linear in pages full of ``<``; the second has no tags."""
    page = _HIDDEN.sub(" ", page)
    end = page.rfind(">") + 1
    return page[:end], page[end:]


def plain_text(page: str) -> str:
    """Visible text, one line for each block element that has any."""
    shown, rest = _visible(page)
    shown = _TAG.sub("", _LINE.sub("\n", shown.replace("\n", " "))) + rest.replace("\n", " ")
    lines = (_SPACES.sub(" ", x).strip() for x in html.unescape(shown).split("\n"))
    return "\n".join(x for x in lines if x)


def links(page: str, base: str) -> list[str]:
    """Targets of the page's anchors in order, resolved against its address."""
    out = []
    for tag in _ANCHOR.finditer(_visible(page)[0]):
        m = _HREF.search(tag[1])
        if m is None:
            continue
        target = html.unescape(m[1] or m[2] or m[3] or "").strip()
        try:
            out.append(urljoin(base, target))
        except ValueError:
            out.append(target)
    return out


def title(page: str) -> str:
    found = _TITLE.search("".join(_visible(page)))
    return _SPACES.sub(" ", html.unescape(found[1]).replace("\n", " ")).strip() if found else ""


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_id(*parts: str | bytes) -> str:
    """A urn:uuid that the same parts always give."""
    h = hashlib.sha256(b"\0".join(p.encode("utf-8", "surrogatepass") if isinstance(p, str) else p for p in parts)).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}>"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record in the file format; Content-Length is set from the block, and line breaks in values become spaces."""
    one_line = lambda v: re.sub(r"[\r\n]+", " ", v)  # noqa: E731 - a break in a value would begin another header
    head = b"".join(f"{k}: {one_line(v)}\r\n".encode("utf-8", "surrogatepass") for k, v in headers if k.lower() != "content-length")
    return VERSION + b"\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a plain WARC file: headers (names as written) and block. A last
    record that is cut off is left out."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int({k.lower(): v for k, v in headers.items()}.get("content-length", 0))
        if end + 4 + size > len(data):
            return
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of crawled pages: page_id, record_id, target_uri, date,
    http_headers and payload. Null address and page count as empty; a null id is
    kept; rows that repeat give records that repeat; other columns are ignored;
    an empty table gives none."""
    url, page = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (url_col, html_col))
    h = F.sha2(F.concat_ws("\0", F.lit("response"), url, F.coalesce(F.col(id_col).cast("string"), F.lit("")), page).cast("binary"), 256)
    uuid = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n"))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), uuid.alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), page.alias("payload"))


DERIVED = "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, source_headers string, source_payload_digest string, block_digest string, content_length long, block string"


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DERIVED.split(", ")]
    for batch in batches:
        for part in slices(batch, column="payload"):
            rows = []
            for r in part.to_pylist():
                page, head, uri = r["payload"] or "", r["http_headers"] or "", r["target_uri"] or ""
                source: dict[str, list[str]] = {}
                for name, _, value in (k.partition(":") for k in head.split("\r\n")[1:] if k):
                    source.setdefault(name, []).append(value.strip())
                of = digest(page.encode("utf-8", "surrogatepass"))
                about = {"title": title(page), "links": links(page, uri), "status": head.split("\r\n", 1)[0], "headers": {k: v if len(v) > 1 else v[0] for k, v in source.items()}, "payload_digest": of, "payload_length": len(page.encode("utf-8", "surrogatepass"))}
                both = (("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain", plain_text(page)))
                data = [block.encode("utf-8", "surrogatepass") for _, _, block in both]
                own = [record_id(kind, r["record_id"] or "", d) for (kind, _, _), d in zip(both, data, strict=True)]
                for i, (kind, mime, block) in enumerate(both):
                    rows.append((r["page_id"], kind, own[i], r["record_id"], own[1 - i], uri, r["date"], mime, head, of, digest(data[i]), len(data[i]), block))
            columns = zip(*rows, strict=True)
            types = {"page_id": pa.int64(), "content_length": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=names)


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response.

    records: as ``responses`` returns; further columns are ignored. refers_to is
    the response's record_id, concurrent_to the other derivative's, and
    source_payload_digest the payload's digest;
    source_headers are its HTTP headers as they came. Null payload counts as
    empty: its conversion has no text, and both records are still made. Rows
    that repeat give records that repeat; an empty table gives none. Record ids
    follow from kind, response and block, so that a task run again makes the
    same records.
    """
    return records.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload").mapInArrow(_derive, DERIVED)


def files(derived: DataFrame) -> DataFrame:
    """Each derived record in the file format, in ``warc`` (binary), one row for
    each; nulls are empty values; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                headers = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"] or ""), ("WARC-Concurrent-To", r["concurrent_to"]), ("WARC-Target-URI", r["target_uri"] or ""), ("WARC-Date", r["date"] or ""), ("WARC-Block-Digest", r["block_digest"]), ("Content-Type", r["content_type"])]
                # the source's own digest and headers, the latter as a JSON string on one line
                headers += [("WARC-Source-Payload-Digest", r["source_payload_digest"]), ("WARC-Source-Headers", json.dumps(r["source_headers"]))]
                out.append(serialise(headers, r["block"].encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("record_id"), pa.array(out, pa.binary())], names=["page_id", "record_id", "warc"])

    return derived.mapInArrow(run, "page_id long, record_id string, warc binary")
