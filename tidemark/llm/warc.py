"""WARC derivative builder: response records into linked metadata and conversion records.

Each response gives two records that refer to it: ``metadata`` with fields taken from its payload
(title, language, charset, outlinks) and ``conversion`` with its plain text. Both keep the
response's target URI, date and record id (``WARC-Refers-To``), and carry its HTTP header lines
and payload digest beside their own block digest, length and identifiers. ``record`` holds the
whole WARC/1.1 record as bytes, ready to be written one after the other; the source's payload
digest and header lines are extension fields in it (``WARC-Source-Payload-Digest``, and one
``WARC-Source-HTTP-Header`` for each line), as the standard fields describe the record itself.

Record ids are URNs of type-5 UUIDs of the URI, the payload digest and the kind of record, so a
rebuilt record has the id it had before. The work is one pass over the rows without a shuffle.

Defined cases: a null payload counts as empty; a null URI gives records without a target line; a
page without text gives a conversion record with an empty block. Rows that repeat give records
that repeat. An empty table gives an empty result. Columns that are not named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FETCHED = "1970-01-01T00:00:00Z"
HTTP_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
RECORD = (
    "page_id {id}, record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, source_headers string, source_payload_digest string, block_digest string, content_length long, "
    "text string, record binary"
)

#: A tag with its attributes; a value in quotes may hold ``>``. Possessive, so a failure costs one pass.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_TAG_START = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
#: Elements whose content is no text of the page, up to their end tag or the page's end.
_HIDDEN = {name: re.compile(rf"</{name}\b", re.I) for name in ("script", "style", "noscript", "template", "title")}
#: The end tag of the head may be missing; then the body, if it has a tag, ends it.
_HEAD_END = re.compile(r"</head\b|<body\b", re.I)
_BREAKS = set(
    "address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split()
)
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n\s*")
_LONG_NUMBER = re.compile(r"&#0*+[0-9]{8,}+;?")
_LINE_BREAKS = re.compile(r"[\x00-\x20\x7f]")


def _tags(page: str):
    """The page in one pass: ``(text, name, closing, attributes)``, the text being that before the tag.

    A quote that is never closed would hide the rest of the page; from there on a tag ends at the
    next ``>``. Hidden elements are passed over, with their content in place of attributes; text of
    the head is left out.
    """
    at = look = quiet_until = 0
    quotes, heads = True, 0
    while (where := page.find("<", look)) >= 0:
        name, closing, attributes = "", False, ""
        if page.startswith("<!--", where):
            end = page.find("-->", where + 4) + 3
            end = end if end > 2 else len(page)
        elif page.startswith(("<!", "<?"), where):
            end = page.find(">", where) + 1
        elif quotes and (tag := _TAG.match(page, where)):
            closing, name, attributes, end = tag[1] == "/", tag[2].lower(), tag[3], tag.end()
        elif start := _TAG_START.match(page, where):
            end, quotes = page.find(">", where) + 1, False
            closing, name, attributes = start[1] == "/", start[2].lower(), page[start.end() : max(end - 1, 0)]
        else:
            look = where + 1
            continue
        if not end:
            break
        text = page[at:where] if at >= quiet_until else ""
        if not closing and name in _HIDDEN:
            content_from, found = end, _HIDDEN[name].search(page, end)
            end = found.start() if found else len(page)
            attributes = page[content_from:end]
        elif name == "head" and not closing:
            heads += 1
            found = _HEAD_END.search(page, end) if heads == 1 else None
            quiet_until = found.start() if found else quiet_until
        yield text, name, closing, attributes
        at = look = end
    yield page[at:] if at >= quiet_until else "", "", True, ""


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def _unescaped(text: str) -> str:
    # Numbers beyond Unicode, of any length, are the replacement character.
    return html.unescape(_LONG_NUMBER.sub("�", text))


def read_page(page: str) -> tuple[str, str]:
    """Metadata fields and the visible text, a line for each block element, entities decoded."""
    one_line = lambda found: " ".join(_unescaped(found).split())
    named, links, parts = {}, [], []
    for text, name, closing, attributes in _tags(page):
        parts.append(text)
        if name == "title" and not closing:
            named.setdefault("title", one_line(attributes))
            parts.append(" ")
        elif name in _BREAKS:
            parts.append("\n")
        elif name == "" or name in _HIDDEN:
            parts.append(" ")
        if not closing and name in ("html", "meta", "a"):
            for key, *values in _ATTRIBUTE.findall(attributes):
                value = next(filter(None, values), "")
                if name == "a" and key.lower() == "href":
                    links += [one_line(value)] if value.strip("\"'") else []
                    break
                if value and (name, key.lower()) in (("html", "lang"), ("meta", "charset")):
                    named.setdefault({"lang": "language"}.get(key.lower(), "charset"), one_line(value))
    fields = [(name, named[name]) for name in ("title", "language", "charset") if name in named]
    fields += [("outlink", f"{link} L a/@href") for link in links]
    shown = _LINES.sub("\n", _SPACES.sub(" ", _unescaped("".join(parts)))).strip()
    return "".join(f"{name}: {value}\r\n" for name, value in fields), shown


def plain_text(page: str) -> str:
    return read_page(page)[1]


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, uri, payload, date, headers, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload = payload or ""
            payload_digest = digest(payload.encode())
            response = given or urn(uri or "", payload_digest, "response")
            fields, shown = read_page(payload)
            target = _LINE_BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", uri or "")
            for kind, content_type, text in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", shown)):
                block = text.encode()
                own, block_digest = urn(uri or "", payload_digest, kind), digest(block)
                lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Refers-To: {response}"]
                lines += [f"WARC-Target-URI: {target}"] if target else []
                lines += [f"WARC-Source-Payload-Digest: {payload_digest}"]
                lines += [f"WARC-Source-HTTP-Header: {line}" for line in (headers or "").splitlines() if line.strip()]
                lines += [f"WARC-Date: {date}", f"WARC-Block-Digest: {block_digest}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
                record = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
                rows.append((page_id, kind, own, response, uri, date, content_type, headers, payload_digest, block_digest, len(block), text, record))
        columns = list(zip(*rows, strict=True)) or [[]] * 13
        types = [batch.schema.field(0).type] + [pa.string()] * 9 + [pa.int64(), pa.string(), pa.binary()]
        names = [part.split(" ")[0] for part in RECORD.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def derivatives(
    responses: DataFrame,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    date: Column | None = None,
    headers: Column | None = None,
    record_id: Column | None = None,
) -> DataFrame:
    """A metadata and a conversion row for each response; see ``RECORD`` for the columns."""
    text = lambda c, default: (F.lit(default) if c is None else c).cast("string")
    return responses.select(
        F.col(id_col).alias("page_id"),
        F.col(uri_col).cast("string").alias("uri"),
        F.col(payload_col).cast("string").alias("payload"),
        text(date, FETCHED).alias("date"),
        text(headers, HTTP_HEADERS).alias("headers"),
        text(record_id, None).alias("given"),
    ).mapInArrow(_derive, RECORD.format(id=responses.schema[id_col].dataType.simpleString()))
