"""WARC derivatives: metadata and plain-text conversion records for response records.

Every response gives two linked records. Both name the response in
``WARC-Refers-To`` and keep its target and date; the metadata record's fields
hold the response's own headers and digests, so that a derivative can be traced
when the response is not at hand. Identifiers are a function of the source's
identifier and the kind, so a repeated run writes the same records.

Records are rows ``type``, ``record_id``, ``refers_to``, ``headers`` (array of
name and value, in order) and ``block`` (bytes); ``write_warc`` and
``read_warc`` turn them into WARC/1.1 files and back.

Defined cases
-------------
* A null payload is an empty one: both records exist, with an empty text.
* A null URL gives no target header, a null time the date 1970-01-01.
* Repeated responses give repeated, equal records.
* Texts are converted whole. Unclosed comments, scripts and styles reach to the
  end; a ``<`` that begins no tag is text. Bytes that are no UTF-8 are replaced.
* Other columns of the input play no part.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "type string, record_id string, refers_to string, headers array<struct<name:string,value:string>>, block binary"
_ARROW = pa.schema([
    ("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
    ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary()),
])
VERSION = "WARC/1.1"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:keysieve:derivatives")

_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANGUAGE = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=", re.I)
_BREAKS = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|main|aside|blockquote|pre|title|head|body|hr|dl|dt|dd)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.I)
_TAG = re.compile(r"<[A-Za-z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[A-Za-z/!?][^>]*>")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[\n ]*")


def plain_text(page: str) -> str:
    """What a reader sees, a line per block."""
    seen = _UNSEEN.sub(" ", page)
    text = html.unescape(_TAG.sub("", _BREAKS.sub("\n", seen.replace("\n", " "))))
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip()


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(parts))}>"


def _record(kind: str, record_id: str, refers_to: str | None, headers: list[tuple[str, str | None]], block: bytes) -> dict:
    own = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *headers, ("WARC-Block-Digest", sha1_digest(block)), ("Content-Length", str(len(block)))]
    return {"type": kind, "record_id": record_id, "refers_to": refers_to, "headers": [{"name": n, "value": _line(v)} for n, v in own if v is not None], "block": block}


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def derive(response: dict) -> list[dict]:
    """The metadata and the conversion record of one response record."""
    headers = {h["name"].lower(): h["value"] for h in response["headers"]}
    head, _, payload = response["block"].partition(b"\r\n\r\n")
    page, source = payload.decode("utf-8", "replace"), response["record_id"]
    text = plain_text(page)
    title, language = _TITLE.search(page), _LANGUAGE.search(page)
    linked = [("WARC-Refers-To", source), ("WARC-Target-URI", headers.get("warc-target-uri")), ("WARC-Date", headers.get("warc-date"))]
    fields = [("source-" + h["name"].lower(), h["value"]) for h in response["headers"]]
    fields += [("http-status", head.split(b"\r\n")[0].decode("latin-1"))]
    fields += [("http-" + n.strip().lower(), v.strip()) for n, _, v in (line.decode("latin-1").partition(":") for line in head.split(b"\r\n")[1:])]
    fields += [("title", plain_text(title[1]) if title else ""), ("language", language[1] if language else ""),
               ("links", str(len(_LINK.findall(page)))), ("text-digest", sha1_digest(text.encode()))]
    block = "".join(f"{n}: {_line(v)}\r\n" for n, v in fields).encode()
    return [
        _record("metadata", _urn(source, "metadata"), source, [*linked, ("Content-Type", "application/warc-fields")], block),
        _record("conversion", _urn(source, "conversion"), source, [*linked, ("Content-Type", "text/plain; charset=utf-8")], text.encode()),
    ]


def response(key: str, url: str | None, date: str, body: bytes) -> dict:
    """A response record for a page that was fetched whole."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    headers = [("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", sha1_digest(body)), ("Content-Type", "application/http; msgtype=response")]
    return _record("response", _urn("response", key, url or ""), None, headers, block)


def _batches(rows: Iterator[dict], size: int = 200) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def responses(pages: DataFrame, id_column: str = "page_id", url: str = "url", body: str = "html", fetched: str = "fetched_at") -> DataFrame:
    """Response records for a table of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(response(k.as_py() or "", u.as_py(), d.as_py(), (b.as_py() or "").encode()) for k, u, d, b in zip(*batch.columns, strict=True))

    # Dates are UTC whatever zone the session is in, so they come from the seconds since 1970.
    seconds = F.floor(F.coalesce(F.unix_micros(fetched), F.lit(0)) / 1_000_000)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")).cast("string")
    clock = [F.lpad(F.floor(F.pmod(seconds, F.lit(whole)) / part).cast("string"), 2, "0") for whole, part in ((86_400, 3600), (3600, 60), (60, 1))]
    date = F.concat(day, F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))
    return pages.select(F.col(id_column).cast("string"), F.col(url), date, F.col(body)).toDF("k", "u", "d", "b").mapInArrow(run, SCHEMA)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all response records; other types give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(out for start in range(0, batch.num_rows, 200) for row in batch.slice(start, 200).to_pylist() for out in derive(row))

    found = records.filter("type = 'response'").select("type", "record_id", "refers_to", F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")).alias("headers"),
                                                       F.coalesce("block", F.lit(b"")).alias("block"))
    return found.mapInArrow(run, SCHEMA)


def header(name: str):
    """A column with the value of the first header of that name."""
    return F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), 0)["value"]


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC/1.1 files, one per partition, with any file system Spark knows.

    The separator that ends a record is the one the text writer puts after every row.
    """
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")
    start = F.concat(F.lit(f"{VERSION}\r\n"), lines, F.lit("\r\n")).cast("binary")
    records.select(F.concat(start, F.col("block")).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of one uncompressed file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = [{"name": n, "value": v} for n, _, v in (line.partition(": ") for line in lines)]
        by_name = {h["name"].lower(): h["value"] for h in headers}
        at = end + 4 + int(by_name["content-length"])
        yield {"type": by_name["warc-type"], "record_id": by_name["warc-record-id"], "refers_to": by_name.get("warc-refers-to"), "headers": headers, "block": data[end + 4 : at]}
        at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all uncompressed WARC files below a folder; a file must fit in memory, as one partition's records did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(parse(content.as_py()))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select("content").mapInArrow(run, SCHEMA)
