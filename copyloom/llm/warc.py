"""Derivatives of WARC responses: linked metadata and plain-text conversion records, and readers and writers of the format."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyloom.llm.html_text import render

RECORD = "record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, http_headers string, payload_digest string, block_digest string, content_length long, block binary"
DATE = "1970-01-01T00:00:00Z"
_EOL = "\r\n"
BATCH = 16 << 20


def _urn(*parts: Column | str) -> Column:
    """A stable urn:uuid from the sha-256 of the parts."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = [F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def _digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of pages: the page as an HTTP response; a null url or html counts as empty. Row for row."""
    body = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    at = pages.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("target_uri"), body.alias("body"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.length("body").cast("string"), F.lit(_EOL))
    at = at.select("*", http.alias("http_headers")).select("*", F.concat(F.encode(F.concat("http_headers", F.lit(_EOL)), "UTF-8"), "body").alias("block"))
    return at.select(
        _urn("id", "target_uri", _digest(F.col("body"))).alias("record_id"), F.lit("response").alias("warc_type"), F.lit(None).cast("string").alias("refers_to"), "target_uri", F.lit(date).alias("date"),
        F.lit("application/http;msgtype=response").alias("content_type"), "http_headers", _digest(F.col("body")).alias("payload_digest"), _digest(F.col("block")).alias("block_digest"),
        F.length("block").cast("long").alias("content_length"), "block",
    )


def _split_http(block: bytes) -> tuple[str, bytes]:
    """The headers, each ended by a line feed, and the body; a block that doesn't begin as a response is all body."""
    if not block.startswith(b"HTTP/"):
        return "", block
    found = re.search(rb"\r?\n\r?\n", block)
    if not found:
        return block.decode("utf-8", "replace"), b""
    return block[: found.start()].decode("utf-8", "replace") + _EOL, block[found.end() :]


def _unchunked(body: bytes) -> bytes:
    """A chunked body put together; what follows a broken chunk is left as it is."""
    out, at = [], 0
    while found := _CHUNK.match(body, at):
        size = int(found[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[found.end() : found.end() + size])
        at = found.end() + size
    return b"".join([*out, body[at:]])


_TEXT = re.compile(rb"[\t\n\f\r\x20-\x7e]*\Z|[\t\n\f\r\x20-\x7e]{8}")
_CHUNK = re.compile(rb"(?:\r?\n)?([0-9a-fA-F]{1,15})[^\r\n]*\r?\n")


def _unpacked(body: bytes) -> bytes:
    """All members of a gzip body; what is no member after the first is dropped."""
    out: list[bytes] = []
    while body.startswith(b"\x1f\x8b") or not out:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(body))
        except zlib.error:
            if not out:
                raise
            break
        body = member.unused_data
    return b"".join(out)


def _decoded(body: bytes, head: dict[str, str]) -> bytes | None:
    """The body without its transfer and content encodings; null if one of these is unknown or its data are broken. A body that isn't packed at
    all, whatever its header says, is left as it is."""
    if head.get("transfer-encoding", "").lower().split(",")[-1].strip() == "chunked":
        body = _unchunked(body)
    for name in reversed([x.strip() for x in head.get("content-encoding", "").lower().split(",")]):
        try:
            if name in ("gzip", "x-gzip"):
                body = _unpacked(body)
            elif name == "deflate":
                body = zlib.decompressobj(15 if body[:1] == b"x" else -15).decompress(body)
            elif name == "zstd":
                with zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True) as frames:
                    body = frames.read()
            elif name not in ("", "identity"):
                return None
        except (zlib.error, zstandard.ZstdError):
            return None if b"\x00" in body[:4096] or body[:2] == b"\x1f\x8b" or not _TEXT.match(body) else body
    return body


def page_text(head: str, body: bytes) -> str | None:
    """The visible text of an HTTP response; plain text as it is, null for what is neither text nor HTML, or is packed in a way unknown here. Bytes are read by the byte order mark,
    the header's charset, or the page's own; what isn't in that charset is replaced."""
    fields: dict[str, str] = {}
    for line in head.splitlines()[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    kind, _, rest = fields.get("content-type", "").partition(";")
    kind = kind.strip().lower()
    body = _decoded(body, fields)
    if body is None or kind and kind not in ("text/html", "application/xhtml+xml", "text/plain"):
        return None
    told = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", rest, re.I)
    own = re.search(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?([\w.:-]+)", body[:2048], re.I)
    marks = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
    charset = next((c for m, c in marks.items() if body.startswith(m)), None) or (told[1] if told else own[1].decode() if own and kind != "text/plain" else "utf-8")
    try:
        text = body.decode({"iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252"}.get(charset.lower(), charset), "replace")
    except (LookupError, UnicodeError):
        text = body.decode("utf-8", "replace")
    return text if kind == "text/plain" else render(text)


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response in records (RECORD): a metadata record with the source's headers and digests, and a
    conversion record with the page's visible text; both refer to the response's identifier. Other types give none, and a response that is neither HTML nor
    plain text, or whose encoding can't be undone, has no conversion record.

    A response without HTTP headers is all body, taken for HTML; transfer and content encodings are undone, and bytes read by their charset. Null blocks
    count as empty. The derivatives' identifiers follow from the source's, so reruns agree and repeated responses give repeated derivatives.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, texts = [], []
            for block in batch.column("block").to_pylist():
                head, body = _split_http(block or b"")
                heads.append(head)
                texts.append(page_text(head, body))
            cols = [batch.column(c) for c in ("record_id", "target_uri", "date", "payload_digest", "block_digest", "content_length")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(heads, pa.string()), pa.array(texts, pa.string())], names=["source", "target_uri", "date", "source_payload", "source_digest", "source_length", "head", "text"])

    slim = records.where("warc_type = 'response'").select("record_id", "target_uri", "date", "payload_digest", "block_digest", "content_length", "block")
    at = slim.mapInArrow(convert, "source string, target_uri string, date string, source_payload string, source_digest string, source_length long, head string, text string")
    fields = F.concat(
        F.lit("source-record-id: "), F.coalesce("source", F.lit("")), F.lit(f"{_EOL}source-payload-digest: "), F.coalesce("source_payload", F.lit("")), F.lit(f"{_EOL}source-block-digest: "), F.coalesce("source_digest", F.lit("")),
        F.lit(f"{_EOL}source-content-length: "), F.coalesce(F.col("source_length").cast("string"), F.lit("")), F.lit(f"{_EOL}text-length: "), F.coalesce(F.char_length("text"), F.lit(0)).cast("string"), F.lit(_EOL), "head",
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.encode(fields, "UTF-8").alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.encode("text", "UTF-8").alias("block")),
    )
    at = at.select("source", "target_uri", "date", "head", F.inline(F.filter(kinds, lambda x: x["block"].isNotNull())))
    return at.select(
        _urn(F.coalesce("source", F.lit("")), "warc_type").alias("record_id"), "warc_type", F.col("source").alias("refers_to"), "target_uri", "date", "content_type", F.col("head").alias("http_headers"),
        _digest(F.col("block")).alias("payload_digest"), _digest(F.col("block")).alias("block_digest"), F.length("block").cast("long").alias("content_length"), "block",
    )


_NAMES = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Length", "content_length"))


def to_bytes(row: dict) -> bytes:
    """A record as one gzip member."""
    head = "".join(f"{name}: {row[col]}{_EOL}" for name, col in _NAMES if row[col] is not None)
    return gzip.compress(f"WARC/1.1{_EOL}{head}{_EOL}".encode() + (row["block"] or b"") + b"\r\n\r\n", mtime=0)


def members(records: DataFrame) -> DataFrame:
    """(record_id, member): each record in the file format; the members of a file need only be put end to end."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(map(to_bytes, rows), pa.binary())], names=["record_id", "member"])

    return records.mapInArrow(write, "record_id string, member binary")


def parse(f: BinaryIO) -> Iterator[dict]:
    """The records of a file, plain or gzip, one at a time. A gzip file is unpacked as it is read."""
    start = f.read(2)
    f.seek(0)
    f = gzip.GzipFile(fileobj=f) if start == b"\x1f\x8b" else f
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := f.readline().strip()) and b":" in line:
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        row = {col: head.get(name.lower()) for name, col in _NAMES}
        row["content_length"] = int(row["content_length"] or 0)
        row["block"] = f.read(row["content_length"])
        row["http_headers"] = _split_http(row["block"])[0] if row["warc_type"] == "response" else None
        yield row


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records (RECORD) of WARC files. A file's bytes are one row, so it should be of the customary size (about 1 GB, 2 GB at most), but it is unpacked
    record by record, and no more than BATCH bytes of records wait at once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = {"content_length": pa.int64(), "block": pa.binary()}
        made = lambda got: pa.RecordBatch.from_arrays([pa.array([r[c] for r in got], kinds.get(c, pa.string())) for c in names], names=names)
        for batch in batches:
            for data in batch.column(0):
                got, size = [], 0
                for row in parse(io.BufferedReader(pa.BufferReader(data.as_buffer()))):
                    got.append(row)
                    size += row["content_length"]
                    if size > BATCH:
                        yield made(got)
                        got, size = [], 0
                yield made(got)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, RECORD)
