"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A response record, as a crawler wrote it, is parsed: its WARC headers, the HTTP
headers within, and the payload, whose chunks and compression are undone for the
text.  It gives two records.  Both refer to it (``WARC-Refers-To``, with its
target and date), and to each other (``WARC-Concurrent-To``).  The metadata
record keeps the response's HTTP headers, record id and payload digest; the
conversion record holds the page's text.  Records are WARC/1.1, one gzip member
each, in files of the shared folder; the manifest, which Spark's own commit
protects, names the files that count.

``read_responses`` takes responses from WARC files.  ``responses`` builds them
from a table of pages, where a column may give each its record id, date, HTTP
headers and payload digest; only what is absent is made up, by rule.  Derived ids
are name-based (UUID 5), so a task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.scratch import Scratch

#: Bytes of a file, roughly; date and HTTP headers of pages whose table gives none.
FILE_BYTES, DATE, HTTP = 64 << 20, "1970-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8"
#: Bytes that a payload may have when its compression is undone; a larger one has no text, and the metadata says so.
MOST = 256 << 20
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:kinloom:warc")

#: What drops out before tags do: comments, scripts and styles, to the end of the page if they never end.
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*>|\Z)", re.S | re.I)
#: Tags of elements whose content drops out where an end tag follows, quoted values whole; svg may close itself.
_HOLDER = re.compile(r"""<(/?)(noscript|template|svg)(?=[\s/>])((?:[^<>"'=]++|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>""", re.I)
#: What follows a tag's name, quoted values whole.
_REST = r"""(?:[^<>"'=]++|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+>?"""
#: Elements that end a line.
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b" + _REST, re.I)
_TAG = re.compile("<[a-zA-Z/!?]" + _REST)
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def _without_holders(page: str) -> str:
    """A page without its noscript, template and svg elements; of a tag without its partner only the tag goes."""
    out, done, open_ = [], 0, {}
    cuts: list[tuple[int, int]] = []
    for m in _HOLDER.finditer(page):
        name = m[2].lower()
        starts = open_.setdefault(name, [])
        if not m[1]:
            if name == "svg" and m[3].endswith("/"):
                cuts.append(m.span())
            else:
                starts.append(m.span())
        else:
            cuts.append((starts.pop()[0], m.end()) if starts else m.span())
    cuts += [span for starts in open_.values() for span in starts]
    for a, b in sorted(cuts):
        if b <= done:
            continue
        if a >= done:
            out += [page[done:a], " "]
        done = b
    return "".join([*out, page[done:]])


def plain_text(page: str) -> str:
    """A page's text: no scripts, styles, comments or tags; entities resolved; a line for each block."""
    text = _TAG.sub("", _BREAK.sub("\n", _without_holders(_RAW.sub(" ", page.replace("\r", " ").replace("\n", " ")))))
    return _LINES.sub("\n", _BLANK.sub(" ", html.unescape(text))).strip()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def _line(value: str) -> str:
    """A header's value: control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC record; headers without a value are left out."""
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_at(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """Headers of the record at a place, by their names in lower case, and where its block begins and ends."""
    head = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:head].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = _fields(_lines(lines))
    return headers, head + 4, head + 4 + int(headers["content-length"])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (named in lower case) and blocks of uncompressed records end to end."""
    at = 0
    while at < len(data):
        headers, start, end = _record_at(data, at)
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record of another length")
        yield headers, data[start:end]
        at = end + 4


def _lines(lines: list[str]) -> list[tuple[str, str]]:
    """Header fields in order, with their names as they are; folded lines are joined."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def _fields(lines: list[tuple[str, str]]) -> dict[str, str]:
    """Header fields by their names in lower case; of repeated names the values are joined."""
    out: dict[str, str] = {}
    for name, value in lines:
        name = name.lower()
        out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _unchunked(body: bytes) -> bytes:
    """A body sent in chunks, whole; what isn't chunked as it should be stays as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = re.match(rb"\s*([0-9a-fA-F]+)\s*(?:;|$)", body[at:end])
        if not size:
            return body
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if at >= len(body) and out else body


class NoText(ValueError):
    """Why a payload has no text."""


def _inflated(body: bytes, kind: int) -> bytes:
    """All members of a compressed body; what breaks off gives its beginning."""
    out, size = [], 0
    while body:
        member = zlib.decompressobj(kind)
        try:
            out.append(member.decompress(body, MOST - size + 1))
        except zlib.error:
            if not out:
                raise
            break  # what follows the last member
        size += len(out[-1])
        if size > MOST:
            raise NoText("too large")
        body = member.unused_data if kind == 31 else b""
    return b"".join(out)


def _unpacked(body: bytes, coding: str) -> bytes:
    """A gzip or deflate body uncompressed; what isn't compressed after all stays as it is."""
    coding = coding.strip().lower()
    kinds = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15), "": (), "identity": ()}.get(coding)
    if kinds is None:
        raise NoText(f"content-encoding {coding}")
    for kind in kinds:
        try:
            return _inflated(body, kind)
        except zlib.error:
            continue
    return body


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields in order and payload of an HTTP response; a block without headers is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, _lines(lines), payload


#: Byte order marks, and a charset that a page names in its first 1024 bytes.
_MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
_META = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def _decoded(payload: bytes, charset: str | None) -> str:
    """A payload's characters: by its byte order mark, its header's charset, the page's own, or UTF-8; of unknown charsets by UTF-8."""
    for mark, name in _MARKS:
        if payload.startswith(mark):
            return payload[len(mark) :].decode(name, "replace")
    if not charset and (own := _META.search(payload[:1024])):
        charset = own[1].decode("ascii", "replace")
        charset = "utf-8" if charset.lower().startswith("utf-16") else charset  # a page whose tags can be read isn't UTF-16
    try:
        return payload.decode(charset or "utf-8", "replace")
    except (LookupError, ValueError):  # no such charset, or one that is no encoding of text
        return payload.decode("utf-8", "replace")


def page_text(fields: dict[str, str], payload: bytes) -> str:
    """The text of a payload: of HTML without its tags, of other text as it is, of anything else none.

    Raises ``NoText`` where a content coding isn't known or the payload is larger than ``MOST``.
    """
    kind = fields.get("content-type", "text/html")
    if not re.match(r"\s*(?:text/|application/(?:xhtml\+)?xml)", kind, re.I):
        return ""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    for coding in reversed(fields.get("content-encoding", "").split(",")):
        payload = _unpacked(payload, coding)
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    text = _decoded(payload, named[1] if named else None)
    return text if re.match(r"\s*text/plain", kind, re.I) else plain_text(text)


def response(url: str | None, page: str | None, unique: str, own_id: str | None = None, date: str | None = None, http: str | None = None, payload_digest: str | None = None) -> bytes:
    """A response record of a page; id, date, HTTP headers and digest are made up where they are null."""
    payload = (page or "").encode("utf-8", "replace")
    payload_digest = payload_digest or digest(payload)
    block = (http or HTTP).rstrip("\r\n").encode("utf-8", "replace") + b"\r\n\r\n" + payload
    own = own_id or record_id("response", unique, url or "", payload_digest)
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", date or DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", payload_digest), ("Content-Type", "application/http; msgtype=response")], block
    )


def derive(key: int | None, data: bytes) -> tuple[bytes, bytes] | None:
    """The metadata and the conversion record of a response record; None of a record of another type.

    A response without an id gets one from its bytes.  The metadata has a line
    for each of the source's HTTP headers, in order, and tells why there is no
    text where a payload can't be read.
    """
    headers, start, end = _record_at(data, 0)
    if headers.get("warc-type") != "response":
        return None
    status, http, payload = http_parts(data[start:end])
    source = headers.get("warc-record-id") or record_id("response", hashlib.sha256(data).hexdigest())
    url, date = headers.get("warc-target-uri"), headers.get("warc-date")
    payload_digest = headers.get("warc-payload-digest") or digest(payload)
    own, other = record_id("metadata", source), record_id("conversion", source)
    refers = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date)]
    fields = [("page-id", None if key is None else str(key)), ("source-record-id", source), ("source-payload-digest", payload_digest), ("source-length", str(len(payload))), ("source-http-status", status or None)]
    fields += [(f"source-http-{name}", value) for name, value in http]
    try:
        text, why = page_text(_fields(http), payload).encode("utf-8", "replace"), None
    except NoText as reason:
        text, why = b"", str(reason)
    fields.append(("no-text", why))
    about = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields if v is not None).encode()
    return (
        record([("WARC-Type", "metadata"), ("WARC-Record-ID", own), *refers, ("WARC-Concurrent-To", other), ("WARC-Block-Digest", digest(about)), ("Content-Type", "application/warc-fields")], about),
        record([("WARC-Type", "conversion"), ("WARC-Record-ID", other), *refers, ("WARC-Concurrent-To", own), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(text)), ("Content-Type", "text/plain; charset=UTF-8")], text),
    )


_RECORDS = "page_id long, record binary"
#: Bytes of records that leave a task at once.
_BATCH = 8 << 20


def _batches(rows: Iterator[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
    keys, held, size = [], [], 0
    for key, data in rows:
        keys.append(key), held.append(data)
        size += len(data)
        if size >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.binary())], ["page_id", "record"])
            keys, held, size = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.binary())], ["page_id", "record"])


def responses(
    pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", own_id: str | None = None, date: str | None = None, http: str | None = None, payload_digest: str | None = None
) -> DataFrame:
    """Response records of a table of pages: ``page_id, record``.

    The last four name columns of the table, where it has them: record ids, dates,
    HTTP headers (status line first) and payload digests; they are kept as they
    are, and null ones made up.  A made-up id comes from the row's file name and
    number there (or, of a table that isn't read from files, from its place), its
    URL and its payload, so that repeated rows have ids of their own; the made-up date is ``DATE`` and the headers are ``HTTP``.  A null
    page is an empty payload, a null URL leaves the target headers out.  Other
    columns are ignored; an empty table gives an empty result.
    """
    given = [F.col(c).cast("string") if c else F.lit(None).cast("string") for c in (own_id, date, http, payload_digest)]
    place = F.monotonically_increasing_id().cast("string")
    try:
        of_file = F.concat_ws(" ", "_metadata.file_name", F.col("_metadata.row_index").cast("string"))
        pages.select(of_file)
        place = of_file
    except AnalysisException:
        pass  # not read from files
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), place.alias("place"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"),
        *(c.alias(f"given{i}") for i, c in enumerate(given)),
    )

    def build(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield from _batches((k, response(u, h, f"{k} {n}", *rest)) for k, n, u, h, *rest in zip(*columns, strict=True))

    return rows.mapInArrow(build, _RECORDS)


def _members(name: str) -> Iterator[bytes]:
    """Uncompressed records of a WARC file, one after another, whatever its name or compression."""
    from kinloom.llm.repair_store import _store

    system, path = _store(name)
    with system.open_input_stream(path, compression=None) as file:
        raw = file.read(1 << 20)
        packed = raw[:2] == b"\x1f\x8b"
        unpack = zlib.decompressobj(31) if packed else None
        held, out, size, need = b"", [], 0, 0
        while raw:
            if packed:
                while raw:
                    out.append(unpack.decompress(raw))
                    size += len(out[-1])
                    raw = unpack.unused_data
                    if unpack.eof:
                        unpack = zlib.decompressobj(31)
            else:
                out.append(raw)
                size += len(raw)
            if len(held) + size >= need:  # so that the parts of a long record are put together once
                held, at, out, size, need = held + b"".join(out), 0, [], 0, 0
                while (head := held.find(b"\r\n\r\n", at)) >= 0:
                    end = _record_at(held, at)[2] + 4
                    if end > len(held):
                        need = end - at
                        break
                    yield held[at:end]
                    at = end
                held = held[at:]
            raw = file.read(1 << 20)
        held += b"".join(out)
        if held.strip():
            raise ValueError(f"{name}: a WARC record breaks off")


def read_responses(files: DataFrame, column: str = "file") -> DataFrame:
    """Response records of WARC files, plain or gzip: ``page_id, record``, with a null ``page_id``.

    ``files`` has the files' addresses; null ones are left out.  Records of other
    types are left out.  Files that aren't WARC raise an error.
    """
    from kinloom.llm.repair_store import spread

    def read(batches):
        def rows():
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    yield from ((None, r) for r in _members(name) if _record_at(r, 0)[0].get("warc-type") == "response")

        yield from _batches(rows())

    return spread(files.select(column).where(F.col(column).isNotNull()), column).mapInArrow(read, _RECORDS)


def write_derivatives(source: DataFrame, scratch: Scratch, key: str = "page_id", record: str = "record") -> DataFrame:
    """Write the derivative records of response records; returns the manifest ``file, records``.

    A null record and a record of another type give nothing, a null key leaves
    the page-id field out.  Repeated rows give repeated records, with the ids
    that theirs give.  Other columns are ignored; an empty table has no files.
    """
    from kinloom.llm.repair_store import _store

    folder = scratch.path("warc")

    def write(batches):
        system = out = None
        size = count = 0
        done = []

        def close():
            if out is not None:
                out.close()
                done.append((name, count))

        for batch in batches:
            for k, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r is None or (two := derive(k, r)) is None:
                    continue
                if out is None or size >= FILE_BYTES:
                    close()
                    if system is None:
                        system, root = _store(folder)
                        system.create_dir(root, recursive=True)
                    own = f"{uuid.uuid4().hex}.warc.gz"
                    name, size, count = f"{folder}/{own}", 0, 0
                    out = system.open_output_stream(posixpath.join(root, own), compression=None)
                for one in two:
                    size += out.write(gzip.compress(one, 1, mtime=0)) or len(one)
                    count += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["file", "records"])

    rows = source.select(F.col(key).cast("long").alias("page_id"), F.col(record).cast("binary").alias("record"))
    return scratch.cut(rows.mapInArrow(write, "file string, records long"), "manifest")


_KIND = pa.schema(
    [(n, pa.string()) for n in ("record_id", "type", "refers_to", "concurrent_to", "target_uri", "date", "source_digest", "block_digest", "content_type")] + [("page_id", pa.int64()), ("block", pa.string())]
)


def read_derivatives(manifest: DataFrame) -> DataFrame:
    """One row per record, from the files; blocks whose digest doesn't hold raise an error."""
    from kinloom.llm.repair_store import spread

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                pair: dict[str, tuple] = {}
                for h, block in (next(records(r)) for r in _members(name)):
                    if digest(block) != h["warc-block-digest"]:
                        raise ValueError(f"{h['warc-record-id']}: the block isn't what its digest says")
                    if h["warc-type"] == "metadata":
                        about = _fields(_lines(block.decode().split("\r\n")))
                        pair = {h["warc-refers-to"]: (int(about["page-id"]) if "page-id" in about else None, about["source-payload-digest"])}
                    key, source = pair[h["warc-refers-to"]]
                    rows.append((h["warc-record-id"], h["warc-type"], h["warc-refers-to"], h["warc-concurrent-to"], h.get("warc-target-uri"), h.get("warc-date"), source, h["warc-block-digest"], h["content-type"], key, block.decode()))
                    size += len(block)
                    if size > _BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(_KIND.names, r, strict=True)) for r in rows], _KIND)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(_KIND.names, r, strict=True)) for r in rows], _KIND)

    return spread(manifest.select("file"), "file").mapInArrow(
        read, "record_id string, type string, refers_to string, concurrent_to string, target_uri string, date string, source_digest string, block_digest string, content_type string, page_id long, block string"
    )
