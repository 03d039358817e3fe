"""WARC records: responses, the metadata and plain-text conversions derived from them, and files of records.

A derivative names its response by WARC-Refers-To (and that record's target and date), keeps the response's date, target and
payload digest, and carries the source's WARC and HTTP headers in its JSON block (metadata) or its text (conversion). Identifiers
of derivatives are name-based: the same response always gives the same records.

Defined results: a null page is an empty one, a null url is kept as an empty target; a response that can't be read as WARC gives
no derivatives but a row of kind ``invalid`` with the reason; repeated responses give repeated derivatives.
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
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.llm._common import slices

VERSION = "WARC/1.1"
#: Bytes of a header line that are read at once.
LINE = 1 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 9562's namespace for URLs
#: Elements of which nothing is shown, elements that begin a line, and elements whose links are listed.
HIDDEN = frozenset("script style template noscript".split())
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol option p pre section table td th title tr ul".split())
LINKED = frozenset("a area link img script iframe source".split())
# Patterns with possessive repeats only: none goes back over what it has read.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_BEGUN = re.compile(r"</?[A-Za-z]")
_ATTRIBUTE = re.compile(r"""([^\s=>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
#: What a tag's name asks for: 1 a line, 2 links, 4 nothing shown, 8 the title.
_KIND = {form: (name in BLOCKS) | 2 * (name in LINKED) | 4 * (name in HIDDEN) | 8 * (name == "title") for name in BLOCKS | LINKED | HIDDEN for form in (name, name.upper())}
_CLOSED = {name: re.compile(rf"</{name}\s*+>", re.I) for name in (*HIDDEN, "title")}


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as archives write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(0).join(names))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version, headers, length of the block, the block, two line ends. Line ends inside values become spaces."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def read_record(data: bytes, at: int = 0) -> tuple[list[tuple[str, str]], bytes, int]:
    """Headers, block and the place after the record that begins at ``at``; a header's folded lines are joined."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or data[at : at + 5] != b"WARC/":
        raise ValueError(f"no WARC record at byte {at}")
    headers: list[tuple[str, str]] = []
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        else:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"header without a colon: {line[:40]!r}")
            headers.append((name.strip(), value.strip()))
    size = header(headers, "Content-Length")
    if size is None or not size.isdigit():
        raise ValueError("no content length")
    begin, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("the block is shorter than its length")
    return headers, data[begin:stop], stop + 4


def header(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def read_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("HTTP/"):
        raise ValueError("the block is no HTTP response")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def dechunked(payload: bytes) -> bytes | None:
    """The payload without its chunk sizes; None where it isn't written in chunks."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at, at + 1000)
        try:
            size = int(payload[at:end].split(b";")[0].strip(), 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        if not size:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
        if at > len(payload):
            return None


def decoded(payload: bytes, http: list[tuple[str, str]]) -> tuple[bytes, bytes, list[str]]:
    """The payload without its transfer coding, that without its content codings, and the codings undone.

    Archives also hold payloads that were decoded before: what isn't written as a header says stays as it is.
    """
    undone = []
    if "chunked" in (header(http, "Transfer-Encoding") or "").lower() and (body := dechunked(payload)) is not None:
        payload = body
        undone.append("chunked")
    entity = payload
    for coding in reversed([c.strip().lower() for c in (header(http, "Content-Encoding") or "").split(",")]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            try:
                entity = zlib.decompressobj(bits).decompress(entity)
            except zlib.error:
                continue
            undone.append(coding)
            break
    return payload, entity, undone


def payload_text(payload: bytes, http: list[tuple[str, str]]) -> str:
    """The payload in the character set that the source header names, else UTF-8; bytes that don't fit are replaced."""
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", header(http, "Content-Type") or "", re.I)
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _attribute(tag: str) -> tuple[str, str] | None:
    """The first href or src of a tag's attributes."""
    for name, *values in _ATTRIBUTE.findall(tag):
        if name.lower() in ("href", "src"):
            return name.lower(), html.unescape(next((v for v in values if v), "")).strip()
    return None


def _joined(base: str, link: str) -> str:
    """The link as an absolute one; absolute ones, and such as can't be joined, as they are."""
    if link.startswith(("http://", "https://")):
        return link
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def scan(page: str, base: str = "") -> tuple[str, str, list[dict[str, str]]]:
    """What a page shows, its title and its links, in one pass whose time is in proportion to the page.

    No scripts, styles or comments are shown; each block begins a line; entities are resolved, white space in lines collapses. A tag
    ends at the first > outside a quoted value, a comment that isn't closed at the first >, a hidden element that isn't closed at the
    end of the page; a < that begins no tag, and one whose tag never ends, are text.
    """
    out: list[str] = []
    links: list[dict[str, str]] = []
    title: str | None = None
    at, comments = 0, True
    find, match, show, kind_of = page.find, _TAG.match, out.append, _KIND.get
    while (start := find("<", at)) >= 0:
        if start > at:
            show(page[at:start])
        if found := match(page, start):
            closing, name, rest = found.groups()
            at = found.end()
            kind = kind_of(name)
            if kind is None:
                kind = kind_of(name.lower(), 0)
            if not kind:
                continue
            if kind & 1:
                show("\n")
            if closing:
                continue
            if kind & 2 and (link := _attribute(rest)):
                links.append({"path": f"{name.upper()}@/{link[0]}", "url": _joined(base, link[1])})
            if kind & 4:
                closed = _CLOSED[name.lower()].search(page, at)
                at = closed.end() if closed else len(page)
            elif kind & 8 and title is None:
                closed = _CLOSED["title"].search(page, at)
                title = " ".join(html.unescape(page[at : closed.start()]).split()) if closed else ""
        elif page.startswith(("<!", "<?"), start):
            end = -1
            if comments and page.startswith("<!--", start):
                end = find("-->", start + 4)
                comments = end >= 0
                end += 2 if comments else 0
            if end < 0:
                end = find(">", start)
            if end < 0:
                at = start
                break
            at = end + 1
        elif _BEGUN.match(page, start):  # no tag ends from here on
            at = start
            break
        else:
            show("<")
            at = start + 1
    out.append(page[at:])
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), title or "", links


def response(url: str, page: str, number: str, date: str) -> bytes:
    """A page as an archived HTTP response."""
    payload = page.encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, number, digest(payload))), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
    return write_record(headers, block)


def derivatives(record: bytes) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """(kind, headers, block) of the metadata and the conversion record of one response record."""
    source, block, _ = read_record(record)
    if header(source, "WARC-Type") != "response":
        raise ValueError("not a response")
    status, http, payload = read_http(block)
    url, number, date = (header(source, k) or "" for k in ("WARC-Target-URI", "WARC-Record-ID", "WARC-Date"))
    own = header(source, "WARC-Payload-Digest") or digest(payload)
    plain, entity, undone = decoded(payload, http)
    text, title, links = scan(payload_text(entity, http), url)
    known = {
        "source-warc-headers": [list(h) for h in source],
        "source-http-status": status,
        "source-http-headers": [list(h) for h in http],
        "payload-digest": own,
        "payload-digest-verified": own in (digest(payload), digest(plain)),
        "payload-length": len(payload),
        "decoded": undone,
        "title": title,
        "links": links,
    }
    out = []
    for kind, content_type, body in (("metadata", "application/json", json.dumps(known, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, number)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To", number), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Payload-Digest", own), ("WARC-Block-Digest", digest(body)), ("Content-Type", content_type)]
        out.append((kind, headers, body))
    return out


def response_records(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, record): every page as a response record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                rows = zip(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([response(u or "", h or "", str(i), date) for i, u, h in rows], pa.binary())], names=["page_id", "record"])

    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, record binary")


DERIVED = "page_id long, kind string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, block_digest string, content_length long, record binary"


def derive(responses: DataFrame) -> DataFrame:
    """Two rows for each response record: its metadata and its conversion, with the main headers as columns and the whole record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DERIVED.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 7, pa.int64(), pa.binary()]
        for batch in batches:
            for part in slices(batch, "record"):
                rows = []
                for page, record in zip(*(c.to_pylist() for c in part.columns)):
                    try:
                        found = derivatives(record or b"")
                    except ValueError as e:
                        rows.append((page, "invalid", None, None, None, None, None, None, 0, str(e).encode()))
                        continue
                    for kind, headers, body in found:
                        get = dict(headers).get
                        rows.append((page, kind, get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Target-URI"), get("WARC-Date"), get("WARC-Payload-Digest"), get("WARC-Block-Digest"), len(body), write_record(headers, body)))
                cols = list(zip(*rows)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return responses.select("page_id", "record").mapInArrow(run, DERIVED)


def write_warc(records: DataFrame, path: str, column: str = "record") -> DataFrame:
    """Write records as ``path``/part-N.warc.gz, a gzip member for each, and return (file, records). A file appears whole or not at all.

    ``path`` is a URI that pyarrow can open from every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():05d}.warc.gz"
        own = f"{root}/.attempt-{task.taskAttemptId()}"
        n = 0
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    out.write(gzip.compress(record, 6, mtime=0))
                    n += 1
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    return records.select(column).mapInArrow(run, "file string, records long")


def stream_records(stream: BinaryIO) -> Iterator[tuple[str, bytes]]:
    """(kind, record) of a stream of records, one held at a time; kind ``invalid`` with the reason where the stream isn't one.

    After damage reading goes on at the next line that begins a record; damage to the compression ends the stream.
    """
    line = b""
    try:
        while True:
            while not line.startswith(b"WARC/"):
                if line.strip():
                    yield "invalid", f"no WARC record at {line[:40]!r}".encode()
                    while line and not line.startswith(b"WARC/"):
                        line = stream.readline(LINE)
                    continue
                line = stream.readline(LINE)
                if not line:
                    return
            head, size = [line], None
            while (line := stream.readline(LINE)) not in (b"", b"\r\n", b"\n"):
                head.append(line)
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    size = int(value)
            if size is None:
                yield "invalid", b"no content length"
                line = b""
                continue
            record = b"".join(head) + b"\r\n" + stream.read(size) + b"\r\n\r\n"
            try:
                headers, _, _ = read_record(record)
            except ValueError as e:
                yield "invalid", str(e).encode()
            else:
                yield header(headers, "WARC-Type") or "", record
            line = b""
    except (EOFError, zlib.error, gzip.BadGzipFile) as e:
        yield "invalid", f"compression: {e}".encode()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, kind, record) of the records in .warc and .warc.gz files.

    A file is streamed by one task, a record at a time; pyarrow opens it, so ``path`` is one that it can open from every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def rows(held: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.binary()))], names=["file", "position", "kind", "record"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with store.open_input_file(at) as raw:
                    packed = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    held, size = [], 0
                    with gzip.open(raw) if packed else io.BufferedReader(raw) as stream:
                        for n, (kind, record) in enumerate(stream_records(stream)):
                            held.append((name, n, kind, record))
                            size += len(record)
                            if size > 4_000_000:
                                yield rows(held)
                                held, size = [], 0
                    if held:
                        yield rows(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path")
    return files.mapInArrow(run, "file string, position long, kind string, record binary")
