"""Operator 5: WARC archives, written and read back sequentially.

write() makes one gzip member per record. Of records with equal payloads of at least min_payload bytes the
one with the smallest page_id is a response; the others are revisits that name it and hold no payload. Every
task writes its own archives through a file system that both driver and executors reach, under a name that
no other attempt has, and reports them; only archives that a finished task reported are ever read, so lost
executors and repeated attempts do no harm.

read() goes through an archive once, with memory for one head (a url) and a step: it inflates one gzip member at a time in small
steps, frames the record by its Content-Length, and verifies the digests of block and payload. A record that
does not agree with its length or digest raises. Archives of other writers are read too: records of every type, digests
by SHA-1, SHA-256, SHA-512 or MD5 in hex or base 32, or none, and revisits without a block.

Scale: the digests of all rows are aggregated with map-side combining and only digests that occur more than
once are joined back; the join is one that Spark may split where a group of equal payloads is large. The
html goes through one shuffle; archives are closed at a size.

Defined results: null html is an empty payload; empty or short payloads are always responses; null url
leaves out the target header; null page_id is last in order; repeated page_ids give a record each, and all
rows that carry a group's smallest page_id are responses; extra columns are ignored; an empty table gives
no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, new_folder, shuffle_parts, small_batches, spread

MIN_PAYLOAD = 100
ARCHIVE_BYTES = 64 << 20
STEP = 1 << 16
#: Bytes of a record's head, which holds a url, and of its HTTP head; a damaged record has no end of either.
HEAD, HTTP_HEAD = 1 << 28, 1 << 24
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long"


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """The bytes of one record, not yet compressed. A revisit's block is the HTTP head alone."""
    revisit = refers_to is not None
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"] if revisit else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member with no time in its head, so equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Members:
    """The gzip members of a stream, one after the other, each inflated in steps."""

    def __init__(self, stream, step: int = STEP):
        self.stream, self.step, self.held, self.offset = stream, step, b"", 0

    def __iter__(self) -> Iterator[tuple[int, Iterator[bytes]]]:
        while self.held or self._more():
            at = self.offset
            steps = self._inflate()
            yield at, steps
            for _ in steps:  # what the caller left
                pass

    def _more(self) -> bool:
        self.held += self.stream.read(self.step)
        return bool(self.held)

    def _inflate(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.held and not self._more():
                raise ValueError(f"the member at {self.offset} is cut short")
            given, self.held = self.held, b""
            while given and not z.eof:
                out = z.decompress(given, 4 * self.step)
                self.offset += len(given) - len(z.unconsumed_tail) - len(z.unused_data)
                given = z.unconsumed_tail
                if out:
                    yield out
            self.held = z.unused_data
        out = z.flush()
        if out:
            yield out


class _Body:
    """The record inside a member: its head, then exactly Content-Length bytes, then the closing line ends."""

    def __init__(self, steps: Iterator[bytes]):
        self.steps, self.held = steps, b""

    def until(self, mark: bytes) -> bytes:
        held = bytearray(self.held)
        at = held.find(mark)
        while at < 0:  # a head is as long as its url
            more = next(self.steps, b"")
            if not more or len(held) > HEAD:
                raise ValueError("a record without end of head")
            seen = max(0, len(held) - len(mark) + 1)
            held += more
            at = held.find(mark, seen)
        self.held = bytes(held[at + len(mark) :])
        return bytes(held[:at])

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held:
                self.held = next(self.steps, b"")
                if not self.held:
                    raise ValueError("a record shorter than its Content-Length")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part

    def ends_with(self, mark: bytes) -> bool:
        """Whether what is left is exactly mark; a longer rest is not read."""
        while len(self.held) <= len(mark):
            more = next(self.steps, b"")
            if not more:
                break
            self.held += more
        return self.held == mark


def _fields(lines: list[str]) -> dict[str, str]:
    """Names in lower case; a line that begins with white space goes on with the field before."""
    out, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class _Digests:
    """Running digests of bytes: SHA-256, and what else a head declares."""

    def __init__(self, declared: str | None):
        self.declared = declared
        self.kind, _, self.value = (declared or "").partition(":")
        self.kind = self.kind.lower().replace("-", "")
        self.sha256 = hashlib.sha256()
        self.other = hashlib.new(self.kind) if self.kind in ("sha1", "sha512", "md5") else None

    def update(self, part: bytes) -> None:
        self.sha256.update(part)
        if self.other:
            self.other.update(part)

    def agrees(self) -> bool:
        """Whether the declared digest, in hex or base 32, is that of the bytes; one that is missing or of an unknown kind says nothing."""
        own = self.sha256 if self.kind == "sha256" else self.other
        if own is None:
            return True
        return self.value.lower() == own.hexdigest() or self.value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def read_stream(stream, archive: str = "", payloads: bool = False) -> Iterator[dict]:
    """The records of an archive in order, of whatever type and writer. payloads: each has its payload too, else only size and digest are kept.

    payload_bytes of a revisit is what its own HTTP head declares, or null; payload_digest is the SHA-256 of what is there, for a
    revisit the one declared (bare if SHA-256). Records without HTTP content have their whole block as payload."""
    for offset, steps in Members(stream):
        body = _Body(steps)
        first, *lines = body.until(b"\r\n\r\n").decode(errors="replace").split("\r\n")
        head = _fields(lines)
        if not first.startswith("WARC/") or "warc-type" not in head or not head.get("content-length", "").isdigit():
            raise ValueError(f"no WARC record at {offset} of {archive}")
        kind, size, kept, status = head["warc-type"].lower(), 0, [], None
        http = bytearray() if kind in ("response", "revisit", "request") and head.get("content-type", "application/http").lower().startswith("application/http") else None
        block, payload = _Digests(head.get("warc-block-digest")), _Digests(head.get("warc-payload-digest"))
        for part in body.take(int(head["content-length"])):
            block.update(part)
            if http is not None:
                seen = max(0, len(http) - 3)
                http += part
                at = http.find(b"\r\n\r\n", seen)
                if at < 0:
                    if len(http) > HTTP_HEAD:
                        raise ValueError(f"the HTTP head of the record at {offset} of {archive} has no end")
                    continue
                status, part, http = bytes(http[:at]), bytes(http[at + 4 :]), None
            payload.update(part)
            size += len(part)
            if payloads:
                kept.append(part)
        if not body.ends_with(b"\r\n\r\n"):
            raise ValueError(f"the record at {offset} of {archive} is longer than its Content-Length")
        if not block.agrees():
            raise ValueError(f"the block digest of the record at {offset} of {archive} does not agree")
        revisit = kind == "revisit"
        fields = _fields((status or b"").decode(errors="replace").split("\r\n")[1:])
        declared = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
        # chunked and compressed bodies have other lengths than their heads may say
        plain = not fields.keys() & {"transfer-encoding", "content-encoding"}
        if not revisit and (not payload.agrees() or kind == "response" and plain and declared is not None and size != declared):
            raise ValueError(f"the payload digest of the record at {offset} of {archive} does not agree")
        digest = payload.sha256.hexdigest()
        if revisit:
            digest = payload.value.lower() if payload.kind == "sha256" else payload.declared
        number = lambda k: int(head[k]) if k in head else None
        out = {"page_id": number("warc-page-id"), "url": head.get("warc-target-uri"), "record_type": kind, "payload_bytes": declared if revisit else size, "payload_digest": digest, "refers_to": number("warc-refers-to-page-id"), "archive": archive, "offset": offset}
        yield out | ({"payload": b"".join(kept)} if payloads else {})


def _write(batches: Iterator[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    stream, done, count, at = None, [], 0, 0
    name = ""

    def close():
        nonlocal stream
        if stream:
            stream.close()
            done.append((name, count, at))
            stream = None

    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "digest")), strict=True):
            page_id, url, html, refers_to, digest = (x.as_py() for x in row)
            if stream is None:
                name, count, at = f"pages-{TaskContext.get().partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex[:12]}.warc.gz", 0, 0
                stream = system.open_output_stream(f"{root}/{name}", compression=None)
            data = member(record(page_id, url, (html or "").encode(), refers_to, digest))
            stream.write(data)
            count, at = count + 1, at + len(data)
            if at >= limit:
                close()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done]), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))], names=["archive", "records", "bytes"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in RECORD.split(", ")]
    for batch in batches:
        for archive, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
            system, path = fs.FileSystem.from_uri(archive)
            found, seen = [], 0
            with system.open_input_stream(path, compression=None) as stream:
                for r in read_stream(stream, archive):
                    found.append(r)
                    seen += 1
                    if len(found) == 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True)], names=names)
                        found = []
            if seen != records:
                raise ValueError(f"{archive} has {seen} records instead of {records}")
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True)], names=names)


def write(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to archives in folder (a URI that executors can write to); returns the manifest, one row per archive."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    long = F.octet_length(html) >= min_payload
    equal = pages.where(long).select(F.sha2(html.cast("binary"), 256).alias("digest"), F.col("page_id").cast("long").alias("page_id"))
    equal = equal.groupBy("digest").agg(F.count("*").alias("_n"), F.min("page_id").alias("_first")).where("_n > 1").drop("_n")
    equal = spread(equal)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to")
    joined = rows.join(equal, "digest", "left").select("page_id", "url", "html", refers, "digest")
    return cut(joined.mapInArrow(lean(lambda it: _write(it, folder, archive_bytes)), MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that the manifest names, in columns RECORD."""
    parts = shuffle_parts(manifest.sparkSession)
    return manifest.select("archive", "records").repartition(parts).mapInArrow(lean(_read), RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read(write(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
