"""WARC archives: a writer that turns repeated payloads into revisits, and a reader that salvages.

The writer makes each record a gzip member of its own; the reader takes members
of several records too.  It checks every member (gzip checksum) and record (WARC
header, lengths, payload's SHA-1 in hex or base32); after a failed check it looks
for the next member or version line that reads as a valid record, goes on from
there and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, shared_fs

GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: An archive file is closed once it has this many bytes.
FILE_BYTES = 1 << 30
#: Where an uncompressed record is only guessed at (after damage), its header is looked for within so many bytes.
MAX_HEADER = 1 << 16
#: Content of a member beyond this is held in a temporary file.
HELD = 64 << 20
_WINDOW = 4 << 20
_STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs of RFC 4122


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def type(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header (the block itself where there is none)."""
        head, found, rest = self.block.partition(b"\r\n\r\n")
        return rest if found and head.startswith(b"HTTP/") else self.block

    @property
    def payload_length(self) -> int:
        """Of the full payload: a revisit has it in its HTTP header."""
        m = re.search(rb"(?im)^content-length:\s*(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(m[1]) if m else len(self.payload)


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Source:
    """A window over a seekable file, in which records begin with one of ``marks``."""

    def __init__(self, f, marks: tuple[bytes, ...] = (GZIP, VERSION)):
        self.f, self.size, self.at, self.data, self.marks = f, f.seek(0, 2), 0, b"", marks

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.data):
            self.f.seek(at)
            self.at, self.data = at, self.f.read(max(n, _WINDOW))
        return self.data[at - self.at : at - self.at + n]

    def find(self, at: int) -> int:
        """Where the next of the marks stands; -1: nowhere."""
        while at < self.size:
            part = self.get(at, _WINDOW)
            hits = [i for i in map(part.find, self.marks) if i >= 0]
            if hits:
                return at + min(hits)
            if len(part) < _WINDOW:
                return -1
            at += len(part) - len(VERSION)
        return -1

    def index(self, what: bytes, at: int, n: int) -> int:
        """Where ``what`` stands in the ``n`` bytes from ``at`` on; -1: nowhere."""
        stop = min(at + n, self.size)
        while at < stop:
            part = self.get(at, min(_WINDOW, stop - at))
            i = part.find(what)
            if i >= 0:
                return at + i
            if at + len(part) >= stop:
                return -1
            at += len(part) - len(what) + 1
        return -1


def _plain(src: _Source, at: int, most: int) -> Record:
    """The uncompressed record at ``at``, whose header takes up to ``most`` bytes; ValueError if it isn't one."""
    end = src.index(b"\r\n\r\n", at, most) if src.get(at, len(VERSION)) == VERSION else -1
    if end < 0:
        raise ValueError("no record header")
    headers = {}
    for line in src.get(at, end - at).decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    try:
        n = int(headers["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no content length") from None
    if not 0 <= n <= src.size or src.get(end + 4 + n, 4) != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return Record(at, end + 8 + n, headers, src.get(end + 4, n))


def _member(src: _Source, at: int) -> tuple[_Source, int]:
    """The content and the end of the gzip member at ``at``; ValueError if gzip's check fails."""
    d, out, pos = zlib.decompressobj(31), tempfile.SpooledTemporaryFile(HELD), at  # noqa: SIM115
    try:
        while not d.eof:
            part = src.get(pos, 1 << 16)
            if not part:
                raise ValueError("the member is cut off")
            out.write(d.decompress(part))
            pos += len(part)
    except zlib.error as e:
        raise ValueError(f"the member is damaged: {e}") from None
    return _Source(out, (VERSION,)), pos - len(d.unused_data)


class _WrongDigest(ValueError):
    def __init__(self, end: int):
        super().__init__("the payload's digest is wrong")
        self.end = end


def _sha1(stated: str) -> bytes | None:
    """The bytes of a digest in hex or base32, in any case; None if it is of another kind or form."""
    kind, _, text = (x.strip() for x in stated.partition(":"))
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", text):
        return bytes.fromhex(text)
    return base64.b32decode(text.upper()) if re.fullmatch("[A-Za-z2-7]{32}", text) else None


def _records(src: _Source, at: int, most: int) -> tuple[Iterable[Record | Gap], int]:
    """What stands at ``at``, and its end; ValueError if a check fails.  ``most`` bounds the header of an uncompressed record.

    Records of a gzip member have the member's start and end, and so have gaps among them.
    """
    if GZIP in src.marks and src.get(at, len(GZIP)) == GZIP:
        content, end = _member(src, at)
        inside, first = _walk(content), []
        for x in inside:
            first.append(x)
            if isinstance(x, Record):
                break
        else:
            raise ValueError(first[0].reason if first else "the member is empty")

        def placed():
            for x in itertools.chain(first, inside):
                if isinstance(x, Gap):
                    x.reason = f"{x.reason} (bytes {x.start} to {x.end} of the member's content)"
                x.start, x.end = at, end
                yield x

        return placed(), end
    record = _plain(src, at, most)
    sha1 = _sha1(record.headers.get("warc-payload-digest", "")) if record.type == "response" else None
    if sha1 is not None and hashlib.sha1(record.payload).digest() != sha1:
        raise _WrongDigest(record.end)
    return (record,), record.end


def _walk(src: _Source) -> Iterator[Record | Gap]:
    at, gap, why, guess = 0, None, "", False
    while at < src.size:
        try:
            found, end = _records(src, at, MAX_HEADER if guess else src.size)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            # the lengths in a member that passed gzip's check hold: no record is looked for inside a payload
            guess = not (isinstance(e, _WrongDigest) and GZIP not in src.marks)
            at = src.find(at + 1) if guess else e.end
            if at < 0:
                break
            continue
        if gap is not None:
            yield Gap(gap, at, why)
            gap, guess = None, False
        yield from found
        at = end
    if gap is not None:
        yield Gap(gap, src.size, why)


def salvage(f) -> Iterator[Record | Gap]:
    """All records of an open, seekable file in order, with a Gap for each run of bytes that isn't one.

    Records and headers may have any length.  Only where a version line is met in
    search of the next record after damage, its header must end within ``MAX_HEADER``.
    A member that fails gzip's check is a gap as a whole.
    """
    return _walk(_Source(f))


def mark_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 1000) -> DataFrame:
    """``pages`` with ``__bytes``, ``__sha1`` and ``__owner``: the largest id that has this payload, where another's is larger.

    Payloads are grouped by their digest with partial maxima, so that a payload
    that a third of the pages share costs each task one row.  Only repeated
    payloads are joined back.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    marked = pages.withColumns({"__bytes": F.octet_length(payload).cast("long"), "__sha1": F.sha1(payload.cast("binary"))})
    owners = marked.filter(F.col("__bytes") >= min_bytes).groupBy(F.col("__sha1").alias("__s2")).agg(F.max(page_id).alias("__owner"), F.count("*").alias("__n"))
    owners = materialize(owners.filter("__n > 1 and __owner is not null").select("__s2", "__owner"), "warc-owners")
    return marked.join(owners, F.col("__sha1") == F.col("__s2"), "left").drop("__s2")


def write_archives(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", level: int = 6, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Writes a record for each row and returns the manifest (path, records, bytes of each archive).

    Null html is an empty payload; a null URL gives no target header; a null id
    is written as such and never owns a payload.  Rows that repeat the owner's id
    and payload are responses too.  An empty table writes no archive.  Only files
    in the manifest count, so that attempts of lost executors do no harm.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    fs, local = shared_fs(path)
    fs.create_dir(local, recursive=True)
    rows = mark_revisits(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")), "page_id", "html", min_bytes)
    revisit = F.col("__owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__owner"))
    rows = rows.select("page_id", "url", F.when(revisit, None).otherwise(F.col("html").cast("binary")).alias("payload"), F.col("__bytes").alias("n"), F.col("__sha1").alias("sha1"), F.when(revisit, F.col("__owner")).alias("owner"))

    def write(batches):
        out_fs, sink, name, done = shared_fs(path)[0], None, "", {"records": 0, "bytes": 0}
        for batch in batches:
            for page, target, payload, n, sha1, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    name = f"{local}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    sink, done = out_fs.open_output_stream(name, compression=None), {"records": 0, "bytes": 0}
                data = gzip_member(_page_record(page, target, payload, n, sha1, owner, date), level)
                sink.write(data)
                done = {"records": done["records"] + 1, "bytes": done["bytes"] + len(data)}
                if done["bytes"] >= file_bytes:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pylist([done | {"path": name}], schema=_MANIFEST)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([done | {"path": name}], schema=_MANIFEST)

    found = [r.asDict() | {"root": path} for r in rows.mapInArrow(write, "path string, records long, bytes long").collect()]
    found.sort(key=lambda r: r["path"])
    with fs.open_output_stream(f"{local}/manifest.json") as f:
        f.write(json.dumps(found).encode())
    return found


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _page_record(page, target, payload, n, sha1, owner, date) -> bytes:
    name = lambda p: f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{p}')}>"
    headers = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", name(page)), ("WARC-Date", date)]
    if target is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target)))
    headers.append(("WARC-Payload-Digest", f"sha1:{sha1}"))
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if owner is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(owner)), ("X-Refers-To-Page-Id", str(owner))]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return record_bytes(headers, _STATUS % n + (payload or b""))


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_start long, gap_end long, gap_reason string, path string"


def read_archives(spark: SparkSession, manifest: list[dict], payloads: bool = False, whole: bool = False) -> DataFrame:
    """A row for each record and for each gap (``gap_end`` not null) of the archives.

    A damaged archive gives the records that can be read; nothing raises but a
    missing file.  With ``whole`` a gap raises too, and so does an archive that
    has more or fewer records than the manifest says.  ``payloads`` adds the
    payload of responses.
    """
    schema = _READ + (", payload binary" if payloads else "")
    if not manifest:
        return spark.createDataFrame([], schema)
    names = [x.strip().split()[0] for x in schema.split(",")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.strip().split()[1]] for x in schema.split(",")]

    def read(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                own = manifest[i]
                with shared_fs(own["root"])[0].open_input_file(own["path"]) as f:
                    out, held, records = [], 0, 0
                    for x in salvage(f):
                        records += isinstance(x, Record)
                        if whole and isinstance(x, Gap):
                            raise ValueError(f"{own['path']}: bytes {x.start} to {x.end} are no record: {x.reason}")
                        try:
                            out.append(_row(x, own["path"], payloads))
                        except ValueError as e:  # an id that is no number
                            if whole:
                                raise
                            out.append(_row(Gap(x.start, x.end, f"damaged header: {e}"), own["path"], payloads))
                        held += len(out[-1][-1] or b"") if payloads else 0
                        if len(out) == 5_000 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out, held = [], 0
                    if whole and records != own["records"]:
                        raise ValueError(f"{own['path']}: {records} records, {own['records']} in the manifest")
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    n = len(manifest)
    return spark.range(0, n, 1, n).mapInArrow(read, schema)


def _row(x: Record | Gap, path: str, payloads: bool) -> tuple:
    if isinstance(x, Gap):
        return (None, None, None, None, None, None, x.start, x.end, x.reason, path) + ((None,) if payloads else ())
    h = x.headers

    def number(k: str) -> int | None:
        if k in h and not re.fullmatch(r"-?[0-9]{1,18}", h[k]):
            raise ValueError(f"{k} is no number")
        return int(h[k]) if k in h else None

    row = (number("x-page-id"), h.get("warc-target-uri"), x.payload_length, h.get("warc-payload-digest", "").removeprefix("sha1:"), x.type, number("x-refers-to-page-id"), None, None, None, path)
    return row + ((x.payload if x.type == "response" else None,) if payloads else ())
