"""WARC archives: writing with revisit records, and a salvage reader.

The reader walks an archive member by member (gzip) or record by record (plain). A member or record
that fails a check (inflation and its CRC, version line, headers, length, closing lines, block digest) is
not the end: the reader searches on for the next valid member or version line, recovers what follows and
logs the skipped bytes as a quarantined gap with its reason. Memory is bounded by the largest record.

Rows with null html have an empty payload. Of rows with equal payloads the one with the largest page_id
is the response; a null page_id is below all others, and alone it is a response. Repeated rows of the
response are responses too. Empty tables give no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import files
from tidewheel.llm.storage import bounded_batches, materialise, new_folder

#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 32 << 20
#: Payloads from this size on are written once; later copies are revisits.
MIN_REVISIT_BYTES = 0
_STEP = 1 << 16
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
#: Holds a url with line breaks or with white space at its ends; a page without a url has no target at all.
_EXACT = "X-Target-URI-Base64"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    start: int = 0
    end: int = 0

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block

    def http(self) -> dict[str, str]:
        head = self.block.partition(b"\r\n\r\n")[0].decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head)}


@dataclass
class Gap:
    start: int
    end: int
    reason: str = field(default="")


def encode(headers: list[tuple[str, str]], block: bytes, level: int | None = 1) -> bytes:
    """One record; a gzip member of its own unless ``level`` is None."""
    lines = [*headers, ("WARC-Block-Digest", "sha1:" + digest32(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    data = head.encode() + block + b"\r\n\r\n"
    if level is None:
        return data
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Bad(Exception):
    pass


class _Source:
    """Bytes at any offset of a file or buffer, without holding all of it."""

    def __init__(self, f):
        self.f = f
        self.size = f.size() if callable(getattr(f, "size", None)) else len(f.getbuffer())

    def at(self, start: int, n: int) -> bytes:
        self.f.seek(start)
        return self.f.read(max(0, min(n, self.size - start)))

    def find(self, what: bytes, start: int) -> int:
        """The next offset of ``what`` from ``start`` on, or -1."""
        while start < self.size:
            part = self.at(start, _STEP * 16 + len(what))
            at = part.find(what)
            if at >= 0:
                return start + at
            start += max(1, len(part) - len(what) + 1)
        return -1


def _headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(_VERSION) or len(lines[0]) > 9:
        raise Bad("version line")
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        k, colon, v = line.partition(b":")
        if not colon:
            raise Bad("header line")
        last = k.strip().lower().decode("utf-8", "replace")
        out[last] = v.strip().decode("utf-8", "replace")
    if not out.get("content-length", "").isdigit():
        raise Bad("content length")
    return out


def _checked(headers: dict[str, str], block: bytes, tail: bytes) -> Record:
    if len(block) != int(headers["content-length"]):
        raise Bad("record length")
    if tail != b"\r\n\r\n":
        raise Bad("closing lines")
    name, _, want = headers.get("warc-block-digest", "").partition(":")
    if name.lower() == "sha1" and want.upper() != digest32(block):
        raise Bad("block digest")
    return Record(headers, block)


def _member(src: _Source, at: int) -> Record:
    """The record in the gzip member at ``at``."""
    z, data, pos = zlib.decompressobj(31), bytearray(), at
    need: int | None = None
    try:
        while not z.eof:
            raw = src.at(pos, _STEP)
            if not raw:
                raise Bad("cut member")
            seen = len(data)
            data += z.decompress(raw)
            pos += len(raw) - len(z.unused_data)
            if need is None:
                if not data.startswith(_VERSION[: len(data)]):
                    raise Bad("version line")
                # Headers have no limit, as the writer has none; only what is new is searched.
                end = data.find(b"\r\n\r\n", max(0, seen - 3))
                if end >= 0:
                    need = end + 8 + int(_headers(bytes(data[:end]))["content-length"])
            if need is not None and len(data) > need:
                raise Bad("record length")
    except zlib.error:
        raise Bad("inflation") from None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Bad("headers")
    record = _checked(_headers(bytes(data[:end])), bytes(data[end + 4 : -4]), bytes(data[-4:]))
    record.start, record.end = at, pos
    return record


def _plain(src: _Source, at: int) -> Record:
    """The uncompressed record at ``at``."""
    head, n = b"", _STEP
    while b"\r\n\r\n" not in head:
        if len(head) >= src.size - at:
            raise Bad("headers")
        head = src.at(at, n)
        if not head.startswith(_VERSION[: max(1, len(head))]):
            raise Bad("version line")
        n *= 4
    end = head.find(b"\r\n\r\n")
    headers = _headers(head[:end])
    length = int(headers["content-length"])
    if at + end + 8 + length > src.size:
        raise Bad("record length")
    block = src.at(at + end + 4, length + 4)
    record = _checked(headers, block[:length], block[length:])
    record.start, record.end = at, at + end + 8 + length
    return record


def read(f) -> Iterator[Record | Gap]:
    """All records of an archive in order, and the gaps between them."""
    src = _Source(f)
    at = 0
    while at < src.size:
        try:
            record = _member(src, at) if src.at(at, 3) == _MAGIC else _plain(src, at)
            yield record
            at = record.end
            continue
        except Bad as e:
            reason = str(e)
        start, seek = at, at + 1
        at = src.size
        # The next place at which a whole record passes its checks.
        marks = {m: src.find(m, seek) for m in (_MAGIC, _VERSION)}
        while any(x >= 0 for x in marks.values()):
            mark = min((m for m in marks if marks[m] >= 0), key=lambda m: marks[m])
            try:
                (_member if mark == _MAGIC else _plain)(src, marks[mark])
                at = marks[mark]
                break
            except Bad:
                marks[mark] = src.find(mark, marks[mark] + 1)
        yield Gap(start, at, reason)


def _target(headers: dict[str, str]) -> str | None:
    exact = headers.get(_EXACT.lower())
    return headers.get("warc-target-uri") if exact is None else base64.b64decode(exact).decode("utf-8", "surrogatepass")


def page_record(page_id, url: str | None, payload: bytes, sha: str, refers_to, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda x: f"<urn:page:{'' if x is None else x}:{sha}>"
    headers = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        *([("WARC-Target-URI", "".join(url.splitlines()).strip())] if url is not None else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + sha),
    ]
    if url is not None and url != headers[3][1]:  # a header can't hold it as it is
        headers.append((_EXACT, base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()))
    if is_revisit:
        headers += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Truncated", "length")]
    return encode(headers, http if is_revisit else http + payload)


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives; gives the manifest: uri, bytes, records.

    The choice of responses is an aggregation by payload digest; its result, a row for each distinct
    payload, joins back. Spark may split a hot digest's partition, as any task can write any page.
    """
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).alias("n"))
    keep = p.groupBy("sha", "n").agg(F.max("page_id").alias("keeper")).hint("shuffle_hash")
    rows = p.alias("p").join(keep.alias("k"), ["sha", "n"]).select("page_id", "url", "html", "sha", "keeper")

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, records, done = None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    archive, records = files.Out(folder, f"pages-{TaskContext.get().partitionId():05d}", ".warc.gz"), 0
                payload = row["html"].encode("utf-8", "surrogatepass")
                sha = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                revisit = len(payload) >= min_revisit_bytes and row["page_id"] != row["keeper"]
                archive.write(page_record(row["page_id"], row["url"], payload, sha, row["keeper"], revisit))
                records += 1
                if archive.size >= ARCHIVE_BYTES:
                    archive.close()
                    done.append((archive.uri, archive.size, records))
                    archive = None
        if archive is not None:
            archive.close()
            done.append((archive.uri, archive.size, records))
        yield pa.RecordBatch.from_pydict({"uri": [x[0] for x in done], "bytes": [x[1] for x in done], "records": [x[2] for x in done]}, schema=_MANIFEST)

    return materialise(rows.mapInArrow(out, "uri string, bytes long, records long"), "warc-manifest")


_MANIFEST = pa.schema([("uri", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
_FOUND = pa.schema([(k, pa.string()) for k in ("uri", "type", "id", "target", "refers", "digest")] + [(k, pa.int64()) for k in ("payload_bytes", "start", "end")] + [("ok", pa.bool_()), ("gap", pa.string()), ("payload", pa.binary())])


def complete(found: Iterator[Record | Gap], expected: int | None) -> Iterator[Record | Gap]:
    """``found``, and a gap at its end if it has fewer records than the manifest says."""
    n, end = 0, 0
    for x in found:
        n, end = n + isinstance(x, Record), x.end
        yield x
    if expected is not None and n < expected:
        yield Gap(end, end, f"{expected - n} records missing")


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record and each gap of the archives in ``manifest`` (uri, and perhaps records, the number written).

    uri, type, id, target, refers, digest, payload_bytes, start, end, ok, gap, payload: ``digest`` is
    computed from a response's payload and taken from a revisit's headers, as is its size; ``ok`` tells
    whether it agrees with the header; ``gap`` has the reason of a quarantined gap, else null.
    """
    bounded_batches(spark)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input(uri) as f:
                    for x in complete(read(f), expected):
                        row = dict.fromkeys(_FOUND.names) | {"uri": uri, "start": x.start, "end": x.end}
                        if isinstance(x, Gap):
                            row |= {"gap": x.reason}
                        else:
                            h, body = x.headers, x.payload()
                            said = h.get("warc-payload-digest", "").removeprefix("sha1:")
                            revisit = x.kind == "revisit"
                            length = x.http().get("content-length", "")
                            row |= {"type": x.kind, "id": h.get("warc-record-id"), "target": _target(h), "refers": h.get("warc-refers-to")}
                            row |= {"digest": said if revisit else digest32(body), "payload_bytes": (int(length) if length.isdigit() else None) if revisit else len(body)}
                            row |= {"ok": revisit or not said or said == row["digest"], "payload": body if payloads and not revisit else None}
                            held += len(body) if payloads else 0
                        rows.append(row)
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    schema = ", ".join(f"`{f.name}` {kinds[f.type]}" for f in _FOUND)
    # Archives have a bounded size; each is a row that any task can take.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    said = F.col("records") if "records" in manifest.columns else F.lit(None).cast("long")
    return manifest.select("uri", said.alias("records")).repartition(parts).mapInArrow(out, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read the archives back: the contract's columns, from the archives alone.

    A gap, a digest that disagrees or an archive with fewer records than were written is an error: no record is dropped.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    got = read_archives(spark, write(pages, new_folder(spark, "warc")))
    lost = F.raise_error(F.concat(F.lit("record lost in "), "uri", F.lit(": "), F.coalesce("gap", F.lit("payload digest"))))
    got = got.filter(F.when(F.col("gap").isNull() & F.col("ok"), True).otherwise(lost.cast("boolean")))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+):", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return got.select(
        as_id(F.col("id")).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        as_id(F.col("refers")).alias("refers_to"),
        F.col("target").alias("url"),
    )
