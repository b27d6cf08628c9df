r"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Writing. Of records with equal payloads of at least `least_bytes`, the one with the
largest id is a response and the others revisit it. Each record is a gzip member of
its own. Spark's text writer stores them as they are, with an empty member (a valid
part of any gzip file) as the line separator, so archives are written through Spark's
committer into any store it knows, and a lost task leaves nothing behind.

Reading. A file is walked member by member (or record by record where it isn't
compressed). A record counts when its member's checksum, its lengths and its digests
hold. After a failed check the reader looks for the next offset at which a valid
member or a version line starts, goes on there, and logs the bytes between as a gap.
It does the same inside a member's content, also in what unpacks before a member fails;
there only records with a block digest count.

A file is one row of Spark's `binaryFile` source; `archive_bytes` sets the size of the
files that are written here. Foreign files have to fit a task (2 GB at most).

Defined results: a null payload is empty; a null id is written as such and read back
as null; a null url has no target line. Rows that repeat id and payload are both
responses. Empty tables give empty archives and results. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from urllib.parse import quote

from panelkit.operators.rows import small_side
from panelkit.session import materialize

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/[0-9]")
# An empty gzip member: header, empty block, checksum and size of nothing.
EMPTY_MEMBER = "\x1f\x8b\x08" + "\0" * 6 + "\x03\x03" + "\0" * 9
RECORD = "urn:x-page:"
CHUNK = 1 << 14
# Fixed value: the profile of revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# --- writing ----------------------------------------------------------------------------


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool, level: int = 3) -> bytes:
    """One record as a gzip member."""
    block = b"" if is_revisit else HTTP + payload
    lines = [
        f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <{RECORD}{_name(page_id)}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if is_revisit:
        lines += [f"WARC-Refers-To: <{RECORD}{_name(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    record = VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _name(page_id) -> str:
    return "null" if page_id is None else str(page_id)


def with_revisits(pages: DataFrame, page_id: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, refers_to, is_revisit)."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn(
        "same", F.when(F.octet_length("payload") >= least_bytes, F.unhex(F.sha2(F.col("payload").cast("binary"), 256)))
    )
    first = (
        rows.filter("same IS NOT NULL").groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n")
    )
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    # Rows without a digest have no join to make; equal payloads are fewer than pages.
    shared = small_side(materialize(first, "warc-shared"))
    small = rows.filter("same IS NULL").withColumn("refers_to", F.lit(None).cast(rows.schema["page_id"].dataType))
    return rows.filter("same IS NOT NULL").join(shared, "same", "left").unionByName(small).select(
        "page_id", "url", "payload", F.when(again, F.col("refers_to")).alias("refers_to"), again.alias("is_revisit")
    )


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
    *, least_bytes: int = 1000, archive_bytes: int = 16_000_000,
) -> None:
    """Writes archives of about `archive_bytes` of payload each below `path`: rows are dealt evenly over as many as that takes."""
    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            ids, urls, bodies, refs, again = (f.column(i).to_pylist() for i in range(5))
            out = [member(i, u, b.encode("utf-8", "surrogatepass"), r, a) for i, u, b, r, a in zip(ids, urls, bodies, refs, again)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    size = pages.agg(F.sum(F.octet_length(F.col(payload).cast("string")))).first()[0] or 0
    rows = with_revisits(pages, page_id, url, payload, least_bytes).repartition(1 + size // archive_bytes)
    (
        rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").text(path)
    )


# --- reading ----------------------------------------------------------------------------


class Damaged(Exception):
    """A check failed; says which."""


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at `at` unpacks to, its end, and what failed ("" if its checksum holds)."""
    unpacker, content, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not unpacker.eof and at < len(data):  # in pieces: what is left over is copied
            before, piece = unpacker.copy(), view[at:at + CHUNK]
            content.append(unpacker.decompress(piece))
            at = min(at + CHUNK, len(data))
    except zlib.error:
        content.append(_up_to_error(before, piece))
        return b"".join(content), at, "member: checksum or data"
    if not unpacker.eof:
        return b"".join(content), at, "member: cut short"
    return b"".join(content), at - len(unpacker.unused_data), ""


def _up_to_error(unpacker, piece: memoryview) -> bytes:
    """What the bytes of a piece unpack to before its first fault."""
    out = []
    try:
        for i in range(len(piece)):
            out.append(unpacker.decompress(piece[i:i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _unpack(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at `at`; its checksum holds."""
    content, end, fault = _inflate(data, at)
    if fault:
        raise Damaged(fault)
    return content, end


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record at `at`; its lengths and block digest hold."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("record: header cut short")
    first, *lines = data[at:stop].split(b"\r\n")
    header = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("record: header line")
        header[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = header.get("content-length", "")
    if not first.startswith(b"WARC/") or not size.isascii() or not size.isdigit():
        raise Damaged("record: version or length")
    begin, end = stop + 4, stop + 4 + int(size)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("record: length")
    block = data[begin:end]
    if (digest := header.get("warc-block-digest")) and digest.startswith("sha1:") and digest != _sha1(block):
        raise Damaged("record: block digest")
    return header, block, end + 4


def _payload(header: dict[str, str], block: bytes) -> bytes:
    if header.get("warc-type") == "response" and block.startswith(b"HTTP/"):
        _, cut, rest = block.partition(b"\r\n\r\n")
        if not cut:
            raise Damaged("record: http header")
        block = rest
    digest = header.get("warc-payload-digest", "")
    if header.get("warc-type") != "revisit" and digest.startswith("sha1:") and digest != _sha1(block):
        raise Damaged("record: payload digest")
    return block


def _holds(data: bytes, at: int) -> bool:
    try:
        _record(data, at)
    except Damaged:
        return False
    return True


def _next_start(data: bytes, after: int, packed: bool = True) -> int:
    """The next offset from `after` on that starts a valid member (if `packed`) or record.

    A version line at the start of a line is taken as it is (what follows is checked in
    turn); one that is glued to other bytes only if a whole record holds there.
    """
    zipped, line = data.find(MAGIC, after) if packed else -1, VERSION_LINE.search(data, after)
    while zipped >= 0 or line:
        if not line or 0 <= zipped < line.start():
            try:
                _unpack(data, zipped)
                return zipped
            except Damaged:
                zipped = data.find(MAGIC, zipped + 1)
        elif data[line.start() - 1:line.start()] == b"\n" or _holds(data, line.start()):
            return line.start()
        else:
            line = VERSION_LINE.search(data, line.start() + 1)
    return len(data)


def _records(data: bytes, at: int = 0) -> Iterator[tuple]:
    """Records and gaps of plain bytes from `at` on, with offsets in them."""
    lost, reason = None, ""
    while at < len(data):
        try:
            header, block, end = _record(data, at)
            payload = _payload(header, block)
        except Damaged as e:
            lost, reason = (at, str(e)) if lost is None else (lost, reason)
            at = _next_start(data, at + 1, packed=False)
            continue
        if lost is not None:
            yield "gap", lost, at, reason, None
            lost = None
        yield "record", at, end, header, payload
        at = end
    if lost is not None:
        yield "gap", lost, len(data), reason, None


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", start, end, header, payload) and ("gap", start, end, reason, None), in order.

    Offsets are those of the file; records and gaps inside a member have the member's.
    Of a member that fails its check, records count whose own lengths and block digest
    hold, and the member is logged as a gap up to where the reader goes on.
    """
    at, lost, reason = 0, None, ""
    while at < len(data):
        inside, fault = [], ""
        try:
            if data.startswith(MAGIC, at):
                content, end, fault = _inflate(data, at)
                inside = [e for e in _records(content) if not fault or e[0] == "record" and "warc-block-digest" in e[3]]
                if fault and not inside:
                    raise Damaged(fault)
                if fault:
                    end = _next_start(data, at + 1)
            else:
                header, block, end = _record(data, at)
                inside = [("record", 0, 0, header, _payload(header, block))]
        except Damaged as e:
            lost, reason = (at, str(e)) if lost is None else (lost, reason)
            at = _next_start(data, at + 1)
            continue
        if lost is not None:
            yield "gap", lost, at, reason, None
            lost = None
        for kind, _, _, what, payload in inside:
            yield kind, at, end, what, payload
        if fault:
            yield "gap", at, end, fault, None
        at = end
    if lost is not None:
        yield "gap", lost, len(data), reason, None


def _digest(header: dict[str, str], payload: bytes) -> str:
    """Bare hex SHA-1 of the full payload; a revisit's is the one it states."""
    if header.get("warc-type") != "revisit":
        return hashlib.sha1(payload).hexdigest()
    try:
        return base64.b32decode(header.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
    except ValueError:
        return ""


def _page(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").removeprefix(RECORD)
    return int(name) if name.removeprefix("-").isdigit() else None


READ_SCHEMA = (
    "kind string, file string, start long, end long, reason string, page_id long, record_type string, target_uri string, "
    "refers_to long, payload_bytes long, payload_digest string"
)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """Records and gaps of all files under `path` (column kind); with `payloads` also the payload."""
    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for name, data in zip(f.column(0), f.column(1)):
                out = [_row(name.as_py(), *event) for event in salvage(data.as_py())]
                columns = list(zip(*out)) if out else [()] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(columns[i]), field.type) for i, field in enumerate(schema) if payloads or field.name != "payload"],
                    [field.name for field in schema if payloads or field.name != "payload"],
                )

    text, number = pa.string(), pa.int64()
    schema = pa.schema([
        ("kind", text), ("file", text), ("start", number), ("end", number), ("reason", text), ("page_id", number),
        ("record_type", text), ("target_uri", text), ("refers_to", number), ("payload_bytes", number), ("payload_digest", text),
        ("payload", pa.binary()),
    ])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, READ_SCHEMA + (", payload binary" if payloads else ""))


def _row(file: str, kind: str, start: int, end: int, what, payload: bytes | None) -> tuple:
    if kind == "gap":
        return kind, file, start, end, what, None, None, None, None, None, None, None
    size = what.get("warc-payload-length", "")
    revisit = what.get("warc-type") == "revisit"
    return (
        kind, file, start, end, None, _page(what.get("warc-record-id")), what.get("warc-type"), what.get("warc-target-uri"),
        _page(what.get("warc-refers-to")), int(size) if revisit and size.isdigit() else len(payload), _digest(what, payload), payload,
    )
