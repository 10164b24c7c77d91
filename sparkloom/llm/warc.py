"""WARC archives: a writer with payload de-duplication and a splittable reader of gzip members.

Every record is a gzip member of its own, as the format asks for. The writer makes one archive for each
task in the shared folder (written under a name of the attempt, then moved, so a task that runs again replaces
its archive). The reader cuts archives into byte ranges. A task looks for the gzip magic from its
range's start, takes a candidate for a record only if it inflates to a record header that can be read, and owns
the records that start inside its range; the last one is read beyond the range's end.

Equal payloads of ``least_bytes`` bytes or more are stored once: the record with the smallest page_id is the
response, the others are revisit records that refer to it.

Defined cases: null html is the empty payload; of repeated rows with the smallest page_id each is a response; a null
page_id is larger than all others, and where all are null all are responses; a null url stays null; bytes of
any kind may be in a payload, also gzip magic or whole records; urls, headers and payloads may be of any length, and a
record is held whole, one at a time; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, fresh_path, join_named, open_store, partitions, table, trimmed

LEAST_BYTES = 0
LEVEL = 4
RANGE_BYTES = 4 << 20
READ_BYTES = 1 << 20
#: Most ranges that one reading task takes, once there are more than a few for each shuffle partition.
RANGES_A_TASK = 16
#: First responses of repeated payloads that are broadcast to the writer; of more only those of the most frequent payloads are.
BROADCAST_ROWS = 200_000
DATE = "1970-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, unique: str, date: str = DATE) -> bytes:
    """One record before compression; a revisit record has the HTTP header but no payload."""
    name = lambda i: f"<urn:page:{i}>" if i is not None else f"<urn:page:none:{unique}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target or 'urn:page:no-url'}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a record for each page; returns path, bytes and records of each archive."""
    bounded(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    marked = plain.withColumn("digest", F.sha1("payload"))
    first = marked.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = cut(first.where("n > 1 AND first_id IS NOT NULL"))
    joined = join_named(marked, first, "digest", "n", BROADCAST_ROWS).select("page_id", "url", "payload", "digest", "first_id")
    fs, top = open_store(folder)
    fs.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, top = open_store(folder)
        name = f"part-{task.partitionId():06d}.warc.gz"
        draft, n, size = f"{top}/.{name}.{task.taskAttemptId()}", 0, 0
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                for page_id, url, body, digest, first_id in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    kind = "revisit" if first_id is not None and page_id != first_id else "response"
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = pack.compress(record(kind, page_id, url, body, base32(digest), first_id, f"{task.partitionId()}-{n}")) + pack.flush()
                    out.write(member)
                    n, size = n + 1, size + len(member)
        if n:
            fs.move(draft, f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})
        else:
            fs.delete_file(draft)

    return cut(joined.mapInArrow(trimmed(run), "path string, bytes long, records long"))


class RangeReader:
    """Records of an archive that start in [start, end)."""

    def __init__(self, source, size: int, start: int, end: int):
        self.source, self.size, self.start, self.end = source, size, start, min(end, size)
        self.base, self.buffer = start, b""

    def _at(self, offset: int, n: int) -> bytes:
        """Up to n bytes from offset on."""
        n = min(n, self.size - offset)
        if n <= 0:
            return b""
        if offset < self.base or offset + n > self.base + len(self.buffer):
            self.base, self.buffer = offset, self.source.read_at(min(max(n, READ_BYTES), self.size - offset), offset)
        return self.buffer[offset - self.base : offset - self.base + n]

    def _member(self, offset: int) -> tuple[bytes, int] | None:
        """The inflated record at offset and its end, or None if no record starts there."""
        inflate, out, at, checked = zlib.decompressobj(31), bytearray(), offset, False
        while not inflate.eof:
            part = self._at(at, 1 << 16)
            if not part:
                return None
            try:
                out += inflate.decompress(part)
            except zlib.error:
                return None
            at += len(part)
            if not checked:
                if not b"WARC/1.".startswith(out[:7]):
                    return None
                # once a record has begun, its header may be as long as its url
                checked = len(out) >= 7
        end = at - len(inflate.unused_data)
        return (bytes(out), end) if parse(bytes(out)) is not None else None

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        at = self.start
        while at < self.end:
            window = self._at(at, READ_BYTES)
            k = window.find(MAGIC)
            if k < 0:
                # the magic may straddle two windows
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            at += k
            if at >= self.end:
                return
            found = self._member(at)
            if found is None:
                at += 1
                continue
            yield parse(found[0])
            at = found[1]


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of a record, or None if it isn't one."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/1."):
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = dict(x.split(": ", 1) for x in lines if ": " in x)
    length = fields.get("Content-Length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return fields, rest[: int(length)]


RECORDS = "page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, intact boolean, payload binary"


def _id(field: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", field or "")
    return int(m[1]) if m else None


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """All records of archives (path, bytes), range by range; intact tells that the payload has the digest of its header.

    Ranges are dealt to as many tasks as there are ranges, up to a few for each shuffle partition, or one for each
    ``RANGES_A_TASK`` ranges; the number is stated, so that adaptive execution doesn't gather small rows of ranges in one task.
    """
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("begin")
    ranges = archives.where("bytes > 0").select("path", "bytes", begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RECORDS.split(", ")])

        for batch in batches:
            for path, size, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                fs, name = open_store(path)
                with fs.open_input_file(name) as source:
                    for fields, block in RangeReader(source, size, start, start + range_bytes):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        m = re.search(rb"(?m)^Content-Length: (\d+)", http)
                        n = int(m[1]) if m else len(payload)
                        url = fields.get("WARC-Target-URI")
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if fields["WARC-Type"] == "response" else digest
                        n = len(payload) if fields["WARC-Type"] == "response" else n
                        rows.append((_id(fields["WARC-Record-ID"]), fields["WARC-Type"], None if url == "urn:page:no-url" else url, _id(fields.get("WARC-Refers-To")), n, own, own == digest, payload if payloads else None))
                        held += len(payload)
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield flush()
                            held = 0
        if rows:
            yield flush()

    n = archives.where("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    tasks = min(int(n), max(4 * partitions(archives.sparkSession), -(-int(n) // RANGES_A_TASK)))
    return ranges.repartition(tasks).mapInArrow(trimmed(run), RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
