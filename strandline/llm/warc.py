"""WARC archives: a writer that stores equal payloads once, and a splittable reader of gzip-compressed archives.

Each record is a gzip member of its own. A reading task gets a byte range of a file: it looks for gzip magic, takes a
candidate for a record's start only if its first bytes decompress to a WARC version line and header, and owns the
records whose members start inside its range; the last may end outside. From a record on, the next follows where its
member ends. So ranges of any size give each record exactly once.

Files are opened with pyarrow's file systems by URI. A writing task first writes under a name of its own attempt and
then moves the file in place; readers go by the written list of files, so attempts that were lost leave nothing.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.shared import fresh_path, shuffle_partitions, written

SPLIT_BYTES, READ_BYTES, FILE_BYTES, TASK_BYTES, PROBE_BYTES = 8 << 20, 1 << 20, 64 << 20, 256 << 20, 512
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = "file string, start long, record_type string, record_id string, refers_to string, target string, payload_bytes long, payload_digest string, payload binary, intact boolean"


def plan_records(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each row of ``pages`` as page_id, url, html, record_type, refers_to.

    Of rows with equal payloads (the html in UTF-8, null as empty) of at least ``min_bytes`` bytes that with the largest
    id is a response, others revisit it; smaller ones are responses, and so are rows with a null id and rows that
    repeat the largest id. Digests are counted with a map-side combine first; only those that repeat are
    joined, and a join splits skewed ones.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    large, small = rows.filter(F.octet_length("html") >= min_bytes).withColumn("digest", F.sha2("html", 256)), rows.filter(F.octet_length("html") < min_bytes)
    best = large.groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "best")
    joined = large.join(written(best, "repeated"), "digest", "left")
    other = F.col("best").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("best"))
    planned = joined.select("page_id", "url", "html", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("best")).alias("refers_to"))
    return planned.union(small.select("page_id", "url", "html", F.lit("response"), F.lit(None).cast("long")))


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _record(page_id, url, html, kind, refers_to) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = "".join(c for c in url or "urn:x-none" if c > " ")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(plan: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the planned records to gzip archives in ``folder``; their list (file, bytes, records) as a written table."""

    def write(batches):
        context, files, out, sink = TaskContext.get(), [], None, None
        system, base = _open(folder)
        system.create_dir(base, recursive=True)

        def close():
            sink.close()
            name = f"part-{context.partitionId():06d}-{len(files):04d}-{uuid.uuid4().hex[:12]}.warc.gz"
            system.move(out[0], f"{base}/{name}")
            files.append((f"{folder}/{name}", out[1], out[2]))

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    out = [f"{base}/_attempt-{context.taskAttemptId()}-{uuid.uuid4().hex}", 0, 0]
                    sink = system.open_output_stream(out[0], compression=None)
                    member = _member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + record_id(None).encode() + f"\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode())
                    sink.write(member)
                    out[1] += len(member)
                member = _member(_record(*row))
                sink.write(member)
                out[1] += len(member)
                out[2] += 1
                if out[1] >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if files:
            c = list(zip(*files))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64())], ["file", "bytes", "records"])

    return written(plan.mapInArrow(write, "file string, bytes long, records long"), "archives")


class _Bytes:
    """Bytes of a file from a place on, read as they are needed and forgotten when they lie behind."""

    def __init__(self, source, start: int):
        self.source, self.base, self.held, self.ended = source, start, b"", False
        source.seek(start)

    def upto(self, end: int) -> None:
        while not self.ended and self.base + len(self.held) < end:
            more = self.source.read(READ_BYTES)
            self.ended = not more
            self.held += more

    def forget(self, before: int) -> None:
        self.held = self.held[before - self.base :]
        self.base = before


def _looks_like_record(data: bytes) -> bool:
    """Whether a gzip member starts here whose first bytes are a WARC version and a header field."""
    try:
        first = zlib.decompressobj(31).decompress(data, 200)
    except zlib.error:
        return False
    version, _, rest = first.partition(b"\r\n")
    return version.startswith(b"WARC/") and b":" in rest.partition(b"\r\n")[0]


def _inflate(data: _Bytes, at: int) -> tuple[bytes, int]:
    """The member that starts at ``at``, and where it ends."""
    z, out, place = zlib.decompressobj(31), [], at
    while not z.eof:
        data.upto(place + 1)
        chunk = data.held[place - data.base :]
        if not chunk:
            raise EOFError("an archive ends inside a record")
        out.append(z.decompress(chunk))
        place = data.base + len(data.held) - len(z.unused_data)
    return b"".join(out), place


def parse_record(raw: bytes) -> tuple:
    """record_type, record_id, refers_to, target, payload_bytes, payload_digest (hex), payload, intact."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "0")
    if not length.isdecimal():
        return fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), None, None, None, False
    whole = len(block) >= int(length)
    block = block[: int(length)]
    kind, label = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    digest = base64.b32decode(label[5:]).hex() if label.startswith("sha1:") and len(label) == 37 else label[5:].lower() or None
    payload = size = None
    intact = True
    if "application/http" in fields.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
        size = int(said) if said.isdigit() else len(payload)
        if kind == "revisit":
            payload = None
        else:
            intact = len(payload) == size and hashlib.sha1(payload).hexdigest() == (digest or hashlib.sha1(payload).hexdigest())
            size = len(payload)
    return kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), size, digest, payload, intact and whole


def records_from(source, start: int, end: int):
    """(start, member) of each record whose member starts in [start, end); a member that is damaged or ends early gives
    (start, None), and the search goes on behind its beginning."""
    data, at = _Bytes(source, start), start
    while at < end:  # until a member begins here, then from one to the next
        data.upto(at + READ_BYTES)
        found = data.held.find(MAGIC, at - data.base)
        if found < 0:
            if data.ended:
                return
            at = data.base + len(data.held) - len(MAGIC) + 1
            data.forget(at)
            continue
        at = data.base + found
        if at >= end:
            return
        data.upto(at + PROBE_BYTES)
        if not _looks_like_record(data.held[at - data.base : at - data.base + PROBE_BYTES]):
            at += 1
            continue
        while at < end:
            data.upto(at + len(MAGIC))
            if data.held[at - data.base : at - data.base + len(MAGIC)] != MAGIC:
                break
            try:
                raw, after = _inflate(data, at)
            except (EOFError, zlib.error):
                yield at, None
                at += 1
                break
            yield at, raw
            at = after
            data.forget(at)
        if data.ended and at >= data.base + len(data.held):
            return


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each record of the ``files`` (file, bytes): where it is and what it holds. ``payload_bytes`` and
    ``payload_digest`` of a revisit are those of the full payload, which it doesn't hold; ``intact`` is whether a
    record is whole and its payload has the length and digest that it names. Of a member that is damaged or cut off there is
    only the place, not intact; one whose length is no number has its header's fields. No files, no rows."""

    def read(batches):
        for batch in batches:
            for file, start, end in zip(*(batch.column(k).to_pylist() for k in range(3))):
                system, path = _open(file)
                rows, held = [], 0
                with system.open_input_file(path) as source:
                    for at, raw in records_from(source, start, end):
                        rows.append((file, at, *(parse_record(raw) if raw is not None else (*[None] * 7, False))))
                        held += len(raw or b"")
                        if held > SPLIT_BYTES:
                            yield _table(rows)
                            rows, held = [], 0
                yield _table(rows)

    def _table(rows):
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [f.split()[0] for f in RECORD.split(", ")])

    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.filter("bytes > 0").select("file", cuts.alias("start"), "bytes").select("file", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    found = ranges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(found.n, max(shuffle_partitions(spark), found.bytes // TASK_BYTES)))
    return ranges.repartition(tasks, "file", "start").mapInArrow(read, RECORD)


def archive_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")
