"""WARC archives with revisit resolution.

Payloads are never shuffled. Records are written where their rows are read;
only their headers travel: they meet by payload digest, the revisits are joined
to the original responses, and the verdicts of one archive file go back to the
task that rewrites this file with fresh headers.

Archive files are written under names that no other attempt uses, and count
only once a task's manifest row has been committed, so that retries and
speculative attempts leave at most unused files behind.

Defined cases
-------------
null payload      an empty payload
null page id      written without a page id; sorts after all other ids
null url          the record's own URN is the target URI
equal page ids    the record that stands first in the archives comes first
empty table       no archive file, empty results
other columns     of the input are ignored; those named below are its interface
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlake.llm.memory import releasing
from roomlake.storage import Workspace

#: An archive file ends at this many compressed bytes or records, whichever comes first.
ROLL_BYTES = 64 << 20
ROLL_RECORDS = 100_000
#: Tasks that archives are dealt to, at most; beyond, a task takes several.
TASKS = 50_000
NO_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MANIFEST = "path string, n_records long, n_bytes long"
HEADERS = (
    "path string, offset long, length long, record_id string, record_type string, page_id long, target_uri string,"
    " date string, payload_digest string, payload_bytes long, refers_to_record string, refers_to long"
)
ARROW_HEADERS = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()),
     ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_record", pa.string()), ("refers_to", pa.int64())]
)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field_safe(value: str) -> str:
    """A header value of one line: control characters and blanks percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(fields: dict[str, object], block: bytes) -> bytes:
    """One gzip member holding a WARC/1.1 record; fields that are None are left out."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(3, wbits=31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of an unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The HTTP entity of a response block; other blocks are their own payload."""
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def scan_members(stream, window: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member, reading ``window`` bytes at a time."""
    offset, pending = 0, b""
    while True:
        unpack, parts, used = zlib.decompressobj(wbits=31), [], 0
        while not unpack.eof:
            data, pending = pending or stream.read(window), b""
            if not data:
                if used:
                    raise EOFError("the archive ends within a record")
                return
            used += len(data)
            parts.append(unpack.decompress(data))
        pending = unpack.unused_data
        used -= len(pending)
        yield offset, used, b"".join(parts)
        offset += used


class _Roller:
    """Writes records to files below ``root``, beginning a new one when the last is full."""

    def __init__(self, root: str, kind: str):
        self.fs, self.base = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(self.base, recursive=True)
        self.prefix, self.scheme = f"{kind}-{TaskContext.get().partitionId():05d}", root[: len(root) - len(self.base)]
        self.out, self.done = None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"{self.base}/{self.prefix}-{uuid.uuid4().hex}.warc.gz"
            self.out, self.records, self.bytes = self.fs.open_output_stream(self.name, compression=None), 0, 0
        self.out.write(record)
        self.records, self.bytes = self.records + 1, self.bytes + len(record)
        if self.records >= ROLL_RECORDS or self.bytes >= ROLL_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.scheme + self.name, self.records, self.bytes))
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        paths, records, sizes = zip(*self.done) if self.done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["path", "n_records", "n_bytes"])


def write_archives(pages: DataFrame, root: str, *, date: str = NO_DATE) -> DataFrame:
    """One response record for each row of ``pages`` (page_id, url, payload binary); lazily returns the manifest."""

    def write(batches):
        roller = _Roller(root, "crawl")
        for batch in batches:
            for page_id, url, payload in zip(*(batch.column(k) for k in range(3))):
                page_id, url, payload = page_id.as_py(), url.as_py(), payload.as_py() or b""
                urn = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{roller.prefix}/{page_id}/{len(roller.done)}/{getattr(roller, "records", 0)}')}"
                roller.add(
                    build_record(
                        {
                            "WARC-Type": "response", "WARC-Record-ID": f"<{urn}>", "WARC-Date": date, "WARC-Target-URI": _field_safe(url) if url else urn,
                            "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "X-Payload-Length": len(payload), "X-Page-Id": page_id, "Content-Type": "application/http; msgtype=response",
                        },
                        HTTP_HEAD + payload,
                    )
                )
        yield roller.manifest()

    return pages.select("page_id", "url", "payload").mapInArrow(releasing(write), MANIFEST)


def tasks_for(manifest: DataFrame) -> int:
    """A task for each archive; said outright, as adaptive execution would put the few bytes of a manifest into one."""
    return max(1, min(manifest.count(), TASKS))


def read_headers(manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives named in ``manifest``, an archive a task.

    The digest and length of a response are taken from its payload; a header
    that says otherwise is an error. Revisits have those of their headers.
    """

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                rows = []
                with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                    for offset, length, raw in scan_members(stream):
                        rows.append({"path": path, "offset": offset, "length": length} | header_row(*parse_record(raw)))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, ARROW_HEADERS)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, ARROW_HEADERS)

    return manifest.select("path").repartition(tasks_for(manifest)).mapInArrow(releasing(read), HEADERS)


def header_row(fields: dict[str, str], block: bytes) -> dict[str, object]:
    digest, size = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, fields.get("x-payload-length")
    if fields["warc-type"] != "revisit":
        payload = payload_of(fields, block)
        if digest not in (None, found := payload_digest(payload)):
            raise ValueError(f"payload digest {digest} of {fields['warc-record-id']} doesn't hold")
        digest, size = found, len(payload)
    return {
        "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None, "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"), "payload_digest": digest, "payload_bytes": None if size is None else int(size),
        "refers_to_record": fields.get("warc-refers-to"), "refers_to": int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None,
    }


def resolve_revisits(headers: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Each header with its verdict and the response it refers to.

    Of the responses that share a digest and have ``min_bytes`` at least, the
    one of the smallest page id stays; the others become revisits of it. Revisit
    records of the input are joined to that response too; without one they keep
    what they refer to. The minimum of each digest is taken before the shuffle,
    so a digest of very many records meets as one row from each task; in the join
    it stands once against rows that adaptive execution can split.
    """
    is_response = F.col("record_type") == "response"
    shared = is_response & F.col("payload_digest").isNotNull() & (F.col("payload_bytes") >= min_bytes)
    rank = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "path", "offset", "record_id", "target_uri", "date", "payload_bytes")
    originals = headers.where(shared).groupBy("payload_digest").agg(F.min(rank).alias("first"))
    kept = (F.col("first.path") == F.col("path")) & (F.col("first.offset") == F.col("offset"))
    revisit = (F.col("record_type") == "revisit") | (shared & ~kept)
    linked = revisit & F.col("first").isNotNull()
    return headers.join(originals, "payload_digest", "left").select(
        *[c for c in headers.columns if not c.startswith("refers_to") and c != "payload_bytes"],
        F.coalesce("payload_bytes", F.when(linked, F.col("first.payload_bytes"))).alias("payload_bytes"),
        F.when(revisit, "revisit").otherwise(F.col("record_type")).alias("verdict"),
        F.when(linked, F.col("first.record_id")).otherwise(F.col("refers_to_record")).alias("refers_to_record"),
        F.when(linked, F.col("first.page_id")).otherwise(F.col("refers_to")).alias("refers_to"),
        F.when(linked, F.col("first.target_uri")).alias("refers_to_uri"),
        F.when(linked, F.col("first.date")).alias("refers_to_date"),
    )


def rewrite_archives(verdicts: DataFrame, root: str, *, tasks: int) -> DataFrame:
    """Write each source archive anew under the verdicts; lazily returns the manifest.

    The verdicts of one file are gathered in one row: ``ROLL_RECORDS`` at most.
    Files are dealt to twice as many partitions as ``tasks``, so that few share one.
    """
    per_file = verdicts.repartition(2 * tasks, "path").groupBy("path").agg(F.collect_list(F.struct("offset", "verdict", "payload_bytes", "refers_to_record", "refers_to", "refers_to_uri", "refers_to_date")).alias("plan"))

    def rewrite(batches):
        roller = _Roller(root, "dedup")
        for batch in batches:
            for k in range(batch.num_rows):
                path, plan = batch.column("path")[k].as_py(), {x["offset"]: x for x in batch.column("plan")[k].as_py()}
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                    for offset, _, raw in scan_members(stream):
                        roller.add(fresh_record(*parse_record(raw), plan[offset]))
        yield roller.manifest()

    return per_file.mapInArrow(releasing(rewrite), MANIFEST)


def fresh_record(fields: dict[str, str], block: bytes, plan: dict[str, object]) -> bytes:
    """The record under its verdict: a response as it was, or a revisit with the HTTP head only."""
    head = {
        "WARC-Type": plan["verdict"], "WARC-Record-ID": fields["warc-record-id"], "WARC-Date": fields.get("warc-date"), "WARC-Target-URI": fields.get("warc-target-uri"),
        "WARC-Payload-Digest": fields.get("warc-payload-digest"), "X-Payload-Length": plan["payload_bytes"], "X-Page-Id": fields.get("x-page-id"), "Content-Type": fields.get("content-type"),
    }
    if plan["verdict"] != "revisit":
        return build_record(head, block)
    head |= {
        "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": plan["refers_to_record"], "WARC-Refers-To-Target-URI": plan["refers_to_uri"],
        "WARC-Refers-To-Date": plan["refers_to_date"], "X-Refers-To-Page-Id": plan["refers_to"],
    }
    return build_record(head, block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n" if fields.get("content-type", "").startswith("application/http") else b"")


def deduplicate_archives(manifest: DataFrame, space: Workspace, *, min_bytes: int = 0) -> DataFrame:
    """The manifest of archives in which equal payloads stand once."""
    headers = space.save(read_headers(manifest), "headers")
    out = space.save(rewrite_archives(resolve_revisits(headers, min_bytes=min_bytes), space.path("dedup"), tasks=tasks_for(manifest)), "dedup-manifest")
    space.drop("headers")
    return out


def archive_and_deduplicate(pages: DataFrame, space: Workspace, *, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, deduplicate these, and return the headers read back from the result."""
    manifest = space.save(write_archives(pages, space.path("crawl")), "crawl-manifest")
    deduplicated = deduplicate_archives(manifest, space, min_bytes=min_bytes)
    space.drop("crawl", "crawl-manifest")
    return read_headers(deduplicated)
