"""WARC archives: one gzip member per record, written by page and read back in sequence.

The writer gives each task's pages to one archive. Records with equal payloads of at least ``MIN_REVISIT``
bytes share one response, that of the least page_id; the others are revisits that name it and carry
HTTP headers only. The reader inflates a member at a time from fixed chunks, frames each block by its
Content-Length and verifies block and payload digests while it passes, so a record of any size needs
little memory.

Defined results: a null payload is an empty one and always a response; a null page_id is written and read
back as null, never referred to, and alone in its group is a response; rows that repeat the least page_id
of a group are all responses; a null url becomes an empty target; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm._io import new_folder, written
from flightloom.llm._text import tidy

MIN_REVISIT = 100
CHUNK = 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BadRecord(ValueError):
    """A record that breaks the format or fails a digest."""


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One gzip member: a response, or a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Stream:
    """Bytes of one gzip member after another from a file."""

    def __init__(self, source):
        self.source, self.raw, self.member, self.ready = source, b"", None, b""

    def next_member(self) -> bool:
        """Begins the next member; false at the end of the file."""
        if not self.raw:
            self.raw = self.source.read(CHUNK)
        self.member, self.ready = zlib.decompressobj(31), b""
        return bool(self.raw)

    def read(self, limit: int = CHUNK) -> bytes:
        """Some bytes of this member, at most limit; none at its end."""
        while not self.ready:
            if self.member.eof:
                self.raw = self.member.unused_data or self.raw
                return b""
            pending = self.member.unconsumed_tail or self.raw or self.source.read(CHUNK)
            if not pending:
                raise BadRecord("the archive ends within a record")
            self.raw = b""
            self.ready = self.member.decompress(pending, CHUNK)
        out, self.ready = self.ready[:limit], self.ready[limit:]
        return out

    def back(self, data: bytes) -> None:
        self.ready = data + self.ready


def _head(stream: _Stream) -> list[str]:
    data = b""
    while b"\r\n\r\n" not in data:
        more = stream.read()
        if not more:
            raise BadRecord("a header without end")
        data += more
    head, _, rest = data.partition(b"\r\n\r\n")
    stream.back(rest)
    return head.decode("utf-8").split("\r\n")


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def records(source) -> Iterator[dict]:
    """Every record of an archive in order, verified; source: anything with read(n)."""
    stream = _Stream(source)
    while stream.next_member():
        lines = _head(stream)
        if not lines[0].startswith("WARC/"):
            raise BadRecord(lines[0][:40])
        head = _fields(lines[1:])
        left, block, payload = int(head["content-length"]), hashlib.sha256(), hashlib.sha256()
        held, body, stated, start = b"", 0, None, b""
        while left:
            data = stream.read(left)
            if not data:
                raise BadRecord("a block shorter than its Content-Length")
            left -= len(data)
            block.update(data)
            if stated is None:
                held += data
                start, gap, data = held.partition(b"\r\n\r\n")
                if not gap:
                    continue
                stated = int(_fields(start.decode("utf-8").split("\r\n")[1:])["content-length"])
            payload.update(data)
            body += len(data)
        tail = b""
        while more := stream.read():
            tail += more
        if tail != b"\r\n\r\n":
            raise BadRecord("a record without its closing lines")
        if head["warc-block-digest"] != f"sha256:{block.hexdigest()}":
            raise BadRecord("block digest")
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and (digest != payload.hexdigest() or body != stated):
            raise BadRecord("payload digest")
        yield {"page_id": _page(head["warc-record-id"]), "payload_bytes": stated, "payload_digest": digest, "record_type": kind, "refers_to": _page(head["warc-refers-to"]) if kind == "revisit" else None, "url": head["warc-target-uri"]}


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to (null: response).

    The verdict is found on page_id and digest alone. Pages then meet the revisits on page_id and digest, so no digest
    is hot where pages move, and nothing but pages moves where there are few revisits.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(body.cast("binary"), 256).alias("digest"))
    large = named.where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes).select("page_id", "digest")
    shared = large.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1").select("digest", "least"), "shared")
    revisits = large.join(shared, "digest").where("least is not null and (page_id is null or page_id > least)").distinct()
    revisits = written(revisits.select("digest", "page_id", "least"), "revisits").toDF("d", "p", "refers_to")
    same = (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p"))
    return named.join(revisits, same, "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes one archive per task; returns path and records of each. A task run again leaves no half file."""
    folder = folder or new_folder(pages.sparkSession, "warc")

    def save(batches):
        system, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        name, out, n = uuid.uuid4().hex, None, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/_part-{name}", compression=None)
                out.write(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to))
                n += 1
        if out is not None:
            out.close()
            system.move(f"{root}/_part-{name}", f"{root}/{name}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([n], pa.int64())], ["path", "records"])

    saved = with_revisits(pages).mapInArrow(tidy(save), "path string, records long")
    return written(saved, "archives").withColumn("folder", F.lit(folder))


def read_archives(archives: DataFrame, files: int | None = None) -> DataFrame:
    """A row for each record of the archives named by (folder, path); as many tasks as archives unless files is given."""
    files = files or max(1, archives.count())

    def load(batches):
        keys = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for folder, path in zip(*(c.to_pylist() for c in batch.columns)):
                system, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
                rows = []
                with system.open_input_stream(f"{root}/{path}", compression=None) as source:
                    for row in records(source):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(keys, kinds)], keys)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(keys, kinds)], keys)

    return archives.select("folder", "path").repartition(files).mapInArrow(tidy(load), SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages))
