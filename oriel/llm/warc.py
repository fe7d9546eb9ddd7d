"""WARC archives: writing, normalising whole-file gzip streams, and reading by a sidecar offset index."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import file_system, prepare, text_or_empty
from oriel.session import materialise, scratch

#: Payloads of at least so many bytes are stored once.
LEAST_DUPLICATE = 1000
#: Parts that a payload with very many copies is dealt to.
SALTS = 64
CHUNK = 1 << 20


def record(kind: str, page_id: int | None, uri: str | None, digest: str, length: int, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. The id is a hash of what the record says, so reruns write the same bytes."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{uri}|{digest}|{kind}|{refers_to}")
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {length}",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_exactly(stream: io.BufferedIOBase, n: int) -> bytes:
    out = stream.read(n)
    if len(out) < n:
        raise ValueError("the archive is cut short within a record")
    return out


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers with lower-case names, header bytes, block) of each record of an inflated stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {line[:40]!r}")
        head, names = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            names[name.strip().lower()] = value.strip()
        if not line or "content-length" not in names:
            raise ValueError("the archive is cut short within a record's header")
        head.append(line)
        yield names, b"".join(head), read_exactly(stream, int(names["content-length"]))


class Inflated(io.RawIOBase):
    """The inflated bytes of a gzip file of one or more members, read in chunks."""

    def __init__(self, stream) -> None:
        self.stream, self.coder, self.rest, self.within = stream, zlib.decompressobj(31), b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.coder.eof:
                self.rest = self.coder.unused_data + self.rest
                self.coder = zlib.decompressobj(31)
            if not self.rest:
                self.rest = self.stream.read(CHUNK)
            if not self.rest:
                if self.within:
                    raise ValueError("the archive is cut short within a gzip member")
                return 0
            out = self.coder.decompress(self.rest, len(buffer))
            self.within = not self.coder.eof
            self.rest = self.coder.unconsumed_tail
            if self.coder.eof:
                self.rest = self.coder.unused_data
                self.coder = zlib.decompressobj(31)
            if out:
                buffer[: len(out)] = out
                return len(out)


def member(raw: bytes, level: int = 6) -> bytes:
    """``raw`` as a gzip member of its own, without a time stamp."""
    coder = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = coder.compress(raw) + coder.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def normalise(source, sink) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Inflate a whole-file gzip archive once and write each record as a member: (offset, length, headers) of each.

    Takes archives that are members already, too. One record is in memory at a time.
    """
    at = 0
    for names, head, block in records(io.BufferedReader(Inflated(source), CHUNK)):
        out = member(head + block + b"\r\n\r\n")
        sink.write(out)
        yield at, len(out), names
        at += len(out)


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at an index entry."""
    raw = zlib.decompress(file.read_at(length, offset), 31)
    names, _, block = next(records(io.BytesIO(raw)))
    return names, block


def write_monolithic(pages: DataFrame, path: str, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Write archives of one gzip stream each, a record per row; returns the list of (file) of committed attempts.

    Of equal payloads of ``LEAST_DUPLICATE`` bytes or more the row with the largest key is a response and the
    others revisit it; rows with that key again are responses too. Equal payloads are counted by digest before
    anything moves, and those of very many copies are dealt to ``SALTS`` parts. Payloads travel compressed.
    Rows with null keys are written without a key; null html is an empty payload; other columns are dropped.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [(h or "").encode() for h in batch.column(2).to_pylist()]
            packed, digest, size = [zlib.compress(b, 6) for b in bodies], [hashlib.sha1(b).hexdigest() for b in bodies], [len(b) for b in bodies]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(digest, pa.string()), pa.array(size, pa.int64())], names=["k", "u", "z", "digest", "bytes"])

    # the small columns alone find equal payloads
    body = F.encode(text_or_empty("h"), "UTF-8")
    narrow = rows.select("k", F.sha1(body).alias("digest"), F.octet_length(text_or_empty("h")).alias("bytes"))
    leaders = narrow.where(F.col("bytes") >= LEAST_DUPLICATE).groupBy("digest").agg(F.max("k").alias("leader"), F.count("*").alias("copies")).where("copies > 1")
    leaders = materialise(leaders.select("digest", "leader"), "leaders").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    packed = rows.mapInArrow(pack, "k long, u string, z binary, digest string, bytes long")
    salted = packed.withColumn("salt", F.pmod(F.xxhash64("k", "u"), F.lit(SALTS)).cast("int"))
    ready = salted.join(leaders, ["digest", "salt"], "left").select("k", "u", "z", "digest", "bytes", "leader")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sink, coder = f"mono-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz", None, zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in batches:
            if sink is None and batch.num_rows:
                system, base = file_system(path)
                system.create_dir(base, recursive=True)
                sink = system.open_output_stream(f"{base}/{name}", compression=None)
            for k, u, z, digest, size, leader in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                again = leader is not None and k != leader
                sink.write(coder.compress(record("revisit" if again else "response", k, u, digest, size, b"" if again else zlib.decompress(z), leader if again else None)))
        if sink is not None:
            sink.write(coder.flush())
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return materialise(ready.mapInArrow(write, "file string"), "archives")


def normalise_files(files: DataFrame, source: str, path: str) -> DataFrame:
    """Rewrite each archive of ``source`` with a member per record; returns the sidecar index.

    Index: file, offset, length, record_type, record_id, page_id. A file is one task's work, as its stream can
    only be read from the start.
    """
    # dealt in turn from one short list of names, so that no task gets two while another has none
    spread = files.coalesce(1).repartition(max(1, files.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(path)
        system.create_dir(base, recursive=True)
        from_system, from_base = file_system(source)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new = f"{name.removesuffix('.warc.gz').replace('mono', 'warc')}-{uuid.uuid4().hex[:8]}.warc.gz"
                rows: list[tuple] = []

                def index(rows: list[tuple], new: str = new) -> pa.RecordBatch:
                    offset, length, kind, record_id, page = zip(*rows, strict=True)
                    return pa.RecordBatch.from_arrays([pa.array([new] * len(rows)), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(kind), pa.array(record_id), pa.array(page, pa.int64())], names=["file", "offset", "length", "record_type", "record_id", "page_id"])

                with from_system.open_input_stream(f"{from_base}/{name}", compression=None) as stream, system.open_output_stream(f"{base}/{new}", compression=None) as sink:
                    for offset, length, names in normalise(stream, sink):
                        page = names.get("x-page-id")
                        rows.append((offset, length, names.get("warc-type"), names.get("warc-record-id"), int(page) if page else None))
                        if len(rows) == 4096:
                            yield index(rows)
                            rows = []
                if rows:
                    yield index(rows)

    return materialise(spread.mapInArrow(run, "file string, offset long, length long, record_type string, record_id string, page_id long"), "warc-index")


def read_archives(index: DataFrame, path: str) -> DataFrame:
    """Read each record by its index entry and check it: page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(path)
        opened, file = None, None
        for batch in batches:
            out = []
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name != opened:
                    opened, file = name, system.open_input_file(f"{base}/{name}")
                names, block = read_member(file, offset, length)
                digest = base64.b32decode(names["warc-payload-digest"].removeprefix("sha1:")).hex()
                size = int(names["x-payload-length"])
                if names["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name} at {offset}: the payload doesn't have its digest")
                page, refers = names.get("x-page-id"), names.get("x-refers-to-page-id")
                out.append((int(page) if page else None, size, digest, names["warc-type"], int(refers) if refers else None))
            if out:
                page, size, digest, kind, refers = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(kind), pa.array(refers, pa.int64()), *batch.columns[:3]], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
    return index.select("file", "offset", "length").mapInArrow(run, schema)


def roundtrip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise those, and read the result back by its index."""
    path = path or scratch(pages.sparkSession, "warc")
    files = write_monolithic(pages, f"{path}/mono")
    return read_archives(normalise_files(files, f"{path}/mono", f"{path}/members"), f"{path}/members")
