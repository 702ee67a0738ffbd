"""WARC archives of web pages, and their payloads as a chunked record table.

Writing: payloads are compared by their SHA-1 and size. Of equal payloads the record with the least id
is the response, the others are revisits that refer to it and carry no payload. Every task writes its
records to archives of its own in the shared store (gzip, one member a record), and returns a
manifest; only archives of tasks that ended well are in the manifest, whatever executors are lost.

Reading: a task streams an archive and yields rows (record, chunk number, bytes, running SHA-1), so a
payload of any size passes in pieces of ``CHUNK`` bytes. The last chunk of a record has the payload's
size and digest, so no rows need to be brought together.

Shuffles: ids and digests only (a partial aggregate, then a join that broadcasts hot digests). The
revisits come back to the pages by a broadcast of up to ``BROADCAST_ROWS`` rows, else by a join.

Defined cases: null html is an empty payload; a null url has no target; rows without id are written
after their payload's first id, or as responses where there is none, and read back with a null id;
rows repeated with the same id are records of the same type; an empty table gives no archives and an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import as_long, batch, bounded, look_up, saved, shared_dir, small

CHUNK = 1 << 20
ARCHIVE_BYTES = 1 << 30
BROADCAST_ROWS = 1_000_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(id_: int | None) -> str:
    return f"<urn:page:{'none' if id_ is None else id_}>"


def id_of(record: str) -> int | None:
    tail = record.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def header(id_: int | None, url: str | None, size: int, digest: str, first: int | None) -> bytes:
    """The header of a record and of the HTTP message in it; ``first``: the record it revisits, if any."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(id_)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if first is None else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(folder)
        task, part = TaskContext.get(), 0
        out, path, records = None, "", 0
        for rows in batches:
            payloads = rows.column(2).cast(pa.binary())
            for k in range(rows.num_rows):
                if out is None:
                    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{part}.warc.gz"
                    store.create_dir(root, recursive=True)
                    out, records, part = store.open_output_stream(path, compression=None), 0, part + 1
                id_, url, first = (rows.column(c)[k].as_py() for c in (0, 1, 3))
                buffer = payloads[k].as_buffer()
                payload = memoryview(buffer) if buffer is not None else memoryview(b"")
                head = header(id_, url, len(payload), base32_sha1(hashlib.sha1(payload).digest()), first)
                gzip = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(gzip.compress(head))
                for a in range(0, len(payload) if first is None else 0, CHUNK):
                    out.write(gzip.compress(payload[a : a + CHUNK]))
                out.write(gzip.compress(b"\r\n\r\n") + gzip.flush())
                records += 1
                if out.tell() >= ARCHIVE_BYTES:
                    size = out.tell()
                    out.close()
                    yield batch(_MANIFEST, [path], [records], [size])
                    out = None
        if out is not None:
            size = out.tell()
            out.close()
            yield batch(_MANIFEST, [path], [records], [size])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", level: int = 1) -> DataFrame:
    """Writes the pages as archives in the shared store; returns the manifest (path, records, bytes)."""
    html = F.coalesce(F.col(f"`{payload_column}`").cast("string"), F.lit(""))
    rows = bounded(pages).select(as_long(pages, id_column).alias("id"), F.col(f"`{url_column}`").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("size", F.octet_length("html"))
    keys = rows.select("id", "digest", "size")
    first = keys.groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    later = look_up(keys, saved(first, "equal-payloads"), ["digest", "size"], "n").where("id is null or id <> first").select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "first").distinct()
    later = saved(later, "revisits")
    later = F.broadcast(later) if small(later, BROADCAST_ROWS) else later
    rows = rows.join(later, F.col("id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    folder = folder or shared_dir(pages.sparkSession, "warc")
    written = rows.select("id", "url", "html", "first").mapInArrow(writer(folder, level), "path string, records long, bytes long")
    return saved(written, "manifest").withColumn("store", F.lit(folder))


class Stream:
    """The decompressed bytes of a gzip stream of many members, read in bounded pieces."""

    def __init__(self, raw):
        self.raw, self.buffer, self.gzip, self.rest = raw, bytearray(), zlib.decompressobj(31), b""

    def fill(self) -> bool:
        """At most CHUNK more bytes; False at the end."""
        while True:
            data = self.rest or self.raw.read(1 << 16)
            if not data:
                return False
            if self.gzip.eof:
                self.gzip = zlib.decompressobj(31)
            out = self.gzip.decompress(data, CHUNK)
            self.rest = self.gzip.unused_data if self.gzip.eof else self.gzip.unconsumed_tail
            if out:
                self.buffer += out
                return True

    def take(self, most: int) -> bytes:
        if not self.buffer:
            self.fill()
        out = bytes(self.buffer[:most])
        del self.buffer[:most]
        return out

    def head(self) -> tuple[str, dict[str, str]] | None:
        """A first line and the fields up to an empty line; None at the end."""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                return None
        first, *lines = self.buffer[:end].decode("utf-8").split("\r\n")
        del self.buffer[: end + 4]
        return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


_CHUNKS = pa.schema(
    [("record", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("type", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("declared", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("data", pa.binary())]
)
CHUNKS = "record string, chunk long, last boolean, type string, refers_to string, uri string, declared string, payload_bytes long, digest string, data binary"


def chunks_of(stream: Stream, chunk: int, payload: bool) -> Iterator[tuple]:
    """The chunk rows of an archive. ``payload_bytes`` and ``digest`` are those up to the row; in the single row
    of a revisit, those of the payload it stands for, as its header has them."""
    while (warc := stream.head()) is not None:
        fields = warc[1]
        declared = fields.get("warc-payload-digest", "").partition(":")[2]
        http = stream.head()[1]
        size = int(http.get("content-length", 0))
        own = (fields["warc-record-id"],)
        what = (fields["warc-type"], fields.get("warc-refers-to"), fields.get("warc-target-uri"), declared)
        if fields["warc-type"] == "revisit":
            yield (*own, 0, True, *what, size, declared, b"" if payload else None)
        else:
            sha, seen, number = hashlib.sha1(), 0, 0
            while True:
                piece = bytearray()
                while len(piece) < min(chunk, size - seen):
                    got = stream.take(min(chunk, size - seen) - len(piece))
                    if not got:
                        raise ValueError(f"{own[0]}: the archive ends within a payload")
                    piece += got
                seen += len(piece)
                sha.update(piece)
                yield (*own, number, seen == size, *what, seen, base32_sha1(sha.digest()), bytes(piece) if payload else None)
                number += 1
                if seen == size:
                    break
        while len(stream.buffer) < 4 and stream.fill():
            pass
        del stream.buffer[:4]  # the line feeds that end a record


def reader(chunk: int, payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for rows in batches:
            for path, store in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                with FileSystem.from_uri(store)[0].open_input_stream(path, compression=None) as raw:
                    held, size = [], 0
                    for row in chunks_of(Stream(raw), chunk, payload):
                        held.append(row)
                        size += 500 + len(row[-1] or b"")
                        if size > 4 * CHUNK:
                            yield batch(_CHUNKS, *zip(*held, strict=True))
                            held, size = [], 0
                    if held:
                        yield batch(_CHUNKS, *zip(*held, strict=True))

    return run


def read_chunks(manifest: DataFrame, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """The archives of a manifest as rows (record, chunk, last, type, refers_to, uri, declared, payload_bytes,
    digest, data). Without ``payload`` the bytes are read and digested, but not returned."""
    archives = manifest.select("path", "store")
    archives = archives.repartition(max(1, archives.count()))
    return archives.mapInArrow(reader(chunk, payload), CHUNKS)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes the pages, reads the archives back: (page_id, payload_bytes, payload_digest, record_type,
    refers_to, url). A payload whose bytes don't have the digest in its header is an error."""
    chunks = read_chunks(write_archives(pages, **columns), payload=False).where("last")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, ':(-?[0-9]+)>$', 1) as long)")
    digest = F.when(F.col("digest") == F.col("declared"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs: "), "record")))
    return chunks.select(number("record").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), F.col("uri").alias("url"))
