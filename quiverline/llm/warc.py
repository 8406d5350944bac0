"""WARC archives: writing, normalising and reading.

An archive that is one gzip stream over the whole file can only be read from
its start. :func:`normalise` inflates such a stream once, rewrites every record
as a gzip member of its own and writes a sidecar index (``offset length`` of
each member, a line per record), so that any record can be read alone.

Files go through ``pyarrow.fs`` into a folder that all executors share. A task
writes under a name of its own; only names that successful tasks report are used,
so a task that is run again leaves at most an unused file.

Edge cases: null payloads are empty; payloads of fewer than ``LEAST`` bytes are
never replaced by a revisit; repeated rows of one page are all responses; line
breaks in an address are percent-encoded; an empty table makes no archive; an
archive may hold several members, one stream, or both.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from quiverline.llm.common import persist, raw_texts, shared_dir

#: Payloads of fewer bytes are always written out.
LEAST = 100
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
LEVEL = 3

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(rb"<urn:page:(.*)>")


def _header(name: bytes, value: bytes) -> bytes:
    return name + b": " + value.replace(b"\r", b"%0D").replace(b"\n", b"%0A") + b"\r\n"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """A response record, or a revisit of the page ``refers_to`` that holds only the HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = VERSION + b"\r\n" + _header(b"WARC-Type", b"response" if refers_to is None else b"revisit") + _header(b"WARC-Record-ID", b"<urn:page:%s>" % ("" if page_id is None else str(page_id)).encode())
    head += _header(b"WARC-Date", b"1970-01-01T00:00:00Z") + _header(b"WARC-Target-URI", (url or "").encode("utf-8", "replace")) + _header(b"WARC-Payload-Digest", b"sha256:" + digest.encode())
    if refers_to is not None:
        head += _header(b"WARC-Profile", PROFILE) + _header(b"WARC-Refers-To", b"<urn:page:%s>" % str(refers_to).encode())
    return head + b"Content-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def inflate(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in pieces of bounded size."""
    z = zlib.decompressobj(31)
    for part in parts:
        while part:
            if out := z.decompress(part, CHUNK):
                yield out
            part = z.unconsumed_tail
            if z.eof:
                part, z = z.unused_data, zlib.decompressobj(31)
    if rest := z.flush():
        yield rest


def records(parts: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of WARC bytes, one at a time."""
    held = bytearray()
    need = 0  # bytes of the record that is being read, once its header is known
    for part in parts:
        held += part
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = re.search(rb"(?im)^content-length:\s*(\d+)", held[:end])
                need = end + 4 + int(size[1] if size else 0) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields[b"content-length"])]


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _read(f) -> Iterator[bytes]:
    while part := f.read(CHUNK):
        yield part


def normalise(store: fs.FileSystem, source: str, to: str) -> int:
    """Rewrite the archive ``source`` as ``to`` with a member for each record, and its index ``to`` + ``.idx``."""
    at = n = 0
    with store.open_input_stream(source, compression=None) as f, store.open_output_stream(to, compression=None) as out, store.open_output_stream(f"{to}.idx") as index:
        for data in records(inflate(_read(f))):
            out.write(packed := member(data))
            index.write(b"%d %d\n" % (at, len(packed)))
            at += len(packed)
            n += 1
    return n


def read_members(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """Records of a normalised archive, each read by its index entry."""
    with store.open_input_stream(f"{path}.idx") as f:
        entries = [tuple(map(int, x.split())) for x in f.read().splitlines()]
    with store.open_input_file(path) as f:
        for offset, size in entries:
            yield zlib.decompress(f.read_at(size, offset), 31)


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``id``, ``refers_to`` of the pages whose payload a page with a smaller id has as well.

    Digests are grouped with partial aggregation, and copies find their first by
    a join that can split a hot digest.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    digests = pages.select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest")).where(F.octet_length(payload) >= LEAST)
    first = digests.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return digests.join(first, "digest").where("id > refers_to").select("id", "refers_to").distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write monolithic archives under ``folder``; a stored table of their paths.

    Pages that share their id must share their payload for a revisit to be right.
    """
    later = persist(revisits(pages, id_col, payload_col), "warc-revisits")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    rows = rows.join(later, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = z = path = None
        size, paths = 0, []

        def close():
            nonlocal out
            if out is not None:
                out.write(z.flush())
                out.close()
                paths.append(path)
                out = None

        for batch in batches:
            for page, url, payload, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if out is None:
                    store, at = fs.FileSystem.from_uri(folder)
                    path = f"{at}/{uuid.uuid4().hex}"
                    out, z, size = store.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                data = record(page, url, payload, hashlib.sha256(payload).hexdigest(), first)
                out.write(z.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    return persist(rows.mapInArrow(run, "path string"), "warc-archives")


def normalise_all(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive, remove the source; a stored table of the new paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            done = []
            for source in batch.column(0).to_pylist():
                to = f"{source}-{uuid.uuid4().hex[:8]}.warc.gz"
                normalise(store, source, to)
                done.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    done = persist(archives.repartition(spread(archives)).mapInArrow(run, "path string"), "warc-normal")
    store, _ = fs.FileSystem.from_uri(folder)
    for r in archives.toLocalIterator():  # a name for each archive, so few
        store.delete_file(r["path"])
    return done


def spread(archives: DataFrame) -> int:
    """Tasks for work on whole archives: one each, up to a bound."""
    return max(1, min(archives.count(), 10_000))


READ = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean"


def read(archives: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives. ``intact``: the stored payload has the digest that its header states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in READ.split(", ")]
        schema = pa.schema([pa.field(n, {"long": pa.int64(), "boolean": pa.bool_()}.get(x.split()[1], pa.string())) for n, x in zip(names, READ.split(", "), strict=True)])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for data in read_members(store, path):
                    head, block = parse(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = head[b"warc-type"].decode(), head[b"warc-payload-digest"].decode().removeprefix("sha256:")
                    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                    page = _ID.fullmatch(head[b"warc-record-id"])[1].decode()
                    first = _ID.fullmatch(head[b"warc-refers-to"])[1].decode() if kind == "revisit" else None
                    intact = kind == "revisit" or len(payload) == size and hashlib.sha256(payload).hexdigest() == digest
                    rows.append((page or None, head[b"warc-target-uri"].decode(), size, digest, kind, first, intact))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.repartition(spread(archives)).mapInArrow(run, READ)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as monolithic archives, normalise them, and read the records back."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(normalise_all(write(pages, folder), folder), folder)
