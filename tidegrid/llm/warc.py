"""WARC archives: written as whole-file gzip streams, normalised to one member per record with an offset index, read back.

Each task writes one archive as a single gzip stream, as many crawlers do. The normaliser inflates such a stream once, in bounded
pieces, rewrites every record as a gzip member of its own and writes a sidecar index with the place of each member, so that a
reader can fetch any record alone. Files go to the shared scratch folder, under names that are new for every attempt; only the
files of finished tasks are named in the tables that later stages read, so lost executors leave nothing but unused files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.tables import batch_of, only, stored
from tidegrid.session import scratch_path

#: Payloads of at least so many bytes are written once; up to so many repeated payloads are looked up in a broadcast table.
LEAST_SHARED = 0
BROADCAST_ROWS = 500_000
BLOCK_BYTES = 1 << 18
LEVEL = 4

# Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF, GZIP = b"\r\n", 16 + zlib.MAX_WBITS
URN = "urn:x-page:"

WRITTEN = "archive string, records long"
NORMALISED = "archive string, sidecar string, records long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace(":", "://", 1))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP head alone, which states the payload's length."""
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{'none' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True)
            for page_id, url, html, refers_to in rows:
                if out is None:
                    filesystem, name = _filesystem(path)
                    filesystem.create_dir(name.rpartition("/")[0], recursive=True)
                    out = filesystem.open_output_stream(name, compression=None)
                out.write(packer.compress(record(page_id, url, (html or "").encode(), refers_to)))
                count += 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield batch_of(archive=pa.array([path]), records=pa.array([count], pa.int64()))

    return run


def _inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, in pieces of bounded size."""
    unpacker = zlib.decompressobj(GZIP)
    while packed := source.read(BLOCK_BYTES):
        while packed:
            yield unpacker.decompress(packed, BLOCK_BYTES)
            packed = unpacker.unconsumed_tail
            if unpacker.eof:
                packed, unpacker = unpacker.unused_data, zlib.decompressobj(GZIP)


class _Stream:
    """Reads records off a run of inflated pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def head(self) -> bytes | None:
        """Up to and with the empty line that ends a record's header; None at the end."""
        at = -1
        while (at := self.held.find(CRLF + CRLF)) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record header")
                return None
        head, self.held = self.held[: at + 4], self.held[at + 4 :]
        return head

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self.more():
                raise ValueError("the archive ends inside a record")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            if part:
                yield part


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    lines = head.decode().split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines) if name}


def normalise(archive: str) -> tuple[str, str, int]:
    """Rewrites a gzip archive with a member per record; gives the new archive, its sidecar and the number of records.

    The sidecar has a line per record: offset and length of the member, record type and id, parted by tabs.
    """
    base = f"{archive.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
    target, sidecar = f"{base}.members.warc.gz", f"{base}.members.idx"
    filesystem, name = _filesystem(archive)
    offset = count = 0
    with (
        filesystem.open_input_stream(name, compression=None) as source,
        filesystem.open_output_stream(_filesystem(target)[1], compression=None) as out,
        filesystem.open_output_stream(_filesystem(sidecar)[1], compression=None) as index,
    ):
        stream = _Stream(_inflated(source))
        while (head := stream.head()) is not None:
            about = fields(head)
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
            start = offset
            for part in chain([head], stream.take(int(about["content-length"]) + 4)):
                packed = packer.compress(part)
                out.write(packed)
                offset += len(packed)
            packed = packer.flush()
            out.write(packed)
            offset += len(packed)
            index.write(f"{start}\t{offset - start}\t{about['warc-type']}\t{about['warc-record-id']}\n".encode())
            count += 1
    return target, sidecar, count


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            target, sidecar, count = normalise(archive)
            yield batch_of(archive=pa.array([target]), sidecar=pa.array([sidecar]), records=pa.array([count], pa.int64()))


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix(URN)
    return int(name) if name not in ("", "none") else None


def read_member(packed: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A record's page, full payload length, digest, type and the page it refers to; a response's digest is checked."""
    stream = zlib.decompress(packed, GZIP)
    at = stream.index(CRLF + CRLF) + 4
    about = fields(stream[:at])
    block = stream[at : at + int(about["content-length"])]
    http = block.index(CRLF + CRLF) + 4
    length = int(fields(block[:http])["content-length"])
    digest = about["warc-payload-digest"].removeprefix("sha1:")
    if about["warc-type"] == "response" and (len(block) - http != length or digest_of(block[http:]) != digest):
        raise ValueError(f"{about['warc-record-id']}: the payload is not what its header states")
    return _page(about["warc-record-id"]), length, digest, about["warc-type"], _page(about.get("warc-refers-to"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
            filesystem, name = _filesystem(archive)
            rows: list[tuple] = []
            with (
                filesystem.open_input_stream(_filesystem(sidecar)[1], compression=None) as index,
                filesystem.open_input_file(name) as source,
            ):
                # lines are a few dozen bytes a record; members are fetched one by one
                for line in index.read().decode().splitlines():
                    offset, length, _, _ = line.split("\t")
                    rows.append(read_member(source.read_at(int(length), int(offset))))
                    if len(rows) >= 5000:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    page, length, digest, kind, refers = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return batch_of(
        page_id=pa.array(page, pa.int64()),
        payload_bytes=pa.array(length, pa.int64()),
        payload_digest=pa.array(digest, pa.string()),
        record_type=pa.array(kind, pa.string()),
        refers_to=pa.array(refers, pa.int64()),
    )


def with_references(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """``page_id, url, html, refers_to``: of pages with equal payloads of at least ``least_shared`` bytes the largest id has no
    reference, the others refer to it. Texts stay where they are; only digests are shuffled."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = only(pages, ["page_id", "url", "html"]).withColumn("page_id", F.col("page_id").cast("long"))
    keyed = keyed.withColumn("key", F.sha2(payload, 256)).withColumn("long_enough", F.octet_length(payload) >= least_shared)
    groups = keyed.filter("long_enough").groupBy("key").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    several = stored(groups.filter("n > 1 AND kept IS NOT NULL").select("key", "kept"), "copies")
    few = several.count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(several) if few else several, "key", "left")
    other = F.col("long_enough") & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_shared: int = LEAST_SHARED) -> DataFrame:
    """One monolithic archive per partition below ``folder``; ``archive, records`` of each."""
    return stored(with_references(pages, least_shared).mapInArrow(_write(folder), WRITTEN), "archives")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """``archive, sidecar, records`` of the normalised copies, one task per archive."""
    dealt = archives.select("archive").repartition(max(1, archives.count()))
    return stored(dealt.mapInArrow(_normalise, NORMALISED), "normalised")


def read_archives(normalised: DataFrame) -> DataFrame:
    """The records, fetched by their index: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    return normalised.select("archive", "sidecar").repartition(max(1, normalised.count())).mapInArrow(_read, READ)


def archived_pages(pages: DataFrame, folder: str | None = None, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Writes, normalises and reads back the archives of ``page_id, url, html``: one row per page.

    A null html is an empty payload, a null url has no target line. Rows that repeat the largest id with its payload are responses
    each. A page without an id refers to the kept one if its payload has one, else it is a response. An empty table gives an
    empty table; other columns are ignored.
    """
    place = folder or scratch_path(pages.sparkSession, "warc")
    return read_archives(normalise_archives(write_archives(pages, place, least_shared)))
