"""WARC archives in Zstandard frames, written from pages and read back (operator 12).

An archive (``.warc.zst``) begins with a skippable frame that holds its dictionary; then
comes one frame for each record, so a reader needs the dictionary and one frame at a time.
Each task writes archives of at most ``ARCHIVE_BYTES`` into the shared folder, with a
dictionary trained on the first records of each, and returns their names; only names that
a committed task returned are read, so what a lost executor left behind is never seen.

Of equal payloads the page with the largest page_id is written as a response, all others
as revisits without payload. Groups of equal payloads are counted on digests alone. Where
they are few they are broadcast and no page is moved; else the largest are broadcast (at
most one group for each thousandth of all rows) and the other pages are shuffled by digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bytes, cut, cut_folder, discard, table, workers_see_us

#: Magic numbers of the format: a dictionary's skippable frame, an ordinary frame, a trained dictionary.
SKIPPABLE, FRAME, TRAINED = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: Compressed bytes at which an archive is closed.
ARCHIVE_BYTES = 256 << 20
#: What a dictionary is trained on: the first records of its archive, up to these bytes; it takes a hundredth of them at most.
SAMPLE_BYTES, DICTIONARY_BYTES, LEAST_DICTIONARY = 4 << 20, 32 << 10, 1 << 10
#: Groups of equal payloads that are broadcast: 20 bytes of digest and two numbers each, so at most about 10 MB.
MOST_GROUPS = 100_000
#: Beyond that, groups of more than one row in so many are broadcast: fewer than so many groups.
HEAVY_SHARE = 1000
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class BadArchive(ValueError):
    """An archive that breaks the format; the message names the byte where the frame begins."""


# --------------------------------------------------------------------------- records


def base32_sha1(data: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so that a revisit names a record which another task writes."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(urn: str) -> int | None:
    """The page_id in a record's name."""
    given = urn.removeprefix("<urn:page:").partition(":")[0]
    return int(given) if given else None


def safe_uri(url: str) -> str:
    """A url in one header line: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def build(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    """A whole record: version, header lines (those with a value), empty line, block, two line ends."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{name}: {value}" for name, value in headers.items() if value is not None]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None, date: str = DATE) -> bytes:
    """A response with its payload, or (if it refers to another record) a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else safe_uri(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "WARC-Profile": REVISIT if refers_to else None,
        "WARC-Refers-To": refers_to,
    }
    return build("revisit" if refers_to else "response", headers, http if refers_to else http + payload)


def info_record(date: str = DATE) -> bytes:
    """The record that an archive begins with."""
    headers = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
    return build("warcinfo", headers, b"format: WARC File Format 1.1\r\n")


def _header_lines(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name.lower() in out:
            raise BadArchive(f"bad or repeated header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


@dataclass
class Record:
    """One record, checked: its kind, headers (names in lower case), block and payload."""

    kind: str
    headers: dict[str, str]
    block: bytes
    payload: bytes = b""
    payload_bytes: int = 0
    digest: str | None = None


def parse(data: bytes) -> Record:
    """A record from a frame's bytes. What is not a single whole record with right lengths and digests is refused."""
    head, end, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not end or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadArchive("no WARC version line and header")
    headers = _header_lines(lines)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise BadArchive(f"headers missing: {', '.join(sorted(missing))}")
    size = headers["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length {size} does not fit the {len(rest) - 4} bytes of the block")
    record = Record(headers["warc-type"], headers, rest[:-4])
    _same("block", headers.get("warc-block-digest"), record.block)
    if record.kind in ("response", "revisit"):
        _parse_http(record)
    return record


def _same(what: str, claimed: str | None, data: bytes) -> None:
    if claimed is not None and claimed != f"sha1:{base32_sha1(data)}":
        raise BadArchive(f"{what} digest {claimed} does not fit")


def _parse_http(record: Record) -> None:
    head, end, payload = record.block.partition(b"\r\n\r\n")
    status, *lines = head.split(b"\r\n")
    length = _header_lines(lines).get("content-length", "")
    claimed = record.headers.get("warc-payload-digest", "")
    if not end or not status.startswith(b"HTTP/") or not length.isdigit() or not claimed.startswith("sha1:"):
        raise BadArchive("no HTTP header with a length, or no payload digest")
    record.payload, record.payload_bytes, record.digest = payload, int(length), claimed.removeprefix("sha1:")
    if record.kind == "response":
        if len(payload) != record.payload_bytes:
            raise BadArchive(f"HTTP length {length} does not fit the payload's {len(payload)} bytes")
        _same("payload", claimed, payload)
    elif payload or "warc-refers-to" not in record.headers or record.headers.get("warc-profile") != REVISIT:
        raise BadArchive("a revisit with a payload, or without profile or WARC-Refers-To")


# --------------------------------------------------------------------------- archives


def train(samples: list[bytes]) -> bytes:
    """A dictionary of a hundredth of the samples' bytes at most; empty where they are too few to train on."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 100)
    if size < LEAST_DICTIONARY:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # the trainer finds nothing in common
        return b""


@dataclass
class ArchiveWriter:
    """Writes one archive to a binary stream: first records wait for the dictionary, later ones go out at once."""

    out: object
    n_records: int = 0
    n_bytes: int = 0
    _waiting: list[bytes] = field(default_factory=list)
    _waiting_bytes: int = 0
    _frames: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.n_records += 1
        if self._frames is not None:
            self._put(self._frames.compress(record))
            return
        self._waiting.append(record)
        self._waiting_bytes += len(record)
        if self._waiting_bytes >= SAMPLE_BYTES:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def _begin(self) -> None:
        trained = train(self._waiting)
        options = {"level": LEVEL, "write_checksum": True, "write_content_size": True}
        if trained:
            shown = zstandard.ZstdCompressor(**options).compress(trained)
            self._put(struct.pack("<II", SKIPPABLE, len(shown)) + shown)
            options["dict_data"] = zstandard.ZstdCompressionDict(trained)
        self._frames = zstandard.ZstdCompressor(**options)
        for record in self._waiting:
            self._put(self._frames.compress(record))
        self._waiting = []

    def close(self) -> None:
        if self._frames is None:
            self._begin()


class _Ahead:
    """Bytes of a stream by position, read a piece at a time; what was passed is let go."""

    def __init__(self, stream, piece: int = 1 << 20):
        self.stream, self.piece, self.held, self.at, self.passed = stream, piece, b"", 0, 0

    def have(self, n: int) -> bool:
        """Whether n bytes follow; they are held then."""
        while len(self.held) - self.at < n:
            more = self.stream.read(max(self.piece, n))
            if not more:
                return False
            self.held, self.passed, self.at = self.held[self.at :] + more, self.passed + self.at, 0
        return True

    def number(self, offset: int, size: int) -> int:
        if not self.have(offset + size):
            raise BadArchive(f"cut off in the frame at byte {self.position}")
        start = self.at + offset
        return int.from_bytes(self.held[start : start + size], "little")

    def take(self, n: int) -> bytes:
        if not self.have(n):
            raise BadArchive(f"cut off in the frame at byte {self.position}")
        self.at += n
        return self.held[self.at - n : self.at]

    @property
    def position(self) -> int:
        return self.passed + self.at


def _frame_length(ahead: _Ahead) -> int:
    """Length of the frame that follows, by its header and its blocks' headers (3 bytes: last, kind, size)."""
    ahead.have(18)
    at = zstandard.frame_header_size(ahead.held[ahead.at : ahead.at + 18])
    checked = ahead.number(4, 1) & 4
    last = False
    while not last:
        block = ahead.number(at, 3)
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + (4 if checked else 0)


def _load_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary of a leading skippable frame, which holds it plain or as a Zstandard frame."""
    if content[:4] == struct.pack("<I", FRAME):
        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=64 << 20)
    if content[:4] != struct.pack("<I", TRAINED):
        raise BadArchive("the leading skippable frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content)


def read_archive(stream) -> Iterator[Record]:
    """Records of an archive in order, each from a frame of its own; memory holds one frame and its record.

    An empty stream has no records. Without a leading dictionary frame, frames are plain.
    Raises BadArchive on a frame that is cut off, has no checksum or size, names another
    dictionary, fails its checksum, or holds anything but one whole record.
    """
    ahead, known, options = _Ahead(stream), 0, {}
    if ahead.have(8) and ahead.number(0, 4) == SKIPPABLE:
        size = ahead.number(4, 4)
        ahead.take(8)
        options["dict_data"] = _load_dictionary(ahead.take(size))
        known = options["dict_data"].dict_id()
    frames = zstandard.ZstdDecompressor(**options)
    while ahead.have(1):
        begins = ahead.position
        if ahead.number(0, 4) != FRAME:
            raise BadArchive(f"no frame at byte {begins}")
        ahead.have(18)  # a header may lie across two pieces; the last frame may be shorter
        try:
            about = zstandard.get_frame_parameters(ahead.held[ahead.at : ahead.at + 18])
            if not about.has_checksum or about.content_size == zstandard.CONTENTSIZE_UNKNOWN or about.dict_id != known:
                raise BadArchive("a frame without checksum or size, or of another dictionary")
            yield parse(frames.decompress(ahead.take(_frame_length(ahead))))
        except (BadArchive, zstandard.ZstdError, UnicodeDecodeError) as e:
            raise BadArchive(f"frame at byte {begins}: {e}") from None


# --------------------------------------------------------------------------- on Spark


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path of the shared folder: local, HDFS, S3 or GCS, as pyarrow reaches it from a Python worker."""
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def with_originals(pages: DataFrame, min_bytes: int = 0, most_groups: int = MOST_GROUPS) -> DataFrame:
    """page_id, url, html, digest (SHA-1, binary), size, refers_to (page_id) and is_revisit of every page.

    Null html is empty. Equal payloads of at least ``min_bytes`` are a group; its rows with
    the largest page_id (all rows without one, if no row has one) are responses.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digest, size = F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).cast("long").alias("size")
    shown = pages.select("page_id", "url", html.alias("html"), digest, size)
    counted = shown.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last"))
    groups = cut(counted.where("n > 1"), "payload-groups")
    many, rows = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    if many <= most_groups:
        tagged = shown.join(F.broadcast(groups), "digest", "left")
    else:  # rows in groups bound the bar: fewer than HEAVY_SHARE groups pass it
        heavy = groups.where(F.col("n") > rows // HEAVY_SHARE)
        settled = shown.join(F.broadcast(heavy), "digest")
        rest = shown.join(F.broadcast(heavy), "digest", "left_anti")
        tagged = settled.unionByName(rest.join(groups, "digest", "left"))
    again = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    out = tagged.select("page_id", "url", "html", "digest", "size", F.when(again, F.col("last")).alias("refers_to"), again.alias("is_revisit"))
    out._parts = [groups]
    return out


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write rows of with_originals() as archives below ``folder``; one row of ARCHIVES for each. Lazy: write it once."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer, path = [], None, ""
        for batch in batches:
            raw, at = arrow_bytes(batch.column("html"))
            ids, urls, sizes = (batch.column(c).to_pylist() for c in ("page_id", "url", "size"))
            digests, refers, again = (batch.column(c).to_pylist() for c in ("digest", "refers_to", "is_revisit"))
            for k, page_id in enumerate(ids):
                if writer is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    fs, local = _open(path)
                    writer = ArchiveWriter(fs.open_output_stream(local))
                    writer.add(info_record(date))
                digest = base64.b32encode(digests[k]).decode()
                payload = b"" if again[k] else raw[at[k] : at[k + 1]].tobytes()
                original = record_id(refers[k], digest) if again[k] else None
                writer.add(page_record(page_id, urls[k], payload, digest, sizes[k], original, date))
                if writer.n_bytes >= archive_bytes:
                    done.append(_closed(writer, path))
                    writer = None
        if writer is not None:
            done.append(_closed(writer, path))
        columns = zip(*done) if done else ([], [], [])
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "n_records", "n_bytes"])

    workers_see_us(pages.sparkSession)
    return pages.mapInArrow(write, ARCHIVES)


def _closed(writer: ArchiveWriter, path: str) -> tuple[str, int, int]:
    writer.close()
    writer.out.close()
    return path, writer.n_records, writer.n_bytes


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """RECORDS rows of all response and revisit records of the archives named in ``path``; an archive is read by one task, a frame at a time.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, for revisits too; their
    payload is null, and so is every payload if not asked for. An archive with other than
    ``n_records`` records is refused.
    """
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed in batches:
            for path, expected in zip(listed.column("path").to_pylist(), listed.column("n_records").to_pylist()):
                rows, held, n = [], 0, 0
                fs, local = _open(path)
                with fs.open_input_stream(local) as stream:
                    for n, r in enumerate(read_archive(stream), 1):
                        if r.kind not in ("response", "revisit"):
                            continue
                        refers = page_of(r.headers["warc-refers-to"]) if r.kind == "revisit" else None
                        payload = r.payload if with_payload and r.kind == "response" else None
                        page_id, url = page_of(r.headers["warc-record-id"]), r.headers.get("warc-target-uri")
                        rows.append((page_id, url, r.payload_bytes, r.digest, r.kind, refers, payload))
                        held += len(payload or b"")
                        if len(rows) >= 1024 or held >= 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if n != expected:
                    raise BadArchive(f"{path}: {n} records instead of {expected}")
                if rows:
                    yield batch(rows)

    workers_see_us(archives.sparkSession)
    return archives.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0, most_groups: int = MOST_GROUPS, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back without payloads, an archive in each partition."""
    tagged = with_originals(pages, min_bytes, most_groups)
    archives = cut(write_archives(tagged, cut_folder(pages.sparkSession, "warc"), archive_bytes), "archives")
    discard(*tagged._parts)
    return read_archives(archives.repartition(max(1, archives.count())), with_payload=False)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives. No pages, no rows; repeated rows are records each; columns other than page_id, url and html are not read."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p),
d AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(h, 5 * k + 1, 5) AS INTEGER)) AS twenties FROM g)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((twenties[1 + k // 4] >> (5 * (3 - k % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM d
"""
