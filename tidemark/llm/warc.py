"""Web archives: written, normalised to one gzip member per record with an index, read back.

Archives often arrive as one gzip stream over the whole file, which can only be read from
the start. The normaliser inflates such a stream once, in pieces, rewrites every record as a
member of its own, and writes a sidecar index with the place of every member, so that any
record can then be read alone. Nothing holds more than a piece of a record while it does so.

Archives live in the folder that all executors share and are opened through its own file
system. Every attempt of a task writes files of its own; the table of files that Spark
writes names those of the attempts that succeeded, and only they are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import clean_text, keep, slices
from tidemark.session import run_dir

#: Uncompressed bytes after which a task begins the next archive.
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 20
END = b"\r\n\r\n"
#: The record forms and names of the archive format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILES = "path string, records bigint"
RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, payload binary"
)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    value = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value and value != "none" else None


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One record. A revisit holds the reply's header lines but not its payload."""
    reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
    block = reply.encode() + END + (payload if kind == "response" else b"")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + END + block + END


def header(lines: bytes) -> dict[str, str]:
    """The fields of a header block without its version line."""
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


#: Schemes that Spark knows object stores by, and what pyarrow calls them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasb": "abfs", "wasbs": "abfss"}


def known_uri(path: str) -> str:
    """A path of Spark's as pyarrow takes it; anything without a scheme stays as it is."""
    scheme, colon, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{colon}{rest}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Where archives are read and written by pyarrow. Raises, before any work, what is wrong
    with the folder."""
    try:
        return fs.FileSystem.from_uri(known_uri(path))
    except (ValueError, OSError, NotImplementedError) as why:
        raise ValueError(
            f"archives cannot be kept in {path!r}: spark.checkpoint.dir has to name a folder that pyarrow can"
            f" open as well (a path, file:, hdfs:, s3a:, gs:, abfss:): {why}"
        ) from why


def with_types(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """``page_id, url, html, record_type, refers_to``.

    Digests alone are grouped, with a map-side step; the join back has the payloads on one
    side only, where a payload that very many pages share is a skewed key.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        clean_text(html_col).alias("html"),
    )
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = rows.filter(F.octet_length("html") >= least_bytes)
    shared = (
        large.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
        .filter("n > 1 AND first IS NOT NULL")
        .select("digest", "first")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").select(
        "page_id",
        "url",
        "html",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write records (:func:`with_types`) as archives, each one gzip stream; the table of files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        prefix = f"{base}/raw-{task.partitionId()}-{task.taskAttemptId()}"
        paths, counts, out, size = [], [], None, 0
        for batch in slices(batches, 64):
            for page_id, url, html, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    paths.append(f"{prefix}-{len(paths)}.warc.gz")
                    counts.append(0)
                    out, gzip, size = system.open_output_stream(paths[-1], compression=None), zlib.compressobj(6, wbits=31), 0
                data = record(page_id, url, html.encode(), kind, refers_to)
                out.write(gzip.compress(data))
                counts[-1] += 1
                size += len(data)
                if size >= archive_bytes:
                    out.write(gzip.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(gzip.flush())
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"]
        )

    columns = ("page_id", "url", "html", "record_type", "refers_to")
    return keep(records.select(*columns).mapInArrow(work, FILES), "archives")


class _Stream:
    """The inflated bytes of a gzip file of one or more members, a piece at a time."""

    def __init__(self, file):
        self.file, self.inflate = file, zlib.decompressobj(31)
        self.held, self.raw, self.ended = bytearray(), b"", False

    def fill(self) -> bool:
        while not self.ended:
            raw = self.raw or self.file.read(PIECE)
            self.raw = b""
            if not raw:
                self.ended = True
                if not self.inflate.eof:
                    raise ValueError("the archive ends inside a gzip member")
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            found = self.inflate.decompress(raw, PIECE)
            self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data
            if found:
                self.held += found
                return True
        return False

    def header(self) -> bytes | None:
        """Up to the next empty line; None at the end of the file."""
        start = 0
        while True:
            at = self.held.find(END, start)
            if at >= 0:
                out = bytes(self.held[:at])
                del self.held[: at + len(END)]
                return out
            start = max(0, len(self.held) - 3)
            if not self.fill():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self.fill():
                raise ValueError("the archive ends inside a record")
            out = bytes(self.held[:size])
            del self.held[: len(out)]
            size -= len(out)
            yield out


def normalise_file(path: str, target: str, system: fs.FileSystem) -> int:
    """One archive, monolithic or not, as one member per record, and its index beside it: a
    line of JSON with offset, length and header fields per record. Returns their number."""
    n, offset = 0, 0
    with (
        system.open_input_stream(path, compression=None) as source,
        system.open_output_stream(target, compression=None) as out,
        system.open_output_stream(f"{target}.idx") as index,
    ):
        stream = _Stream(source)
        while (lines := stream.header()) is not None:
            fields = header(lines)
            gzip, length = zlib.compressobj(6, wbits=31), 0
            length += out.write(gzip.compress(lines + END))
            for piece in stream.take(int(fields["content-length"]) + len(END)):
                length += out.write(gzip.compress(piece))
            length += out.write(gzip.flush())
            entry = {
                "offset": offset,
                "length": length,
                "type": fields["warc-type"],
                "id": fields["warc-record-id"],
                "url": fields.get("warc-target-uri"),
                "digest": fields.get("warc-payload-digest"),
            }
            index.write(json.dumps(entry).encode() + b"\n")
            offset += length
            n += 1
    return n


def _spread(files: DataFrame) -> DataFrame:
    """One task per archive; there are about as many as input bytes / archive size."""
    return files.repartition(max(1, files.count()), "path")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Normalise archives (a table with their ``path``) into ``folder``; the table of files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            paths, counts = [], []
            for path in batch.column(0).to_pylist():
                name = path.rpartition("/")[2].removesuffix(".warc.gz")
                paths.append(f"{base}/{name}-members-{attempt}.warc.gz")
                counts.append(normalise_file(path, paths[-1], system))
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"]
            )

    return keep(_spread(files).select("path").mapInArrow(work, FILES), "archives")


def read_member(data: bytes, payloads: bool) -> tuple:
    """``(page_id, url, type, refers_to, bytes, digest, payload)`` of one member."""
    inflated = zlib.decompress(data, wbits=31)
    lines, _, rest = inflated.partition(END)
    if not lines.startswith(VERSION.split(b"/")[0]):
        raise ValueError("no record at this place")
    fields = header(lines)
    block = rest[: int(fields["content-length"])]
    reply, _, payload = block.partition(END)
    digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "revisit":
        size, payload = int(header(reply)["content-length"]), None
    else:
        size, found = len(payload), digest32(payload)
        if digest and digest != found:
            raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
        digest = found
    url = fields.get("warc-target-uri")
    return (
        _page(fields["warc-record-id"]),
        None if url is None else unquote(url),
        kind,
        _page(fields.get("warc-refers-to")),
        size,
        digest,
        payload if payloads else None,
    )


def read(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, each read alone by its place in the index.

    ``payload`` is null for revisits, whose size and digest come from their header lines;
    without ``payloads`` it is always null. A payload that does not match its digest is an
    error. An archive is one task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{path}.idx") as index, system.open_input_file(path) as file:
                    found: list[tuple] = []
                    held = 0
                    for line in _lines(index):
                        entry = json.loads(line)
                        file.seek(entry["offset"])
                        found.append(read_member(file.read(entry["length"]), payloads))
                        held += len(found[-1][6] or b"") + 200
                        if held > 8 << 20:
                            yield _batch(found)
                            found, held = [], 0
                    if found:
                        yield _batch(found)

    return _spread(files).select("path").mapInArrow(work, RECORDS)


def _lines(file) -> Iterator[bytes]:
    rest = b""
    while piece := file.read(PIECE):
        *lines, rest = (rest + piece).split(b"\n")
        yield from lines
    if rest:
        yield rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def archive(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    payloads: bool = True,
) -> DataFrame:
    """Pages as archives, normalised, and read back: one row per page, :data:`RECORDS`.

    The payload is the page in UTF-8, empty where it is null. Of pages with equal payloads
    of at least ``least_bytes`` bytes, the one with the smallest id is a response and the
    others revisit it; smaller ones are all responses. Rows that repeat that id with that
    payload are responses too, as is every row of a group without any id; a row without an
    id revisits the page that has one. Payloads of any length are written and read a piece at a
    time and compared whole. An empty table gives no records; other columns are not touched.
    """
    spark: SparkSession = pages.sparkSession
    folder = run_dir(spark, "warc")
    typed = with_types(pages, id_col, url_col, html_col, least_bytes)
    members = normalise(write(typed, folder, archive_bytes), folder)
    return read(members, folder, payloads)
