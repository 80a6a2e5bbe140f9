"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

The writer makes one archive of each group of records; the reader loads the dictionary, decodes frame after frame, and
checks record headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, settled

#: Fixed values of the format: the skippable frame that holds a dictionary, a Zstandard frame, a trained dictionary.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
ZSTD_FRAME = 0xFD2FB528
TRAINED = 0xEC30A437
VERSION = b"WARC/1.1"

DICTIONARY_BYTES = 32 << 10
#: Payload of a task's first records that its dictionary is trained on.
SAMPLE_BYTES = 1 << 20
#: Payload after which a task begins another archive, and the largest archive that the reader takes.
ARCHIVE_BYTES = 32 << 20
#: Payloads from this length on are stored once.
REVISIT_BYTES = 100
CRAWLED = "2024-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive that breaks the format; the message names the place."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def packed(self) -> bytes:
        lines = [f"{k}: {v}".encode() for k, v in self.headers.items()]
        size = f"Content-Length: {len(self.block)}".encode()
        return b"\r\n".join([VERSION, *lines, size, b"", self.block, b"", b""])


def field_value(value: str) -> str:
    """A header value on one line: white space, control characters and % are percent-encoded."""
    return "".join(
        "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) if c < "!" or c in "%\x7f" or c.isspace() else c
        for c in value
    )


def trained_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from samples; their own first bytes if they are too few to train one, nothing without samples."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def loaded_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    if raw[:4] == struct.pack("<I", ZSTD_FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    if not raw:
        return None
    trained = raw[:4] == struct.pack("<I", TRAINED)
    return zstandard.ZstdCompressionDict(raw, zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[Record], dictionary: bytes) -> bytes:
    own = loaded_dictionary(dictionary)
    packer = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=True, write_checksum=True)
    head = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
    return head + b"".join(packer.compress(r.packed()) for r in records)


def read_archive(raw: bytes) -> Iterator[Record]:
    """The records of an archive, one to a frame. Anything that breaks the format raises ArchiveError."""
    if not raw:
        return
    at, own = 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", raw, 4)[0]
        if len(raw) < 8 + size:
            raise ArchiveError("the dictionary's frame is cut off")
        try:
            own = loaded_dictionary(raw[8 : 8 + size])
        except zstandard.ZstdError as error:
            raise ArchiveError(f"unreadable dictionary: {error}") from error
        at = 8 + size
    view = memoryview(raw)
    unpacker = zstandard.ZstdDecompressor(dict_data=own)
    while at < len(raw):
        if len(raw) - at < 4:
            raise ArchiveError(f"{len(raw) - at} bytes after the last frame")
        magic = struct.unpack_from("<I", raw, at)[0]
        if magic in SKIPPABLE_FRAMES:
            if len(raw) - at < 8:
                raise ArchiveError(f"a skippable frame is cut off at {at}")
            at += 8 + struct.unpack_from("<I", raw, at + 4)[0]
            continue
        if magic != ZSTD_FRAME:
            raise ArchiveError(f"no frame at {at}")
        one = unpacker.decompressobj(read_across_frames=False)
        parts, end = [], at
        try:
            while not one.eof and end < len(raw):
                parts.append(one.decompress(view[end : end + (1 << 17)]))
                end += 1 << 17
        except zstandard.ZstdError as error:
            raise ArchiveError(f"unreadable frame at {at}: {error}") from error
        if not one.eof:
            raise ArchiveError(f"the frame at {at} is cut off")
        end = min(end, len(raw)) - len(one.unused_data)
        yield parsed_record(b"".join(parts), at)
        at = end


def parsed_record(raw: bytes, at: int) -> Record:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or first not in (b"WARC/1.0", VERSION):
        raise ArchiveError(f"the frame at {at} doesn't begin with a WARC header")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise ArchiveError(f"a header line without a colon at {at}")
        headers[name.strip()] = value.strip()
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in headers:
            raise ArchiveError(f"the record at {at} has no {name}")
    size = headers.pop("Content-Length")
    if not size.isdigit() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError(f"the record at {at} isn't as long as its Content-Length says")
    return Record(headers, rest[:-4])


HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> Record:
    """A response with the payload, or a revisit that names the response which has it."""
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": CRAWLED,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if url is not None:
        headers["WARC-Target-URI"] = field_value(url)
    if refers_to is not None:
        headers["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return Record(headers, HTTP_HEAD % len(payload))
    return Record(headers, HTTP_HEAD % len(payload) + payload)


def parsed_page(record: Record) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; a response's payload is verified."""

    def page(name: str) -> int | None:
        value = record.headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    head, gap, payload = record.block.partition(b"\r\n\r\n")
    sizes = [x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind = record.headers["WARC-Type"]
    digest = record.headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    if not gap or not head.startswith(b"HTTP/") or len(sizes) != 1:
        raise ArchiveError(f"{record.headers['WARC-Record-ID']}: no HTTP header with one length")
    if kind == "response" and (int(sizes[0]) != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ArchiveError(f"{record.headers['WARC-Record-ID']}: the payload differs from its length or digest")
    return {
        "page_id": page("WARC-Record-ID"), "payload_bytes": int(sizes[0]), "payload_digest": digest,
        "record_type": kind, "refers_to": page("WARC-Refers-To"),
    }


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it; Spark also writes file:/x for file:///x."""
    return pafs.FileSystem.from_uri("file:///" + uri[6:] if uri.startswith("file:/") and uri[6:7] != "/" else uri)


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes `pages` (page_id, url, html) as archives into `folder` and returns their paths and numbers of records.

    A null html is an empty payload, a null url is left out of the record, and a null page_id names no page. Of equal
    payloads of at least 100 bytes the one with the smallest page_id is stored and the others refer to it; rows that
    repeat that page_id are stored each. Every task writes its rows to archives of bounded size and with names of their
    own, and the returned paths are those of the attempts that Spark took, so a task that is lost and runs again leaves
    nothing behind that is read twice.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha2(html, 256)
    slim = pages.select("page_id", "url", "html")
    repeated = (
        slim.where(F.octet_length("html") >= REVISIT_BYTES)
        .groupBy(digest.alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
    )
    # The join is on the digest of a page alone, and only repeated digests are on the other side.
    stored = slim.withColumn("digest", digest).join(repeated, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("first") != F.coalesce("page_id", F.lit(-1)), F.col("first")).alias("refers_to"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        held: list[Record] = []
        size, dictionary = 0, None
        names, counts = [], []

        def close() -> None:
            nonlocal held, size, dictionary
            if dictionary is None:
                sample, room = [], SAMPLE_BYTES
                for r in held:
                    if room > 0:
                        sample.append(r.packed()[: SAMPLE_BYTES // 8])
                        room -= len(sample[-1])
                dictionary = trained_dictionary(sample)
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(write_archive(held, dictionary))
            names.append(f"{folder.rstrip('/')}/{name}")
            counts.append(len(held))
            held, size = [], 0

        for batch in batches:
            for page_id, url, text, sha, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (text or "").encode("utf-8", "surrogatepass")
                held.append(page_record(page_id, url, payload, sha, first))
                size += len(held[-1].block)
                if size >= ARCHIVE_BYTES:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"]
        )

    return settled(stored.mapInArrow(run, "path string, records bigint"))


PAGE = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ]
)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of the archives in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")


def read_pages(archives: DataFrame) -> DataFrame:
    """The records of the archives whose `path` is given, validated; no archives, no rows. One archive is read at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = opened(uri)
                with store.open_input_stream(path) as source:
                    raw = source.read()
                yield from pa.Table.from_pylist([parsed_page(r) for r in read_archive(raw)], PAGE).to_batches()

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return archives.select("path").mapInArrow(run, schema)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    return read_pages(write_pages(pages, new_folder(pages.sparkSession, "warc")))


SQL = """
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digests AS (
    SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM payloads
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
    FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""
