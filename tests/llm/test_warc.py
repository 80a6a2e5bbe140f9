import hashlib
import struct

import pytest
import zstandard

from touchcredit.llm.common import new_folder
from touchcredit.llm.warc import (
    ArchiveError,
    Record,
    archived_pages,
    archives_in,
    page_record,
    parsed_page,
    read_archive,
    read_pages,
    trained_dictionary,
    write_archive,
    write_pages,
)


def record(i, payload):
    return page_record(i, f"http://x.org/{i}", payload, hashlib.sha256(payload).hexdigest(), None)


RECORDS = [record(i, f"<p>page number {i} of many</p>".encode() * (i % 7)) for i in range(200)]


@pytest.mark.parametrize("dictionary", [b"", b"<p>page number of many</p>", trained_dictionary([r.packed() for r in RECORDS])])
def test_round_trip(dictionary):
    raw = write_archive(RECORDS, dictionary)
    assert struct.unpack("<II", raw[:8]) == (0x184D2A5D, len(dictionary))
    got = list(read_archive(raw))
    assert got == RECORDS and [parsed_page(r)["page_id"] for r in got] == list(range(200))
    packed = zstandard.ZstdCompressor().compress(dictionary)
    again = struct.pack("<II", 0x184D2A5D, len(packed)) + packed + raw[8 + len(dictionary) :]
    if dictionary:
        assert list(read_archive(again)) == RECORDS
    # a skippable frame between records is passed over, an archive without a dictionary is read
    assert list(read_archive(write_archive(RECORDS[:2], b"") + struct.pack("<II", 0x184D2A50, 3) + b"abc")) == RECORDS[:2]
    assert list(read_archive(b"")) == []


def frames(*blocks):
    return struct.pack("<II", 0x184D2A5D, 0) + b"".join(zstandard.ZstdCompressor().compress(b) for b in blocks)


HEAD = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"


@pytest.mark.parametrize(
    "raw",
    [
        write_archive(RECORDS, b"")[:-5],
        write_archive(RECORDS, b"") + b"xx",
        write_archive(RECORDS, b"") + b"no frame",
        struct.pack("<II", 0x184D2A5D, 99) + b"short",
        frames(b"HTTP/1.1 200\r\n\r\n"),
        frames(HEAD + b"\r\nbody\r\n\r\n"),
        frames(HEAD + b"Content-Length: 3\r\n\r\nbody\r\n\r\n"),
        frames(HEAD + b"Content-Length: 4\r\n\r\nbodyxxxx"),
        frames(HEAD + b"Content-Length: four\r\n\r\nbody\r\n\r\n"),
        frames(HEAD.replace(b"WARC-Date: 2024-01-01T00:00:00Z\r\n", b"") + b"Content-Length: 4\r\n\r\nbody\r\n\r\n"),
        frames(HEAD + b"no colon\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"),
    ],
)
def test_broken_archives(raw):
    with pytest.raises(ArchiveError):
        list(read_archive(raw))


def test_broken_payloads():
    one = record(1, b"<p>text</p>")
    with pytest.raises(ArchiveError):
        parsed_page(Record(one.headers, one.block.replace(b"text", b"tent")))
    with pytest.raises(ArchiveError):
        parsed_page(Record(one.headers, b"no header"))


@pytest.fixture(scope="module")
def pages(spark):
    same = "<p>" + "é" * 60 + "</p>"
    rows = [
        (5, "http://a/5", same), (3, "http://a/3", same), (9, None, same), (4, "http://a/4", "short"), (2, "x y\r\nWARC-Type: z", "short"),
        (7, "", None), (8, "http://a/8", ""), (None, "http://a/n", same), (3, "http://a/3", same), (10, "u", "long" * 100_000),
    ]
    return rows, spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id bigint, url string, html string, digest string, n int")


def expected(rows):
    firsts = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            firsts[raw] = min(i, firsts.get(raw, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = firsts.get(raw, i)
        kind = "response" if first == i else "revisit"
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), kind, first if kind == "revisit" else None))
    return sorted(out, key=str)


def test_pages(spark, pages):
    rows, frame = pages
    got = archived_pages(frame)
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected(rows)
    folder = new_folder(spark, "warc-test")
    write_pages(frame.repartition(3), folder)
    listed = read_pages(archives_in(spark, folder))
    assert sorted([tuple(r) for r in listed.collect()], key=str) == expected(rows)
    assert archived_pages(frame.limit(0)).count() == 0
