"""Records whose heads, members or blocks are longer than what is read at a time."""

import io
import struct
import zlib

import pytest

from lanternq.llm import warc


def page(i, url="http://x/", payload=b"text"):
    return warc.page_record(i, url, payload, warc.sha1_base32(payload), None, "2000-01-01T00:00:00Z")


def member_with(data, extra, name):
    """A gzip member with an extra field and a file name in its header."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08" + bytes([4 | 8]) + bytes(6) + struct.pack("<H", len(extra)) + extra + name + b"\0"
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def read(data):
    return [(kind, fields.get("x-page-id"), len(block)) for kind, _, _, fields, block in warc.records(io.BytesIO(data))]


@pytest.mark.parametrize("length", [4000, 4096, 65_000, 70_000, 300_000])
def test_long_heads(length):
    plain = [page(1), page(2, "http://x/" + "a" * length), page(3)]
    whole = [r[1] for r in read(b"".join(plain))]
    assert whole == ["1", "2", "3"] == [r[1] for r in read(b"".join(map(warc.member, plain)))]
    damaged = read(b"junk" * 9000 + b"".join(plain))
    assert [r[1] for r in damaged if r[1]] == ["1", "2", "3"]


@pytest.mark.parametrize("sizes", [(10, 10), (60_000, 10), (65_535, 200_000)])
def test_members_with_long_headers_are_salvaged(sizes):
    extra, name = b"e" * sizes[0], b"n" * sizes[1]
    good = [member_with(page(i), extra, name) for i in range(3)]
    spoiled = bytearray(good[0])
    spoiled[-20] ^= 255
    found = read(bytes(spoiled) + good[1] + good[2])
    assert [r[1] for r in found if r[1]] == ["1", "2"]


def test_records_beyond_the_bound_are_gaps(monkeypatch):
    data = [page(1), page(2, payload=b"x" * 5000), page(3)]
    assert [r[1] for r in read(b"".join(data))] == ["1", "2", "3"]
    monkeypatch.setattr(warc, "MOST_BYTES", 4000)
    for records in (data, list(map(warc.member, data))):
        assert [r[1] for r in read(b"".join(records)) if r[1]] == ["1", "3"]


def test_heads_without_end():
    assert [r[1] for r in read(b"WARC/1.0\r\n" + b"a: b\r\n" * 50_000 + page(1)) if r[1]] in (["1"], [])
    assert [r[1] for r in read(b"WARC/1.0\r\nno end " * 3000 + page(1)) if r[1]] == ["1"]
