"""Transport streams: exact round trips, and broken streams that are found out."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=70_000))
def test_any_payload_comes_back(payload):
    stream = media.mux(media.padded(payload))
    assert len(stream) % media.PACKET == 0
    back, stamps, random = media.demux(stream)
    assert back == media.padded(payload)
    assert stamps == [k * media.STEP for k in range(-(-len(back) // media.UNIT))]
    assert random == list(range(0, len(stamps), media.RANDOM_EVERY))


def test_packets_have_sync_and_counters():
    stream = media.mux(b"x" * 100_000)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    own = [p for p in packets if (p[1] & 31) << 8 | p[2] == media.ES_PID]
    assert all(p[0] == 0x47 for p in packets)
    assert [p[3] & 15 for p in own] == [k % 16 for k in range(len(own))]


@pytest.mark.parametrize("cut, reason", [(5, "missing"), (0, "table"), (1, "table")])
def test_a_lost_packet_is_found(cut, reason):
    stream = media.mux(b"x" * 10_000)
    with pytest.raises(ValueError, match=reason):
        media.demux(stream[: cut * 188] + stream[(cut + 1) * 188 :])


def test_broken_table_and_sync():
    stream = bytearray(media.mux(b"x" * 64))
    stream[10] ^= 1
    with pytest.raises(ValueError, match="table"):
        media.demux(bytes(stream))
    with pytest.raises(ValueError, match="sync"):
        media.demux(b"\0" * 188)
    with pytest.raises(ValueError, match="whole"):
        media.demux(b"\x47" * 100)


def test_rows(spark):
    texts = ["", None, "a" * 64, "é" * 33, "long " * 60_000, "a" * 64]
    df = spark.createDataFrame([(i if i != 3 else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in media.features(media.store(df)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i if i != 3 else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.mux(full)).hexdigest()
    assert rows[2][1:] == rows[5][1:] and rows[0][1:] == rows[1][1:]
    assert media.features(media.store(df.limit(0))).count() == 0


def reader(stream):
    """A reader of its own: packet by packet, elementary packets by their stated lengths."""
    out, pending, last = [], b"", None
    for i in range(0, len(stream), 188):
        p = stream[i : i + 188]
        if (p[1] & 31) << 8 | p[2] != 0x100 or not p[3] & 0x10 or p == last:
            continue
        last = p
        data = p[4 + (1 + p[4] if p[3] & 0x20 else 0) :]
        if p[1] & 0x40 and pending:
            out.append(pending)
            pending = b""
        pending += data
    return b"".join(p[9 + p[8] : 6 + int.from_bytes(p[4:6], "big")] for p in [*out, pending])


def test_an_independent_reader_agrees():
    payload = bytes(range(256)) * 700
    assert reader(media.mux(payload)) == payload == media.demux(media.mux(payload))[0]


def test_clock_references_on_random_access_points():
    stream = media.mux(b"x" * 400_000)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    clocks = [int.from_bytes(p[6:12], "big") >> 15 for p in packets if p[3] & 0x20 and p[4] >= 7 and p[5] & 0x10]
    _, stamps, random = media.demux(stream)
    assert clocks == [stamps[k] for k in random] and len(clocks) > 3


def test_legal_streams_of_others():
    payload = b"abc" * 5_000
    stream = media.mux(payload)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    idle = bytes([0x47, 0x01, 0x00, 0x20 | packets[5][3] & 15, 183, 0]) + b"\xff" * 182
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    want = media.demux(stream)
    # a repeated packet, one without payload, a null packet, and other tables before the own ones
    assert media.demux(b"".join([*packets[:5], packets[4], idle, null, *packets[5:]])) == want
    # descriptors of the program and the stream, a network entry in the association table
    pat = media.section(0, 1, b"\x00\x00\xe0\x10" + (1).to_bytes(2, "big") + (0xE000 | media.PMT_PID).to_bytes(2, "big"))
    pmt = media.section(2, 1, b"\xe1\x00\xf0\x06\x05\x04HDMV\x06\xe1\x00\xf0\x03\x0a\x01\x00")
    assert media.demux(b"".join([media.table_packet(0, pat), media.table_packet(media.PMT_PID, pmt), *packets[2:]])) == want
    with pytest.raises(ValueError, match="missing"):
        media.demux(b"".join([*packets[:5], packets[4], packets[4], *packets[5:]]))
