"""MPEG transport streams as a column type: lossless storage of payloads and their demultiplexing.

:func:`mux` stores a payload as one program with one private elementary stream: a program association table,
a program map table, then elementary (PES) packets of up to ``UNIT`` bytes, each with a presentation timestamp
(90 kHz, ``STEP`` ticks apart); every ``RANDOM_EVERY``-th has the random-access indicator and the program clock reference that the map table
names. :func:`demux` reads streams of one program: it follows the tables (with or without descriptors, other programs' and network entries skipped) to
the first elementary stream, checks the continuity counters (one repeat of a packet, packets without payload and announced discontinuities are
legal), reassembles the elementary packets and returns timestamps with random-access points.

:func:`store` writes the streams as a column of a table in the shared folder, :func:`features` reads the stored bytes back.
Both run as Arrow batches within a task; nothing is shuffled or collected, a task holds one batch.

Results for odd rows: a null or empty text is a payload of 64 zero bytes; texts of any length are stored whole;
equal texts give equal streams; repeated rows repeat; an empty table gives an empty result; other columns are dropped.
A stream with a broken or split table, a lost packet or a bad length raises an error with the reason.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import table, tune, written

PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, NULL_PID = 188, 0x47, 0x0000, 0x1000, 0x0100, 0x1FFF
PRIVATE_STREAM, PRIVATE_TYPE, PROGRAM = 0xBD, 0x06, 1
#: Bytes of an elementary packet's payload, ticks of 90 kHz between two, and how often one is a random-access point.
UNIT, STEP, RANDOM_EVERY = 16_384, 3_600, 8
BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC[(c >> 24) ^ b]
    return c


def section(table_id: int, id_field: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + id_field.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, data: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + data).ljust(PACKET, b"\xff")


TABLES = table_packet(PAT_PID, section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + table_packet(
    PMT_PID, section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def timestamp(ticks: int) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def clock(ticks: int) -> bytes:
    """A program clock reference: 33 bits of 90 kHz, 6 reserved ones, 9 bits of 27 MHz."""
    return ((ticks & 0x1FFFFFFFF) << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter = [TABLES], 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        body = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + timestamp(n * STEP) + body
        # The first packet carries an adaptation field, with the random-access flag and the clock on random-access points; the last is filled up by one.
        first = bytes([7, 0x50]) + clock(n * STEP) if n % RANDOM_EVERY == 0 else b"\x01\x00"
        room = PACKET - 4 - len(first)
        parts = [(first, pes[:room])]
        full = range(room, len(pes), PACKET - 4)
        parts += [(b"", pes[k : k + PACKET - 4]) for k in full]
        for k, (field, data) in enumerate(parts):
            short = PACKET - 4 - len(field) - len(data)
            if short and field:
                field = bytes([field[0] + short]) + field[1:] + b"\xff" * short
            elif short:
                field = b"\x00" if short == 1 else bytes([short - 1, 0]) + b"\xff" * (short - 2)
            out.append(bytes([SYNC, (0x40 if k == 0 else 0) | ES_PID >> 8, ES_PID & 255, (0x30 if field else 0x10) | counter]) + field + data)
            counter = counter + 1 & 15
    return b"".join(out)


def one_table(packets: np.ndarray, heads: np.ndarray, pid: int, table_id: int) -> bytes:
    """The body of the first table section on a packet id."""
    rows = np.flatnonzero((heads == pid) & (packets[:, 1] & 0x40 > 0) & (packets[:, 3] & 0x10 > 0))
    if not len(rows):
        raise ValueError(f"no table on {pid:#x}")
    raw = packets[rows[0]].tobytes()
    at = 4 + (raw[4] + 1 if raw[3] & 0x20 else 0)
    start = at + 1 + raw[at] if at < PACKET else PACKET
    size = int.from_bytes(raw[start + 1 : start + 3], "big") & 0xFFF
    whole = raw[start : start + 3 + size]
    if len(whole) < 12 or len(whole) != 3 + size or whole[0] != table_id or crc32_mpeg(whole):
        raise ValueError(f"bad table on {pid:#x}")
    return whole[8:-4]


def tables(packets: np.ndarray, heads: np.ndarray) -> int:
    """The id of the first elementary stream of the first program, from the association and map tables."""
    body = one_table(packets, heads, PAT_PID, 0)
    programs = [body[i : i + 4] for i in range(0, len(body), 4)]
    maps = [int.from_bytes(x[2:], "big") & 0x1FFF for x in programs if x[:2] != b"\x00\x00"]  # 0: the network's table
    if not maps:
        raise ValueError("no program")
    body = one_table(packets, heads, maps[0], 2)
    at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
    if len(body) < at + 5:
        raise ValueError("no elementary stream")
    return int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF


def ordered(own: np.ndarray) -> np.ndarray:
    """The packets with a payload, without legal repeats; raises if one is missing."""
    own = own[own[:, 3] & 0x10 > 0]
    counter = own[:, 3] & 15
    ahead = (counter[1:] - counter[:-1]) & 15
    again = (ahead == 0) & (own[1:, 4:] == own[:-1, 4:]).all(axis=1)
    again[1:] &= ~again[:-1]  # a packet may repeat once
    jump = (own[1:, 3] & 0x20 > 0) & (own[1:, 4] > 0) & (own[1:, 5] & 0x80 > 0)
    if ((ahead != 1) & ~again & ~jump).any():
        raise ValueError("a packet is missing")
    return own[np.append(True, ~again)] if len(own) else own


def demux(stream: bytes) -> tuple[bytes, list[int], list[int]]:
    """The elementary payload, the timestamps of its packets (-1: none), and the packets that are random-access points."""
    if len(stream) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    if (packets[:, 1] & 0x80).any():
        raise ValueError("a damaged packet")
    heads = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    own = ordered(packets[heads == tables(packets, heads)])
    if not len(own):
        return b"", [], []
    adapted = (own[:, 3] & 0x20) > 0
    skip = np.where(adapted, own[:, 4].astype(np.int64) + 1, 0) + 4
    if (skip > PACKET).any():
        raise ValueError("bad adaptation field")
    data = own[np.arange(PACKET)[None, :] >= skip[:, None]].tobytes()
    ends = np.cumsum(PACKET - skip)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    if not len(starts) or starts[0]:
        raise ValueError("no start of an elementary packet")
    random = adapted[starts] & (own[starts, 4] > 0) & ((own[starts, 5] & 0x40) > 0)
    bounds = [*(ends[starts] - (PACKET - skip[starts])).tolist(), len(data)]
    body, stamps = [], []
    for at, end in zip(bounds, bounds[1:]):
        head = data[at : at + 14]
        size = int.from_bytes(head[4:6], "big")
        if head[:3] != b"\x00\x00\x01" or size and size != end - at - 6:
            raise ValueError("bad elementary packet")
        t = head[9:14]
        stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1 if head[7] & 0x80 else -1)
        body.append(data[at + 9 + head[8] : end])
    return b"".join(body), stamps, np.flatnonzero(random).tolist()


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\x00")


def store(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (key, n_bytes, media): the text's padded UTF-8 bytes as a transport stream, in a table of the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], names=[key, "n_bytes", "media"])

    return written(docs.select(key, text_col).mapInArrow(pack, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary"), "media")


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the stored streams back: payload sums, all timestamps, and the numbers of the packets that are random-access points."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rows = batch.column(1).to_pylist(), []
            for size, stream in zip(sizes, batch.column(2).to_pylist()):
                payload, stamps, random = demux(stream)
                feature = f"pid={ES_PID};pes={len(stamps)};pts={stamps[0]}-{stamps[-1]};rap={','.join(map(str, random))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, stamps, random))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array(x, kind) for x, kind in zip(list(zip(*rows)) or [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access"])

    kind = media.schema[key].dataType.simpleString()
    return media.mapInArrow(unpack, f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>")


def op5_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return features(store(table(spark, sf_dir, "documents")))


QUERIES = {"op5_transport_streams": op5_transport_streams}
SQL: dict[str, str] = {}
