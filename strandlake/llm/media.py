"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

`mux` stores a payload as one elementary stream: a program association table, a program map table, then
one PES packet per access unit, each with a presentation time stamp, a clock reference and the
random-access flag.  `demux` reads any such stream back: it finds the programs from the tables, checks
sync bytes, section checksums and continuity counters, reassembles the PES packets and returns the
payload with the time stamps and random-access points.  Both work on arrays of whole packets.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm._spark import table

PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, MEDIA_PID = 0, 0x100, 0x101
#: Private data in PES packets.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Payload bytes of an access unit; one is a second's worth of 8-bit samples at 1,536 Hz.
UNIT = 1536
TICKS = 90_000
#: Payloads are padded with spaces to a multiple of this.
BLOCK = 192
PES_HEADER = 14


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(body: bytes) -> bytes:
    return body + crc_mpeg(body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), dtype=np.uint8)


_PAT = _table_packet(PAT_PID, _section(bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])))
_PMT = _table_packet(PMT_PID, _section(bytes([2, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0])))


def _stamp(pts: np.ndarray) -> np.ndarray:
    """The five bytes of a PTS-only field, for each time stamp."""
    p = pts.astype(np.int64)
    return np.stack([0x21 | (p >> 29) & 0x0E, (p >> 22) & 255, 1 | (p >> 14) & 0xFE, (p >> 7) & 255, 1 | (p << 1) & 0xFE], axis=1).astype(np.uint8)


def _clock(pts: np.ndarray) -> np.ndarray:
    """The six bytes of a program clock reference, extension 0."""
    p = pts.astype(np.int64)
    return np.stack([(p >> 25) & 255, (p >> 17) & 255, (p >> 9) & 255, (p >> 1) & 255, (p & 1) << 7 | 0x7E, p * 0], axis=1).astype(np.uint8)


def _units(data: np.ndarray, pts: np.ndarray) -> np.ndarray:
    """Packets of equally long access units.  data: units x bytes."""
    n, size = data.shape
    pes = np.zeros((n, PES_HEADER + size), dtype=np.uint8)
    pes[:, :9] = [0, 0, 1, STREAM_ID, (size + 8) >> 8, (size + 8) & 255, 0x84, 0x80, 5]
    pes[:, 9:14] = _stamp(pts)
    pes[:, 14:] = data
    first, rest = 176, pes.shape[1] - 176
    packets = 1 + max(0, -(-rest // 184))
    out = np.full((n, packets, PACKET), 0xFF, dtype=np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1] = MEDIA_PID >> 8
    out[:, 0, 1] |= 0x40
    out[:, :, 2] = MEDIA_PID & 255
    out[:, :, 3] = 0x10
    stuffed = max(0, -rest)  # a unit that ends in its first packet lengthens the adaptation field
    out[:, 0, 3] = 0x30
    out[:, 0, 4] = 7 + stuffed
    out[:, 0, 5] = 0x50
    out[:, 0, 6:12] = _clock(pts)
    out[:, 0, 12 + stuffed :] = pes[:, : min(first, pes.shape[1])]
    whole = max(0, rest) // 184
    if whole:
        out[:, 1 : 1 + whole, 4:] = pes[:, first : first + whole * 184].reshape(n, whole, 184)
    if rest > 0 and (left := rest - whole * 184):
        gap = 184 - left
        out[:, -1, 3] = 0x30
        out[:, -1, 4] = gap - 1
        if gap > 1:
            out[:, -1, 5] = 0
        out[:, -1, 4 + gap :] = pes[:, -left:]
    return out.reshape(-1, PACKET)


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """A transport stream that holds the payload.  An empty payload has tables only."""
    data = np.frombuffer(payload, dtype=np.uint8)
    whole = len(data) // unit
    parts = []
    if whole:
        parts.append(_units(data[: whole * unit].reshape(whole, unit), np.arange(whole) * TICKS))
    if len(data) > whole * unit:
        parts.append(_units(data[whole * unit :].reshape(1, -1), np.array([whole * TICKS])))
    media = np.concatenate(parts) if parts else np.zeros((0, PACKET), np.uint8)
    media[:, 3] |= (np.arange(len(media)) % 16).astype(np.uint8)
    return b"".join((_PAT.tobytes(), _PMT.tobytes(), media.tobytes()))


class StreamError(ValueError):
    """The bytes aren't a well-formed transport stream."""


@dataclass
class Stream:
    payload: bytes
    packets: int
    program: int
    pid: int
    stream_type: int
    discontinuities: int
    pts: list[int] = field(default_factory=list)
    #: (time stamp, packet index) of each access unit with the random-access flag.
    random_access: list[tuple[int, int]] = field(default_factory=list)


def _read_section(packet: np.ndarray, table_id: int) -> bytes:
    start = 4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0)
    start += 1 + int(packet[start])
    size = 3 + ((int(packet[start + 1]) & 15) << 8 | int(packet[start + 2]))
    body = packet[start : start + size].tobytes()
    if len(body) != size or body[0] != table_id or crc_mpeg(body):
        raise StreamError("bad section")
    return body


def demux(stored: bytes) -> Stream:
    """Parses the first program's first elementary stream, of tables that fit a packet each; raises StreamError on
    damage but for continuity breaks, which are counted.  A packet sent twice in a row, as may be, counts once."""
    if not stored or len(stored) % PACKET:
        raise StreamError("not whole packets")
    p = np.frombuffer(stored, dtype=np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise StreamError("lost sync")
    pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    start = (p[:, 1] & 0x40) > 0
    tables = np.flatnonzero((pid == PAT_PID) & start)
    if not len(tables):
        raise StreamError("no program association table")
    pat = _read_section(p[tables[0]], 0)
    programs = [(pat[i] << 8 | pat[i + 1], (pat[i + 2] & 31) << 8 | pat[i + 3]) for i in range(8, len(pat) - 4, 4)]
    program, map_pid = next(x for x in programs if x[0])
    maps = np.flatnonzero((pid == map_pid) & start)
    if not len(maps):
        raise StreamError("no program map table")
    pmt = _read_section(p[maps[0]], 2)
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    stream_type, media_pid = pmt[at], (pmt[at + 1] & 31) << 8 | pmt[at + 2]
    own = np.flatnonzero(pid == media_pid)
    m = p[own]
    again = np.zeros(len(m), dtype=bool)
    again[1:] = ((m[1:, 3] & 0x10) > 0) & (m[1:] == m[:-1]).all(axis=1)
    own, m = own[~again], m[~again]
    has_data, has_field = (m[:, 3] & 0x10) > 0, (m[:, 3] & 0x20) > 0
    counter = m[:, 3] & 15
    expected = (counter[:-1] + has_data[1:]) % 16
    breaks = int((counter[1:] != expected).sum())
    begin = np.where(has_field, 5 + m[:, 4].astype(np.int32), 4)
    access = has_field & (m[:, 4] > 0) & ((m[:, 5] & 0x40) > 0)
    heads = np.flatnonzero(start[own])
    out = Stream(b"", len(p), program, media_pid, stream_type, breaks)
    if not len(heads):
        return out
    h, b = m[heads], begin[heads]
    byte = lambda i: np.take_along_axis(h, (b + i)[:, None], axis=1)[:, 0].astype(np.int64)
    if (byte(0) | byte(1)).any() or (byte(2) != 1).any():
        raise StreamError("bad PES start code")
    if ((byte(7) & 0x80) == 0).any():
        raise StreamError("no time stamp")
    pts = (byte(9) >> 1 & 7) << 30 | byte(10) << 22 | (byte(11) >> 1) << 15 | byte(12) << 7 | byte(13) >> 1
    skip = begin.copy()
    skip[heads] += 9 + byte(8).astype(np.int32)
    keep = (np.arange(PACKET)[None, :] >= skip[:, None]) & has_data[:, None]
    keep[: heads[0]] = False
    declared = (byte(4) << 8 | byte(5)) - 3 - byte(8)
    got = np.add.reduceat(keep.sum(axis=1), heads)
    if (declared != got).any():
        raise StreamError("PES length differs")
    out.payload = m[keep].tobytes()
    out.pts = pts.tolist()
    out.random_access = [(int(t), int(i)) for t, i, a in zip(pts, own[heads], access[heads], strict=True) if a]
    return out


def feature(s: Stream) -> str:
    """The stream's index in one string: program, packets, breaks, time range, and random-access points."""
    return json.dumps({"program": s.program, "pid": s.pid, "type": s.stream_type, "packets": s.packets, "breaks": s.discontinuities, "units": len(s.pts), "pts": [s.pts[0], s.pts[-1]] if s.pts else [], "access": len(s.random_access), "access_crc32": zlib.crc32(np.array(s.random_access, dtype="<i8").tobytes())}, separators=(",", ":"))


def padded(raw: bytes, block: int = BLOCK) -> bytes:
    return raw.ljust(max(block, -(-len(raw) // block) * block), b" ")


def media_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False, keep_index: bool = False) -> DataFrame:
    """Stores each row's text as a stream and reads it back; with keep_media, the stream is a column; with keep_index,
    so are pts, the time stamp of each access unit, and random_access, the time stamp and packet of each access point.

    Null text is empty and stores 192 spaces.  Null keys and repeated rows give a row each, equal texts equal
    values; an empty table gives no rows.  Only the key and the derived columns are returned, so no name clashes.
    """
    schema = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())] + [("media", pa.binary())] * keep_media + [("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())])))] * keep_index)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1).cast(pa.large_binary()):
                raw = x.as_py() or b""
                stored = mux(padded(raw))
                got = demux(stored)
                back = got.payload
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(got), *([stored] if keep_media else ()), *([got.pts, [{"pts": t, "packet": i} for t, i in got.random_access]] if keep_index else ())))
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True))], names=["k", *schema.names])

    ddl = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media + ", pts array<bigint>, random_access array<struct<pts: bigint, packet: bigint>>" * keep_index
    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` AS k", f"CAST(`{text}` AS STRING) AS t").mapInArrow(convert, f"k {kind}, {ddl}").withColumnRenamed("k", key)


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text through a transport stream and back."""
    return media_rows(table(spark, sf_dir, "documents"))
