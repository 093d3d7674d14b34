"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

demux() parses the program tables, checks continuity counters, reassembles elementary packets (PES) and gathers timestamps
with random-access points; mux() writes a one-program stream that carries any bytes as a private elementary stream. The
payload is cut into elementary packets, each with a presentation time and a random-access mark.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
PACKET, SYNC = 188, 0x47
PAT_PID, NULL_PID = 0x0000, 0x1FFF
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
CLOCK, CLOCK_WRAP = 90_000, 1 << 33
POLYNOMIAL = 0x04C11DB7

#: Ours: where the one program is, bytes in an elementary packet, ticks of 90 kHz from one to the next.
PROGRAM, PMT_PID, DATA_PID = 1, 0x1000, 0x0100
CHUNK, STEP = 8 * 1024, CLOCK // 25
PAD = 64


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ POLYNOMIAL if value >> 31 else value << 1) & 0xFFFFFFFF
        out.append(value)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC of a section; 0 over a section with its own CRC."""
    value = 0xFFFFFFFF
    for byte in data:
        value = (value << 8 ^ _CRC[value >> 24 ^ byte]) & 0xFFFFFFFF
    return value


def _section(table: int, extension: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(ticks: int) -> bytes:
    ticks %= CLOCK_WRAP
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def mux(payload: bytes, chunk: int = CHUNK, step: int = STEP) -> bytes:
    """A transport stream with the payload: tables first, then an elementary packet for each chunk."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), chunk)):
        data = payload[at : at + chunk]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * step) + data
        base = k * step % CLOCK_WRAP
        clock = (base << 15 | 0x3F << 9).to_bytes(6, "big")
        # The first packet has a clock reference and the random-access mark, the last one is stuffed in its adaptation field.
        first = b"\x50" + clock
        room = PACKET - 4 - 1 - len(first)
        start = True
        while pes or start:
            body = pes[: room if start else PACKET - 4]
            pes = pes[len(body) :]
            head = bytes([SYNC, (0x40 if start else 0) | DATA_PID >> 8, DATA_PID & 0xFF])
            field_ = first if start else b""
            spare = PACKET - 4 - len(body) - (1 + len(field_) if start else 0)
            if start or spare:
                if not start and spare == 1:
                    adaptation = b"\x00"
                else:
                    if not start:
                        field_, spare = b"\x00", spare - 2
                    adaptation = bytes([len(field_) + spare]) + field_ + b"\xff" * spare
                out.append(head + bytes([0x30 | counter]) + adaptation + body)
            else:
                out.append(head + bytes([0x10 | counter]) + body)
            counter = counter + 1 & 15
            start = False
    return b"".join(out)


@dataclass
class ElementaryPacket:
    """A reassembled packet: its stream, the byte offset where it begins, its times and random-access mark, its data."""

    pid: int
    offset: int
    pts: int | None
    dts: int | None
    random_access: bool
    complete: bool
    data: bytes


@dataclass
class Stream:
    """What demux found: stream types by PID, elementary packets in order of their ends, and what was wrong."""

    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    packets: list[ElementaryPacket] = field(default_factory=list)
    n_packets: int = 0
    continuity_errors: int = 0
    crc_errors: int = 0
    sync_losses: int = 0
    flagged_errors: int = 0
    first_clock: int | None = None
    last_clock: int | None = None


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def demux(data: bytes) -> Stream:
    """Reads a transport stream, from wherever sync bytes a packet apart begin; damaged parts are counted, not raised."""
    out, pmts, counters, tables, open_ = Stream(), {}, {}, {}, {}
    at, end = 0, len(data)

    def close(pid: int) -> None:
        if pid not in open_:
            return
        begin, access, parts, whole = open_.pop(pid)
        raw = b"".join(parts)
        if len(raw) < 9 or raw[:3] != b"\x00\x00\x01" or len(raw) < 9 + raw[8]:
            return
        length = int.from_bytes(raw[4:6], "big")
        pts = _ticks(raw[9:14]) if raw[7] & 0x80 and raw[8] >= 5 else None
        dts = _ticks(raw[14:19]) if raw[7] & 0x40 and raw[8] >= 10 else None
        body = raw[9 + raw[8] : 6 + length if length else None]
        out.packets.append(ElementaryPacket(pid, begin, pts, dts, access, whole and (not length or len(raw) >= 6 + length), body))

    def section(pid: int, body: bytes, start: bool) -> None:
        if start:
            tables[pid] = body[1 + body[0] :] if body else b""
        elif pid in tables:
            tables[pid] += body
        raw = tables.get(pid, b"")
        if len(raw) < 3 or len(raw) < (need := 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)):
            return
        tables.pop(pid)
        raw = raw[:need]
        if need < 12 or section_crc(raw):
            out.crc_errors += 1
        elif raw[0] == 0 and pid == PAT_PID:
            for k in range(8, need - 4, 4):
                if number := int.from_bytes(raw[k : k + 2], "big"):
                    pmts[int.from_bytes(raw[k + 2 : k + 4], "big") & 0x1FFF] = number
        elif raw[0] == 2 and pid in pmts:
            k = 12 + (int.from_bytes(raw[10:12], "big") & 0xFFF)
            own = out.programs.setdefault(pmts[pid], {})
            while k + 5 <= need - 4:
                own[int.from_bytes(raw[k + 1 : k + 3], "big") & 0x1FFF] = raw[k]
                k += 5 + (int.from_bytes(raw[k + 3 : k + 5], "big") & 0xFFF)

    while at + PACKET <= end:
        if data[at] != SYNC or at + PACKET < end and data[at + PACKET] != SYNC and at + 2 * PACKET <= end:
            out.sync_losses += 1
            at += 1
            while at + PACKET <= end and not (data[at] == SYNC and (at + PACKET == end or data[at + PACKET] == SYNC)):
                at += 1
            continue
        b1, b3 = data[at + 1], data[at + 3]
        pid, start = (b1 & 0x1F) << 8 | data[at + 2], bool(b1 & 0x40)
        out.n_packets += 1
        body, access, restart = at + 4, False, False
        if b1 & 0x80:
            out.flagged_errors += 1
        if b3 & 0x20:
            size = data[at + 4]
            body += 1 + size
            if size:
                flags = data[at + 5]
                access, restart = bool(flags & 0x40), bool(flags & 0x80)
                if flags & 0x10 and size >= 7:
                    clock = int.from_bytes(data[at + 6 : at + 12], "big")
                    out.last_clock = (clock >> 15) * 300 + (clock & 0x1FF)
                    out.first_clock = out.last_clock if out.first_clock is None else out.first_clock
        if pid != NULL_PID and b3 & 0x10:
            counter, last = b3 & 15, counters.get(pid)
            repeat = last is not None and counter == last and not restart
            if last is not None and not restart and not repeat and counter != last + 1 & 15:
                out.continuity_errors += 1
                if pid in open_:
                    open_[pid][3] = False
                tables.pop(pid, None)
            counters[pid] = counter
            if not repeat and not b1 & 0x80:
                content = data[body : at + PACKET]
                if pid == PAT_PID or pid in pmts:
                    section(pid, content, start)
                elif any(pid in x for x in out.programs.values()):
                    if start:
                        close(pid)
                        open_[pid] = [at, access, [], True]
                    if pid in open_:
                        open_[pid][2].append(content)
        at += PACKET
    for pid in list(open_):
        close(pid)
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """The number of bytes of a text (null: none), and the bytes with zeros up to a positive multiple of PAD."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\0")


def feature(found: Stream) -> str:
    """Stream types, counts, errors, times (90 kHz) and random-access points of a stream, as text."""
    streams = ",".join(f"{n}:{pid}={kind}" for n, own in sorted(found.programs.items()) for pid, kind in sorted(own.items()))
    times = [p.pts for p in found.packets if p.pts is not None]
    access = [(p.pts, p.offset) for p in found.packets if p.random_access]
    points = zlib.crc32(np.array(access, "<i8").tobytes()) if access else 0
    return (
        f"streams={streams};packets={found.n_packets};pes={len(found.packets)};complete={sum(p.complete for p in found.packets)};"
        f"continuity_errors={found.continuity_errors};crc_errors={found.crc_errors};sync_losses={found.sync_losses};"
        f"pts={times[0] if times else ''}..{times[-1] if times else ''};access_points={len(access)};access_crc32={points}"
    )


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes in a transport stream. A null text is an empty one."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [padded(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in raw], pa.int64()), pa.array([mux(x) for _, x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


ACCESS = "array<struct<pid:int,pts:long,dts:long,offset:long,random_access:boolean>>"


def describe(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, points) of store()'s
    rows, all from the stored bytes; points has the times and random-access mark of each elementary packet.

    A null or damaged stream has what can be read of it: no payload at worst.
    """
    point = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())]))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "points"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), point]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc, n, blob in zip(*(batch.column(k).slice(at, 256) for k in range(3))):
                    stored = blob.as_py() or b""
                    found = demux(stored)
                    payload = b"".join(p.data for p in found.packets)
                    points = [{"pid": p.pid, "pts": p.pts, "dts": p.dts, "offset": p.offset, "random_access": p.random_access} for p in found.packets]
                    rows.append((doc.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(found), points))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, points " + ACCESS
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)
