"""MPEG transport streams as a media column: write payloads as streams, read them back.

``mux`` carries each payload in private-stream PES packets with presentation timestamps,
behind program tables and with a random-access point at each packet start. ``demux``
parses the tables, checks continuity counters, reassembles the elementary stream and
lists the timestamps with their random-access points.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of the stream: packet size, sync byte, table ids, PIDs, PES stream id, 90 kHz clock.
PACKET, SYNC, PAT, PMT = 188, 0x47, 0x00, 0x02
PMT_PID, STREAM_PID, PROGRAM, PRIVATE_STREAM, PRIVATE_PES = 0x1000, 0x100, 1, 0xBD, 0x06
FIRST_PTS, TICKS_A_UNIT = 90_000, 3_600
#: Payload bytes of a timed unit, units of a PES packet, PES packets between program tables.
UNIT, UNITS_A_PES, PES_A_TABLE = 576, 16, 16

STREAMS = "doc_id long, n_bytes long, media binary"
PARSED = "doc_id long, payload binary, packets long, programs long, stream_pid int, pes long, continuity_errors long, table_errors long, access_points array<struct<packet:long,pts:long,random_access:boolean>>"


@functools.cache
def crc_table() -> tuple[int, ...]:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, most significant bit first."""
    out = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(crc)
    return tuple(out)


def section_crc(data: bytes) -> int:
    crc, known = 0xFFFFFFFF, crc_table()
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ known[crc >> 24 ^ byte]
    return crc


@functools.cache
def table_packet(kind: int) -> np.ndarray:
    """A transport packet with the program association table or the program map table, counter zero."""
    pid = 0 if kind == PAT else PMT_PID
    body = PROGRAM.to_bytes(2, "big") + b"\xc1\x00\x00"
    if kind == PAT:
        body += PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")
    else:
        body += (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    section = bytes([kind]) + (0xB000 | len(body) + 4).to_bytes(2, "big") + body
    section += section_crc(section).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


def timestamp(pts: int) -> bytes:
    """33 bits in five bytes with marker bits, as in a PES header with PTS only."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def pes_packets(payload: bytes, pts: int, counter: int) -> np.ndarray:
    """Transport packets of one PES packet; the first has a clock reference and is a random-access point, the last is stuffed."""
    body = np.frombuffer(b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(payload) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + timestamp(pts % 2**33) + payload, np.uint8)
    lead = PACKET - 12
    whole, rest = divmod(len(body) - lead, PACKET - 4)
    rows = np.full((1 + whole + (rest > 0), PACKET), 0xFF, np.uint8)
    rows[:, :3] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
    rows[:, 3] = 0x10 | (np.arange(counter, counter + len(rows)) & 15)
    rows[0, 1] |= 0x40
    rows[0, 3] |= 0x20
    base = pts % 2**33
    rows[0, 4:12] = 7, 0x50, base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, 0
    rows[0, 12:] = body[:lead]
    rows[1 : 1 + whole, 4:] = body[lead : lead + whole * (PACKET - 4)].reshape(-1, PACKET - 4)
    if rest:
        rows[-1, 3] |= 0x20
        rows[-1, 4] = PACKET - 5 - rest
        if rest < PACKET - 5:
            rows[-1, 5] = 0
        rows[-1, PACKET - rest :] = body[-rest:]
    return rows


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\xff")


def mux_bytes(payload: bytes) -> bytes:
    """A transport stream of ``payload``, whose length is a positive multiple of 576."""
    out, counter, size = [], 0, UNIT * UNITS_A_PES
    for k, at in enumerate(range(0, len(payload), size)):
        if k % PES_A_TABLE == 0:
            for kind in (PAT, PMT):
                packet = table_packet(kind).copy()
                packet[3] |= k // PES_A_TABLE & 15
                out.append(packet.tobytes())
        rows = pes_packets(payload[at : at + size], FIRST_PTS + k * UNITS_A_PES * TICKS_A_UNIT, counter)
        counter += len(rows)
        out.append(rows.tobytes())
    return b"".join(out)


def sections(rows: np.ndarray, pid: np.ndarray, starts: np.ndarray, wanted: int, kind: int) -> tuple[list[bytes], int]:
    """Bodies of the tables of one kind on one PID that fit a packet, and how many fail their checksum."""
    good, bad = [], 0
    for row, start in zip(rows[pid == wanted], starts[pid == wanted], strict=True):
        data = row[start:].tobytes()
        if not row[1] & 0x40 or not data:
            continue
        data = data[1 + data[0] :]
        size = 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)
        if data[:1] != bytes([kind]) or size > len(data) or section_crc(data[:size]):
            bad += 1
        else:
            good.append(data[8 : size - 4])
    return good, bad


def demux_bytes(media: bytes | None) -> tuple:
    """Values of ``PARSED`` after doc_id. A stream without readable tables has no payload."""
    rows = np.frombuffer(media or b"", np.uint8)
    rows = rows[: len(rows) // PACKET * PACKET].reshape(-1, PACKET)
    number = np.flatnonzero(rows[:, 0] == SYNC)
    rows = rows[number]
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    control = rows[:, 3] >> 4 & 3
    starts = np.where(control & 2, 5 + rows[:, 4].astype(np.int32), 4)
    tables, bad = sections(rows, pid, starts, 0, PAT)
    programs = {b[k : k + 2]: int.from_bytes(b[k + 2 : k + 4], "big") & 0x1FFF for b in tables for k in range(0, len(b), 4) if b[k : k + 2] != b"\0\0"}
    stream = None
    for map_pid in programs.values():
        maps, more = sections(rows, pid, starts, map_pid, PMT)
        bad += more
        for b in maps:
            at = 4 + (int.from_bytes(b[2:4], "big") & 0x0FFF)
            if stream is None and at + 5 <= len(b):
                stream = int.from_bytes(b[at + 1 : at + 3], "big") & 0x1FFF
    errors = 0
    for one in np.unique(pid):
        counters = (rows[(pid == one) & (control & 1 > 0), 3] & 15).astype(np.int16)
        errors += int(((np.diff(counters) - 1) % 16 != 0).sum())
    mine = (pid == stream) & (control & 1 > 0) if stream is not None else np.zeros(len(rows), bool)
    rows, starts, number, control = rows[mine], np.minimum(starts[mine], PACKET), number[mine], control[mine]
    data = rows[np.arange(PACKET) >= starts[:, None]]
    ends = np.cumsum(PACKET - starts)
    first = np.flatnonzero(rows[:, 1] & 0x40)
    begin = ends[first] - (PACKET - starts[first])
    parts, points = [], []
    for k, at in enumerate(begin.tolist()):
        pes = data[at : begin[k + 1] if k + 1 < len(begin) else len(data)]
        if len(pes) < 14 or pes[:3].tobytes() != b"\0\0\1":
            errors += 1
            continue
        size, head = int(pes[4]) << 8 | int(pes[5]), 9 + int(pes[8])
        p = [int(x) for x in pes[9:14]]
        pts = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1 if pes[7] & 0x80 else None
        random_access = bool(control[first[k]] & 2 and rows[first[k], 4] and rows[first[k], 5] & 0x40)
        parts.append(pes[head : 6 + size if size else len(pes)].tobytes())
        points.append({"packet": int(number[first[k]]), "pts": pts, "random_access": random_access})
    return b"".join(parts), len(media or b"") // PACKET, len(programs), stream, len(parts), errors, bad, points


def mux(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of ``docs(doc_id, text)``: the UTF-8 of each whole text, padded with bytes 255 to a
    positive multiple of 576, as a transport stream. A null text is empty; repeated rows stay; equal texts give equal streams.
    """

    def run(batches):
        for part in slices(batches):
            data = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, data), pa.int64()), pa.array([mux_bytes(padded(d)) for d in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STREAMS)


def demux(streams: DataFrame) -> DataFrame:
    """``PARSED`` columns of ``streams(doc_id, media)`` and its other columns, each under its own name; one that is named as a parsed column comes back as ``given_`` and its name.

    A null or damaged stream gives what can be read, with its errors counted.
    """
    parsed = {"payload", "packets", "programs", "stream_pid", "pes", "continuity_errors", "table_errors", "access_points"}
    streams = streams.withColumnsRenamed({c: f"given_{c}" for c in streams.columns if c in parsed})
    rest = [f for f in streams.schema.fields if f.name not in ("doc_id", "media")]

    def run(batches):
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("packet", pa.int64()), ("pts", pa.int64()), ("random_access", pa.bool_())]))]
        names = ["payload", "packets", "programs", "stream_pid", "pes", "continuity_errors", "table_errors", "access_points"]
        for part in slices(batches):
            found = list(zip(*map(demux_bytes, part.column("media").to_pylist()), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True)), part.column("media"), *(part.column(f.name) for f in rest)], ["doc_id", *names, "media", *(f.name for f in rest)])

    return streams.mapInArrow(run, PARSED + ", media binary" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest))


def query(docs: DataFrame) -> DataFrame:
    """The digest of the streams read back, under its contract."""
    points = F.col("access_points")
    feature = F.concat_ws(
        ";",
        *(F.concat(F.lit(f"{label}="), value.cast("string")) for label, value in (
            ("packets", F.col("packets")), ("programs", F.col("programs")), ("pid", F.col("stream_pid")), ("pes", F.col("pes")),
            ("continuity_errors", F.col("continuity_errors")), ("table_errors", F.col("table_errors")),
            ("random_access", F.size(F.filter(points, lambda x: x["random_access"]))),
            ("first_pts", F.element_at(points, 1)["pts"]), ("last_pts", F.element_at(points, -1)["pts"]),
        )),
    )
    return demux(mux(docs)).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
