"""Framed record logs (binary segments) to bronze rows.

A segment is a sequence of frames: magic, version, header, payload, and a
CRC-32C of both.  A whole segment file is one row that Spark reads; a task
walks through its frames.  What follows the last sound frame is a fault with
its offset (``incomplete`` for a torn tail), never skipped silently."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the frame layout, big-endian: version, header length, flags, stream, connection, sequence, wall time, monotonic time, payload length.
_VERSION = 2
_HEADER = struct.Struct(">HHIIQQqQI")
_CRC = struct.Struct(">I")
LARGEST_PAYLOAD = 16 * 1024 * 1024

SCHEMA = (
    "path string, offset long, stream_id long, connection_epoch long, record_sequence long, receive_wall_time_ns long, receive_monotonic_ns long, payload binary, fault string"
)


def _table(polynomial: int = 0x82F63B78) -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (polynomial if byte & 1 else 0)
        out.append(byte)
    return out


_TABLE = _table()


def crc32c(data: bytes, start: int = 0) -> int:
    """Castagnoli CRC of ``data``, continued from ``start``."""
    crc, table = start ^ 0xFFFFFFFF, _TABLE
    for byte in data:
        crc = crc >> 8 ^ table[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF


@dataclass
class Frame:
    stream_id: int
    connection_epoch: int
    record_sequence: int
    receive_wall_time_ns: int
    receive_monotonic_ns: int
    payload: bytes


def encode(frame: Frame, magic: bytes) -> bytes:
    size = len(magic) + _HEADER.size + _CRC.size
    head = magic + _HEADER.pack(
        _VERSION, size, 0, frame.stream_id, frame.connection_epoch, frame.record_sequence, frame.receive_wall_time_ns, frame.receive_monotonic_ns, len(frame.payload)
    )
    head += _CRC.pack(crc32c(head))
    body = head + frame.payload
    return body + _CRC.pack(crc32c(body))


def frames(data: bytes, magic: bytes) -> Iterator[tuple[int, Frame | None, str | None]]:
    """Offset and frame of each sound frame; the first fault ends the walk."""
    size = len(magic) + _HEADER.size + _CRC.size
    at = 0
    while at < len(data):
        head = data[at : at + size]
        if len(head) < size:
            yield at, None, "incomplete" if magic.startswith(head[: len(magic)]) or head.startswith(magic) else "invalid_magic"
            return
        version, length, flags, stream, connection, sequence, wall, monotonic, n = _HEADER.unpack_from(head, len(magic))
        fault = (
            "invalid_magic" if not head.startswith(magic)
            else "unsupported_version" if version != _VERSION
            else "invalid_header_length" if length != size
            else "unsupported_flags" if flags
            else "header_checksum" if _CRC.unpack(head[-_CRC.size :])[0] != crc32c(head[: -_CRC.size])
            else "payload_too_large" if n > LARGEST_PAYLOAD
            else "incomplete" if at + size + n + _CRC.size > len(data)
            else None
        )
        if fault is None and _CRC.unpack_from(data, at + size + n)[0] != crc32c(data[at : at + size + n]):
            fault = "frame_checksum"
        if fault:
            yield at, None, fault
            return
        yield at, Frame(stream, connection, sequence, wall, monotonic, data[at + size : at + size + n]), None
        at += size + n + _CRC.size


def read_segments(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """Rows of all segments under ``path``; a row with a ``fault`` has no payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 6, pa.binary(), pa.string()]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for at, f, fault in frames(data, magic):
                    row = (f.stream_id, f.connection_epoch, f.record_sequence, f.receive_wall_time_ns, f.receive_monotonic_ns, f.payload) if f else (None,) * 6
                    held.append((name, at, *row, fault))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
