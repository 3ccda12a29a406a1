"""The write-ahead log's frames: type, length, payload, CRC-32; and the entries in them.

A frame is one byte of type, four of length, the payload, four of checksum of the payload; numbers
are little-endian. A payload is an encoded internal key and a value, each after its length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptionError
from ..functions import keys
from ..model import DELETE, LOG_SCHEMA, MAX_SEQ, PUT

#: Frame types; only whole entries are written.
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
_HEAD, _U32, _U64 = struct.Struct("<BI"), struct.Struct("<I"), struct.Struct(">Q")

Entry = tuple[bytes, int, int, bytes]


def encode_key(key: bytes, seq: int, op: int) -> bytes:
    if not 0 <= seq <= MAX_SEQ or op not in (PUT, DELETE):
        raise CorruptionError(f"no such entry: seq {seq}, op {op}")
    return key + _U64.pack(seq << 8 | op)


def decode_key(data: bytes) -> tuple[bytes, int, int]:
    if len(data) < 8:
        raise CorruptionError("an internal key has at least 8 bytes")
    number = _U64.unpack(data[-8:])[0]
    if number & 255 not in (PUT, DELETE):
        raise CorruptionError(f"unknown op {number & 255}")
    return data[:-8], number >> 8, number & 255


def encode_entry(entry: Entry) -> bytes:
    key, seq, op, value = entry
    inner = encode_key(key, seq, op)
    return _U32.pack(len(inner)) + inner + _U32.pack(len(value)) + value


def decode_entry(data: bytes) -> Entry:
    try:
        n = _U32.unpack_from(data)[0]
        inner = data[4 : 4 + n]
        size = _U32.unpack_from(data, 4 + n)[0]
    except struct.error as e:
        raise CorruptionError("an entry ends too early") from e
    value = data[8 + n : 8 + n + size]
    if len(inner) != n or len(value) != size:
        raise CorruptionError("an entry ends too early")
    return (*decode_key(inner), value)


def frame(payload: bytes, kind: int = FULL) -> bytes:
    return _HEAD.pack(kind, len(payload)) + payload + _U32.pack(zlib.crc32(payload))


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Frames up to the first that is torn or whose checksum is wrong: there the log ends."""
    at = 0
    while at + 5 <= len(data):
        kind, n = _HEAD.unpack_from(data, at)
        payload, tail = data[at + 5 : at + 5 + n], data[at + 5 + n : at + 9 + n]
        if len(payload) < n or len(tail) < 4 or _U32.unpack(tail)[0] != zlib.crc32(payload) or not FULL <= kind <= LAST:
            return
        yield kind, payload
        at += 9 + n


def encode_log(entries: list[Entry]) -> bytes:
    return b"".join(frame(encode_entry(e)) for e in entries)


def replay(data: bytes) -> Iterator[Entry]:
    """The entries of a log, in order."""
    for kind, payload in frames(data):
        if kind == FULL:
            yield decode_entry(payload)


def write_segments(log: DataFrame, path: str, entries: int = 1000) -> None:
    """Write a change log as segments of so many sequence numbers each: rows of segment and data, its frames.

    Frames are made by expressions; a task then lays those of a segment end to end.
    """
    assert entries > 0
    rows = log.select(F.floor(F.col("seq") / entries).cast("long").alias("segment"), "seq", keys.frame("key", "seq", "op", "value").alias("frame"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for segment, data in zip(batch.column("segment").to_pylist(), batch.column("frame").to_pylist()):
                if segment != now and held:
                    yield pa.record_batch({"segment": pa.array([now], pa.int64()), "data": pa.array([b"".join(held)], pa.binary())})
                    held = []
                now = segment
                held.append(data)
        if held:
            yield pa.record_batch({"segment": pa.array([now], pa.int64()), "data": pa.array([b"".join(held)], pa.binary())})

    rows = rows.repartition("segment").sortWithinPartitions("segment", "seq")
    rows.select("segment", "frame").mapInArrow(joined, "segment long, data binary").write.mode("error").parquet(path)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            found = list(replay(data or b""))
            columns = zip(*found) if found else ([], [], [], [])
            kinds = (pa.binary(), pa.int64(), pa.int8(), pa.binary())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["key", "seq", "op", "value"])


def replay_segments(segments: DataFrame) -> DataFrame:
    """The entries of segments (a column data); each segment ends at its first torn or damaged frame."""
    return segments.select("data").mapInArrow(_entries, LOG_SCHEMA)


def replay_files(spark: SparkSession, pattern: str) -> DataFrame:
    """The entries of a store's log files, read by the executors; ``pattern`` is a folder or a glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(pattern)
    return replay_segments(files.select(F.col("content").alias("data")))
