"""The data model: a change log of key, seq, op, value, and a store's options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import CompressionError, InvalidArgument

PUT, DELETE = 0, 1
#: Sequence numbers have 56 bits; a key and its 8-byte trailer fit in 65,535 bytes.
MAX_SEQ = (1 << 56) - 1
MAX_KEY_BYTES = 65_535 - 8
CODECS = ("none", "snappy", "zstd")

LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), False),
    ]
)


@dataclass(frozen=True)
class Options:
    """A buffer of pending changes is sealed at ``write_buffer_size`` bytes; when ``max_pending_runs``
    sealed ones wait, the oldest is flushed."""

    write_buffer_size: int = 64 << 20
    max_pending_runs: int = 2
    compression: str = "none"
    run_partitions: int | None = None
    auto_compact: bool = True

    def __post_init__(self):
        if self.write_buffer_size < 1 or self.max_pending_runs < 1:
            raise InvalidArgument("write_buffer_size and max_pending_runs are at least 1")
        if self.compression not in CODECS:
            raise CompressionError(f"unknown codec {self.compression!r}; known: {', '.join(CODECS)}")


def check_key(key: bytes) -> bytes:
    if not isinstance(key, (bytes, bytearray)):
        raise InvalidArgument("keys are bytes")
    if len(key) > MAX_KEY_BYTES:
        raise InvalidArgument(f"a key has at most {MAX_KEY_BYTES} bytes")
    return bytes(key)


def entry_size(key: bytes, value: bytes) -> int:
    """What an entry adds to the pending size."""
    return len(key) + 8 + len(value)
