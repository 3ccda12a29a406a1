"""Errors of the engine. A missing key is None and not an error."""


class StoreError(Exception):
    """Any failure of a store."""


class CorruptionError(StoreError):
    """Stored bytes that can't be what was written."""


class InvalidArgument(StoreError, ValueError):
    """A call that can't be carried out as asked."""


class CompressionError(StoreError):
    """An unknown codec."""


class Closed(StoreError):
    """The store was closed."""


class SnapshotLost(StoreError):
    """Versions older than this snapshot were compacted away."""
