"""A store that is held against a plain dictionary at every step."""

from __future__ import annotations

from .store import KVStore


class Mismatch(AssertionError):
    """The store and the dictionary disagree."""


class CheckedStore:
    """Applies each call to a store and to a dictionary and compares what they answer."""

    def __init__(self, store: KVStore):
        self.store, self.plain = store, dict[bytes, bytes]()

    def put(self, key: bytes, value: bytes) -> None:
        self.store.put(key, value)
        self.plain[key] = value

    def delete(self, key: bytes) -> None:
        self.store.delete(key)
        self.plain.pop(key, None)

    def flush(self) -> None:
        self.store.flush()

    def get(self, key: bytes) -> bytes | None:
        got, expected = self.store.get(key), self.plain.get(key)
        if got != expected:
            raise Mismatch(f"get({key!r}) gave {got!r}, not {expected!r}")
        return got

    def verify_scan(self, start: bytes, end: bytes) -> int:
        """Compare a range, order included; returns the number of pairs."""
        got = [(bytes(r["key"]), bytes(r["value"])) for r in self.store.scan(start, end).collect()]
        expected = sorted((k, v) for k, v in self.plain.items() if start <= k < end)
        for n, (a, b) in enumerate(zip(got, expected)):
            if a != b:
                raise Mismatch(f"scan({start!r}, {end!r}) gave {a!r} at place {n}, not {b!r}")
        if len(got) != len(expected):
            raise Mismatch(f"scan({start!r}, {end!r}) gave {len(got)} pairs, not {len(expected)}")
        return len(got)
