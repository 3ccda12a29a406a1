"""A versioned key-value store: runs in Parquet, a manifest, and a write-ahead log.

Single writes go to the log and wait in buffers of bounded size and number; batches of rows become
runs at once, without passing the driver. A flush writes each waiting buffer, oldest first, as a
sorted run at level 0. Reads see runs and buffers together and take the highest sequence number of
a key, so neither the order of files nor a repeated replay matters.

Maintenance only adds files. Those that a version no longer names stay for readers that still use
them, until ``vacuum`` removes the ones that are old enough.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Closed, InvalidArgument, SnapshotLost
from ..functions.keys import check_op, check_seq, versions_first
from ..functions.shared import checkpoint
from ..model import DELETE, LOG_SCHEMA, MAX_KEY_BYTES, MAX_SEQ, PUT, Options, check_key
from ..operators import compaction, reads
from ..operators.layout import writer_options
from . import wal
from .buffers import Buffers
from .files import Folder
from .manifest import Manifest, Run, Version

#: How long files that no version names are kept for readers, unless ``vacuum`` is told otherwise.
KEEP_HOURS = 24.0


class KVStore:
    """One keyspace under one folder; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, uri: str, options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        self.folder = Folder(spark, uri)
        self.manifest = Manifest(spark, self.folder)
        for name in ("manifest", "state", "wal", "runs"):
            self.folder.make(name)
        self.version: Version = self.manifest.read()
        self.closed = False
        self._replay()

    open = classmethod(lambda cls, spark, uri, options=None: cls(spark, uri, options))

    def _replay(self) -> None:
        """Take what the log holds beyond the last flush; repeated entries do no harm."""
        seen: dict[tuple[bytes, int], wal.Entry] = {}
        for name in self.folder.names("wal"):
            if not name.startswith("."):
                for e in wal.replay(self.folder.read("wal", name)):
                    if e[1] > self.version.flushed_seq:
                        seen[e[:2]] = e
        waiting = sorted(seen.values(), key=lambda e: e[1])
        self.buffers = Buffers(self.options.write_buffer_size, self.options.max_pending_runs, waiting)
        self.next_seq = max(self.version.next_seq, waiting[-1][1] + 1 if waiting else 1)

    def _check(self) -> None:
        if self.closed:
            raise Closed("the store is closed")

    # writes

    def put(self, key: bytes, value: bytes) -> int:
        """Set a key; returns the sequence number of the write."""
        return self._write([(key, PUT, bytes(value))])

    def delete(self, key: bytes) -> int:
        """Remove a key; a key that isn't there gets a tombstone all the same."""
        return self._write([(key, DELETE, b"")])

    def write_many(self, changes: list[tuple[bytes, int, bytes]]) -> int:
        """Several changes (key, op, value) in one log record; returns the last sequence number."""
        return self._write(changes)

    def _write(self, changes) -> int:
        self._check()
        entries = [(check_key(k), self.next_seq + n, op, v if op == PUT else b"") for n, (k, op, v) in enumerate(changes)]
        if not entries:
            return self.next_seq - 1
        if entries[-1][1] > MAX_SEQ:
            raise InvalidArgument("sequence numbers are used up")
        self.folder.write_new(wal.encode_log(entries), "wal", f"{entries[0][1]:020d}.log")
        self.next_seq = entries[-1][1] + 1
        self.buffers.add(entries)
        if self.buffers.should_rotate():
            self.buffers.rotate()
            while self.buffers.at_capacity():
                self.flush_oldest()
            self._compact_by_itself()
        return entries[-1][1]

    def put_df(self, df: DataFrame, order: list[str]) -> int:
        """Put rows of key and value, in the order of ``order``; returns the last sequence number."""
        return self.apply_df(df.withColumn("op", F.lit(PUT)), order)

    def delete_df(self, keys: DataFrame, order: list[str] | None = None) -> int:
        """Delete the keys of a table with a column key."""
        return self.apply_df(keys.withColumns({"op": F.lit(DELETE), "value": F.lit(b"")}), order or ["key"])

    def apply_df(self, df: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> int:
        """Apply rows of key, op, value as one run at level 0.

        ``batch`` is a stream's name and the batch's number in it; they are committed with the run,
        and a batch that was committed before is left out.

        Sequence numbers follow ``order``, which should be total: rows are range-partitioned and
        sorted by it, and each partition starts at the count of those before it. The driver sees
        one count for each partition.
        """
        self._check()
        if batch and self.version.batches.get(batch[0], -1) >= batch[1]:
            return self.next_seq - 1
        done = [{"edit": "batch", "stream": batch[0], "batch": batch[1]}] if batch else []
        self.flush()
        rows = df.select(F.struct(*order).alias("o"), F.col("key").cast("binary").alias("key"), check_op(F.col("op").cast("int")).alias("op"), F.col("value").cast("binary").alias("value"))
        long = F.raise_error(F.lit(f"a key has at most {MAX_KEY_BYTES} bytes"))
        rows = rows.withColumn("key", F.when(F.octet_length("key") <= MAX_KEY_BYTES, F.col("key")).otherwise(long.cast("binary")))
        rows = rows.repartitionByRange("o").sortWithinPartitions("o").drop("o").withColumn("id", F.monotonically_increasing_id())
        rows = checkpoint(rows)
        part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
        counts = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect())
        if not counts:
            if done:
                self._commit(done)
            return self.next_seq - 1
        base, first = self.next_seq, {}
        for p, n in counts:
            first[p] = base
            base += n
        starts = self.spark.createDataFrame(list(first.items()), "p long, first long")
        log = rows.withColumn("p", part).join(F.broadcast(starts), "p").withColumn("seq", check_seq(F.col("first") + place))
        value = F.when(F.col("op") == PUT, F.coalesce("value", F.lit(b""))).otherwise(F.lit(b""))
        run = self._write_run(log.select("key", "seq", "op", value.alias("value")), 0, sum(n for _, n in counts))
        self.next_seq = base
        self._commit([run.edit(), {"edit": "next_seq", "seq": base}, {"edit": "flushed_seq", "seq": base - 1}, *done])
        self._compact_by_itself()
        return base - 1

    def flush(self) -> None:
        """Seal the open buffer and write all that wait, oldest first."""
        self._check()
        self.buffers.rotate()
        while self.flush_oldest():
            pass
        self._compact_by_itself()

    def flush_oldest(self) -> bool:
        """Write the buffer sealed first as a run at level 0 and commit it; false if none waits.

        Log files all of whose entries are flushed are dropped after the commit.
        """
        self._check()
        entries = self.buffers.oldest()
        if entries is None:
            return False
        run = self._write_run(self.spark.createDataFrame(entries, LOG_SCHEMA), 0, len(entries))
        self._commit([run.edit(), {"edit": "next_seq", "seq": self.next_seq}, {"edit": "flushed_seq", "seq": entries[-1][1]}])
        self.buffers.pop_oldest()
        for name in self.folder.names("wal"):
            # a file holds whole writes and its name is its first number; a write isn't cut by buffers
            if not name.startswith(".") and int(name.removesuffix(".log")) <= self.version.flushed_seq:
                self.folder.delete("wal", name)
        return True

    def _compact_by_itself(self) -> None:
        while self.options.auto_compact and self.maybe_compact():
            pass

    def _write_run(self, log: DataFrame, level: int, entries: int | None, ranged: bool = False) -> Run:
        """Sort a log into a run: ranges of keys, each in internal-key order. ``ranged`` if it lies in ranges already."""
        name = f"run-{uuid.uuid4().hex}"
        path = self.folder.uri("runs", name)
        parted = log if ranged else self._in_ranges(log)
        writer = parted.sortWithinPartitions(*versions_first()).write
        writer.options(**writer_options(self.options.compression, entries)).mode("error").parquet(path)
        return self._describe(name, level)

    def _in_ranges(self, log: DataFrame) -> DataFrame:
        n = self.options.run_partitions
        return log.repartitionByRange(n, "key") if n else log.repartitionByRange("key")

    def _describe(self, name: str, level: int) -> Run:
        """A written run's size and bounds."""
        stats = reads.run_stats(self.spark.read.schema(LOG_SCHEMA).parquet(self.folder.uri("runs", name))).first()
        return Run(
            name, level, self.folder.size("runs", name), stats["entries"], stats["tombstones"] or 0, bytes(stats["min_key"] or b""),
            bytes(stats["max_key"] or b""), stats["min_seq"] or 0, stats["max_seq"] or 0,
        )

    def _commit(self, edits: list[dict]) -> None:
        self.version = self.manifest.commit(self.version, edits)

    # reads

    @property
    def last_seq(self) -> int:
        """The last committed sequence number: the id of the current snapshot."""
        return self.next_seq - 1

    def _runs(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(*[self.folder.uri("runs", r.path) for r in runs])

    def log(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """All stored versions; runs that hold no key in [start, end) aren't opened."""
        self._check()
        some = self._runs([r for r in self.version.runs.values() if r.meets(start, end)])
        waiting = self.buffers.entries()
        return some.unionByName(self.spark.createDataFrame(waiting, LOG_SCHEMA)) if waiting else some

    def layers(self) -> list[DataFrame]:
        """Runs, then waiting buffers, the open one last: the highest layer with a key has its newest entry."""
        self._check()
        runs = sorted(self.version.runs.values(), key=lambda r: r.max_seq)
        return [self._runs([r]) for r in runs] + [self.spark.createDataFrame(x, LOG_SCHEMA) for x in self.buffers.layers()]

    def _snapshot(self, as_of: int | None) -> int | None:
        if as_of is not None and as_of < self.version.min_snapshot:
            raise SnapshotLost(f"snapshots before {self.version.min_snapshot} were compacted away")
        return as_of

    def get(self, key: bytes, as_of: int | None = None) -> bytes | None:
        """A key's value, or None. What waits is newer than any run, so a buffer's answer is final."""
        self._check()
        waiting = self.buffers.get(key, self._snapshot(as_of))
        if waiting is not None:
            return waiting[1]
        row = reads.get_state(self.log(key, key + b"\0"), key, self._snapshot(as_of)).first()
        return bytes(row["value"]) if row["state"] == "value" else None

    def multi_get(self, keys: DataFrame, as_of: int | None = None) -> DataFrame:
        return reads.multi_get(self.log(), keys, self._snapshot(as_of))

    def scan(self, start: bytes, end: bytes, as_of: int | None = None) -> DataFrame:
        """Live keys with start <= key < end, in key order."""
        return reads.scan(self.log(start, end), start, end, self._snapshot(as_of))

    def history(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return reads.history(self.log(start, end), start, end)

    # maintenance

    def refresh_current(self) -> DataFrame:
        """Merge what is newer than the current-snapshot table into a new one, tombstones too, and return it.

        Only runs with later entries are read beside the old table. Rows lie in ranges of keys
        before they are merged, so one exchange serves the merge and the order of the file.
        """
        self.flush()
        old, seq = self.version.current, self.version.current_seq
        later = self._runs([r for r in self.version.runs.values() if r.max_seq > seq]).where(F.col("seq") > seq)
        log = later.unionByName(self._table(old)) if old else later
        name = f"current-{uuid.uuid4().hex}"
        merged = reads.latest(self._in_ranges(log)).sortWithinPartitions("key")
        merged.write.options(**writer_options(self.options.compression)).parquet(self.folder.uri("runs", name))
        self._commit([{"edit": "current", "path": name, "seq": self.last_seq}])
        return self._table(name)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.folder.uri("runs", name))

    def seal_current(self) -> None:
        """Make the current-snapshot table a run of level 1. Its entries repeat others, which does no harm."""
        name = self.version.current
        if name is None:
            return
        edits = [{"edit": "current", "path": None}]
        if not self._table(name).isEmpty():
            edits.insert(0, self._describe(name, 1).edit())
        self._commit(edits)

    def maybe_compact(self) -> bool:
        """Compact the level that most needs it, if one does."""
        level = compaction.choose(self.version.sizes())
        if level is None:
            return False
        self.compact_level(level)
        return True

    def compact_level(self, level: int) -> None:
        """Merge a level with the runs below that it overlaps into one run of the next level.

        Tombstones go if no deeper run may hold their keys, and only those that the
        current-snapshot table has seen. Older versions go in any case, so snapshots before the
        newest merged entry can't be read any more. Rows are put into ranges of keys and merged
        there, so one exchange serves the merge and the order of the run. The merged runs' files
        stay until ``vacuum``.
        """
        self._check()
        top = self.version.at_level(level)
        if not top:
            return
        low, high = min(r.min_key for r in top), max(r.max_key for r in top)
        meets = lambda r: r.min_key <= high and r.max_key >= low
        below = [r for r in self.version.at_level(level + 1) if meets(r)]
        chosen = top + below
        low, high = min(r.min_key for r in chosen), max(r.max_key for r in chosen)
        names = {r.path for r in chosen}
        others = [r for r in self.version.runs.values() if r.path not in names and meets(r)]
        merged = compaction.compact(self._in_ranges(self._runs(chosen)), drop_tombstones=False)
        if not others:
            unseen = F.col("seq") > self.version.current_seq if self.version.current else F.lit(False)
            merged = merged.where((F.col("op") == PUT) | unseen)
        run = self._write_run(merged, level + 1, sum(r.entries for r in chosen), ranged=True)
        edits = [{"edit": "remove", "path": r.path} for r in chosen]
        if run.entries:
            edits.append(run.edit())
        edits.append({"edit": "min_snapshot", "seq": max(r.max_seq for r in chosen)})
        self._commit(edits)

    def vacuum(self, keep_hours: float = KEEP_HOURS) -> list[str]:
        """Remove files of runs that the newest version doesn't name and that are older than so many hours.

        Readers that began before may still use younger ones, and writers may be at work on them.
        """
        self._check()
        now = self.manifest.read()
        gone = [
            n for n in self.folder.names("runs") if n not in now.runs and n != now.current and self.folder.age_ms("runs", n) >= keep_hours * 3_600_000
        ]
        for name in gone:
            self.folder.delete("runs", name)
        return gone

    def close(self) -> None:
        """Stop using the store. What waits stays in the log and is replayed on the next open."""
        self.closed = True

    def __enter__(self) -> "KVStore":
        return self

    def __exit__(self, *_) -> None:
        self.close()
