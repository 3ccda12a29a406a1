import io
import random

import pytest
from pyspark.sql import functions as F

from tidelog import cli
from tidelog.errors import Closed, InvalidArgument, SnapshotLost, StoreError
from tidelog.model import DELETE, PUT, Options
from tidelog.sources import manifest
from tidelog.sources.checked import CheckedStore, Mismatch
from tidelog.sources.files import Folder
from tidelog.sources.store import KVStore
from tidelog.sources.wal import replay_files
from tidelog.streaming.ingest import apply_batch, ingest, latest_state

QUIET = Options(run_partitions=1, auto_compact=False)


def scanned(store, start=b"", end=b"\xff\xff", as_of=None):
    return [(bytes(r["key"]), bytes(r["value"])) for r in store.scan(start, end, as_of).collect()]


def test_put_get_delete_reopen(spark, tmp_path):
    with KVStore.open(spark, str(tmp_path), QUIET) as store:
        store.put(b"k", b"v1")
        store.put(b"k", b"v2")
        store.put(b"empty", b"")
        store.delete(b"ghost")
        assert store.get(b"k") == b"v2" and store.get(b"empty") == b"" and store.get(b"ghost") is None
        assert scanned(store) == [(b"empty", b""), (b"k", b"v2")]
        assert scanned(store, as_of=1) == [(b"k", b"v1")]
    with pytest.raises(Closed):
        store.get(b"k")
    with KVStore.open(spark, str(tmp_path), QUIET) as store:
        assert scanned(store) == [(b"empty", b""), (b"k", b"v2")] and store.last_seq == 4
        store.flush()
        store.delete(b"k")
        assert store.get(b"k") is None
    with KVStore.open(spark, str(tmp_path), QUIET) as store:
        assert scanned(store) == [(b"empty", b"")]
        store.flush()
        assert scanned(store) == [(b"empty", b"")] and store.put(b"z", b"1") == 6


def test_random_changes_against_a_dict(spark, tmp_path):
    rng = random.Random(42)
    store, plain = KVStore.open(spark, str(tmp_path), QUIET), {}
    for step in range(7):
        changes = []
        for _ in range(60):
            key = f"rnd{rng.randrange(50):04}".encode()
            if rng.random() < 0.75:
                value = f"val_{rng.getrandbits(32)}".encode()
                changes.append((key, PUT, value))
                plain[key] = value
            else:
                changes.append((key, DELETE, b""))
                plain.pop(key, None)
        store.write_many(changes)
        if step == 1:
            store.flush()
        elif step == 3:
            store = KVStore.open(spark, str(tmp_path), QUIET)
        elif step == 4:
            store.flush()
            store.compact_level(0)
        elif step == 5:
            store.refresh_current()
        assert scanned(store) == sorted(plain.items())
    probes = spark.createDataFrame([(f"rnd{k:04}".encode(),) for k in range(0, 60, 3)], "key binary")
    got = {bytes(r["key"]): bytes(r["value"]) for r in store.multi_get(probes).collect()}
    assert got == {k: v for k, v in plain.items() if int(k[3:]) % 3 == 0}


def test_compaction(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path), Options(run_partitions=1))
    for n in range(4):
        store.write_many([(f"k{k}".encode(), PUT, f"{n}".encode()) for k in range(5)] + [(b"gone", DELETE, b"")])
        store.flush()
    assert store.version.sizes().keys() == {1}  # four runs at level 0 were merged
    assert [r.tombstones for r in store.version.at_level(1)] == [0]
    assert scanned(store) == [(f"k{k}".encode(), b"3") for k in range(5)]
    with pytest.raises(SnapshotLost):
        store.scan(b"a", b"z", as_of=3)
    assert scanned(store, as_of=store.last_seq)[0] == (b"k0", b"3")
    store.delete(b"k1")
    store.flush()
    store.compact_level(0)
    assert [k for k, _ in scanned(store)] == [b"k0", b"k2", b"k3", b"k4"]
    # a tombstone stays while a deeper run may hold its key
    store.compact_level(1)
    store.delete(b"k2")
    store.flush()
    store.compact_level(0)
    assert [r.tombstones for r in store.version.at_level(1)] == [1]
    assert [k for k, _ in scanned(store)] == [b"k0", b"k3", b"k4"]


def test_batches(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path), Options(auto_compact=False, compression="zstd"))
    df = spark.range(500).select(F.format_string("k%05d", F.col("id") % 200).cast("binary").alias("key"), F.format_string("v%05d", "id").cast("binary").alias("value"), "id")
    assert store.put_df(df.repartition(5), ["id"]) == 500
    assert store.delete_df(df.where("id % 7 = 0 and id < 200").select("key")) == 529
    expected = {f"k{i % 200:05}".encode(): f"v{i:05}".encode() for i in range(500) if i % 200 % 7}
    assert scanned(store) == sorted(expected.items())
    assert store.history(b"k00001", b"k00002").select("seq").collect() == store.log().where(F.col("key") == b"k00001").orderBy(F.col("seq").desc()).select("seq").collect()
    assert store.put_df(df.where("false"), ["id"]) == 529


def test_limits_and_writers(spark, tmp_path):
    one, two = (KVStore.open(spark, str(tmp_path), QUIET) for _ in range(2))
    with pytest.raises(InvalidArgument):
        one.put(b"x" * 65_528, b"")
    one.put(b"a", b"1")
    with pytest.raises(StoreError):
        two.put(b"b", b"2")
    small = KVStore.open(spark, str(tmp_path / "small"), Options(write_buffer_size=40, max_pending_runs=1, run_partitions=1, auto_compact=False))
    for n in range(4):
        small.put(f"key{n}".encode(), b"0123456789")
    assert len(small.version.runs) == 2 and len(scanned(small)) == 4


def test_sealed_buffers_wait_and_drain_oldest_first(spark, tmp_path):
    options = Options(write_buffer_size=40, max_pending_runs=3, run_partitions=1, auto_compact=False)
    store = KVStore.open(spark, str(tmp_path), options)
    for n in range(4):
        store.put(f"key{n % 3}".encode(), b"0123456789")
    assert store.buffers.sealed_count == 2 and not store.version.runs and not store.buffers.at_capacity()
    assert store.get(b"key0") == b"0123456789" and store.get(b"key0", as_of=0) is None
    assert [x.count() for x in store.layers()] == [2, 2]
    store.delete(b"key1")
    assert store.get(b"key1") is None and store.get(b"key1", as_of=2) == b"0123456789"
    assert store.flush_oldest() and store.buffers.sealed_count == 1
    assert [(r.min_seq, r.max_seq) for r in store.version.runs.values()] == [(1, 2)] and store.version.flushed_seq == 2
    assert len(store.folder.names("wal")) == 3  # those of what still waits
    again = KVStore.open(spark, str(tmp_path), options)
    assert scanned(again) == scanned(store) == [(b"key0", b"0123456789"), (b"key2", b"0123456789")]
    store.put(b"key3", b"0123456789")
    store.put(b"key4", b"0123456789")
    store.put(b"key5", b"0123456789")
    store.put(b"key6", b"0123456789")
    assert store.buffers.sealed_count == 2 and len(store.version.runs) == 2  # the third sealed one made the oldest go
    store.flush()
    assert store.buffers.sealed_count == 0 and store.folder.names("wal") == [] and not store.flush_oldest()


def test_readers_outlive_maintenance(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path), QUIET)
    for n in range(3):
        store.write_many([(f"k{k}".encode(), PUT, f"{n}".encode()) for k in range(5)])
        store.flush()
    lazy, current = store.scan(b"a", b"z"), store.refresh_current()
    before = {r["key"]: r["value"] for r in current.collect()}
    store.delete(b"k1")
    again = store.refresh_current()
    store.compact_level(0)
    assert len(lazy.collect()) == 5 and {r["key"]: r["value"] for r in current.collect()} == before
    assert {(bytes(r["key"]), r["op"], r["seq"]) for r in again.collect()} == {(b"k1", DELETE, 16), *((f"k{k}".encode(), PUT, 11 + k) for k in (0, 2, 3, 4))}
    assert store.vacuum() == []
    assert len(store.vacuum(keep_hours=0)) == 5  # four runs and a table
    assert [k for k, _ in scanned(store)] == [b"k0", b"k2", b"k3", b"k4"] and again.count() == 5


def test_current_table_takes_up_later_entries_only(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path), QUIET)
    store.write_many([(b"a", PUT, b"1"), (b"b", PUT, b"2"), (b"c", PUT, b"3")])
    first = store.refresh_current()
    store.write_many([(b"b", DELETE, b""), (b"d", PUT, b"4")])
    store.flush()
    store.compact_level(0)  # keeps the tombstone that the table hasn't seen
    assert sum(r.tombstones for r in store.version.runs.values()) == 1
    second = store.refresh_current()
    rows = lambda df: sorted((bytes(r["key"]), r["seq"], r["op"]) for r in df.collect())
    assert rows(first) == [(b"a", 1, 0), (b"b", 2, 0), (b"c", 3, 0)]
    assert rows(second) == [(b"a", 1, 0), (b"b", 4, 1), (b"c", 3, 0), (b"d", 5, 0)]
    names = sorted(n for n in store.folder.names("runs"))
    store.refresh_current()
    assert rows(store._table(store.version.current)) == rows(second) and len(store.folder.names("runs")) == len(names) + 1


def test_a_batch_delivered_again_adds_nothing(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path), QUIET)
    df = spark.createDataFrame([(b"a", PUT, b"1", 1), (b"a", PUT, b"2", 2)], "key binary, op int, value binary, n int")
    apply = apply_batch(store, ["n"], "orders")
    apply(df, 0)
    apply(df, 0)
    apply(df.where("false"), 1)
    assert store.log().count() == 2 and store.last_seq == 2
    again = KVStore.open(spark, str(tmp_path), QUIET)
    apply_batch(again, ["n"], "orders")(df, 0)
    assert again.log().count() == 2
    apply_batch(again, ["n"], "orders")(df, 2)
    apply_batch(again, ["n"], "other")(df, 0)
    assert [r["seq"] for r in again.history(b"a", b"b").collect()] == [6, 5, 4, 3, 2, 1]


def test_manifest_starts_from_the_last_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "STATE_EVERY", 4)
    folder = Folder(spark, str(tmp_path))
    folder.make("manifest")
    folder.make("state")
    log, version = manifest.Manifest(spark, folder), manifest.Version()
    for n in range(10):
        run = manifest.Run(f"run-{n}", n % 2, n, n, 0, b"a", b"z", n, n)
        edits = [run.edit(), {"edit": "next_seq", "seq": n}, {"edit": "current", "path": f"c{n}", "seq": n}, {"edit": "batch", "stream": "s", "batch": n}]
        version = log.commit(version, edits + ([{"edit": "remove", "path": f"run-{n - 3}"}] if n > 2 else []))
    assert folder.names("state") == [f"{4:020d}", f"{8:020d}"] and log.read() == version and version.commits == 10
    for n in range(8):
        folder.delete("manifest", f"{n:020d}")
    assert log.read() == version
    with pytest.raises(StoreError):
        log.commit(manifest.Version(commits=9), [])


def test_filter_skips_absent_keys(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path), QUIET)
    rows = spark.range(50_000).select(F.format_string("k%08d", F.col("id") * 2).cast("binary").alias("key"), F.lit(b"v").alias("value"), "id")
    store.put_df(rows, ["id"])

    def read(key):
        df = store.log(key, key + b"\0").where(F.col("key") == key)
        n = len(df.collect())
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return n, leaves.apply(0).metrics().apply("numOutputRows").value()

    hits, misses = [read(b"k%08d" % (2 * n)) for n in (7, 12_345, 49_999)], [read(b"k%08d" % (2 * n + 1)) for n in range(100, 40_000, 4000)]
    assert all(n == 1 and rows >= 1 for n, rows in hits) and all(n == 0 for n, _ in misses)
    # bounds of the files and pages can't tell odd keys; only the filter can, and it errs at one in a hundred
    assert sum(rows > 0 for _, rows in misses) <= 2


def test_torn_log_tail_ends_the_replay(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path), QUIET)
    store.write_many([(b"a", PUT, b"1"), (b"b", PUT, b"2")])
    name = store.folder.names("wal")[0]
    data = store.folder.read("wal", name)
    store.folder.delete("wal", name)
    store.folder.write_new(data[:-2], "wal", name)
    store.folder.write_new(data, "wal", "00000000000000000000.log")  # and the same entries once more
    assert scanned(KVStore.open(spark, str(tmp_path), QUIET)) == [(b"a", b"1"), (b"b", b"2")]


def test_stream_makes_runs(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(f"k{n % 10}".encode(), PUT if n % 4 else DELETE, f"{n}".encode(), n) for n in range(60)]
    for at in range(0, 60, 20):
        spark.createDataFrame(rows[at : at + 20], "key binary, op int, value binary, n int").coalesce(1).write.mode("append").parquet(str(source))
    store = KVStore.open(spark, str(tmp_path / "db"), QUIET)
    stream = spark.readStream.schema("key binary, op int, value binary, n int").option("maxFilesPerTrigger", 1).parquet(str(source))
    ingest(stream, store, ["n"], str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(120)
    assert len(store.version.runs) == 3
    plain = {}
    for k, op, v, _ in rows:
        plain[k] = v if op == PUT else None
    assert scanned(store) == sorted((k, v) for k, v in plain.items() if v is not None)


def test_continuous_latest_state(spark, tmp_path):
    entries = [(f"k{n % 7}", n + 1, n % 3 == 0 and 1 or 0, f"{n}") for n in range(50)]
    random.Random(1).shuffle(entries)
    for at in range(0, 50, 25):
        spark.createDataFrame(entries[at : at + 25], "key string, seq long, op int, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, op int, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = latest_state(stream).writeStream.outputMode("complete").format("memory").queryName("latest_view").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["key"]: (r["seq"], r["op"], r["value"]) for r in spark.table("latest_view").collect()}
    assert got == {k: max((s, o, v) for x, s, o, v in entries if x == k) for k in {e[0] for e in entries}}


def test_command_line(spark, tmp_path):
    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        code = cli.main([str(tmp_path), *args], spark, out, err)
        return code, out.getvalue()

    assert run("put", "hello", "world") == (0, "OK\n")
    assert run("get", "hello") == (0, "world\n")
    assert run("get", "none") == (0, "(not found)\n")
    assert run("put", "a", "1")[0] == 0 and run("scan", "a", "i") == (0, "a = 1\nhello = world\n")
    assert run("flush") == (0, "flushed\n") and run("delete", "hello") == (0, "OK\n")
    assert run("scan", "a", "z") == (0, "a = 1\n")
    assert run("nothing")[0] == 1 and run("put", "a")[0] == 1 and cli.main(["only"], spark, err=io.StringIO()) == 1


def test_current_snapshot_can_be_sealed(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path), QUIET)
    store.seal_current()
    store.write_many([(b"a", PUT, b"1"), (b"b", PUT, b"2"), (b"a", PUT, b"3"), (b"b", DELETE, b"")])
    current = store.refresh_current()
    assert sorted((bytes(r["key"]), r["op"]) for r in current.collect()) == [(b"a", PUT), (b"b", DELETE)]
    store.seal_current()
    assert store.version.current is None and len(store.version.at_level(1)) == 1
    assert scanned(store) == [(b"a", b"3")] and scanned(store, as_of=2) == [(b"a", b"1"), (b"b", b"2")]
    store.compact_level(0)
    assert scanned(store) == [(b"a", b"3")] and store.version.sizes().keys() == {1}


def test_checked_store(spark, tmp_path):
    checked = CheckedStore(KVStore.open(spark, str(tmp_path), QUIET))
    checked.put(b"a", b"1")
    checked.put(b"b", b"2")
    checked.delete(b"a")
    checked.delete(b"none")
    checked.flush()
    checked.put(b"c", b"3")
    assert checked.get(b"a") is None and checked.get(b"c") == b"3"
    assert checked.verify_scan(b"a", b"z") == 2 and checked.verify_scan(b"m", b"n") == 0
    checked.plain[b"b"] = b"other"
    with pytest.raises(Mismatch):
        checked.verify_scan(b"a", b"z")
    with pytest.raises(Mismatch):
        checked.get(b"b")


def test_bounds_reach_the_files(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path), QUIET)
    for first in (b"a", b"m"):
        store.write_many([(first + b"%d" % n, PUT, b"v") for n in range(5)])
        store.flush()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = store.scan(b"a1", b"a3", as_of=9)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(key" in pushed and "LessThan(key" in pushed and "LessThanOrEqual(seq,9)" in pushed
    assert len(store.log(b"a1", b"a3").inputFiles()) == 1  # the other run can't hold such keys
    assert [k for k, _ in scanned(store, b"a1", b"a3")] == [b"a1", b"a2"]


def test_log_files_are_read_by_executors(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path), QUIET)
    store.write_many([(b"a", PUT, b"1"), (b"b", PUT, b"2")])
    store.delete(b"a")
    got = sorted((bytes(r["key"]), r["seq"], r["op"]) for r in replay_files(spark, store.folder.uri("wal")).collect())
    assert got == [(b"a", 1, PUT), (b"a", 3, DELETE), (b"b", 2, PUT)]
