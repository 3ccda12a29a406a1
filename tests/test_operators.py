import zlib

import pytest
from pyspark.sql import functions as F

from tidelog.errors import CorruptionError, StoreError
from tidelog.functions import keys
from tidelog.operators import compaction, layout, reads
from tidelog.sources import manifest, wal

LOG = "key binary, seq long, op byte, value binary"


def log(spark, *entries):
    return spark.createDataFrame([(k, s, o, v) for k, s, o, v in entries], LOG)


def pairs(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def test_latest_wins_before_any_flush(spark):
    df = log(spark, (b"a", 1, 0, b"old"), (b"a", 3, 0, b"new"), (b"b", 2, 0, b"x"), (b"b", 4, 1, b""), (b"c", 5, 1, b""))
    assert pairs(reads.scan(df, b"a", b"z")) == [(b"a", b"new")]
    assert pairs(reads.scan(df, b"a", b"z", as_of=2)) == [(b"a", b"old"), (b"b", b"x")]
    assert [bytes(r["key"]) for r in reads.tombstones(df).orderBy("key").collect()] == [b"b", b"c"]


def test_bounds_and_odd_keys(spark):
    df = log(spark, (b"", 1, 0, b"empty key"), (b"\x00", 2, 0, b""), (b"a", 3, 0, b"v"), (b"a\x00", 4, 0, b"w"), (b"\xff", 5, 0, b"hi"))
    assert pairs(reads.scan(df, b"", b"\xff")) == [(b"", b"empty key"), (b"\x00", b""), (b"a", b"v"), (b"a\x00", b"w")]
    assert pairs(reads.scan(df, b"z", b"a")) == [] and pairs(reads.scan(df, b"a", b"a")) == []
    assert reads.get_state(df, b"\x00").first()["state"] == "value"
    assert reads.get_state(df, b"none").first()["state"] == "absent"


def test_snapshot_read_keeps_three_states(spark):
    df = log(spark, (b"k", 1, 0, b"v1"), (b"k", 3, 0, b"v3"), (b"k", 5, 1, b""))
    got = {s: tuple(reads.get_state(df, b"k", s).first())[1:] for s in (0, 1, 2, 3, 5)}
    assert {s: (a, b and bytes(b)) for s, (a, b) in got.items()} == {0: ("absent", None), 1: ("value", b"v1"), 2: ("value", b"v1"), 3: ("value", b"v3"), 5: ("tombstone", None)}


def test_merge_of_overlapping_runs(spark):
    a, b = log(spark, (b"a", 5, 0, b"a"), (b"c", 5, 0, b"c_new")), log(spark, (b"b", 3, 0, b"b"), (b"c", 3, 0, b"c_old"), (b"d", 4, 1, b""))
    for runs in ((a, b), (b, a)):
        got = {bytes(r["key"]): (r["op"], bytes(r["value"])) for r in reads.merge_runs(*runs).collect()}
        assert got == {b"a": (0, b"a"), b"b": (0, b"b"), b"c": (0, b"c_new"), b"d": (1, b"")}
    assert compaction.compact(a.unionByName(b), True).count() == 3


def test_internal_keys(spark):
    df = log(spark, (b"hi", 42, 1, b""), (b"", (1 << 56) - 1, 0, b""))
    encoded = [bytes(r[0]) for r in df.select(keys.encode("key", "seq", "op")).collect()]
    assert encoded == [wal.encode_key(b"hi", 42, 1), wal.encode_key(b"", (1 << 56) - 1, 0)]
    assert encoded[0].hex().upper() == "68690000000000002A01"
    back = df.select(keys.decode(keys.encode("key", "seq", "op")).alias("d")).select("d.*").collect()
    assert [(bytes(r[0]), r[1], r[2]) for r in back] == [(b"hi", 42, 1), (b"", (1 << 56) - 1, 0)]
    for bad in (b"short", b"key" + bytes(7) + b"\x02"):
        with pytest.raises(Exception, match="corrupt entry"):
            spark.createDataFrame([(bad,)], "d binary").select(keys.decode("d")).collect()
        with pytest.raises(CorruptionError):
            wal.decode_key(bad)
    with pytest.raises(Exception, match="out of range"):
        log(spark, (b"k", 1 << 56, 0, b"")).select(keys.encode("key", "seq", "op")).collect()
    order = [bytes(r[0]) + bytes([r[1]]) for r in log(spark, (b"a", 1, 0, b""), (b"b", 9, 0, b""), (b"a", 2, 0, b"")).orderBy(*keys.versions_first()).select("key", "seq").collect()]
    assert order == [b"a\x02", b"a\x01", b"b\x09"]


def test_log_frames_and_torn_tails(spark):
    entries = [(f"key{i:04}".encode(), i, i % 2, b"" if i % 2 else f"val{i}".encode()) for i in range(50)]
    data = wal.encode_log(entries)
    assert list(wal.replay(data)) == entries
    assert list(wal.replay(data[:-3])) == entries[:-1]
    assert list(wal.replay(data[:100] + b"\xff" + data[101:])) == entries[: len(list(wal.replay(data[:100] + b"\xff" + data[101:])))]
    assert list(wal.replay(b"")) == []
    crc = spark.createDataFrame([(b"123456789",)], "d binary").select(keys.frame_crc("d")).first()[0]
    assert crc == zlib.crc32(b"123456789") == 3421780262


def test_manifest_edits_end_at_the_first_bad_line():
    edits = [{"edit": "next_seq", "seq": 42}, {"edit": "current", "path": "x"}]
    data = manifest.encode_edits(edits)
    assert manifest.decode_edits(data) == (edits, True)
    assert manifest.decode_edits(data[:-5]) == (edits[:1], False)
    version = manifest.Version()
    for e in edits:
        version.apply(e)
    assert (version.next_seq, version.current) == (42, "x")


def test_level_limits_and_choice(spark):
    limits = [r[0] for r in spark.range(7).select(keys.level_limit("id")).collect()]
    assert limits == [compaction.limit_of(n) for n in range(7)]
    assert limits[:5] == [(1 << 63) - 1, 10 << 20, 100 << 20, 1 << 30, 10 << 30]
    assert compaction.choose({0: (4, 1)}) == 0 and compaction.choose({0: (3, 1 << 40)}) is None
    assert compaction.choose({1: (1, 10 << 20)}) is None and compaction.choose({1: (1, (10 << 20) + 1), 2: (9, 1 << 40)}) == 1
    m = spark.createDataFrame([(1, 5), (2, (100 << 20) + 1), (3, 1 << 41)], "level long, bytes long")
    assert compaction.pick_level(m).first()["level"] == 2 and compaction.pick_level(m.where("level = 1")).isEmpty()


def test_bloom_sizing(spark):
    sizes = (0, 1, 6, 7, 1000, 10_000, 100_000)
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", keys.bloom_bits("n"), keys.bloom_hashes("n"))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == {n: layout.bloom_size(n) for n in sizes}
    assert layout.bloom_size(0) == (64, 6) and layout.bloom_size(1)[1] == 30 and layout.bloom_size(1000)[1] == 7


def test_blocks(spark):
    df = log(spark, *((f"key{i:04}".encode(), i + 1, 0, b"v") for i in range(100)))
    rows = layout.block_restarts(df).orderBy("place").collect()
    assert [r["place"] for r in rows if r["restart"]] == list(range(0, 100, 16))
    assert rows[1]["shared"] == 6 and rows[10]["shared"] == 5 and rows[16]["shared"] == 0
    index = layout.block_index(df, 16).drop("entries")
    probes = spark.createDataFrame([(k,) for k in (b"a", b"key0015", b"key0015x", b"key0099", b"zzz")], "key binary")
    got = {bytes(r["key"]): r["block"] for r in layout.index_find(index.select("last_key", F.col("block").cast("long").alias("block")), probes).collect()}
    assert got == {b"a": 0, b"key0015": 0, b"key0015x": 1, b"key0099": 6, b"zzz": None}


def test_rotation(spark):
    df = log(spark, *((b"kk", i + 1, 0, b"x" * 10) for i in range(10)))  # 20 bytes each
    big = log(spark, *((b"k%d" % (i % 13), i + 1, 0, b"x" * (i * 7 % 50)) for i in range(2000))).withColumn("shard", F.length("key"))
    got = {(r["shard"], r["seq"]): r["run"] for r in layout.rotation_runs(big.repartition(3), 500).collect()}
    state, expected = {}, {}
    for r in sorted(big.collect(), key=lambda r: r["seq"]):
        run, held = state.get(r["shard"], (0, 0))
        expected[r["shard"], r["seq"]] = run
        held += len(r["key"]) + 8 + len(r["value"])
        state[r["shard"]] = (run + 1, 0) if held >= 500 else (run, held)
    assert got == expected
    runs = layout.rotation_runs(df, 50).groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in runs} == {0: 3, 1: 3, 2: 3, 3: 1}


def test_places(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "x long").repartition(5)
    assert sorted(tuple(r) for r in layout.place(df, F.col("x").desc()).collect()) == [(100 - n, n) for n in range(100, -1, -1)]


def test_places_of_many_wide_rows(spark):
    rows = spark.range(100_000).select(F.xxhash64("id").alias("x"), F.repeat(F.lit("v"), 1500).alias("value"), F.col("id").alias("place_before"))
    placed = layout.place(rows.repartition(16), F.col("x"))
    assert placed.columns == ["x", "value", "place_before", "place"]
    got = placed.agg(F.count("place"), F.countDistinct("place"), F.min("place"), F.max("place")).first()
    assert tuple(got) == (100_000, 100_000, 0, 99_999)
    least, most = (placed.where(c).agg(F.max("x"), F.min("x")).first() for c in ("place < 40000", "place >= 40000"))
    assert least[0] <= most[1]
    assert layout.place(rows.where("false"), F.col("x")).collect() == []


def test_lookups_over_many_ranges(spark):
    keys_ = spark.range(60_000).select(F.format_string("k%08d", "id").alias("key"), (F.col("id") + 1).alias("seq"))
    index = layout.block_index(keys_, 50).select("last_key", F.col("block").cast("long").alias("block"))
    assert index.count() == 1200
    probes = spark.range(0, 61_000, 3).select(F.format_string("k%08d", "id").alias("key"), F.col("id").alias("n"))
    found = layout.index_find(index, probes.select("key").repartition(16)).join(probes, "key")
    wrong = found.where("not (block <=> if(n < 60000, cast(floor(n / 50) as bigint), null))")
    assert found.count() == probes.count() and wrong.isEmpty()


def test_codecs():
    assert layout.writer_options("zstd", 10)["parquet.bloom.filter.expected.ndv#key"] == "10"
    from tidelog.model import Options

    with pytest.raises(StoreError):
        Options(compression="lzma")
    with pytest.raises(StoreError):
        Options(write_buffer_size=0)


def test_log_segments(spark, tmp_path):
    entries = [(f"key{i % 40:04}".encode(), i, i % 2, b"" if i % 2 else f"val{i}".encode()) for i in range(250)]
    df = log(spark, *entries)
    framed = df.orderBy("seq").select(keys.frame("key", "seq", "op", "value")).collect()
    assert b"".join(bytes(r[0]) for r in framed) == wal.encode_log(entries)
    wal.write_segments(df.repartition(3), str(tmp_path / "s"), 100)
    segments = spark.read.parquet(str(tmp_path / "s"))
    assert {r["segment"]: bytes(r["data"]) for r in segments.collect()} == {k: wal.encode_log(entries[100 * k : 100 * k + 100]) for k in range(3)}
    rows = lambda d: sorted((bytes(r["key"]), r["seq"], r["op"], bytes(r["value"])) for r in d.collect())
    assert rows(wal.replay_segments(segments)) == sorted(entries)
    torn = segments.withColumn("data", F.when(F.col("segment") == 1, F.substring("data", F.lit(1), F.octet_length("data") - 1)).otherwise(F.col("data")))
    assert rows(wal.replay_segments(torn)) == sorted(entries[:199] + entries[200:])
    wal.write_segments(df.where("false"), str(tmp_path / "none"))
    assert rows(wal.replay_segments(spark.read.parquet(str(tmp_path / "none")))) == []
