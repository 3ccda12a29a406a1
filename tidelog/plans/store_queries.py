"""Queries that go through files: a store's life from open to vacuum, its log, its manifest, a stream.

Each writes a folder of its own below the cluster's shared folder; rows that come back are strings,
as in ``kv_queries``. Event numbers are dense, so a store that takes the events in their order
gives them the sequence numbers that the SQL has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from ..model import Options
from ..operators import layout, reads
from ..sources import wal
from ..sources.files import Folder
from ..sources.manifest import Manifest, Run, Version
from ..sources.store import KVStore
from ..streaming.ingest import ingest
from .kv_queries import AS_OF, EV, LI, _WANTED_SQL, _latest, _merged_sql, _placed, _scan_sql, _table, _wanted, _with, ev, li

MANUAL = Options(auto_compact=False, compression="zstd")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/kv-{uuid.uuid4().hex}"


def _text(df: DataFrame) -> DataFrame:
    """Keys and values as strings, ops as numbers."""
    out = df.withColumns({c: F.decode(c, "UTF-8") for c in ("key", "value") if c in df.columns})
    return out.withColumn("op", F.col("op").cast("int")) if "op" in df.columns else out


def _loaded(spark, log: DataFrame, uri: str, options: Options = MANUAL, batches: int = 1, last: int = 0) -> KVStore:
    """A store that took a log in its order, in several batches of sequence numbers up to ``last``."""
    store = KVStore.open(spark, uri, options)
    cuts = [last * n // batches for n in range(1, batches)]
    for low, high in zip([None, *cuts], [*cuts, None]):
        some = log if low is None else log.where(F.col("seq") > low)
        store.apply_df(some if high is None else some.where(F.col("seq") <= high), ["seq"])
    return store


def _events(spark, sf_dir, uri, batches=1, options=MANUAL) -> KVStore:
    log = ev(spark, sf_dir)
    return _loaded(spark, log, uri, options, batches, log.count() if batches > 1 else 0)


def kv_store_roundtrip(spark, sf_dir):
    """Open, apply half, close, open, apply the rest with a level-0 merge at four runs, close, open, scan."""
    uri, log = _folder(spark), ev(spark, sf_dir)
    with KVStore.open(spark, uri) as store:
        store.apply_df(log.where(F.col("seq") <= AS_OF), ["seq"])
    with KVStore.open(spark, uri) as store:
        later = log.where(F.col("seq") > AS_OF)
        for n in range(3):
            store.apply_df(later.where((F.col("seq") > AS_OF + 1000 * n) & ((F.col("seq") <= AS_OF + 1000 * (n + 1)) | F.lit(n == 2))), ["seq"])
    return _placed(_text(KVStore.open(spark, uri).scan(b"", b"\xff")), "key", "value")


def kv_store_scan_range(spark, sf_dir):
    """A range of the line items from one sorted run; the bounds reach its files."""
    return _placed(_text(_loaded(spark, li(spark, sf_dir), _folder(spark)).scan(*[x.encode() for x in LI])), "key", "value")


def kv_store_as_of(spark, sf_dir):
    return _placed(_text(_events(spark, sf_dir, _folder(spark), batches=3).scan(*[x.encode() for x in EV], as_of=AS_OF)), "key", "value")


def kv_store_multi_get(spark, sf_dir):
    keys = _wanted(spark, sf_dir).withColumn("key", F.encode("key", "UTF-8"))
    return _text(_events(spark, sf_dir, _folder(spark)).multi_get(keys)).select("key", "value")


def kv_store_delete(spark, sf_dir):
    """Deletes of the keys of a table, after the events."""
    store = _events(spark, sf_dir, _folder(spark))
    store.delete_df(_wanted(spark, sf_dir).where("key > 'user:000050'").withColumn("key", F.encode("key", "UTF-8")))
    return _text(store.scan(b"", b"\xff"))


def kv_store_compact(spark, sf_dir):
    """What is stored after four runs were merged at the bottom: live entries with their numbers."""
    store = _events(spark, sf_dir, _folder(spark), batches=4)
    store.compact_level(0)
    store.vacuum(keep_hours=0)
    return _text(store.log())


def kv_store_compact_above(spark, sf_dir):
    """Tombstones stay while a deeper run may hold their keys."""
    uri, log = _folder(spark), ev(spark, sf_dir)
    store = KVStore.open(spark, uri, MANUAL)
    store.apply_df(log.where("seq <= 400"), ["seq"])
    store.compact_level(0)
    store.compact_level(1)  # now at level 2
    store.apply_df(log.where("seq > 400 and seq <= 700"), ["seq"])
    store.apply_df(log.where("seq > 700"), ["seq"])
    store.compact_level(0)
    top = [r for r in store.version.runs.values() if r.level == 1]
    return _text(store._runs(top))


def kv_store_current(spark, sf_dir):
    """The current-snapshot table, built once and then merged with what came later."""
    log, store = ev(spark, sf_dir), KVStore.open(spark, _folder(spark), MANUAL)
    store.apply_df(log.where("seq <= 6000"), ["seq"])
    store.refresh_current()
    store.apply_df(log.where("seq > 6000"), ["seq"])
    return _text(store.refresh_current())


def kv_store_sealed(spark, sf_dir):
    """The table sealed as a run of level 1, then merged with the run beside it."""
    store = _events(spark, sf_dir, _folder(spark))
    store.refresh_current()
    store.seal_current()
    store.compact_level(0)
    return _text(store.log())


def kv_store_recover(spark, sf_dir):
    """Single writes that were never flushed, read by a store that replays the log."""
    uri = _folder(spark)
    with KVStore.open(spark, uri, MANUAL) as store:
        # the nations are 25 at every size
        for row in _table(spark, sf_dir, "nation").orderBy("n_nationkey").toLocalIterator():
            store.put(f"nation:{row['n_name']}".encode(), str(row["n_regionkey"]).encode())
            if row["n_nationkey"] % 4 == 3:
                store.delete(f"nation:{row['n_name']}".encode())
    return _text(KVStore.open(spark, uri, MANUAL).log())


def kv_store_buffers(spark, sf_dir):
    """The layers of a store with small buffers: flushed runs, sealed buffers, and the open one."""
    store = KVStore.open(spark, _folder(spark), Options(write_buffer_size=150, max_pending_runs=3, auto_compact=False, run_partitions=1))
    for row in _table(spark, sf_dir, "nation").orderBy("n_nationkey").toLocalIterator():
        store.put(f"{row['n_nationkey']:04}".encode(), b"x" * 28)
    out = reads.overlay(*store.layers()).groupBy("layer").agg(F.count(F.lit(1)).alias("entries"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
    return out.withColumn("layer", F.col("layer").cast("long")).withColumn("flushed", F.col("max_seq") <= store.version.flushed_seq)


def kv_wal_replay(spark, sf_dir):
    """The events as framed log segments, written, read back, replayed twice, and merged."""
    path = _folder(spark)
    wal.write_segments(ev(spark, sf_dir), path)
    once = wal.replay_segments(spark.read.parquet(path))
    return _text(reads.latest(once.unionByName(once)))


def kv_wal_torn(spark, sf_dir):
    """Segments whose last frame is torn: each ends before it."""
    path = _folder(spark)
    wal.write_segments(ev(spark, sf_dir), path)
    torn = spark.read.parquet(path).withColumn("data", F.substring("data", F.lit(1), F.octet_length("data") - 3))
    return _text(wal.replay_segments(torn))


def kv_manifest_recover(spark, sf_dir):
    """Edits committed one by one and read again: the runs that are left."""
    folder = Folder(spark, _folder(spark))
    for name in ("manifest", "state"):
        folder.make(name)
    log, version = Manifest(spark, folder), Version()
    # the nations are 25 at every size
    for row in _table(spark, sf_dir, "nation").orderBy("n_nationkey").toLocalIterator():
        n, region = row["n_nationkey"], row["n_regionkey"]
        edits = [Run(f"run-{n}", region, 100 * n, n, 0, b"a", b"z", n, n).edit(), {"edit": "next_seq", "seq": n + 1}]
        version = log.commit(version, edits + ([{"edit": "remove", "path": f"run-{n // 2}"}] if n % 3 == 0 else []))
    now = log.read()
    assert now == version
    rows = [(r.path, r.level, r.bytes, now.next_seq) for r in now.runs.values()]
    return spark.createDataFrame(rows, "path string, level long, bytes long, next_seq long")


def kv_stream_ingest(spark, sf_dir):
    """The events as a stream of files into a store, one run for each micro-batch; each is delivered once more."""
    source, uri, name = _folder(spark), _folder(spark), uuid.uuid4().hex
    # a file source takes files by age, and a store numbers what comes as it comes
    rows = ev(spark, sf_dir).withColumn("op", F.col("op").cast("int"))
    for part in ("seq <= 2000", "seq > 2000 and seq <= 7000", "seq > 7000"):
        rows.where(part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("key string, seq long, op int, value string").option("maxFilesPerTrigger", 1).parquet(source)
    store = KVStore.open(spark, uri)
    for checkpoint in (_folder(spark), _folder(spark)):
        ingest(stream, store, ["seq"], checkpoint, {"availableNow": True}, name).awaitTermination()
    return _placed(_text(store.scan(b"", b"\xff")), "key", "value")


def kv_block_seek(spark, sf_dir):
    return layout.block_seek(ev(spark, sf_dir), _wanted(spark, sf_dir).withColumn("key", F.concat("key", F.lit("x"))))


_ALL = ("", "~")
_NATION = "nations AS (SELECT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r, n_name AS name FROM nation)"

_QUERIES = {
    "kv_store_roundtrip": (kv_store_roundtrip, _scan_sql("ev", _ALL)),
    "kv_store_scan_range": (kv_store_scan_range, _scan_sql("li", LI)),
    "kv_store_as_of": (kv_store_as_of, _scan_sql("ev", EV, f"seq <= {AS_OF}")),
    "kv_store_multi_get": (kv_store_multi_get, _with("ev", f"{_latest()}, {_WANTED_SQL} SELECT key, value FROM latest WHERE op = 0 AND key IN (SELECT key FROM wanted)")),
    "kv_store_delete": (kv_store_delete, _with("ev", f"{_latest()}, {_WANTED_SQL} SELECT key, value FROM latest WHERE op = 0 AND key NOT IN (SELECT key FROM wanted WHERE key > 'user:000050')")),
    "kv_store_compact": (kv_store_compact, _merged_sql("ev", True)),
    "kv_store_compact_above": (kv_store_compact_above, _with("ev", f"{_latest('seq > 400')} SELECT key, seq, op::INT AS op, value FROM latest")),
    "kv_store_current": (kv_store_current, _merged_sql("ev")),
    "kv_store_sealed": (kv_store_sealed, _merged_sql("ev", True)),
    "kv_store_recover": (kv_store_recover, f"""WITH {_NATION}, puts AS (SELECT *, row_number() OVER (ORDER BY n) + (SELECT count(*) FROM nations m WHERE m.n < nations.n AND m.n % 4 = 3) AS seq FROM nations)
        SELECT 'nation:' || name AS key, seq, 0 AS op, r::VARCHAR AS value FROM puts UNION ALL SELECT 'nation:' || name, seq + 1, 1, '' FROM puts WHERE n % 4 = 3"""),
    "kv_store_buffers": (kv_store_buffers, f"""WITH {_NATION}, s AS (SELECT row_number() OVER (ORDER BY n) AS seq FROM nations),
        l AS (SELECT seq, (seq - 1) // 4 AS layer FROM s), m AS (SELECT max(layer) + CASE WHEN max(seq) % 4 = 0 THEN 1 ELSE 0 END AS top FROM l)
        SELECT layer::BIGINT AS layer, count(*) AS entries, min(seq) AS min_seq, max(seq) AS max_seq, layer < top - 2 AS flushed FROM l, m GROUP BY layer, top"""),
    "kv_wal_replay": (kv_wal_replay, _merged_sql("ev")),
    "kv_wal_torn": (kv_wal_torn, _with("ev", "ends AS (SELECT max(seq) AS seq FROM log GROUP BY seq // 1000) SELECT key, seq, op::INT AS op, value FROM log WHERE seq NOT IN (SELECT seq FROM ends)")),
    "kv_manifest_recover": (kv_manifest_recover, f"""WITH {_NATION}, gone AS (SELECT n // 2 AS n, n AS at FROM nations WHERE n % 3 = 0)
        SELECT 'run-' || n AS path, r AS level, 100 * n AS bytes, (SELECT max(n) + 1 FROM nations) AS next_seq FROM nations WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.n = nations.n AND gone.at >= nations.n)"""),
    "kv_stream_ingest": (kv_stream_ingest, _scan_sql("ev", _ALL)),
    "kv_block_seek": (kv_block_seek, _with("ev", f"""n AS (SELECT key, max(seq) AS seq FROM log GROUP BY key), {_WANTED_SQL}
        SELECT wanted.key || 'x' AS key, min(n.key) AS found, arg_min(n.seq, n.key) AS seq FROM wanted LEFT JOIN n ON n.key >= wanted.key || 'x' GROUP BY wanted.key""")),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
