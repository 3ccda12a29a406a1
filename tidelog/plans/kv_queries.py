"""Queries over change logs derived from the driver's tables, with their DuckDB SQL.

``ev`` has few keys with many versions, ``li`` many keys with few, ``ord`` one version of each key,
``conv`` long values. Keys and values are strings, so that both engines hash results alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import compaction, layout, reads

AS_OF = 5000
EV = ("user:000020", "user:000080")
LI = ("ord:00001000/", "ord:00002000/")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(df: DataFrame, key: str, seq: str, deleted: str, value: str) -> DataFrame:
    df = df.selectExpr(f"{key} AS key", f"cast({seq} AS bigint) AS seq", f"cast(if({deleted}, 1, 0) AS tinyint) AS op", f"{value} AS value")
    return df.withColumn("value", F.when(F.col("op") == 1, "").otherwise(F.col("value")))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(_table(spark, sf_dir, "events"), "concat('user:', lpad(user_id, 6, '0'))", "event_id + 1", "event_type = 'error'", "concat(event_type, '|', props)")


_LI_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global order gives the sequence numbers; a store would hand them out by range partition."""
    df = _table(spark, sf_dir, "lineitem")
    # rank in two steps so that no task sorts the whole table: by day, then by the days before
    day = F.to_date("l_shipdate")
    df = df.withColumn("day", day)
    days = df.groupBy("day").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("day", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("day").orderBy(*_LI_ORDER.split(", ")))
    df = df.withColumn("inside", inside).join(days, "day").withColumn("rank", F.col("before") + F.col("inside"))
    return _log(df, "concat('ord:', lpad(l_orderkey, 8, '0'), '/', lpad(l_linenumber, 2, '0'))", "rank", "l_returnflag = 'R'", "concat(l_returnflag, '|', l_linestatus)")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(_table(spark, sf_dir, "orders"), "concat('cust:', lpad(o_custkey, 8, '0'), '/ord:', lpad(o_orderkey, 8, '0'))", "o_orderkey + 1", "o_orderstatus = 'F'", "concat(o_orderstatus, '|', o_orderpriority)")


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    # conversations are dealt by id, and ids of one length sort as their keys do
    key = "concat('conv:', lpad(conv_id, 6, '0'), '/', lpad(turn, 4, '0'))"
    return _log(_table(spark, sf_dir, "conversations"), key, "conv_id * 10000 + turn + 1", "false", "concat(role, '|', text)")


_SQL = {
    "ev": """SELECT 'user:' || lpad(user_id::VARCHAR, 6, '0') AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op,
                    CASE WHEN event_type = 'error' THEN '' ELSE event_type || '|' || props END AS value FROM events""",
    "li": f"""SELECT 'ord:' || lpad(l_orderkey::VARCHAR, 8, '0') || '/' || lpad(l_linenumber::VARCHAR, 2, '0') AS key,
                    row_number() OVER (ORDER BY {_LI_ORDER}) AS seq, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS op,
                    CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag || '|' || l_linestatus END AS value FROM lineitem""",
    "ord": """SELECT 'cust:' || lpad(o_custkey::VARCHAR, 8, '0') || '/ord:' || lpad(o_orderkey::VARCHAR, 8, '0') AS key, o_orderkey + 1 AS seq,
                    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS op,
                    CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus || '|' || o_orderpriority END AS value FROM orders""",
    "conv": """SELECT 'conv:' || lpad(conv_id::VARCHAR, 6, '0') || '/' || lpad(turn::VARCHAR, 4, '0') AS key, conv_id * 10000 + turn + 1 AS seq, 0 AS op,
                    role || '|' || text AS value FROM conversations""",
}


def _with(log: str, body: str) -> str:
    return f"WITH log AS ({_SQL[log]}), {body}"


_LATEST = "latest AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM log{where} GROUP BY key)"


def _latest(where: str = "") -> str:
    return _LATEST.format(where=f" WHERE {where}" if where else "")


def _placed(df: DataFrame, *columns: str) -> DataFrame:
    """With the place of each row in key order, so that the order is compared too."""
    return layout.place(df.select(*columns), F.col("key")).withColumn("place", F.col("place") + 1)


def _range(key: str, bounds: tuple[str, str]) -> str:
    return f"{key} >= '{bounds[0]}' AND {key} < '{bounds[1]}'"


def kv_scan_range(spark, sf_dir):
    return _placed(reads.scan(ev(spark, sf_dir), *EV), "key", "value")


def kv_scan_range_wide(spark, sf_dir):
    return _placed(reads.scan(li(spark, sf_dir), *LI), "key", "value")


def kv_scan_all(spark, sf_dir):
    return _placed(reads.scan(li(spark, sf_dir), "", "~"), "key", "value")


def kv_scan_as_of(spark, sf_dir):
    return _placed(reads.scan(ev(spark, sf_dir), *EV, as_of=AS_OF), "key", "value")


def kv_scan_empty(spark, sf_dir):
    return reads.scan(ev(spark, sf_dir), EV[1], EV[0]).agg(F.count(F.lit(1)).alias("n"))


def _get(key):
    return lambda spark, sf_dir: reads.get_state(ev(spark, sf_dir), key)


def _get_sql(key: str) -> str:
    return _with(
        "ev",
        f"""hit AS (SELECT max(seq) AS s, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM log WHERE key = '{key}')
        SELECT '{key}' AS key, CASE WHEN s IS NULL THEN 'absent' WHEN op = 1 THEN 'tombstone' ELSE 'value' END AS state,
               CASE WHEN op = 0 THEN value END AS value FROM hit""",
    )


def _wanted(spark, sf_dir):
    return _table(spark, sf_dir, "customer").selectExpr("concat('user:', lpad(c_custkey, 6, '0')) AS key")


def kv_multi_get(spark, sf_dir):
    return reads.multi_get(ev(spark, sf_dir), _wanted(spark, sf_dir))


def kv_history(spark, sf_dir):
    return reads.history(ev(spark, sf_dir), *EV).selectExpr("key", "seq", "cast(op AS int) AS op", "value", "version")


def kv_tombstones(spark, sf_dir):
    return reads.tombstones(li(spark, sf_dir))


def kv_prefix_scan(spark, sf_dir):
    return _placed(reads.prefix_scan(conv(spark, sf_dir), "conv:00001"), "key", "value")


def kv_prefix_scan_orders(spark, sf_dir):
    return _placed(reads.prefix_scan(orders(spark, sf_dir), "cust:000001"), "key", "value")


def _bands(log: DataFrame) -> list[DataFrame]:
    return [log.where("seq <= 3000"), log.where("seq > 3000 and seq <= 7000"), log.where("seq > 7000")]


def kv_overlay_layers(spark, sf_dir):
    return _placed(reads.layered_scan(_bands(ev(spark, sf_dir))[::-1], *EV), "key", "value")


def kv_merge_runs(spark, sf_dir):
    return reads.merge_runs(*_bands(ev(spark, sf_dir))).selectExpr("key", "seq", "cast(op AS int) AS op", "value")


def kv_compact_keep_tombstones(spark, sf_dir):
    return compaction.compact(li(spark, sf_dir), False).selectExpr("key", "seq", "cast(op AS int) AS op", "value")


def kv_compact_bottom(spark, sf_dir):
    return compaction.compact(li(spark, sf_dir), True).selectExpr("key", "seq", "cast(op AS int) AS op", "value")


def kv_current_snapshot(spark, sf_dir):
    """The active-segment idea: newest entries of old current state and a new batch."""
    log = ev(spark, sf_dir)
    current = reads.latest(log.where("seq <= 6000"))
    return reads.merge_runs(current, log.where("seq > 6000")).selectExpr("key", "seq", "cast(op AS int) AS op", "value")


def kv_level_limits(spark, sf_dir):
    return spark.range(7).select(F.col("id").alias("level"), keys.level_limit("id").alias("limit_bytes"))


def _manifest(spark, sf_dir):
    """Runs at levels 1 to 6 whose sizes come from the orders."""
    df = _table(spark, sf_dir, "orders")
    return df.selectExpr("cast(1 + o_orderkey % 6 AS bigint) AS level", "cast(o_orderkey * 1000 AS bigint) AS bytes")


_MANIFEST_SQL = "WITH m AS (SELECT (1 + o_orderkey % 6)::BIGINT AS level, (o_orderkey * 1000)::BIGINT AS bytes FROM orders)"
_LIMIT_SQL = "CASE level WHEN 0 THEN 9223372036854775807 WHEN 1 THEN 10485760 WHEN 2 THEN 104857600 ELSE (1073741824 * 10 ** (level - 3))::BIGINT END"


def kv_level_sizes(spark, sf_dir):
    return compaction.level_sizes(_manifest(spark, sf_dir))


def kv_compaction_pick(spark, sf_dir):
    return compaction.pick_level(_manifest(spark, sf_dir))


def kv_manifest_fold(spark, sf_dir):
    from ..sources.manifest import fold

    edits = _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 100 + l_linenumber AS n", "l_partkey % 7 AS level", "concat('run-', l_partkey % 500) AS path", "if(l_returnflag = 'R', 'remove', 'add') AS action"
    )
    return fold(edits).selectExpr("level", "path")


def kv_run_stats(spark, sf_dir):
    log = ev(spark, sf_dir).withColumn("run", F.floor((F.col("seq") - 1) / 1000))
    return reads.run_stats(log, "run")


def kv_memtable_bytes(spark, sf_dir):
    return ev(spark, sf_dir).agg(F.sum(reads.entry_bytes()).cast("long").alias("bytes"), F.count(F.lit(1)).alias("entries"))


def kv_rotation_runs(spark, sf_dir):
    """Sixteen shards by user, each with a buffer of 4 KiB."""
    log = ev(spark, sf_dir).withColumn("shard", F.substring("key", 6, 6).cast("long") % 16)
    return layout.rotation_runs(log, 4096).groupBy("shard", "run").agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def kv_internal_key_encode(spark, sf_dir):
    return ev(spark, sf_dir).select("key", "seq", F.hex(keys.encode("key", "seq", "op")).alias("encoded"))


def kv_internal_key_decode(spark, sf_dir):
    d = ev(spark, sf_dir).select(keys.decode(keys.encode("key", "seq", "op")).alias("d"))
    return d.select(F.decode("d.key", "UTF-8").alias("key"), "d.seq", F.col("d.op").cast("int").alias("op"))


def kv_internal_key_order(spark, sf_dir):
    """Places in internal-key order within each key."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    return ev(spark, sf_dir).select("key", "seq", place.alias("place"))


def kv_bloom_sizing(spark, sf_dir):
    runs = ev(spark, sf_dir).groupBy(F.floor((F.col("seq") - 1) / 700).alias("run")).agg(F.countDistinct("key").alias("n"))
    return runs.select("run", "n", keys.bloom_bits("n").alias("bits"), keys.bloom_hashes("n").alias("hashes"))


def kv_block_restarts(spark, sf_dir):
    log = ev(spark, sf_dir).withColumn("run", F.floor((F.col("seq") - 1) / 1000))
    return layout.block_restarts(log, "run").select("run", "key", "seq", "place", "restart", "shared")


def kv_index_find(spark, sf_dir):
    index = layout.block_index(ev(spark, sf_dir), 64).select("last_key", F.col("block").cast("long").alias("block"))
    return layout.index_find(index, _wanted(spark, sf_dir)).select("key", F.coalesce("block", F.lit(-1)).alias("block"))


def kv_wal_crc(spark, sf_dir):
    return ev(spark, sf_dir).select("key", "seq", keys.frame_crc("value").alias("crc"))


def _scan_sql(log: str, bounds: tuple[str, str], where: str = "") -> str:
    both = f"{_range('key', bounds)}{' AND ' + where if where else ''}"
    return _with(log, f"{_latest(both)} SELECT key, value, row_number() OVER (ORDER BY key) AS place FROM latest WHERE op = 0")


def _merged_sql(log: str, only_live: bool = False) -> str:
    return _with(log, f"{_latest()} SELECT key, seq, op::INT AS op, value FROM latest" + " WHERE op = 0" * only_live)


_PREFIX = "SELECT key, value, row_number() OVER (ORDER BY key) AS place FROM latest WHERE op = 0"
_WANTED_SQL = "wanted AS (SELECT 'user:' || lpad(c_custkey::VARCHAR, 6, '0') AS key FROM customer)"
_BYTES = "strlen(key) + 8 + strlen(value)"

#: Each shard's entries in order; the fold carries the run's number and the bytes held.
_ROTATION_SQL = "WITH RECURSIVE " + _with(
    "ev",
    f"""s AS (SELECT substr(key, 6, 6)::BIGINT % 16 AS shard, seq, {_BYTES} AS bytes FROM log),
    o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS i FROM s),
    f AS (SELECT shard, i, seq, bytes, 0::BIGINT AS run, bytes AS held FROM o WHERE i = 1
          UNION ALL
          SELECT o.shard, o.i, o.seq, o.bytes, CASE WHEN f.held >= 4096 THEN f.run + 1 ELSE f.run END, CASE WHEN f.held >= 4096 THEN 0 ELSE f.held END + o.bytes
          FROM f JOIN o ON o.shard = f.shard AND o.i = f.i + 1)
    SELECT shard, run, count(*) AS entries, sum(bytes)::BIGINT AS bytes, min(seq) AS min_seq, max(seq) AS max_seq FROM f GROUP BY shard, run""",
).removeprefix("WITH ")
#: CRC-32 by the table of its polynomial, over the bytes of the hex form.
_CRC_SQL = _with(
    "ev",
    """t AS (SELECT list(list_reduce([n::BIGINT] || [8::BIGINT, 7, 6, 5, 4, 3, 2, 1], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)),
    b AS (SELECT key, seq, [4294967295::BIGINT] || list_transform(range(1, strlen(value) + 1), lambda k: ('0x' || substr(hex(value), 2 * k - 1, 2))::BIGINT) AS b FROM log)
    SELECT key, seq, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295::BIGINT) AS crc FROM b, t""",
)

_QUERIES = {
    "kv_scan_all": (kv_scan_all, _scan_sql("li", ("", "~"))),
    "kv_scan_range": (kv_scan_range, _scan_sql("ev", EV)),
    "kv_scan_range_wide": (kv_scan_range_wide, _scan_sql("li", LI)),
    "kv_scan_as_of": (kv_scan_as_of, _scan_sql("ev", EV, f"seq <= {AS_OF}")),
    "kv_scan_empty": (kv_scan_empty, _with("ev", f"{_latest(_range('key', EV[::-1]))} SELECT count(*) AS n FROM latest WHERE op = 0")),
    "kv_get_hit": (_get("user:000021"), _get_sql("user:000021")),
    "kv_get_tombstone": (_get("user:000004"), _get_sql("user:000004")),
    "kv_get_missing": (_get("user:none"), _get_sql("user:none")),
    "kv_multi_get": (kv_multi_get, _with("ev", f"{_latest()}, {_WANTED_SQL} SELECT key, value FROM latest WHERE op = 0 AND key IN (SELECT key FROM wanted)")),
    "kv_history": (kv_history, _with("ev", f"s AS (SELECT 1) SELECT key, seq, op::INT AS op, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC)::INT AS version FROM log WHERE {_range('key', EV)}")),
    "kv_tombstones": (kv_tombstones, _with("li", f"{_latest()} SELECT key, seq FROM latest WHERE op = 1")),
    "kv_prefix_scan": (kv_prefix_scan, _with("conv", f"{_latest("starts_with(key, 'conv:00001')")} {_PREFIX}")),
    "kv_prefix_scan_orders": (kv_prefix_scan_orders, _with("ord", f"{_latest("starts_with(key, 'cust:000001')")} {_PREFIX}")),
    "kv_overlay_layers": (kv_overlay_layers, _scan_sql("ev", EV)),
    "kv_merge_runs": (kv_merge_runs, _merged_sql("ev")),
    "kv_compact_keep_tombstones": (kv_compact_keep_tombstones, _merged_sql("li")),
    "kv_compact_bottom": (kv_compact_bottom, _merged_sql("li", True)),
    "kv_current_snapshot": (kv_current_snapshot, _merged_sql("ev")),
    "kv_level_limits": (kv_level_limits, f"SELECT level, {_LIMIT_SQL} AS limit_bytes FROM (SELECT unnest(range(7))::BIGINT AS level)"),
    "kv_level_sizes": (kv_level_sizes, f"{_MANIFEST_SQL} SELECT level, sum(bytes)::BIGINT AS bytes, count(*) AS runs, {_LIMIT_SQL} AS limit_bytes FROM m GROUP BY level"),
    "kv_compaction_pick": (kv_compaction_pick, f"{_MANIFEST_SQL}, s AS (SELECT level, sum(bytes)::BIGINT AS b FROM m GROUP BY level) SELECT min(level) AS level FROM s WHERE b > {_LIMIT_SQL} HAVING min(level) IS NOT NULL"),
    "kv_manifest_fold": (kv_manifest_fold, """WITH e AS (SELECT l_orderkey * 100 + l_linenumber AS n, l_partkey % 7 AS level, 'run-' || (l_partkey % 500) AS path, CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END AS action FROM lineitem)
        SELECT level, path FROM (SELECT level, path, action, row_number() OVER (PARTITION BY level, path ORDER BY n DESC, action DESC) AS k FROM e) WHERE k = 1 AND action = 'add'"""),
    "kv_run_stats": (kv_run_stats, _with("ev", f"""r AS (SELECT *, (seq - 1) // 1000 AS run FROM log) SELECT run, count(*) AS entries, sum(op)::BIGINT AS tombstones, min(key) AS min_key, max(key) AS max_key,
        min(seq) AS min_seq, max(seq) AS max_seq, sum({_BYTES})::BIGINT AS bytes FROM r GROUP BY run""")),
    "kv_memtable_bytes": (kv_memtable_bytes, _with("ev", f"s AS (SELECT 1) SELECT sum({_BYTES})::BIGINT AS bytes, count(*) AS entries FROM log")),
    "kv_rotation_runs": (kv_rotation_runs, _ROTATION_SQL),
    "kv_internal_key_encode": (kv_internal_key_encode, _with("ev", "s AS (SELECT 1) SELECT key, seq, hex(key) || printf('%016X', seq * 256 + op) AS encoded FROM log")),
    "kv_internal_key_decode": (kv_internal_key_decode, _with("ev", "s AS (SELECT 1) SELECT key, seq, op::INT AS op FROM log")),
    "kv_internal_key_order": (kv_internal_key_order, _with("ev", "s AS (SELECT 1) SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC)::INT AS place FROM log")),
    "kv_bloom_sizing": (kv_bloom_sizing, _with("ev", """r AS (SELECT (seq - 1) // 700 AS run, count(DISTINCT key) AS n FROM log GROUP BY run),
        b AS (SELECT run, n, (ceil(greatest(ceil(n * -ln(0.01) / (ln(2) * ln(2))), 64) / 8) * 8)::BIGINT AS bits FROM r)
        SELECT run, n, bits, least(greatest(round(bits / n * ln(2)), 1), 30)::BIGINT AS hashes FROM b""")),
    "kv_block_restarts": (kv_block_restarts, _with("ev", """r AS (SELECT *, (seq - 1) // 1000 AS run FROM log),
        p AS (SELECT run, key, seq, (row_number() OVER w - 1)::INT AS place, lag(key) OVER w AS prev FROM r WINDOW w AS (PARTITION BY run ORDER BY key, seq DESC))
        SELECT run, key, seq, place, place % 16 = 0 AS restart, CASE WHEN place % 16 = 0 THEN 0 ELSE coalesce(list_min(list_filter(range(1, least(strlen(key), strlen(prev)) + 1), lambda k: key[k] <> prev[k])) - 1, least(strlen(key), strlen(prev))) END::BIGINT AS shared FROM p""")),
    "kv_index_find": (kv_index_find, _with("ev", f"""b AS (SELECT (row_number() OVER (ORDER BY key, seq DESC) - 1) // 64 AS block, key FROM log),
        i AS (SELECT block, max(key) AS last_key FROM b GROUP BY block), {_WANTED_SQL}
        SELECT wanted.key, coalesce(min(block), -1)::BIGINT AS block FROM wanted LEFT JOIN i ON last_key >= wanted.key GROUP BY wanted.key""")),
    "kv_wal_crc": (kv_wal_crc, _CRC_SQL),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
