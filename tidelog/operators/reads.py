"""Reading a change log: snapshots, lookups, range scans, history.

A log is any DataFrame with key, seq, op, value; keys and values may be binary or strings. For a
snapshot s: entries with seq <= s are visible, the newest visible one of each key is the latest,
and it is live if it is a put. The seq filter stands below the aggregation, the op filter above
it; key bounds go to the scan since the key is the grouping key.

The newest entry is the maximum of a struct that begins with seq, which pre-aggregates in each
task, so a key with very many versions sends one row from each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import versions_first
from ..model import DELETE, PUT


def visible(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Entries of a snapshot."""
    return log if as_of is None else log.where(F.col("seq") <= as_of)


def latest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest visible entry of each key, tombstones too."""
    newest = visible(log, as_of).groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("e"))
    return newest.select("key", "e.seq", "e.op", "e.value")


def live(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Keys that have a value, with it."""
    return latest(log, as_of).where(F.col("op") == PUT).select("key", "value", "seq")


def between(log: DataFrame, start, end) -> DataFrame:
    """Entries with start <= key < end."""
    return log.where((F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end)))


def scan(log: DataFrame, start, end, as_of: int | None = None) -> DataFrame:
    """Live keys from start to before end, in key order. Reversed bounds give nothing."""
    return live(between(log, start, end), as_of).orderBy("key").select("key", "value")


def prefix_scan(log: DataFrame, prefix: str, as_of: int | None = None) -> DataFrame:
    """Live keys that begin with a prefix, in key order."""
    some = log.where(F.col("key").startswith(prefix)) if prefix else log
    return live(some, as_of).orderBy("key").select("key", "value")


def get_state(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """One row for a key: state is value, tombstone or absent."""
    hit = visible(log.where(F.col("key") == F.lit(key)), as_of).agg(F.max(F.struct("seq", "op", "value")).alias("e"))
    state = F.when(F.col("e").isNull(), "absent").when(F.col("e.op") == DELETE, "tombstone").otherwise("value")
    return hit.select(F.lit(key).alias("key"), state.alias("state"), F.when(state == "value", F.col("e.value")).alias("value"))


def multi_get(log: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """Live values of many keys; ``keys`` has a column key. The semi-join runs before aggregation."""
    return live(log.join(keys.select("key").distinct(), "key", "left_semi"), as_of).select("key", "value")


def history(log: DataFrame, start=None, end=None) -> DataFrame:
    """All versions, newest first within a key, with their rank."""
    some = log if start is None else between(log, start, end)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    return some.withColumn("version", rank).orderBy(*versions_first())


def tombstones(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Keys whose latest entry is a delete."""
    return latest(log, as_of).where(F.col("op") == DELETE).select("key", "seq")


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Runs merged to the newest entry of each key; tombstones stay. Order of runs doesn't matter."""
    return latest(reduce(DataFrame.unionByName, runs))


def overlay(*layers: DataFrame) -> DataFrame:
    """Layers with their place in priority order, oldest first, as column layer."""
    return reduce(DataFrame.unionByName, [x.withColumn("layer", F.lit(n)) for n, x in enumerate(layers)])


def layered_scan(layers: list[DataFrame], start, end) -> DataFrame:
    """A range scan over layers; the highest seq wins wherever it lies."""
    return scan(overlay(*layers).drop("layer"), start, end)


def entry_bytes() -> Column:
    """What an entry adds to a run's size: key, 8 bytes, value."""
    return F.octet_length("key") + 8 + F.octet_length("value")


def run_stats(log: DataFrame, *by: str) -> DataFrame:
    """Entries, tombstones, key and seq bounds and bytes of each run."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"), F.sum((F.col("op") == DELETE).cast("long")).alias("tombstones"),
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
        F.sum(entry_bytes()).cast("long").alias("bytes"),
    )
