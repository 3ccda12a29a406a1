"""Leveled compaction: limits, choice of a level, merging, tombstone collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..model import PUT
from . import reads

#: The deepest level that may overflow; what it gives goes to the one below.
LAST_SOURCE_LEVEL = 6
L0_RUNS = 4


def limit_of(level: int) -> int:
    """Bytes that a level may hold."""
    return (1 << 63) - 1 if level == 0 else (10 << 20, 100 << 20)[level - 1] if level < 3 else (1 << 30) * 10 ** (level - 3)


def level_sizes(manifest: DataFrame) -> DataFrame:
    """Bytes, runs and limit of each level of a manifest (level, bytes)."""
    sizes = manifest.groupBy("level").agg(F.sum("bytes").cast("long").alias("bytes"), F.count(F.lit(1)).alias("runs"))
    return sizes.withColumn("limit_bytes", keys.level_limit("level"))


def pick_level(manifest: DataFrame) -> DataFrame:
    """The first level from 1 on that is over its limit: one row, or none."""
    over = level_sizes(manifest).where(F.col("level").between(1, LAST_SOURCE_LEVEL) & (F.col("bytes") > F.col("limit_bytes")))
    return over.agg(F.min("level").alias("level")).where("level is not null")


def choose(sizes: dict[int, tuple[int, int]]) -> int | None:
    """The level to compact, from {level: (runs, bytes)}; level 0 goes by its number of runs."""
    if sizes.get(0, (0, 0))[0] >= L0_RUNS:
        return 0
    return next((n for n in range(1, LAST_SOURCE_LEVEL + 1) if sizes.get(n, (0, 0))[1] > limit_of(n)), None)


def compact(log: DataFrame, drop_tombstones: bool) -> DataFrame:
    """Runs of a level and what they overlap below, merged to the newest entry of each key.

    Tombstones may go only if no older run can hold their keys.
    """
    merged = reads.latest(log)
    return merged.where(F.col("op") == PUT) if drop_tombstones else merged
