"""How entries lie in runs and blocks: rotation, restart points, block index, writer options."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import shared_prefix, versions_first
from ..functions.shared import checkpoint
from ..model import CODECS
from .reads import entry_bytes

RESTART_EVERY = 16


def place(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``place``, the number of rows before each in a total order, without one task that sorts all.

    Rows are sorted by ranges and written once with the range that they are in; each then adds the
    rows of the ranges before: one count for each range, so their join is a broadcast of as many
    rows as there are partitions. Counts and rows come from the same files: were the ranges made
    anew for each use, other bounds could be drawn for each. Rows that are equal in ``order`` lie
    in one range, in any order.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    rows = checkpoint(rows)
    part, inside = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("__part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("__part", before.alias("__before")))
    placed = rows.join(counts, part == F.col("__part"))
    return placed.select(*df.columns, (F.col("__before") + inside).alias("place"))


def rotation_runs(log: DataFrame, write_buffer_size: int) -> DataFrame:
    """The run of each entry if a buffer is sealed once it holds ``write_buffer_size`` bytes.

    Sealing restarts the count, so it is a fold in write order and no window function. Shards (a
    column ``shard``, else one) rotate each for itself and in parallel; a shard streams through
    its task in batches, and only the bytes held and the run's number are kept between them.
    """
    shard = F.col("shard").cast("long") if "shard" in log.columns else F.lit(0).cast("long")
    rows = log.select(shard.alias("shard"), "key", "seq", "op", entry_bytes().cast("long").alias("bytes"))
    kinds = dict(rows.dtypes)

    def fold(batches):
        now, run, held = None, 0, 0
        for pdf in batches:
            out = []
            for own, n in zip(pdf["shard"].tolist(), pdf["bytes"].tolist()):
                if own != now:
                    now, run, held = own, 0, 0
                out.append(run)
                held += n
                if held >= write_buffer_size:
                    run, held = run + 1, 0
            yield pdf.assign(run=out)

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "seq")
    return dealt.mapInPandas(fold, f"shard long, key {kinds['key']}, seq long, op {kinds['op']}, bytes long, run long")


def block_restarts(log: DataFrame, *by: str) -> DataFrame:
    """Entries in internal-key order with their place, whether a full key stands there, and the prefix shared with the key before."""
    order = Window.partitionBy(*by).orderBy(*versions_first())
    rows = log.withColumn("place", F.row_number().over(order) - 1).withColumn("before", F.lag("key").over(order))
    restart = F.col("place") % RESTART_EVERY == 0
    shared = F.when(restart, F.lit(0).cast("long")).otherwise(shared_prefix("before", "key"))
    return rows.withColumns({"restart": restart, "shared": shared}).drop("before")


def block_index(log: DataFrame, block_entries: int, *by: str) -> DataFrame:
    """The last key of each block of so many entries, of each run named by ``by`` or of the whole log."""
    if by:
        rows = log.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*versions_first())) - 1)
    else:
        rows = place(log, *versions_first())
    rows = rows.withColumn("block", F.floor(F.col("place") / block_entries))
    return rows.groupBy(*by, "block").agg(F.max("key").alias("last_key"), F.count(F.lit(1)).alias("entries"))


def seek(entries: DataFrame, probes: DataFrame, *payload: str) -> DataFrame:
    """For each probe (a column key) the ``payload`` of the first entry at or after it; nulls if it is past all.

    Among entries of one key the first in ``payload``'s order is taken. Both are put in one order
    by ranges, and each probe takes the next entry; one after the last entry of its range takes
    the first of the ranges behind. That is one sort, where an inequality join would compare every
    probe with every entry. The ranges are written once, since both uses must see the same ones.
    """
    held = entries.select("key", F.struct(*payload).alias("found"), F.lit(1).alias("kind"))
    asked = probes.select("key", F.lit(None).cast(held.schema["found"].dataType).alias("found"), F.lit(0).alias("kind"))
    both = held.unionByName(asked).repartitionByRange("key").sortWithinPartitions("key", "kind", "found")
    both = checkpoint(both.withColumn("p", F.spark_partition_id()))
    # in order of key, probes come before an entry with an equal key
    ahead = Window.partitionBy("p").orderBy("key", "kind", "found").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = both.withColumn("found", F.first("found", ignorenulls=True).over(ahead)).where("kind = 0")
    # one row for each range, so as many as there are partitions
    firsts = both.where("kind = 1").groupBy("p").agg(F.min(F.struct("key", "found")).alias("first"))
    firsts = both.groupBy("p").count().join(firsts, "p", "left")
    behind = Window.orderBy("p").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select("p", F.first("first.found", ignorenulls=True).over(behind).alias("later"))
    out = near.join(F.broadcast(firsts), "p").select("key", F.coalesce("found", "later").alias("found"))
    return out.select("key", *[F.col(f"found.{c}").alias(c) for c in payload])


def index_find(index: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe the first block whose last key is at or after it; no block if it is past all.

    ``index`` (last_key, block) is of one run.
    """
    return seek(index.select(F.col("last_key").alias("key"), "block"), probes, "block")


def block_seek(log: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe the first entry in internal-key order whose key is at or after it: found, seq."""
    newest = log.groupBy("key").agg(F.max("seq").alias("seq"))  # stands first among its versions
    return seek(newest.withColumn("at", F.col("key")), probes, "at", "seq").withColumnRenamed("at", "found")


def bloom_size(n: int) -> tuple[int, int]:
    """Bits and hash functions of a filter for n keys, as the expressions in ``functions.keys``."""
    if n == 0:
        return 64, 6
    bits = -(-max(64, ceil(n * -log(0.01) / log(2) ** 2)) // 8) * 8
    return bits, min(30, max(1, round(bits / n * log(2))))


def writer_options(compression: str = "none", keys: int | None = None) -> dict[str, str]:
    """Parquet options of a run: codec, and a filter on the user key if the number of keys is known."""
    assert compression in CODECS
    out = {"compression": compression, "parquet.block.size": str(64 << 20), "parquet.page.size": str(64 << 10)}
    if keys:
        out |= {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(keys)}
    return out
