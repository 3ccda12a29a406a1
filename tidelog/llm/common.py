"""Shared helpers: the cluster's shared folder, rows as structs, salts, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import checkpoint, ensure_checkpoint_dir, shared_folder

__all__ = ["checkpoint", "ensure_checkpoint_dir", "shared_folder", "carried", "restored", "salted", "salts", "connected_components"]


def carried(df: DataFrame) -> DataFrame:
    """Each row as a struct ``row`` with fields c0, c1, ..., so that no name of its columns can clash."""
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names).select(F.struct(*names).alias("row"))


def field(df: DataFrame, name: str) -> Column:
    """A column of ``df`` in the rows that ``carried`` gives."""
    return F.col(f"row.c{df.columns.index(name)}")


def restored(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` back from ``row``."""
    return rows.select("row.*").toDF(*like.columns)


def salts(n: int) -> Column:
    """An array of all salts, to be exploded on the side that has one row for each key."""
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def salted(n: int, *by) -> Column:
    """A row's salt, the same each time the row is read."""
    return F.pmod(F.xxhash64(*by), F.lit(n))


#: Tasks among which the links of one node are dealt.
HUB_SALTS = 8


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a") % 1_000_003).alias("s")
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest reachable node for every node of ``edges``, as columns (node, component).

    Alternates large-star and small-star rounds until the edges are stars. Edges point from the
    larger node a to the smaller b. Large star: a hangs under the least neighbour of b, or under b
    if that is less than all its neighbours. Small star: a node's smaller neighbours hang under
    the least of them. Least neighbours are summed in each task before they travel. A node that a
    third of all links point to would be one key of the join, so its links are dealt over
    HUB_SALTS tasks; a node points to few others. Rounds end in checkpoints; the driver sees three
    numbers per round and no link. Nodes without an edge are not returned.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = checkpoint(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _stamp(e)
    while seen[0]:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        below = least.select(F.col("a").alias("b"), "m", F.explode(salts(HUB_SALTS)).alias("salt"))
        large = e.withColumn("salt", salted(HUB_SALTS, "a")).join(below, ["b", "salt"], "left")
        large = large.select("a", F.coalesce("m", "b").alias("b")).distinct()
        moved = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b")))
        e = checkpoint(small.where("a <> b").distinct())
        now = _stamp(e)
        if now == seen:
            break
        seen = now
    tops = e.select(F.col("b").alias("a"), "b")
    return e.union(tops).distinct().select(F.col("a").alias("node"), F.col("b").alias("component"))
