"""Best-fit packing with bound-certified repacking.

Each partition packs its pieces by best-fit decreasing and computes a lower bound on its number of
sequences from dual-feasible functions. A partition that meets its bound is certified. Partitions
with a gap give up the documents of their sequences that aren't full; these are pooled, dealt
anew to larger partitions, and packed again, until no gap is left or a round saves nothing. The
bound of all lengths together says how far the whole is from the fewest sequences (``certificate``).

Every document is encoded and closed by an end id. Only documents longer than a sequence are cut,
into whole sequences and a rest. Only lengths travel: a row for each piece, and no ids.

Edge cases: a null or empty text is one piece that holds the end id. Repeated rows and equal ids
are documents of their own. Pieces of one length are interchangeable; ties go by a key of the row.
An empty table packs to nothing. A very long text is encoded whole, in one task. Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .tokens import SLICE_BYTES, encoder, tokenizer_json
from .words import text_slices

#: Pieces that a task packs at a time; each round doubles them, up to so many times.
PARTITION_PIECES = 20_000
DOUBLINGS = 6


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins for ``counts[w]`` items of each size w, by dual-feasible functions.

    For each threshold a: items above C - a count as whole bins, those below a as nothing. And for
    each k: x maps to x if (k + 1) x / C is whole, else to floor((k + 1) x / C) / k bins.
    """
    sizes = np.arange(capacity + 1)
    number, weight = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(weight[-1]) // capacity)
    half = capacity // 2
    a = np.arange(1, half + 1)
    large = number[-1] - number[capacity - a]
    over_half = number[-1] - number[half]
    middle = weight[capacity - a] - weight[a - 1]
    best = max(best, int((large + -(-middle // capacity)).max(initial=0)), int(over_half))
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        # in units of 1 / (k * capacity) bins
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and place of every item, and the room left in each bin; items come longest first."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: there are bins with room r
    for i, w in enumerate(lengths.tolist()):
        fitting = some >> w
        if fitting:
            r = w + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], places[i] = b, capacity - r
        room[b] = left = r - w
        if left:
            if not by_room[left]:
                some |= 1 << left
            by_room[left].append(b)
    return bins, places, room


def _pieces(json: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoder(json).encode, 4 * capacity
        for batch in batches:
            for part, texts in text_slices(batch, size=SLICE_BYTES):
                docs = [x + end for x in encode(texts)]
                sizes = np.fromiter(map(len, docs), np.int64, len(docs)) // 4
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(docs)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.record_batch(
                    {
                        "uid": part.column("uid").take(pa.array(doc)),
                        "doc_id": part.column("doc_id").take(pa.array(doc)),
                        "piece": pa.array(piece.astype(np.int32)),
                        "start": pa.array(piece * capacity),
                        "length": pa.array(np.minimum(capacity, sizes[doc] - piece * capacity)),
                        "ids_crc32": pa.array([zlib.crc32(x[at : at + step]) for x in docs for at in range(0, len(x), step)], pa.int64()),
                    }
                )

    return run


def _pack(capacity: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), _ROWS)
        part, most = TaskContext.get().partitionId(), 2 * PARTITION_PIECES << min(turn, DOUBLINGS)
        for at in range(0, table.num_rows, most):
            own = table.slice(at, most).combine_chunks()
            uid, piece, lengths = (np.asarray(own.column(c)) for c in ("uid", "piece", "length"))
            order = np.lexsort((piece, uid, -lengths))
            uid, piece, lengths = uid[order], piece[order], lengths[order]
            bins, places, room = best_fit_decreasing(lengths, capacity)
            gap = len(room) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            base = (turn << 56) + (part << 28) + at
            n = len(lengths)
            yield pa.record_batch(
                {
                    "uid": pa.array(uid), "piece": pa.array(piece), "length": pa.array(lengths), "sequence_id": pa.array(bins + base), "offset": pa.array(places),
                    "room": pa.array(np.array(room, np.int64)[bins]), "gap": pa.array(np.full(n, gap, np.int64)),
                }
            )

    return run


_ROWS = pa.schema([("uid", pa.int64()), ("piece", pa.int32()), ("length", pa.int64())])
_PACKED = "uid long, piece int, length long, sequence_id long, offset long, room long, gap long"


def _packed(pieces: DataFrame, n: int, capacity: int, turn: int) -> DataFrame:
    # a seed for each round deals the documents in another way
    dealt = pieces.select("uid", "piece", "length").repartition(n, F.xxhash64("uid", "piece", F.lit(turn)))
    return checkpoint(dealt.mapInArrow(_pack(capacity, turn), _PACKED))


def pack_lengths(pieces: DataFrame, capacity: int) -> DataFrame:
    """Sequences for rows of uid, piece, length (at most ``capacity``): adds sequence_id, offset.

    Rounds go on until the bound of all lengths is met, or until a round saves nothing though every
    sequence with room was open to it. A round takes up the documents of the sequences that aren't
    full in partitions with a gap, and elsewhere of those with much room: over a half of the
    capacity in the first round, a sixteenth of that in each that follows. They are dealt anew, to
    partitions twice as large.
    """
    best = _packed(pieces, max(1, ceil(pieces.count() / PARTITION_PIECES)), capacity, 0)
    used, bound = certificate(best, capacity)
    for turn in count(1):
        if used <= bound:
            break
        room = capacity >> 4 * turn - 3
        give = (F.col("gap") > 0) & (F.col("room") > 0) | (F.col("room") > room)
        pool = best.where(give)
        n, before = pool.agg(F.count(F.lit(1)), F.sum((F.col("offset") == 0).cast("long"))).first()
        saved = 0
        if n:
            again = _packed(pool, max(1, ceil(n / (PARTITION_PIECES << min(turn, DOUBLINGS)))), capacity, turn)
            saved = before - again.where("offset = 0").count()
        if saved > 0:
            used, best = used - saved, best.where(~give).union(again)
        elif not room:
            break
    return best.select("uid", "piece", "length", "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """The number of sequences in a result of ``pack_documents``, and a lower bound on it for any packing.

    The driver sees one row for each length, so at most ``capacity``.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():
        counts[length] = n
    return packed.where("offset = 0").count(), lower_bound(counts, capacity)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    ``tokenizer`` is the path of a tokenizers file. Returns one row for each piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"))
    schema = f"uid long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    pieces = checkpoint(rows.mapInArrow(_pieces(tokenizer_json(tokenizer), capacity, end_id), schema))
    packed = pack_lengths(pieces, capacity).drop("length")
    out = pieces.join(packed, ["uid", "piece"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
