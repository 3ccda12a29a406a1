"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of benchmark words. For patterns of one length m, a table holds for each
block of two words how far a search may skip when that block stands at the end of the place
looked at; blocks that no pattern holds skip m - 1 words. Where the table says zero, the hash of
the last block selects a bucket of patterns, the hash of the first block narrows it, and what is
left is compared word by word: all pairs at once by the words' hashes, and those that agree by
their bytes. Many cursors move over a batch at once, so each step is one array operation.

Patterns reach the executors in blocks of about ``block_windows`` windows (the item that fills a
block is not cut), which bounds every broadcast. The driver reads the benchmark row by row, builds
one block at a time and broadcasts all before the scan. Texts are scanned once for each block, and
only if there are several blocks are the results merged by a shuffle.

Edge cases: null and empty texts have no words and no hits; a null benchmark text has no window;
equal windows of several items report all these items; repeated rows are judged each by itself;
an empty benchmark hits nothing, and an empty table gives none. A very long text is scanned whole,
in one task. Other columns of the inputs are ignored, or, by ``drop_contaminated``, given back.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, Words, mix, text_slices

CURSOR_WORDS = 256
#: Pairs of a place and a pattern that are compared at a time, about.
PAIRS_AT_ONCE = 1 << 18


def _blocks(h: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words that end at each word number in ``last``."""
    return h[last] if width == 1 else mix(h[last - 1] * np.uint64(0xD1342543DE82EF95) + h[last])


class WuManber:
    """Search for word sequences of one length."""

    def __init__(self, patterns: dict[bytes, tuple[np.ndarray, set[str]]], length: int):
        self.length, self.width = length, min(2, length)
        self.patterns = list(patterns)
        self.items = [sorted(patterns[p][1]) for p in self.patterns]
        hashes = np.stack([patterns[p][0] for p in self.patterns])
        skip = length - self.width + 1
        self.bits = max(12, int(np.ceil(np.log2(len(hashes) * skip + 1))) + 3)
        self.shift = np.full(1 << self.bits, skip, np.int32)
        for end in range(self.width - 1, length):
            at = _blocks(hashes.ravel(), np.arange(len(hashes)) * length + end, self.width)
            np.minimum.at(self.shift, (at >> np.uint64(64 - self.bits)).astype(np.int64), length - 1 - end)
        self.hashes = hashes
        # patterns by the block at their end, and of one bucket by the block at their start
        first, last = self._edges(hashes.ravel(), np.arange(len(hashes)) * length + length - 1)
        self.order = np.lexsort((first, last))
        last, first = last[self.order], first[self.order]
        self.buckets, self.bucket_at = np.unique(last, return_index=True)
        self.bucket_at = np.append(self.bucket_at, len(last))
        # the pair of blocks, as the number of the bucket and a number that grows with it
        self.firsts, rank = np.unique(first, return_inverse=True)
        self.key = np.searchsorted(self.buckets, last) * (len(self.firsts) + 1) + rank

    def _edges(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last block of the windows that end at each word number."""
        return _blocks(h, ends - self.length + self.width, self.width), _blocks(h, ends, self.width)

    def ends(self, h: np.ndarray) -> np.ndarray:
        """Word numbers at which the shift table can't rule out that a pattern ends."""
        n, reach = len(h), self.length - 1
        begin = np.arange(reach, n, CURSOR_WORDS)
        stop = np.minimum(begin + CURSOR_WORDS, n)
        found = []
        while len(begin):
            move = self.shift[(_blocks(h, begin, self.width) >> np.uint64(64 - self.bits)).astype(np.int64)]
            found.append(begin[move == 0])
            begin = begin + np.maximum(move, 1)
            left = begin < stop
            begin, stop = begin[left], stop[left]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, words: Words, h: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
        """(last word, pattern) of every occurrence inside one text."""
        ends = self.ends(h)
        ends = ends[owner[ends] == owner[ends - self.length + 1]]
        if not len(ends):
            return
        first, last = self._edges(h, ends)
        bucket = np.minimum(np.searchsorted(self.buckets, last), len(self.buckets) - 1)
        rank = np.minimum(np.searchsorted(self.firsts, first), len(self.firsts) - 1)
        some = (self.buckets[bucket] == last) & (self.firsts[rank] == first)
        ends, key = ends[some], bucket[some] * (len(self.firsts) + 1) + rank[some]
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        cuts = np.flatnonzero(np.diff(np.cumsum(hi - lo) // PAIRS_AT_ONCE)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ends)]):
            part = slice(a, b)
            n = hi[part] - lo[part]
            end = np.repeat(ends[part], n)
            pattern = self.order[np.repeat(lo[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            for word in range(self.length):
                same = h[end - self.length + 1 + word] == self.hashes[pattern, word]
                end, pattern = end[same], pattern[same]
            for e, k in zip(end.tolist(), pattern.tolist()):
                text = b" ".join(words.data[words.start[w] : words.end[w]].tobytes() for w in range(e - self.length + 1, e + 1))
                if text == self.patterns[k]:
                    yield e, k


def _pattern_blocks(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[list[WuManber]]:
    by_length: dict[int, dict] = defaultdict(dict)

    def built():
        return [WuManber(p, length) for length, p in sorted(by_length.items())]

    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        w = Words([row["t"].encode()], ALNUM, lower=True)
        h, size = w.hashes(), min(window, len(w))
        spans = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]
        for k in range(len(w) - size + 1 if size else 0):
            by_length[size].setdefault(b" ".join(spans[k : k + size]), (h[k : k + size], set()))[1].add(row["i"] or "")
        if sum(map(len, by_length.values())) >= most:
            yield built()
            by_length.clear()
    if by_length:
        yield built()


def _scan(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                words = Words(texts, ALNUM, lower=True)
                h, owner = words.hashes(), words.text_of()
                spans: dict[int, set] = defaultdict(set)
                items: dict[int, set] = defaultdict(set)
                if len(h):
                    for table in tables.value:
                        for end, k in table.search(words, h, owner):
                            doc = int(owner[end])
                            first = int(end - words.first[doc]) - table.length + 1
                            spans[doc].add((first, first + table.length))
                            items[doc].update(table.items[k])
                merged = [_merge(sorted(spans[k])) if k in spans else [] for k in range(part.num_rows)]
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "uid": part.column("uid"),
                        "n_words": pa.array(words.counts.astype(np.int64)),
                        "spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in merged], _SPANS),
                        "items": pa.array([sorted(items[k]) if k in items else [] for k in range(part.num_rows)], pa.list_(pa.string())),
                    }
                )

    return run


def _clean(tables, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                words = Words(texts, ALNUM, lower=True)
                h, owner = words.hashes(), words.text_of()
                keep = np.ones(part.num_rows, bool)
                for table in tables.value if len(h) else ():
                    for end, _ in table.search(words, h, owner):
                        keep[owner[end]] = False
                yield part.filter(pa.array(keep))

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_windows: int = 500_000,
) -> DataFrame:
    """Occurrences of benchmark windows in each document.

    Returns one row for each input row: doc_id, n_words, spans (disjoint ranges of hit words, end
    exclusive), items (ids, as strings, sorted), n_hit, contaminated.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    schema = f"doc_id {id_type}, uid long, n_words long, spans array<struct<start int, end int>>, items array<string>"
    tables = list(_broadcasts(spark, _pattern_blocks(benchmark, item_id_col, item_text_col, window, block_windows)))
    found = [rows.mapInArrow(_scan(t), schema) for t in tables or [spark.sparkContext.broadcast([])]]
    out = found[0]
    if len(found) > 1:
        for more in found[1:]:
            out = out.union(more)
        # repeated rows have one key; as many as there were come back
        out = out.groupBy("uid").agg(
            F.count(F.lit(1)).alias("n"), F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), (F.col("n") / len(found)).cast("int")))).drop("n", "copy")
        out = out.withColumn("spans", F.expr(_MERGE))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.drop("uid").withColumn("n_hit", covered).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", block_windows: int = 500_000
) -> DataFrame:
    """The rows of ``docs`` without an occurrence of a window; columns as before.

    The rows stream through one scan for each block of patterns and nothing is shuffled.
    """
    spark = docs.sparkSession
    out = docs
    for block in _broadcasts(spark, _pattern_blocks(benchmark, "item_id", "text", window, block_windows)):
        out = out.mapInArrow(_clean(block, text_col), out.schema)
    return out


#: Joins sorted ranges that touch or overlap.
_MERGE = """aggregate(spans, cast(array() as array<struct<start int, end int>>), (r, s) ->
    if(size(r) > 0 and s.start <= element_at(r, -1).end,
       concat(slice(r, 1, size(r) - 1), array(named_struct('start', element_at(r, -1).start, 'end', greatest(s.end, element_at(r, -1).end)))),
       concat(r, array(s))))"""


def _broadcasts(spark, blocks):
    for block in blocks:
        yield spark.sparkContext.broadcast(block)
