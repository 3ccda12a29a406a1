r"""Substring dedup by difference-cover anchors.

A difference cover D of the integers modulo v holds, for every difference, two members that far
apart. So when the same run of words stands at positions i and j, some shift below v puts both
i+shift and j+shift at cover positions, and an anchor of ``window - v + 1`` words that starts
there lies whole inside the run. Anchors are hashed only at cover positions; words whose windows
hold no repeated anchor need nothing more. Around repeated anchors every full window is hashed
with 95 bits and looked up: the extension. It runs on hashes, since the other place of a window is
in another task; words and windows are hashed without polynomials (see ``words``).

Plan: the texts are shuffled once by a hash of id and text and that exchange serves all three passes.
Copies of a whole text are found by a 128-bit hash first; one copy stands for its group. Each
task sums equal anchors and windows before the shuffle, so a passage that a third of the
documents hold arrives as one row for each task and not as one row for each document.

Edge cases: a null or empty text has no words and loses none; ``kept_sha256`` is then the hash of
the empty string. Repeated rows are copies of each other. Windows never cross documents. Documents
shorter than a window lose nothing. An empty table gives none. A very long text is hashed whole, in
one task. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import NOT_SPACE, SPACE, Words, mix, sums, text_slices, window_hashes

#: Difference covers by period; fixed values.
COVERS = {1: (0,), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
#: Marks the row by which a task tells others that something repeats; it stands for no text. The
#: filter is on this and not on uid, else Spark would put it on the texts too and read them anew.
LEAD = 3
SALTS = 32


def _cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least 15 words, or else a third of the window."""
    period = max(v for v in COVERS if window - v + 1 >= min(15, max(1, window // 3)))
    return period, COVERS[period]


class _Anchors:
    """The anchors of some texts: the word numbers where they start and their hashes."""

    def __init__(self, words: Words, window: int):
        period, cover = _cover(window)
        self.hashes, self.size = words.hashes(), window - period + 1
        place = words.positions()
        room = np.repeat(words.counts, words.counts) - place
        whole = np.repeat(words.counts >= window, words.counts)
        self.at = np.flatnonzero(np.isin(place % period, cover) & (room >= self.size) & whole)
        self.value = window_hashes(self.hashes, self.size, self.at)
        self.reach = period - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, values = [], []
            for part, texts in text_slices(batch):
                words = Words(texts, NOT_SPACE, lower=False)
                a = _Anchors(words, window)
                uids.append(np.asarray(part.column("uid"))[words.text_of()[a.at]])
                values.append(a.value)
            uid, value = np.concatenate(uids or [np.zeros(0, np.int64)]), np.concatenate(values or [np.zeros(0, np.uint64)])
            order = np.argsort(value, kind="stable")
            ranked = value[order]
            new = np.concatenate((np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1]))
            size = np.diff(np.append(np.flatnonzero(new), len(ranked)))
            many, lead = np.zeros(len(value), bool), np.zeros(len(value), bool)
            many[order] = np.repeat(size > 1, size)
            lead[order] = new & np.repeat(size > 1, size)
            once = ~many
            # what repeats in this batch is known to repeat: one row tells the others, the rest go anywhere;
            # rows stay in the texts' order, and the anchor is left out where the key tells it: both pack better
            n1, n2, n3 = int(once.sum()), int(lead.sum()), int(many.sum())
            lone = mix(value[many] ^ mix(uid[many].astype(np.uint64)))
            yield pa.record_batch(
                {
                    "pk": _signed(np.concatenate((value[once], value[lead], lone))),
                    "mult": pa.array(np.concatenate((np.ones(n1, np.int8), np.full(n2, LEAD, np.int8), np.full(n3, 2, np.int8)))),
                    "uid": pa.array(np.concatenate((uid[once], np.full(n2, -1), uid[many]))),
                    "anchor": pa.array(
                        np.concatenate((np.zeros(n1 + n2, np.int64), value[many].view(np.int64))), mask=np.arange(n1 + n2 + n3) < n1 + n2
                    ),
                }
            )

    return run


def _member(values: np.ndarray, owner: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Whether each value is in the list of its owner."""
    found = np.zeros(len(values), bool)
    bounds = np.searchsorted(owner, np.arange(len(lists) + 1))
    for k, own in enumerate(lists):
        lo, hi = bounds[k], bounds[k + 1]
        if len(own) and hi > lo:
            found[lo:hi] = np.isin(values[lo:hi], own)
    return found


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                words = Words(texts, NOT_SPACE, lower=False)
                a = _Anchors(words, window)
                lists = [np.array(x or (), np.int64).view(np.uint64) for x in part.column("anchors").to_pylist()]
                hit = a.at[_member(a.value, words.text_of()[a.at], lists)]
                near = np.zeros(len(words) + 1, np.int32)  # windows that hold a repeated anchor
                np.add.at(near, np.maximum(hit - a.reach, 0), 1)
                np.add.at(near, hit + 1, -1)
                place = words.positions()
                fits = np.repeat(words.counts, words.counts) - place >= window
                at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & fits)
                k1 = window_hashes(a.hashes, window, at, 0)
                k2 = (window_hashes(a.hashes, window, at, 1) >> np.uint64(33)).astype(np.int32)
                uid, pos = np.asarray(part.column("uid"))[words.text_of()[at]], place[at]
                order = np.lexsort((k2, k1))
                same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
                new = np.concatenate((np.ones(min(1, len(at)), bool), ~same))
                size = np.diff(np.append(np.flatnonzero(new), len(at)))
                many, lead = np.zeros(len(at), bool), np.zeros(len(at), bool)
                many[order] = np.repeat(size > 1, size)
                lead[order] = new & np.repeat(size > 1, size)
                once = ~many
                # runs of windows that are known to repeat travel as one row each
                m = np.flatnonzero(many)
                cut = np.ones(len(m), bool)
                cut[1:] = (np.diff(at[m]) != 1) | (uid[m][1:] != uid[m][:-1])
                runs = np.flatnonzero(cut)
                length = np.diff(np.append(runs, len(m)))
                r = m[runs]
                lone = mix(k1[r] ^ mix(uid[r].astype(np.uint64) * np.uint64(2654435761) + pos[r].astype(np.uint64)))
                n1, n2, n3 = once.sum(), lead.sum(), len(r)
                yield pa.record_batch(
                    {
                        "k1": _signed(np.concatenate((k1[once], k1[lead], lone))),
                        "k2": pa.array(np.concatenate((k2[once], k2[lead], -1 - k2[r])).astype(np.int32)),
                        "mult": pa.array(np.concatenate((np.ones(n1, np.int8), np.full(n2, LEAD, np.int8), np.full(n3, 2, np.int8)))),
                        "uid": pa.array(np.concatenate((uid[once], np.full(n2, -1), uid[r])).astype(np.int64)),
                        "pos": pa.array(np.concatenate((pos[once], np.zeros(n2), pos[r])).astype(np.int32)),
                        "run": pa.array(np.concatenate((np.ones(n1 + n2), length)).astype(np.int32)),
                    }
                )

    return run


def _removal(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                words = Words(texts, NOT_SPACE, lower=False)
                gone = np.zeros(len(words) + 1, np.int32)
                dups, copied = part.column("dups"), np.asarray(part.column("copied"))
                rows = np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(dups), 0)))
                flat = dups.flatten()
                if len(rows):
                    begin = words.first[rows] + np.asarray(flat.field("pos"))
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, begin + np.asarray(flat.field("run")) + window - 1, -1)
                whole = np.repeat(copied & (words.counts >= window), words.counts)
                keep = ~((np.cumsum(gone)[:-1] > 0) | whole)
                # a kept word travels with the one separator behind it
                step = np.zeros(len(words.data) + 1, np.int8)
                step[words.start[keep]] += 1
                step[words.end[keep] + 1] -= 1
                taken = np.cumsum(step[:-1], dtype=np.int8).view(bool)
                joined = words.data.copy()
                joined[words.end] = SPACE
                joined = joined[taken].tobytes()
                size = np.where(keep, words.end - words.start + 1, 0)
                bounds = np.concatenate(([0], np.cumsum(size)))[words.first].tolist()
                kept = [joined[lo : max(lo, hi - 1)] for lo, hi in zip(bounds, bounds[1:])]
                left = sums(keep, words.first)
                out = {
                    "doc_id": part.column("doc_id"),
                    "n_words": pa.array(words.counts.astype(np.int64)),
                    "n_removed": pa.array((words.counts - left).astype(np.int64)),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                }
                if with_text:
                    out["kept_text"] = pa.array([x.decode("utf-8") for x in kept])
                yield pa.record_batch(out)

    return run


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Remove every word that lies in a window of ``window`` words which also starts elsewhere.

    Returns one row for each input row: doc_id, n_words, n_removed, kept_sha256 and, if asked,
    kept_text (the kept words joined by one space).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashes = {"t1": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(7))}
    # a key of the content and not of the place, so that it is the same each time rows are read
    rows = rows.withColumns(hashes).withColumn("uid", F.shiftrightunsigned(F.xxhash64("doc_id", "t1", "t2"), 1)).repartition("uid")

    named = rows.select("uid", "t1", "t2")  # an exchange without the texts
    rows = rows.drop("t1", "t2")
    groups = named.groupBy("t1", "t2").agg(F.min("uid").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # one group may hold a third of all rows: these meet it in SALTS tasks
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = named.withColumn("salt", F.pmod("uid", F.lit(SALTS)))
    copies = salted.join(groups, ["t1", "t2", "salt"]).select("uid", (F.col("uid") != F.col("least")).alias("spare")).distinct()
    rows = rows.join(copies.hint("shuffle_hash"), "uid", "left")
    apart = rows.where("not coalesce(spare, false)")

    # all three passes ask for the same columns, so that one exchange serves them
    anchors = apart.select("uid", "doc_id", "text").mapInArrow(_anchor_rows(window), "pk long, mult byte, uid long, anchor long")
    anchors = anchors.withColumn("n", F.sum("mult").over(Window.partitionBy("pk"))).where(f"n > 1 and mult < {LEAD}")
    lists = anchors.groupBy("uid").agg(F.collect_set(F.coalesce("anchor", "pk")).alias("anchors"))

    held = apart.join(lists.hint("shuffle_hash"), "uid").select("uid", "doc_id", "text", "anchors")
    windows = held.mapInArrow(_window_rows(window), "k1 long, k2 int, mult byte, uid long, pos int, run int")
    windows = windows.withColumn("n", F.sum("mult").over(Window.partitionBy("k1", "k2"))).where(f"n > 1 and mult < {LEAD}")
    dups = windows.groupBy("uid").agg(F.collect_list(F.struct("pos", "run")).alias("dups"))

    final = rows.join(dups.hint("shuffle_hash"), "uid", "left").select("uid", "doc_id", "text", F.col("spare").isNotNull().alias("copied"), "dups")
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return final.mapInArrow(_removal(window, with_text), schema)
