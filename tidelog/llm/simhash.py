r"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint bit is one if it is set in over half the shingle hashes of a text. Fingerprints are
cut into blocks; two that differ in at most d of the bits agree in all but d blocks, so joining on
every choice of the other blocks finds each close pair, and the Hamming distance is then checked.

Only distinct fingerprints are joined: copies meet in a pre-aggregated grouping. Inside a join
bucket each fingerprint is first compared with a few of the bucket; the components of these links
are contracted, and only pairs of different components are joined after that. So a dense group
gives stars and not all its pairs, yet no link between components is missed.

Edge cases: a null text has no words; its fingerprint is zero and links like any other. With fewer
words than a shingle, the whole sequence is the shingle. Repeated rows share a component. A null
id takes part but is never a component's id; a component of null ids alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, checkpoint, connected_components, field, restored, salted, salts
from .words import NOT_SPACE, SPACE, Words, mix, text_slices

SEED = 42
BITS = 64


def _shingles(texts: list[bytes], size: int, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, and the bounds of each text's shingles.

    With ``distinct`` each shingle of a text counts once, and a text's hashes are sorted.
    """
    words = Words(texts, NOT_SPACE, lower=True)
    # one space between words: the separator behind each word goes with it
    step = np.zeros(len(words.data) + 1, np.int8)
    step[words.start] += 1
    step[words.end + 1] -= 1
    data = words.data.copy()
    data[words.end] = SPACE
    data = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)].tobytes()
    bound = np.concatenate(([0], np.cumsum(words.end - words.start + 1)))
    counts = np.where(words.counts > 0, np.maximum(words.counts - size + 1, 1), 0)
    first = np.repeat(words.first[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.minimum(first + size, np.repeat(words.first[1:], counts))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(data[a:b], SEED) for a, b in zip(bound[first].tolist(), (bound[last] - 1).tolist())]
    hashes = np.array(hashes, np.uint64)
    if distinct:
        owner = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, counts = hashes[new], np.bincount(owner[new], minlength=len(counts))
    return hashes, np.concatenate(([0], np.cumsum(counts)))


#: The bits of each byte value.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Texts whose byte counts are held at a time.
_TEXTS_AT_ONCE = 2000


def _majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The majority bits of each range of hashes, as one 64-bit number.

    Each of the eight bytes is counted by value, and the counts times the values' bits are the
    bits' counts: eight passes where counting bits one by one would take 64.
    """
    out = np.zeros(len(bounds) - 1, np.uint64)
    for lo in range(0, len(out), _TEXTS_AT_ONCE):
        own = bounds[lo : lo + _TEXTS_AT_ONCE + 1]
        counts = np.diff(own)
        n = len(counts)
        part = hashes[own[0] : own[-1]].view(np.uint8).reshape(-1, 8)
        row = np.repeat(np.arange(n) * 256, counts)
        bits = np.empty((n, 8), np.uint8)
        for k in range(8):
            by_value = np.bincount(row + part[:, k], minlength=n * 256).reshape(n, 256)
            bits[:, k] = np.packbits(2 * (by_value @ _BYTE_BITS) > counts[:, None], axis=1, bitorder="little")[:, 0]
        out[lo : lo + n] = bits.view(np.uint64).ravel()
    return out


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": pa.array(_majority(*_shingles(texts, size)).view(np.int64))})

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id and fp, the 64-bit fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"doc_id {id_type}, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def block_masks(distance: int, spare: int) -> list[int]:
    """For ``distance + spare`` blocks, a mask for each choice of ``spare`` blocks that must agree."""
    n = distance + spare
    cuts = [round(BITS * k / n) for k in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [_signed(sum(choice)) for choice in combinations(blocks, spare)]


def _tables(distance: int, spare: int) -> Column:
    """A row for each choice of blocks: its number t and the bits k of ``fp`` in them."""
    return F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(distance, spare)])).alias("t", "k")


def _close(a: str, b: str, distance: int) -> Column:
    """The Hamming check of two fingerprints."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


#: Tasks among which the members of one bucket are dealt.
SALTS = 8


#: Members of a bucket that all others are compared with before components are made.
PIVOTS = 2


def _in_buckets(keyed: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``keyed`` (bucket, node and ``columns``) whose bucket has several, with how many, ``n``, and ``pivots``.

    Pivots are the least node of each of PIVOTS classes, summed in each task first; a bucket's rows
    then meet them in SALTS tasks.
    """
    entry = F.struct("node", *columns)
    least = [F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(PIVOTS)) == k, entry)) for k in range(PIVOTS)]
    buckets = keyed.groupBy("bucket").agg(F.array_compact(F.array(*least)).alias("pivots"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = buckets.withColumn("salt", F.explode(salts(SALTS)))
    return checkpoint(keyed.withColumn("salt", salted(SALTS, "node")).join(buckets, ["bucket", "salt"]).drop("salt"))


def _to_pivots(shared: DataFrame) -> DataFrame:
    """Each member of a bucket with each pivot, once for two that are both pivots: its columns and ``pivot``."""
    each = shared.withColumns({"pivot": F.explode("pivots"), "is_pivot": F.array_contains("pivots.node", F.col("node"))})
    return each.where((F.col("node") > F.col("pivot.node")) | (F.col("node") != F.col("pivot.node")) & ~F.col("is_pivot"))


def _across(shared: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs a, b of members of one bucket whose components (node, c1) differ, smaller component first.

    Every member counts, since any may link two components. One side is dealt over SALTS tasks,
    and the other goes to each of them.
    """
    labelled = shared.drop("pivots").join(near, "node", "left").withColumn("c1", F.coalesce("c1", "node"))
    # buckets that lie in one component have nothing more to compare
    open_ = labelled.groupBy("bucket").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo < hi")
    open_ = open_.select("bucket", F.explode(salts(SALTS)).alias("salt"))
    labelled = checkpoint(labelled.withColumn("salt", salted(SALTS, "node")).join(open_, ["bucket", "salt"]))
    a, b = labelled.alias("a"), labelled.withColumn("salt", F.explode(salts(SALTS))).alias("b")
    same = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.salt") == F.col("b.salt"))
    return a.join(b, same & (F.col("a.c1") < F.col("b.c1")))


def _together(near: DataFrame, links: DataFrame) -> DataFrame:
    """Components of nodes from their first ones (node, c1) and links between those (cx, cy): node, component."""
    far = checkpoint(connected_components(links, "cx", "cy").select(F.col("node").alias("c1"), F.col("component").alias("c2")))
    alone = far.join(near, "c1", "left_anti").select(F.col("c1").alias("node"), "c1")
    return near.unionByName(alone).join(far, "c1", "left").select("node", F.coalesce("c2", "c1").alias("component"))


def _close_components(keyed: DataFrame, distance: int) -> DataFrame:
    """Components of the fingerprints (node) that share a bucket and differ in few bits; columns (node, component).

    Nodes without a link are left out.
    """
    shared = _in_buckets(keyed)
    star = _to_pivots(shared).where(_close("node", "pivot.node", distance))
    star = star.select(F.col("node").alias("x"), F.col("pivot.node").alias("y"))
    near = checkpoint(connected_components(star, "x", "y").select("node", F.col("component").alias("c1")))
    links = _across(shared, near).where(_close("a.node", "b.node", distance)).select(F.col("a.c1").alias("cx"), F.col("b.c1").alias("cy"))
    return _together(near, links)


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 3, spare: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each row's fingerprint and the smallest id reachable over links of at most ``distance`` bits.

    Returns one row for each input row: doc_id, fingerprint (16 hex digits), component_id.
    """
    prints = checkpoint(fingerprints(docs, shingle, id_col, text_col))
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    keyed = ids.select(F.col("fp").alias("node"), _tables(distance, spare)).select("node", F.xxhash64("t", "k").alias("bucket"))
    linked = checkpoint(_close_components(keyed, distance).withColumnRenamed("node", "fp"))
    labels = ids.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labels.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = labels.join(least, "component").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: A band is the least values of BAND_ROWS orders of a text's shingles. Two sets of similarity J
#: agree in a band with probability J ** BAND_ROWS, and in one of all with 0.9993 at 0.8.
BANDS, BAND_ROWS = 24, 6
#: Texts link at this share of common shingles, in hundredths.
SIMILAR = 80
_ORDERS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each range of hashes; zeros for an empty one."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    if len(some):
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for order in _ORDERS[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashes * order, bounds[some]))
            out[some, band] = key
    return out


def _bands(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                hashes, bounds = _shingles(texts, size, distinct=True)
                cuts = bounds.tolist()
                node = [xxhash.xxh64_intdigest(hashes[a:b].tobytes(), SEED) for a, b in zip(cuts, cuts[1:])]
                out = {n: part.column(n) for n in ("doc_id", "t1", "t2")}
                out["node"] = pa.array(np.array(node, np.uint64).view(np.int64))
                out["size"] = pa.array(np.diff(bounds))
                out["fp"] = pa.array(_majority(hashes, bounds).view(np.int64))
                flat = band_keys(hashes, bounds).view(np.int64).ravel()
                out["keys"] = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * BANDS, pa.int32()), pa.array(flat))
                yield pa.record_batch(out)

    return run


#: Bits of a sketch of a set, 64 to a number.
SKETCH_BITS = 1024
_SKETCH = [f"k{n}" for n in range(SKETCH_BITS // 64)]


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each range of hashes a row of SKETCH_BITS bits, as numbers of 64: those that some hash's first bits name."""
    n, shift = len(bounds) - 1, np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    marks = np.zeros((n, SKETCH_BITS), bool)
    marks[np.repeat(np.arange(n), np.diff(bounds)), (hashes >> shift).astype(np.int64)] = True
    return np.packbits(marks, axis=1, bitorder="little").view(np.int64)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                hashes, bounds = _shingles(texts, size, distinct=True)
                out = {"node": part.column("node"), "shingles": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))}
                yield pa.record_batch(out | {k: pa.array(column) for k, column in zip(_SKETCH, sketches(hashes, bounds).T)})

    return run


def _may_be_similar() -> Column:
    """Whether the sketches of a and b leave it open that their sets have the similarity to link; true without sketches.

    Each bit that only one of the sketches has stands for a shingle that only this set has, or for
    several, so the sets have at most the rest in common. No pair that links is ruled out.
    """
    bits = lambda x: [F.col(f"{x}.{k}") for k in _SKETCH]
    lacks = lambda x, y: sum((F.bit_count(u.bitwiseAND(F.bitwise_not(v))) for u, v in zip(bits(x), bits(y))), F.lit(0))
    most = F.least(F.col("a.size") - lacks("a", "b"), F.col("b.size") - lacks("b", "a"))
    return F.coalesce((100 + SIMILAR) * most >= SIMILAR * (F.col("a.size") + F.col("b.size")), F.lit(True))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y, ...) of nodes whose sets of shingles have the similarity to link.

    A group of copies has one y for very many x. Its pairs are dealt over SALTS tasks, and its set
    goes to those tasks and to no others.
    """
    pairs = pairs.withColumn("salt", salted(SALTS, "x"))
    ys = pairs.select("y", "salt").distinct().join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy")), "y")
    pairs = pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")), "x").join(ys, ["y", "salt"])
    both = F.size(F.array_intersect("sx", "sy"))
    return pairs.where((100 + SIMILAR) * both >= SIMILAR * (F.size("sx") + F.size("sy"))).drop("sx", "sy", "salt")


#: Members of buckets with more than so many are compared by their sketches first.
CROWD = 32


def _linked(nodes: DataFrame, texts: DataFrame, shingle: int, distance: int, spare: int) -> DataFrame:
    """Components of the nodes (node, size, fp, keys, doc_id, t1, t2) over links of SIMILAR; columns (node, component).

    Buckets are the fingerprints' block tables, whose pairs pass the Hamming check, and the bands.
    As in ``near_duplicates``, nodes are first compared with the pivots of each bucket, the
    components of these links are contracted, and then only nodes of different components are
    compared, in crowded buckets only those whose sketches leave a link open. The
    shingles of the nodes that share a bucket are made once, from the text of (doc_id, t1, t2).
    """
    # sets without shingles have one node
    by_blocks = nodes.where("size > 0").select("node", "size", "fp", _tables(distance, spare))
    by_blocks = by_blocks.select("node", "size", "fp", F.xxhash64("t", "k").alias("bucket"))
    by_bands = nodes.select("node", "size", F.lit(None).cast("long").alias("fp"), F.explode("keys").alias("bucket"))
    shared = _in_buckets(by_blocks.unionByName(by_bands), "size", "fp")
    # members of a band have no fingerprint there
    close = lambda a, b: F.coalesce(_close(a, b, distance), F.lit(True))
    # sets of such sizes can't be similar enough
    fits = lambda a, b: (F.col(a) * 100 >= F.col(b) * SIMILAR) & (F.col(b) * 100 >= F.col(a) * SIMILAR)
    sources = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("kid"), F.col("t1").alias("k1"), F.col("t2").alias("k2"))
    match = F.col("doc_id").eqNullSafe(F.col("kid")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))
    chosen = texts.join(sources.hint("shuffle_hash"), match)
    sets = chosen.select("node", "text").mapInArrow(_sets(shingle), ", ".join(["node long, shingles array<long>", *(f"{k} long" for k in _SKETCH)]))
    # repeated rows give equal sets
    sets = checkpoint(sets.groupBy("node").agg(*(F.first(c).alias(c) for c in ("shingles", *_SKETCH))))
    star = _to_pivots(shared).where(fits("size", "pivot.size") & close("fp", "pivot.fp"))
    star = _similar(star.select(F.col("node").alias("x"), F.col("pivot.node").alias("y")).distinct(), sets)
    near = checkpoint(connected_components(star, "x", "y").select("node", F.col("component").alias("c1")))
    crowded = shared.where(F.col("n") > CROWD).join(sets.select("node", *_SKETCH), "node")
    rest = shared.where(F.col("n") <= CROWD).withColumns({k: F.lit(None).cast("long") for k in _SKETCH})
    across = _across(crowded.unionByName(rest), near).where(fits("a.size", "b.size") & close("a.fp", "b.fp") & _may_be_similar())
    across = across.select(F.col("a.node").alias("x"), F.col("b.node").alias("y"), F.col("a.c1").alias("cx"), F.col("b.c1").alias("cy"))
    return _together(near, _similar(checkpoint(across.distinct()), sets))


def keep_one_of_each(
    docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, spare: int = 3
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of least id stays.

    Two texts link when their sets of shingles have a similarity of SIMILAR hundredths or more.
    Candidates are, as in ``near_duplicates``, those whose fingerprints (here of the sets) agree in
    ``spare`` blocks and differ in at most ``distance`` bits. At a similarity of 0.8 some ten bits
    differ, more than that check allows, so texts that agree in a band of least shingle hashes are
    candidates too. The similarity of the candidates' hashes decides. Of equal rows one
    stays; a null id stays only if no row of its component has an id.
    """
    text = field(docs, text_col).cast("string")
    hashes = F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(7)).alias("t2")
    named = carried(docs).select("row", field(docs, id_col).alias("doc_id"), *hashes)
    rows = carried(docs).select(field(docs, id_col).alias("doc_id"), text.alias("text"), *hashes)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    prints = checkpoint(rows.mapInArrow(_bands(shingle), f"doc_id {id_type}, t1 long, t2 long, node long, size long, fp long, keys array<long>"))
    source = F.min_by(F.struct("doc_id", "t1", "t2"), F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")).alias("source")
    nodes = prints.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "fp", "keys")), source)
    nodes = checkpoint(nodes.select("node", "size", "fp", "keys", "source.*"))
    linked = _linked(nodes, rows, shingle, distance, spare)
    copies = prints.groupBy("node", "doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")
    kept = copies.groupBy("component").agg(F.min_by(F.struct("doc_id", "t1", "t2", "n"), order).alias("r")).select("r.*")
    kept = checkpoint(kept.toDF("kid", "k1", "k2", "n"))
    match = F.col("doc_id").eqNullSafe(F.col("kid")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))
    once = named.join(kept.where("n = 1").hint("shuffle_hash"), match, "left_semi")
    repeated = named.join(kept.where("n > 1"), match, "left_semi").dropDuplicates(["doc_id", "t1", "t2"])
    return restored(once.unionByName(repeated), docs)
