"""Token-id files by bit-plane shuffling.

A chunk holds the ids of consecutive documents. Its ids are cut into blocks of fixed size, each
block is transposed into byte planes (or bit planes), equal planes of all blocks are laid end to
end, and each plane is compressed with zstandard; planes of zeros cost a few bytes. Chunks are
rows of a Parquet folder that Spark writes and commits, so the files can lie in any store, a lost
executor's chunks are written again, and the columns beside the planes are the chunk index: shard,
chunk, number of ids, document ids and lengths can be read without any plane.

Shards are ranges of document ids in ascending order, with null ids first; equal ids are ordered
by a hash of their texts, then the texts, so that an id of very many rows has several shards.
Repeated rows are documents of their own. Null and empty texts have the end id only. An empty
table gives an empty folder. A very long text is encoded whole, in one task, and makes a chunk of
its own size. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder
from .tokens import SLICE_BYTES, encoder, tokenizer_json
from .words import text_slices

MAGIC = b"TPL1"
BLOCK_IDS = 8192
#: A chunk ends with the document that reaches so many ids.
CHUNK_IDS = 1 << 18
#: A shard has about so many bytes of text, or less.
SHARD_BYTES = 256 << 20
_HEAD = struct.Struct("<4sBBIQ")


def encode_ids(ids: np.ndarray, planes: str = "byte", level: int = 3) -> bytes:
    """A chunk's bytes: header, compressed plane sizes, compressed planes."""
    ids = np.ascontiguousarray(ids, "<u4")
    whole = len(ids) - len(ids) % BLOCK_IDS
    parts: list[list[bytes]] = [[] for _ in range(32 if planes == "bit" else 4)]
    for block in [*ids[:whole].reshape(-1, BLOCK_IDS), *([ids[whole:]] if whole < len(ids) else [])]:
        rows = block.view(np.uint8).reshape(-1, 4).T
        if planes == "bit":
            rows = np.packbits(np.unpackbits(np.ascontiguousarray(rows), axis=0, bitorder="little").reshape(32, -1), axis=1)
        for part, row in zip(parts, rows):
            part.append(row.tobytes())
    pack = zstandard.ZstdCompressor(level=level)
    packed = [pack.compress(b"".join(p)) for p in parts]
    sizes = struct.pack(f"<{len(packed)}I", *map(len, packed))
    return _HEAD.pack(MAGIC, len(packed), 0, BLOCK_IDS, len(ids)) + sizes + b"".join(packed)


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of a chunk."""
    magic, n, _, block_ids, count = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token chunk")
    sizes, at = struct.unpack_from(f"<{n}I", data, _HEAD.size), _HEAD.size + 4 * n
    unpack, planes = zstandard.ZstdDecompressor(), []
    for size in sizes:
        planes.append(np.frombuffer(unpack.decompress(data[at : at + size]) if count else b"", np.uint8))
        at += size
    out = np.empty((count, 4), np.uint8)
    if n == 4:
        for k, plane in enumerate(planes):
            out[:, k] = plane
        return out.view("<u4").ravel()
    done = byte = 0
    while done < count:
        size = min(block_ids, count - done)
        width = (size + 7) // 8
        bits = np.unpackbits(np.stack([p[byte : byte + width] for p in planes]), axis=1, count=size)
        # rows of ``bits`` are the bits of byte 0, then of byte 1, and so on, as the writer laid them
        out[done : done + size] = np.packbits(bits.reshape(4, 8, size), axis=1, bitorder="little")[:, 0].T
        done, byte = done + size, byte + width
    return out.view("<u4").ravel()


def _encode(json: str, end_id: int, planes: str):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, chunk = encoder(json).encode, TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        owners: list[pa.Array] = []
        sizes: list[int] = []

        def flush():
            nonlocal chunk, held, owners, sizes
            data = encode_ids(np.frombuffer(b"".join(held), "<u4"), planes)
            ids = pa.chunked_array(owners).combine_chunks()
            row = pa.record_batch(
                {
                    "shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "n_ids": pa.array([sum(sizes)], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "lengths": pa.array([sizes], pa.list_(pa.int64())),
                    "data": pa.array([data], pa.binary()),
                }
            )
            chunk, held, owners, sizes = chunk + 1, [], [], []
            return row

        waiting = 0
        for batch in batches:
            for part, texts in text_slices(batch, size=SLICE_BYTES):
                docs = [x + end for x in encode(texts)]
                at = 0
                for k, ids in enumerate(docs):
                    held.append(ids)
                    sizes.append(len(ids) // 4)
                    waiting += len(ids) // 4
                    if waiting >= CHUNK_IDS:
                        owners.append(part.column("doc_id").slice(at, k + 1 - at))
                        at, waiting = k + 1, 0
                        yield flush()
                if at < len(docs):
                    owners.append(part.column("doc_id").slice(at))
        if held:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, planes: str = "byte", id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text and write the ids, each document closed by ``end_id``, under ``path``.

    ``tokenizer`` is the path of a tokenizers file. Documents are range-partitioned by id; the
    texts travel, since the bounds are then sampled from the scan and not from the encoding.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    order = F.col("doc_id"), F.xxhash64("text")
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    schema = f"shard int, chunk int, n_ids long, doc_ids array<{id_type}>, lengths array<long>, data binary"
    chunks = rows.mapInArrow(_encode(tokenizer_json(tokenizer), end_id, planes), schema)
    chunks.write.option("compression", "none").option("parquet.block.size", str(32 << 20)).mode("error").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index with the number of ids before each chunk: shard, chunk, n_ids, first_id."""
    index = spark.read.parquet(path).select("shard", "chunk", "n_ids")
    # one row for each shard: as many as there are range partitions, whatever their size
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_first"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    index = index.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return index.join(shards, "shard").select("shard", "chunk", "n_ids", (F.col("shard_first") + F.col("inside")).alias("first_id"))


def _decode(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = decode_ids(batch.column("data")[k].as_py())
                lengths = np.asarray(batch.column("lengths")[k].values)
                bounds = np.concatenate(([0], np.cumsum(lengths)))
                if bounds[-1] != len(data):
                    raise ValueError("a chunk's index and its ids disagree")
                rows = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                n = len(rows)
                out = {
                    "doc_id": batch.column("doc_ids")[k].values,
                    "shard": pa.array(np.full(n, batch.column("shard")[k].as_py(), np.int32)),
                    "chunk": pa.array(np.full(n, batch.column("chunk")[k].as_py(), np.int32)),
                    "inside": pa.array(bounds[:-1]),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in rows], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(data.astype(np.int64)))
                yield pa.record_batch(out)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids."""
    chunks = spark.read.parquet(path)
    id_type = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, shard int, chunk int, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = chunks.mapInArrow(_decode(with_ids), schema)
    index = read_index(spark, path).drop("n_ids")
    out = docs.join(index, ["shard", "chunk"]).withColumn("start", F.col("inside") + F.col("first_id"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def new_folder(spark: SparkSession) -> str:
    """A folder for one result in the cluster's shared folder."""
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
