"""Token ids of whole texts in a packed binary table.

Format: one row for each block of consecutive documents. `payload` holds the block's ids one after another, each in
the minimum number of bits that the vocabulary needs, most significant bit first; `doc_at` has the offset at which
each document begins in the block, `first_id` the number of ids in the shard before the block. Bits of id i of a block
begin at bit i * width, so any document or id range is unpacked with numpy from its own bytes alone. Shards follow one
another in ascending doc_id order, and the manifest has each shard's number of ids.

Nulls and edges: a null text is an empty one; a null doc_id sorts first; equal doc_ids are ordered by a hash of the text,
repeated rows are each kept; an empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odolith.llm.encoding import encoder
from odolith.llm.text import slices
from odolith.session import scratch_path, ship

BLOCKS = "shard int, block int, first_id long, n_ids int, width int, min_doc_id long, max_doc_id long, doc_ids array<bigint>, doc_at array<int>, payload binary"
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 18


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids in `width` bits each, most significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = (ids[:, None].astype(np.uint32) >> np.arange(width - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack_bits(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """ids start .. start + count - 1 of a payload, read from their own bytes only."""
    if count <= 0:
        return np.zeros(0, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(payload, f">u{width // 8}", count, start * width // 8).astype(np.uint32)
    first, last = start * width // 8, -(-(start + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first))[start * width - first * 8 :][: count * width]
    return bits.reshape(count, width).astype(np.uint32) @ (1 << np.arange(width - 1, -1, -1, dtype=np.uint32))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, shards: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text of docs (doc_id, text) and write the packed table to path/blocks.

    Rows are range-partitioned by doc_id and a hash of the text, so a doc_id with very many texts is split; all work after that is within a partition.
    """
    spark = docs.sparkSession
    ship(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, at, n_block = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        width = bits_for(max(enc.vocabulary, (end_id or 0) + 1))
        held_ids, held_docs, held_sizes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal at, n_block, held, held_ids, held_docs, held_sizes
            ids, sizes = np.concatenate(held_ids), np.concatenate(held_sizes)
            doc_ids = pa.concat_arrays(held_docs)
            known = doc_ids.drop_null().to_numpy()
            row = {
                "shard": [shard], "block": [n_block], "first_id": [at], "n_ids": [len(ids)], "width": [width],
                "min_doc_id": [int(known[0]) if len(known) else None], "max_doc_id": [int(known[-1]) if len(known) else None],
                "doc_ids": [doc_ids.to_pylist()], "doc_at": [(np.cumsum(sizes) - sizes).tolist()], "payload": [pack_bits(ids, width)],
            }
            at, n_block, held, held_ids, held_docs, held_sizes = at + len(ids), n_block + 1, 0, [], [], []
            return pa.RecordBatch.from_pydict(row, schema=BLOCK_SCHEMA)

        for batch in slices(batches, size=2 << 20):
            ids, sizes = enc.encode(batch.column("text"), end_id)
            held_ids.append(ids)
            held_sizes.append(sizes)
            held_docs.append(batch.column("doc_id").cast(pa.int64()))
            held += len(ids)
            if held >= block_ids:
                yield close()
        if held_docs:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(shards, "doc_id", "h") if shards else rows.repartitionByRange("doc_id", "h")
    rows.sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()), ("min_doc_id", pa.int64()),
    ("max_doc_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_at", pa.list_(pa.int32())), ("payload", pa.binary()),
])


def manifest(blocks: DataFrame) -> DataFrame:
    """shard, shard_first: the number of ids in all shards before it. One row for each write task."""
    per = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_first"))


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, unpacked from the written blocks."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in ("shard", "first_id", "n_ids", "width", "doc_ids", "doc_at", "payload")}
                ids = unpack_bits(row["payload"].as_py(), row["width"].as_py(), 0, row["n_ids"].as_py())
                at = row["doc_at"].values.to_numpy().astype(np.int64)
                ends = np.append(at[1:], len(ids))
                body, n = memoryview(ids.astype("<u4").tobytes()), len(at)
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["shard"].as_py()), pa.int32()), row["doc_ids"].values, pa.array(row["first_id"].as_py() + at), pa.array(ends - at), pa.array(crc, pa.int64()),
                ], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = blocks.select("shard", "first_id", "n_ids", "width", "doc_ids", "doc_at", "payload").mapInArrow(documents, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(manifest(blocks), "shard").select("doc_id", (F.col("shard_first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark, path: str, doc_id: int) -> np.ndarray:
    """The ids of one document (of all rows with that doc_id): only its blocks are read, only its bits unpacked."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter((F.col("min_doc_id") <= doc_id) & (F.col("max_doc_id") >= doc_id))
    out = []
    for b in blocks.orderBy("shard", "block").select("n_ids", "width", "doc_ids", "doc_at", "payload").toLocalIterator():
        ends = [*b.doc_at[1:], b.n_ids]
        out += [unpack_bits(bytes(b.payload), b.width, a, e - a) for d, a, e in zip(b.doc_ids, b.doc_at, ends) if d == doc_id]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs to a new store in the shared folder and read its documents back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
