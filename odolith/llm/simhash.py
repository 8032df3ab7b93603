"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprint: 64 bits; a bit is 1 if it is set in more than half of the XXH64 values of the text's word shingles.
Covering masks: each of the 64 bits gets a vector a(i) of radius + 1 bits. For each nonzero vector v the mask keeps the
bits with odd <a(i), v>. Up to `radius` differing bits leave some v orthogonal to all their vectors, and that mask
keeps none of them: every pair within the radius agrees in at least one of the 2^(radius+1) - 1 tables. No pair is lost.

Equal fingerprints are joined first, so only distinct ones are compared. Buckets of a table with more than `tile`
members are dealt in pairs of tiles, which cover all pairs of the bucket; a task holds two tiles at most and returns a
spanning forest of the links that it found, not the pairs.

Nulls and edges: a null or empty text has no words and the fingerprint zero, linked like any other; a null doc_id
takes part and has the component of its fingerprint, whose id is the smallest doc_id that is not null (null if there
is none); repeated rows are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.llm.graph import components, spread_join
from odolith.llm.text import LOWER, byte_view, slices, words
from odolith.session import cut, ship

SHINGLE, RADIUS, TILE, SEED = 4, 4, 1024, 42


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    flat, counts = words(texts, LOWER)
    n = len(counts)
    sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    # words of all texts, one space after each
    body, at = byte_view(flat)
    data = np.insert(np.frombuffer(body, np.uint8)[at[0] : at[-1]], np.cumsum(sizes), 32).tobytes()
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    first = np.cumsum(counts) - counts
    own = np.where(counts > shingle, counts - shingle + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(n), own)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own)
    left = first[owner] + inside
    right = left + np.minimum(counts[owner], shingle) - 1
    shingles = map(data.__getitem__, map(slice, begins[left].tolist(), (begins[right] + sizes[right]).tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(left))
    return majority(h, own)


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of hashes of such lengths: the bits that are set in more than half of each run. Four 16-bit counters share a word."""
    out = np.zeros(len(counts), np.uint64)
    # runs are cut so that a 16-bit counter suffices
    parts = np.maximum(1, -(-counts // 60_000))
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    parts, total = parts[some], counts[some]
    owner = np.repeat(np.arange(len(some)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = (np.cumsum(total) - total)[owner] + nth * 60_000
    lanes, group = np.uint64(0x0001000100010001), np.cumsum(parts) - parts
    for k in range(16):
        sums = np.add.reduceat((h >> np.uint64(k)) & lanes, at)
        for lane in range(4):
            ones = np.add.reduceat((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF), group)
            out[some] |= (2 * ones.astype(np.int64) > total).astype(np.uint64) << np.uint64(16 * lane + k)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and fp (the fingerprint as a signed long) of every row."""
    ship(docs.sparkSession)
    columns = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema if f.name in keep), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = fingerprints_of(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return columns.mapInArrow(run, schema)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks, signed, such that any set of up to `radius` bits is missed by one of them. Bit vectors are dealt in turn, zero left out."""
    top = 1 << (radius + 1)
    vector = [i % (top - 1) + 1 for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, top)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked(fps: np.ndarray, radius: int, half: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints. half: only between the first so many and the others."""
    n, out = len(fps), []
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(half or n - 1):
        rest = np.arange(half or i + 1, n)
        for j in rest[np.bitwise_count(fps[rest] ^ fps[i]) <= radius].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect all within the radius; ends of an edge differ in `radius` bits at most."""
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    keyed = distinct.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", F.xxhash64("t", F.col("mask").bitwiseAND(F.col("fp"))).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    # both sides hold a row for each mask, which Spark's estimate leaves out: left alone it broadcasts millions of rows that look like few
    member = keyed.join(shared.hint("merge"), "bucket").select("fp", "bucket", tiles.alias("k"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("tile"))
    # tile i meets tile j in the group (i, j), i <= j; with more than one tile, a tile's own pairs are in (i, i)
    dealt = member.select("fp", "bucket", "tile", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    groups = dealt.groupBy("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")).agg(
        F.collect_list(F.when(F.col("tile") <= F.col("other"), F.col("fp"))).alias("x"), F.collect_list(F.when(F.col("tile") > F.col("other"), F.col("fp"))).alias("y")
    )
    two = (F.size("x") + F.size("y")) == 2
    pair = F.concat("x", "y")
    simple = groups.filter(two & ((F.size("y") == 1) | (F.col("i") == F.col("j")))).select(pair[0].alias("a"), pair[1].alias("b"))
    simple = simple.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                fps = np.concatenate([x, y])
                for i, j in linked(fps.view(np.uint64), radius, len(x) if len(y) else 0):
                    a.append(fps[i])
                    b.append(fps[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    more = groups.filter(~two & ((F.col("i") == F.col("j")) | ((F.size("x") > 0) & (F.size("y") > 0)))).select("x", "y").mapInArrow(run, "a long, b long")
    return simple.unionByName(more)


def grouped(marked: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fp, root, component_id (the smallest doc_id of the component) and rows_of_key (rows with the fingerprint) of every distinct fingerprint of marked (doc_id, fp)."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), radius, tile), "simhash")
    of_fp = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    of_fp = cut(of_fp, "roots")
    of_root = of_fp.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("rows_of_key"))
    return spread_join(of_fp, of_root, "root", of_fp.count()).select("fp", "root", "component_id", F.col("n").alias("rows_of_key"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links) of every row."""
    marked = cut(fingerprints(docs, shingle), "fingerprints")
    return spread_join(marked, cut(grouped(marked, radius, tile), "groups"), "fp", marked.count()).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of docs for each component: the least by doc_id (null last), the text's digest and the other columns. Rows that share a doc_id are rows of their own."""
    rest = [c for c in docs.columns if c != "doc_id"]
    # an id may be that of several texts, each in a component of its own: id and digest name a text
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    marked = cut(fingerprints(docs.select("doc_id", "text", digest.alias("digest")), shingle, ("doc_id", "digest")), "fingerprints")
    groups = cut(grouped(marked, radius, tile), "groups")
    # the least row of a fingerprint, then of a root: minima are taken in the map tasks before anything moves
    place = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest"))
    first = marked.groupBy("fp").agg(place.alias("p")).join(groups, "fp").groupBy("root").agg(F.min("p").alias("p"))
    first = cut(first.select(F.col("p.doc_id").alias("first_id"), F.col("p.digest").alias("first_digest")), "first")
    rows = docs.select("doc_id", digest.alias("digest"), F.struct(*rest).alias("r"))
    kept = rows.join(first, rows.doc_id.eqNullSafe(first.first_id) & (rows.digest == first.first_digest)).groupBy("doc_id", "digest").agg(F.min("r").alias("r"))
    return kept.select("doc_id", "r.*").select(*docs.columns)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
