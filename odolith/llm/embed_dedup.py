"""Near-duplicate vectors by a subspace pigeonhole join, within equal labels.

Unit vectors with cosine >= c lie within squared distance D = 2 - 2c. After one random rotation the vector is split
into blocks of dimensions; each block has the share of D that is in proportion to its dimensions. If two vectors are
within D, some block is within its share, so a range join of each block by its radius finds every pair.

The range join is a grid as wide as the block's radius over several coordinates of the block. The first `depth` of them
deal the rows: a row goes to its own cell and the next one in each, and a pair meets where the higher of its two cells
is in each coordinate. Inside a task `FINE` further coordinates choose which rows of a cell are compared at all: only
those in the same or an adjoining fine cell. Their block distance is tested, and what passes is verified by cosine in
double precision. `depth` follows the size of the largest label and changes how rows are dealt, never which pairs meet.

A pair can pass in several blocks; it counts in the first of them, so links are counted without listing pairs. Equal
vectors of a label are one class from the start, counted by its size. Cells with more than `tile` rows are dealt in
pairs of tiles. A task returns counts for each class and a spanning forest of its links.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
have no links and are components of their own; only vectors of the same length meet; a null vec_id takes part and
counts as a link, but a component is named by its smallest vec_id that is not null (null if there is none); rows that
share a vec_id are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolith.llm.graph import components, spread_join
from odolith.llm.text import ragged
from odolith.session import cut, ship

COSINE, BLOCKS, TILE, SEED = 0.98, 8, 1024, 7
#: Coordinates of the grid inside a task, and classes of a label from which one more coordinate deals the rows.
FINE, DEEPER = 4, 16384
#: Rounding in the tests that only choose candidates.
EPS = 1e-6


@functools.lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))[0]


def bounds(dims: int, blocks: int = BLOCKS) -> np.ndarray:
    return np.linspace(0, dims, min(blocks, dims) + 1).round().astype(int)


def shares(dims: int, cosine: float, blocks: int = BLOCKS) -> np.ndarray:
    """Each block's share of the squared distance, with a little room for rounding."""
    return (2 - 2 * cosine) * np.diff(bounds(dims, blocks)) / dims + EPS


def rotated(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True) @ rotation(v.shape[1])


def cells(x: np.ndarray, block: int, cosine: float, blocks: int = BLOCKS) -> np.ndarray:
    """The grid cell of rotated rows in each coordinate of a block."""
    at = bounds(x.shape[1], blocks)
    return np.floor(x[:, at[block] : at[block + 1]] / np.sqrt(shares(x.shape[1], cosine, blocks)[block])).astype(np.int64)


def adjoining(x: np.ndarray, y: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of the cells x with the cells y, or within x, that differ by one at most in every coordinate; each pair once."""
    both = x if y is None else np.concatenate([x, y])
    low = both.min(axis=0, initial=0) - 1
    step = np.ones(both.shape[1], np.int64)
    step[1:] = np.cumprod((both.max(axis=0, initial=0) - low + 2)[:-1])
    own, other = (x - low) @ step, (x if y is None else y) @ step - low @ step
    order = np.argsort(other, kind="stable")
    ranked = other[order]
    for move in itertools.product((-1, 0, 1), repeat=both.shape[1]):
        delta = int(np.dot(move, step))
        if y is None and delta < 0:
            continue
        lo = np.searchsorted(ranked, own + delta, "left")
        many = np.searchsorted(ranked, own + delta, "right") - lo
        i, j = np.repeat(np.arange(len(own)), many), order[ragged(lo, many)]
        if y is None and not delta:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def links_of(x: np.ndarray, y: np.ndarray | None, block: int, cosine: float, blocks: int = BLOCKS, depth: int = 0, sides: tuple | None = None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of x with y, or within x, that are linked and pass in `block` but in no earlier one.

    sides: for x and y, the coordinates in which a row is in the cell next to its own; a pair counts where no coordinate has both. seen: gets the number of pairs compared.
    """
    at, share = bounds(x.shape[1], blocks), shares(x.shape[1], cosine, blocks)
    rx = rotated(x)
    ry, other = (rx, x) if y is None else (rotated(y), y)
    fine = slice(depth, depth + FINE)
    keep = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for p, q in adjoining(cells(rx, block, cosine, blocks)[:, fine], None if y is None else cells(ry, block, cosine, blocks)[:, fine]):
        if sides:
            apart = sides[0][p] & sides[1][q] == 0
            p, q = p[apart], q[apart]
        if seen is not None:
            seen.append(len(p))
        for s in range(0, len(p), 200_000):
            i, j = p[s : s + 200_000], q[s : s + 200_000]
            part = slice(at[block], at[block + 1])
            ok = ((rx[i, part] - ry[j, part]) ** 2).sum(1) <= share[block]
            i, j = i[ok], j[ok]
            gap = (rx[i] - ry[j]) ** 2
            first = np.ones(len(i), bool)
            for k in range(block):
                first &= gap[:, at[k] : at[k + 1]].sum(1) > share[k]
            v, w = x[i], other[j]
            dot = np.einsum("ij,ij->i", v, w) / (np.sqrt(np.einsum("ij,ij->i", v, v)) * np.sqrt(np.einsum("ij,ij->i", w, w)))
            ok = first & (dot >= cosine)
            keep.append((i[ok], j[ok]))
    return tuple(np.concatenate(z) for z in zip(*keep))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Those of the links (i, j) among n nodes that join two trees when taken in turn."""
    root, a, b = list(range(n)), [], []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for p, q in zip(i.tolist(), j.tolist()):
        s, t = find(p), find(q)
        if s != t:
            root[max(s, t)] = min(s, t)
            a.append(p)
            b.append(q)
    return a, b


def classes(vectors: DataFrame) -> DataFrame:
    """cid, label, v, n, least: the distinct vectors that can link, how often each occurs and its smallest vec_id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    kept = vectors.select("vec_id", F.col("label"), v.alias("v")).filter(sound)
    kept = kept.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    # written once, so that numbers stay what they are
    return cut(kept.select(F.monotonically_increasing_id().alias("cid"), "*"), "vectors")


def deal(found: DataFrame, cosine: float, blocks: int = BLOCKS, tile: int = TILE, depth: int = 1) -> DataFrame:
    """Rows (label, dims, block, cell, i, j, tile, side, cid, n, v): the classes of each cell, dealt in pairs of tiles i <= j."""

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(np.asarray(lists.offsets))
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                x = rotated(np.stack([lists[int(r)].values.to_numpy() for r in rows]))
                part = batch.take(pa.array(rows))
                for k in range(len(bounds(dims, blocks)) - 1):
                    cell = cells(x, k, cosine, blocks)[:, :depth]
                    lists_of = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * cell.shape[1], pa.int32()), pa.array(cell.ravel()))
                    full = lambda v: pa.array(np.full(len(rows), v), pa.int32())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("label"), full(dims), full(k), lists_of], names=["cid", "label", "dims", "block", "own"])

    label = found.schema["label"].dataType.simpleString()
    placed = found.select("cid", "label", "v").mapInArrow(bins, f"cid long, label {label}, dims int, block int, own array<bigint>")
    # bit k of side: the row is in the cell after its own in coordinate k
    placed = placed.withColumn("side", F.explode(F.expr("sequence(0, shiftleft(1, size(own)) - 1)")))
    placed = placed.withColumn("cell", F.expr("transform(own, (c, k) -> c + getbit(side, k))")).drop("own")
    key = ["label", "dims", "block", "cell"]
    # a cell in which every row is a neighbour's in the same coordinate has no pairs of its own
    size = placed.groupBy(*key).agg(F.count("*").alias("m"), F.bit_and("side").alias("common")).filter("m > 1 AND common = 0")
    tiles = F.ceil(F.col("m") / tile).cast("int")
    joined = placed.join(size.select(*key, tiles.alias("k")), key).withColumn("tile", F.pmod(F.xxhash64("cid", F.lit(0)), F.col("k")).cast("int"))
    dealt = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select(*key, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "side", "cid")
    return dealt.join(found.select("cid", "n", "v"), "cid")


def compare(dealt: DataFrame, cosine: float, blocks: int = BLOCKS, depth: int = 1) -> DataFrame:
    """Rows (a, b, w): links of class a to w other rows where b is null; else an edge of the spanning forest."""
    groups = dealt.groupBy("label", "dims", "block", "cell", "i", "j").agg(F.collect_list(F.struct("tile", "side", "cid", "n", "v")).alias("rows"))
    groups = groups.filter(F.size("rows") > 1).select("block", "i", "j", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, w = [], [], []
            for g in range(batch.num_rows):
                block, i, j = (batch.column(c)[g].as_py() for c in ("block", "i", "j"))
                rows = batch.column("rows")[g].values
                tile, side, cid, n = (rows.field(c).to_numpy() for c in ("tile", "side", "cid", "n"))
                x = rows.field("v").flatten().to_numpy().reshape(len(side), -1)
                left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
                if not len(left) or not len(right):
                    continue
                p, q = links_of(x[left], None if i == j else x[right], block, cosine, blocks, depth, (side[left], side[right]))
                p, q = left[p], right[q]
                if not len(p):
                    continue
                weight = np.bincount(p, weights=n[q], minlength=len(cid)) + np.bincount(q, weights=n[p], minlength=len(cid))
                some = np.flatnonzero(weight)
                s, t = forest(p, q, len(cid))
                a += [cid[some], cid[s]]
                b += [np.full(len(some), -1), cid[t]]
                w += [weight[some].astype(np.int64), np.zeros(len(s), np.int64)]
            join = lambda z: pa.array(np.concatenate(z) if z else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([join(a), join(b), join(w)], names=["a", "b", "w"])

    return groups.mapInArrow(run, "a long, b long, w long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, tile: int = TILE, depth: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id of every row of vectors (vec_id, embedding, label)."""
    ship(vectors.sparkSession)
    found = classes(vectors)
    if depth is None:
        largest = found.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        depth = 1 + max(0, math.ceil(math.log2(max(largest, 1) / DEEPER)))
    links = cut(compare(deal(found, cosine, blocks, tile, depth), cosine, blocks, depth), "vector-links")
    counts = links.filter("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("w"))
    roots = components(links.filter("b >= 0").select("a", "b"), "vector-components")
    of = found.select("cid", "label", "v", "n", "least").join(counts, "cid", "left").join(roots, F.col("cid") == roots.node, "left")
    of = cut(of.select(F.struct("label", "v").alias("key"), "n", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), "least", F.coalesce("root", "cid").alias("root")), "vector-roots")
    of_root = of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("rows_of_key"))
    known = spread_join(of, of_root, "root", of.count()).select("key", "n_links", "component_id", F.col("n").alias("rows_of_key"))
    rows = vectors.select("vec_id", F.struct("label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).alias("key"))
    out = spread_join(rows, known, "key", rows.count(), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long").alias("component_id"))
