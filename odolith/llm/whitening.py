"""Whitening of embeddings: what the leading components of the corpus say of each vector, with unit variance and no correlation.

Each entry c becomes the whole number x = floor(256 c). The fit list has each distinct x vector once, so copies do not
weigh. Its rows, less their mean, are reduced by QR block by block: a task folds its rows into one triangle, triangles
are stacked by sixteens and reduced again, until one of the vector's own size is left; the covariance is never formed.
That triangle goes through Householder bidiagonalisation, dqds and twisted factorisations (qd.py) at the driver.

Scale: one shuffle (of distinct vectors); sums and triangles are folded where the rows are, and what a task passes on
has the size of one triangle. Applying the model is narrow.

Nulls and edges: rows whose vector is null or holds null or non-finite entries are dropped, as are those whose length is
not the most frequent one (the shortest of equally frequent ones); a null id and repeated rows are kept; vectors without
entries, and empty tables, give no rows; with fewer dimensions than components there are as many as dimensions. Where
nothing varies along a component `whitened` is null, and `explained` is null where nothing varies at all. A `deviation` beyond
64 bits is null. Further columns are ignored. A component's sign is that which makes its greatest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.llm import qd
from odolith.session import cut, ship

SCALE, FAN_IN = 256, 16


class Whitening(NamedTuple):
    """n, exact sums of each dimension, unit directions as rows, their eigenvalues, the trace of the covariance and the identity error."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def whole_numbers(embedding: Column) -> Column:
    """floor(256 c) of each entry as long; null for a vector that is null or holds null or non-finite entries."""
    entries = embedding.cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(entries, lambda c: F.floor(c * SCALE) + F.lit(0).cast("bigint")))


def quantised(rows: DataFrame, embedding: str, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """keep and x of the rows that remain, and the number of dimensions (0: none remain)."""
    made = rows.select(*keep, whole_numbers(F.col(embedding)).alias("x")).filter(F.size("x") > 0)
    common = made.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return (made, 0) if common is None else (made.filter(F.size("x") == common.d), common.d)


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def moments(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Rows, and exact sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = matrix(batch, d)
            # 64 bits hold the sums of a batch unless its entries are huge
            small = len(x) == 0 or np.abs(x.astype(float)).max() * len(x) < 2**62
            n, total = n + len(x), total + (x if small else x.astype(object)).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dimension": pa.array([-1, *range(d)], pa.int32()), "total": pa.array([str(n), *map(str, total)])})

    parts = fit.select("x").mapInArrow(run, "dimension int, total string")
    found = {r.dimension: int(r.total) for r in parts.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return found.get(-1, 0), tuple(found.get(i, 0) for i in range(d))


def triangle(fit: DataFrame, d: int, mean: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of all rows less their mean, by blocks and then by stacks of FAN_IN triangles."""

    def reduced(rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(rows, mode="r")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            x = matrix(batch, d)
            if len(x):
                r = reduced(np.vstack([r, x - mean]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"block": pa.array([TaskContext.get().partitionId()], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    def stacked(table: pa.Table) -> pa.Table:
        r = np.vstack([np.frombuffer(b, float).reshape(-1, d) for b in table.sort_by("block").column("r").to_pylist()])
        return pa.table({"block": pa.array([table.column("block")[0].as_py() // FAN_IN], pa.int32()), "r": pa.array([reduced(r).tobytes()], pa.binary())})

    blocks = fit.rdd.getNumPartitions()
    rows = fit.select("x").mapInArrow(folded, "block int, r binary")
    while blocks > 1:
        rows = rows.groupBy(F.floor(F.col("block") / FAN_IN).alias("stack")).applyInArrow(stacked, "block int, r binary")
        blocks = -(-blocks // FAN_IN)
    r = np.vstack([np.zeros((0, d)), *[np.frombuffer(x.r, float).reshape(-1, d) for x in rows.collect()]])
    return np.vstack([r, np.zeros((max(d - len(r), 0), d))])


def projector(model: Whitening) -> np.ndarray:
    """Columns that map a vector less the mean to its whitened components; NaN where nothing varies."""
    flat = model.values <= 0
    return np.where(flat, np.nan, model.directions.T / np.sqrt(np.where(flat, 1.0, model.values)))


def identity_error(fit: DataFrame, d: int, model: Whitening) -> float | None:
    """Greatest absolute entry of the whitened fit list's covariance less the identity, over components that vary."""
    mean, map_ = np.array([s / model.n for s in model.sums]), projector(model)
    map_ = map_[:, model.values > 0]
    k = map_.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = (matrix(batch, d) - mean) @ map_
            total, first = total + w.T @ w, first + w.sum(axis=0)
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(i, np.arange(k)), pa.int32()), "j": pa.array(np.append(j, np.full(k, -1)), pa.int32()), "total": np.append(total.ravel(), first)})

    if not k:
        return None
    sums = {(r.i, r.j): r.total / model.n for r in fit.select("x").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    return float(max(abs(sums[i, j] - sums[i, -1] * sums[j, -1] - (i == j)) for i in range(k) for j in range(k)))


def fit_list(made: DataFrame) -> DataFrame:
    return cut(made.select("x").distinct(), "fit-list")


def fit(distinct: DataFrame, d: int, components: int = 4) -> Whitening:
    """The model of a fit list of d dimensions."""
    ship(distinct.sparkSession)
    n, sums = moments(distinct, d)
    r = triangle(distinct, d, np.array([s / n for s in sums]))
    values, directions = qd.leading(r, components)
    if len(directions):
        directions = directions * np.where(np.take_along_axis(directions, np.abs(directions).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
    lead = np.where(np.abs(directions).any(axis=1), values[: len(directions)] / n, 0.0)
    model = Whitening(n, sums, directions, lead, float(values.sum()) / n, 0.0)
    return model._replace(identity_error=identity_error(distinct, d, model))


def applied(made: DataFrame, d: int, model: Whitening, keep: tuple[str, ...]) -> DataFrame:
    """keep, component, n, deviation, whitened, explained, identity_error: a row for each row and component."""
    mean, map_, k = np.array([s / model.n for s in model.sums]), projector(model), len(model.values)
    n, sums = model.n, np.array(model.sums, object)
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, d)
            # whole numbers of any size, unless all fit into 64 bits
            span = n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, model.sums))
            exact = d * span * span < 2**63
            gap = n * (x if exact else x.astype(object)) - (sums.astype(np.int64) if exact else sums)
            deviation = [v if -(2**63) <= v < 2**63 else None for v in (gap * gap).sum(axis=1).tolist()]
            whitened = ((x - mean) @ map_).ravel()
            at = np.repeat(np.arange(len(x)), k)
            own = {c: batch.column(c).take(pa.array(at)) for c in keep}
            yield pa.RecordBatch.from_pydict(own | {
                "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), "n": pa.array(np.full(len(at), n, np.int64)), "deviation": pa.array(deviation, pa.int64()).take(pa.array(at)),
                "whitened": pa.array(whitened, mask=np.isnan(whitened)), "explained": pa.array(explained * len(x), pa.float64()), "identity_error": pa.array([model.identity_error] * len(at), pa.float64()),
            })

    kinds = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in keep)
    return made.mapInArrow(run, f"{kinds}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whitened(rows: DataFrame, embedding: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = 4) -> DataFrame:
    """Fit on all rows and apply to all rows."""
    made, d = quantised(rows, embedding, keep)
    if not d:
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.sparkSession.createDataFrame([], f"{kinds}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return applied(made, d, fit(fit_list(made), d, components), keep)
