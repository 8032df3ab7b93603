"""Ordered folds of any length as mergeable summaries: rows are dealt by ranges of (key, order), so no key is folded in one task.

A fold is a summary of consecutive rows and a rule that joins the summaries of two neighbouring stretches. A task runs
over its range and writes each row with the summary of its key's rows so far in that range, by a segmented scan over
whole arrays. A range begins inside at most one key, so what has to be carried on is one summary for each range: these
are scanned the same way and joined to the rows of the keys that go on. Rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolith.session import cut, ship

Summary = dict[str, Any]


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.asarray(b) != 0)


class Fold(NamedTuple):
    """row: arrays of the inputs -> summaries of single rows; join: (summary, next summary) -> summary. All parts are doubles."""

    inputs: tuple[str, ...]
    parts: tuple[str, ...]
    row: Callable[..., Summary]
    join: Callable[[Summary, Summary], Summary]


def mean_fold(alpha: float, x: str = "x") -> Fold:
    """Exponential mean: what was before keeps the share `keep`, the rows add `add`; the first value starts it."""
    return Fold(
        (x,), ("keep", "add", "start"), lambda x: {"keep": np.full(len(x), 1 - alpha), "add": alpha * x, "start": x},
        lambda a, b: {"keep": a["keep"] * b["keep"], "add": a["add"] * b["keep"] + b["add"], "start": a["start"]},
    )


def mean_of(s: Summary) -> Column:
    return s["keep"] * s["start"] + s["add"]


def variance_fold(alpha: float) -> Fold:
    """mean_fold() with `spread`, the weighted squares about the stretch's own mean; merging adds the gap between means."""
    mean = mean_fold(alpha)

    def join(a: Summary, b: Summary) -> Summary:
        wa, wb = b["keep"] * (1 - a["keep"]), 1 - b["keep"]
        gap = ratio(a["add"], 1 - a["keep"]) - ratio(b["add"], wb)
        return mean.join(a, b) | {"spread": b["keep"] * a["spread"] + b["spread"] + ratio(wa * wb, wa + wb) * gap * gap}

    return Fold(mean.inputs, (*mean.parts, "spread"), lambda x: mean.row(x) | {"spread": np.zeros(len(x))}, join)


def variance_of(s: Summary) -> Column:
    gap = s["start"] - F.when(s["keep"] < 1, s["add"] / (1 - s["keep"])).otherwise(s["start"])
    return s["spread"] + s["keep"] * (1 - s["keep"]) * gap * gap


def line_fold(tau_s: float) -> Fold:
    """Weighted moments of hours and values about their means; weights fade by tau_s between rows, never for steps back in time."""

    def row(t: np.ndarray, y: np.ndarray) -> Summary:
        one, zero = np.ones(len(t)), np.zeros(len(t))
        return {"t_first": t, "t_last": t, "fade": one, "w": one, "mt": t / 3600, "my": y, "tt": zero, "ty": zero}

    def join(a: Summary, b: Summary) -> Summary:
        gap = np.exp(np.maximum(b["t_first"] - a["t_last"], 0.0) / -tau_s)
        fade = gap * b["fade"]
        wa = fade * a["w"]
        w = wa + b["w"]
        dt, dy, both = b["mt"] - a["mt"], b["my"] - a["my"], wa * b["w"] / w
        return {
            "t_first": a["t_first"], "t_last": b["t_last"], "fade": a["fade"] * fade, "w": w, "mt": a["mt"] + dt * b["w"] / w, "my": a["my"] + dy * b["w"] / w,
            "tt": fade * a["tt"] + b["tt"] + both * dt * dt, "ty": fade * a["ty"] + b["ty"] + both * dt * dy,
        }

    return Fold(("t", "y"), ("t_first", "t_last", "fade", "w", "mt", "my", "tt", "ty"), row, join)


def slope_of(s: Summary) -> Column:
    """Least-squares slope an hour; 0 before three rows or without spread."""
    return F.when((s["n"] < 3) | (s["w"] * s["tt"] <= 1e-12), 0.0).otherwise(s["ty"] / s["tt"])


def cusum_fold(k: float) -> Fold:
    """Sum of what exceeds k, never below 0: the sum so far and the least it has been."""
    return Fold(
        ("x",), ("total", "low"), lambda x: {"total": x - k, "low": x - k},
        lambda a, b: {"total": a["total"] + b["total"], "low": np.minimum(a["low"], a["total"] + b["low"])},
    )


def cusum_of(s: Summary) -> Column:
    return s["total"] - F.least(F.lit(0.0), s["low"])


def highest_fold(x: str = "t") -> Fold:
    """`high`, the greatest value so far, and `earlier`, the greatest without the last row."""
    return Fold(
        (x,), ("last", "high", "earlier"), lambda t: {"last": t, "high": t, "earlier": np.full(len(t), -np.inf)},
        lambda a, b: {"last": b["last"], "high": np.maximum(a["high"], b["high"]), "earlier": np.maximum(a["high"], b["earlier"])},
    )


def together(*folds: Fold) -> Fold:
    """Several folds over the same rows; their parts have different names."""
    inputs = tuple(dict.fromkeys(i for f in folds for i in f.inputs))
    return Fold(
        inputs, tuple(p for f in folds for p in f.parts), lambda *c: {k: v for f in folds for k, v in f.row(*[c[inputs.index(i)] for i in f.inputs]).items()},
        lambda a, b: {k: v for f in folds for k, v in f.join(a, b).items()},
    )


def where_given(name: str, fold: Fold) -> Fold:
    """The fold over those rows alone that have all its inputs, with `n` of them; inputs and parts are named after it, so that several run in one pass."""

    def named(s: Summary) -> Summary:
        return {f"{name}_{p}": v for p, v in s.items()}

    def row(*inputs: np.ndarray) -> Summary:
        given = ~np.isnan(np.array(inputs)).any(axis=0)
        return named(fold.row(*[np.where(given, x, 0.0) for x in inputs]) | {"n": given.astype(float)})

    def join(a: Summary, b: Summary) -> Summary:
        na, nb = a[f"{name}_n"], b[f"{name}_n"]
        with np.errstate(all="ignore"):
            both = fold.join(*[{p: s[f"{name}_{p}"] for p in fold.parts} for s in (a, b)])
        return named({p: np.where(nb == 0, a[f"{name}_{p}"], np.where(na == 0, b[f"{name}_{p}"], both[p])) for p in fold.parts} | {"n": na + nb})

    return Fold(tuple(f"{name}_{i}" for i in fold.inputs), tuple(f"{name}_{p}" for p in (*fold.parts, "n")), row, join)


def given(s: Summary, name: str) -> Summary:
    """The summary of the fold `name` inside one of several."""
    return {k.removeprefix(f"{name}_"): v for k, v in s.items() if k.startswith(f"{name}_")}


def with_count(fold: Fold) -> Fold:
    """The fold with `n`, the number of rows."""
    count = Fold((fold.inputs[0],), ("n",), lambda x: {"n": np.ones(len(x))}, lambda a, b: {"n": a["n"] + b["n"]})
    return together(fold, count)


def stretches(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """True where a row's key differs from that of the row before; the first row is False."""
    new = np.zeros(batch.num_rows, bool)
    for c in by:
        column = batch.column(c)
        for part in column.flatten() if pa.types.is_struct(column.type) else [column]:
            codes = part.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
    return new


def scanned_arrays(s: Summary, new: np.ndarray, join: Callable) -> Summary:
    """Summary of each row's stretch up to it: log2 of the longest stretch passes over the whole arrays."""
    n = len(new)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    depth, step = np.arange(n) - start, 1
    while step <= (depth.max() if n else 0):
        i = np.flatnonzero(depth >= step)
        joined = join({k: v[i - step] for k, v in s.items()}, {k: v[i] for k, v in s.items()})
        s = {k: v.copy() for k, v in s.items()}
        for k, v in joined.items():
            s[k][i] = v
        step *= 2
    return s


def runner(by: list[str], fold: Fold, single: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by key and order: their columns and the summary so far. single: rows are inputs of the fold, else summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = {c: batch.column(f"_{c}").to_numpy(zero_copy_only=False).astype(float) for c in (fold.inputs if single else fold.parts)}
            s = {k: v.copy() for k, v in (fold.row(*arrays.values()) if single else arrays).items()}
            new = stretches(batch, by)
            s = scanned_arrays(s, new, fold.join)
            if held is not None and held_key == [batch.column(c)[0].as_py() for c in by]:
                to = int(new.argmax()) if new.any() else len(new)
                joined = fold.join(held, {k: v[:to] for k, v in s.items()})
                for k, v in joined.items():
                    s[k][:to] = v
            held, held_key = {k: v[-1] for k, v in s.items()}, [batch.column(c)[-1].as_py() for c in by]
            kept = {c: batch.column(c) for c in batch.schema.names if not c.startswith("_") or c == "_range"}
            if single:
                kept["_range"] = pa.array(np.full(len(new), TaskContext.get().partitionId()), pa.int32())
            yield pa.RecordBatch.from_pydict(kept | {f"_{p}": pa.array(s[p]) for p in fold.parts})

    return run


def _schema(df: DataFrame, kept: list[str], parts: tuple[str, ...]) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "_range int", *(f"_{p} double" for p in parts)])


def carried(ends: DataFrame, by: list[str], fold: Fold) -> DataFrame:
    """_range, by, `_before_` parts: for each range that begins inside a key the summary of that key's rows in all ranges before.

    ends: the last row of each range with its summary, one row for each task of the shuffle, whatever the data.
    """
    run = ends.select(*by, "_range", *[f"_{p}" for p in fold.parts]).repartition(1).sortWithinPartitions("_range").mapInArrow(runner(by, fold, single=False), _schema(ends, by, fold.parts))
    turn = Window.orderBy("_range")
    before = run.select("_range", *[F.lag(c).over(turn).alias(c) for c in by], *[F.lag(f"_{p}").over(turn).alias(f"_before_{p}") for p in fold.parts])
    return before.filter(F.col(f"_before_{fold.parts[0]}").isNotNull())


def last_rows(rows: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last row of each range."""
    return rows.groupBy("_range").agg(F.max_by(F.struct(*by, *columns), F.struct(*by, order, "_n")).alias("_end")).select("_range", "_end.*")


def with_carried(rows: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of `before`, which are null where a key begins in the row's range."""
    r, b = rows.alias("r"), F.broadcast(before).alias("b")  # at most one row for each range
    same = [F.col("r._range") == F.col("b._range"), *[F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]]
    return r.join(b, same, "left").select("r.*", *[F.col(f"b.{c}") for c in before.columns if c not in ("_range", *by)])


def folded(df: DataFrame, by: list[str], order: str, fields: dict[str, Column], fold: Fold, results: dict[str, Callable[[Summary], Column]], keep: tuple[str, ...] = ()) -> DataFrame:
    """by, order, keep and results of the fold after each row of its key, in the order of `order`; `n` is among the summary's parts."""
    ship(df.sparkSession)
    fold = with_count(fold)
    own = list(dict.fromkeys([*by, order, *keep]))
    rows = df.select(*own, *[c.cast("double").alias(f"_{name}") for name, c in fields.items()])
    ties = [f"_{name}" for name in fields]
    dealt = rows.repartitionByRange(*by, order).sortWithinPartitions(*by, order, *ties)
    scanned = cut(dealt.mapInArrow(runner(by, fold), _schema(df, own, fold.parts)), "folded")
    before = carried(last_rows(scanned, by, order, [f"_{p}" for p in fold.parts]), by, fold)
    met = with_carried(scanned, before, by)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, earlier = ({p: batch.column(f"{lead}{p}").to_numpy(zero_copy_only=False) for p in fold.parts} for lead in ("_", "_before_"))
            joined = fold.join(earlier, mine)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in (*own, "_range")} | {f"_{p}": pa.array(joined[p]) for p in fold.parts})

    schema = _schema(df, own, fold.parts)
    later = met.filter("_before_n IS NOT NULL").mapInArrow(go_on, schema)
    whole = met.filter("_before_n IS NULL").select(*later.columns).unionByName(later)
    s = {p: F.col(f"_{p}") for p in fold.parts}
    return whole.select(*own, *[f(s).alias(name) for name, f in results.items()])


# A greedy choice: the next kept row is the first that lies far enough after the last one kept.


def jumps(t: np.ndarray, end: np.ndarray, every: float) -> np.ndarray:
    """For each of some rising times the first later one of its stretch (which ends before `end`) that is `every` or more after it, len(t) if none: a binary search of all at once."""
    n = len(t)
    low, high = np.arange(1, n + 1), end.copy()
    while (low < high).any():
        mid = np.minimum((low + high) // 2, n - 1)
        far = (t[mid] - t >= every) & (low < high)
        high, low = np.where(far, mid, high), np.where(far | (low >= high), low, mid + 1)
    return np.append(np.where(low < end, low, n), n)


def chain(entries: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """Which rows the chains from `entries` pass, by pointer doubling: after k rounds all within 2 ** k jumps are found."""
    n = len(jump) - 1
    kept = np.zeros(n + 1, bool)
    kept[entries] = True
    while (jump[:-1] < n).any():
        kept[jump[kept]] = True
        jump = jump[jump]
    return kept[:n]


def last_of_chain(jump: np.ndarray) -> np.ndarray:
    """The row where the chain from each row ends, by pointer doubling."""
    n = len(jump) - 1
    last = np.arange(n)
    jump = np.where(jump < n, jump, np.arange(n + 1))  # the end points to itself
    while (jump[jump] != jump).any():
        jump = jump[jump]
    return jump[last]


def greedy(by: list[str], order: str, every: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over sorted rows: `_kept` as if each key began in this range, whether the key is the range's first, and the highest and last kept time so far."""
    high = highest_fold()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_high, held_kept, first = None, -np.inf, -np.inf, True
        done = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t, new = batch.column("_t").to_numpy(zero_copy_only=False).astype(float), stretches(batch, by)
            key = [batch.column(c)[0].as_py() for c in by]
            goes_on = held_key == key and done > 0
            if done and not goes_on:
                first = False
            s = scanned_arrays(high.row(t), new, high.join)
            number = np.cumsum(new)
            if goes_on:
                own = number == 0
                s["earlier"][own], s["high"][own] = np.maximum(s["earlier"][own], held_high), np.maximum(s["high"][own], held_high)
            at = np.flatnonzero(t > s["earlier"])  # only a new highest time can be kept
            times, of = t[at], number[at]
            jump = jumps(times, np.searchsorted(of, of, "right"), every)
            opens = np.append(True, of[1:] != of[:-1]) if len(at) else np.zeros(0, bool)
            entries = np.flatnonzero(opens)
            if goes_on and len(at) and of[0] == 0:
                ahead = np.flatnonzero((of == 0) & (times - held_kept >= every))
                entries = np.append(ahead[:1], entries[1:])
            kept = np.zeros(len(t), bool)
            kept[at[chain(entries, jump)]] = True
            through = np.where(kept, t, -np.inf)
            last = scanned_arrays({"v": through}, new, lambda a, b: {"v": np.maximum(a["v"], b["v"])})["v"]
            if goes_on:
                last[number == 0] = np.maximum(last[number == 0], held_kept)
            held_key, held_high, held_kept = [batch.column(c)[-1].as_py() for c in by], float(s["high"][-1]), float(last[-1])
            head = first & (number == 0)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in (*by, order)} | {
                "_range": pa.array(np.full(len(t), TaskContext.get().partitionId()), pa.int32()), "_t": t, "_record": t > s["earlier"], "_kept": kept, "_head": head, "_high": s["high"], "_last_kept": last,
                "_n": pa.array(done + np.arange(len(t), dtype=np.int64)),
            })
            first, done = first and not new.any(), done + len(t)

    return run


def throttled(df: DataFrame, key: str, order: str, ts: str, every_s: float) -> DataFrame:
    """key, order, ts of the rows at least every_s seconds after the row of their key that was kept before; the first one is kept. Rows without a time are not kept.

    Each range is decided as if its keys began there. Only the key that a range begins inside needs what was kept before:
    for it the range gives a table of possible entries (within every_s of what came before) and where the chain from each
    ends; those tables are followed range by range, and the range is decided again from its true entry.
    """
    ship(df.sparkSession)
    kinds = f"`{key}` {df.schema[key].dataType.simpleString()}, `{order}` {df.schema[order].dataType.simpleString()}"
    rows = df.filter(F.col(ts).isNotNull()).select(key, order, F.col(ts).cast("double").alias("_t"))
    dealt = rows.repartitionByRange(key, order).sortWithinPartitions(key, order, "_t")
    own = cut(dealt.mapInArrow(greedy([key], order, every_s), f"{kinds}, _range int, _t double, _record boolean, _kept boolean, _head boolean, _high double, _last_kept double, _n bigint"), "throttled")
    ends = last_rows(own, [key], order, ["_high", "_last_kept", "_head"])
    parts = ("high",)
    before = carried(ends.select("_range", key, "_high"), [key], Fold((), parts, lambda: {}, lambda a, b: {"high": np.maximum(a["high"], b["high"])}))
    # ranges that begin inside a key, with only those of its rows that are above all earlier ones
    cont = with_carried(own.filter("_head AND _record"), before, [key]).filter("_before_high IS NOT NULL AND _t > _before_high").select(key, order, "_range", "_t", "_before_high")

    def entries(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_t", "ascending")])
        t = table.column("_t").to_numpy()
        end = t[last_of_chain(jumps(t, np.full(len(t), len(t)), every_s))]
        # what was kept last lies within every_s of the highest time before
        possible = int(np.searchsorted(t, table.column("_before_high")[0].as_py() + every_s, "right")) + 1
        return pa.table({"_range": table.column("_range")[:possible], "_entry": t[:possible], "_exit": end[:possible]})

    tables = cont.groupBy("_range").applyInArrow(entries, "_range int, _entry double, _exit double")
    # a range that lies inside one key leaves what its chain leaves, any other what was kept of its last key
    leaves = with_carried(ends, before, [key]).select("_range", F.when(~F.col("_head") | F.col("_before_high").isNull(), F.col("_last_kept")).alias("_leaves"))
    listed = tables.unionByName(leaves, allowMissingColumns=True)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges in order, each one's entries before its end."""
        kept, now, moved = -np.inf, None, False
        for batch in batches:
            out: list[tuple[int, float]] = []
            for at, entry, exit_, leaves in zip(*[batch.column(c).to_pylist() for c in ("_range", "_entry", "_exit", "_leaves")]):
                if at != now:
                    now, moved = at, False
                    out.append((at, kept))
                if entry is None:
                    kept = kept if leaves is None else leaves
                elif not moved and entry - kept >= every_s:
                    kept, moved = exit_, True
            yield pa.RecordBatch.from_pydict({"_range": pa.array([a for a, _ in out], pa.int32()), "_from": pa.array([k for _, k in out], pa.float64())})

    froms = listed.repartition(1).sortWithinPartitions("_range", F.col("_entry").asc_nulls_last()).mapInArrow(follow, "_range int, _from double")

    def decided(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_t", "ascending")])
        t = table.column("_t").to_numpy()
        ahead = np.flatnonzero(t - table.column("_from")[0].as_py() >= every_s)
        return table.filter(pa.array(chain(ahead[:1], jumps(t, np.full(len(t), len(t)), every_s)))).select([key, order, "_t"])

    again = cont.join(F.broadcast(froms), "_range").groupBy("_range").applyInArrow(decided, f"{kinds}, _t double")
    plain = with_carried(own.filter("_kept"), before, [key]).filter("NOT _head OR _before_high IS NULL").select(key, order, "_t")
    return plain.unionByName(again.select(key, order, "_t")).withColumnRenamed("_t", ts)
