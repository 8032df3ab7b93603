import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from odolith.operators import folds, windows


def rows_of(seed, hot=900, keys=12, late=True):
    """One vehicle with most rows, so that its rows fill several ranges; times that step back now and then."""
    rng, rows = np.random.default_rng(seed), []
    for k, n in [("hot", hot), *[(f"v{i}", int(rng.integers(1, 40))) for i in range(keys)], (None, 7)]:
        t = 1_700_000_000.0
        for i in range(n):
            t += float(rng.choice([0.0, 1.0, 5.0, 9.0, 30.0])) - (20.0 if late and rng.random() < 0.1 else 0.0)
            rows.append((k, i, t, float(rng.normal(100, 3)) if rng.random() > 0.05 else None))
    return rows


@pytest.fixture(params=[1, 7])
def table(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    rows = rows_of(3)
    yield rows, spark.createDataFrame(rows, "vehicle string, seq int, ts double, x double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_key(rows):
    out = {}
    for k, i, t, x in rows:
        out.setdefault(k, []).append((i, t, x))
    return out


def test_mean_and_variance_equal_the_recursion(table):
    rows, df = table
    got = {(r.vehicle, r.seq): r for r in windows.ewvar(df, "vehicle", "seq", "x", 0.07).collect()}
    means = {(r.vehicle, r.seq): r for r in windows.ewma(df, "vehicle", "seq", "x", 0.07).collect()}
    seen = 0
    for k, own in by_key(rows).items():
        n = 0
        for i, _, x in own:
            if x is None:
                continue
            n, seen = n + 1, seen + 1
            if n == 1:
                mean, var = x, 0.0
            else:
                d = x - mean
                mean, var = mean + 0.07 * d, 0.93 * (var + 0.07 * d * d)
            r = got[k, i]
            assert r.n == n and math.isclose(r.mean, mean, rel_tol=1e-12) and math.isclose(r["var"], var, rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(means[k, i].ewma, mean, rel_tol=1e-12)
    assert len(got) == len(means) == seen


def test_trend_equals_the_recursion(table):
    rows, df = table
    got = {(r.vehicle, r.seq): r.slope_per_hour for r in windows.ew_trend(df, "vehicle", "seq", "ts", "x", 600.0).collect()}
    for k, own in by_key(rows).items():
        sums, last, start, n = [0.0] * 5, None, None, 0
        for i, t, x in own:
            if x is None:
                continue
            start = t if start is None else start
            fade = 1.0 if last is None else math.exp(-max(t - last, 0.0) / 600.0)
            h, last, n = (t - start) / 3600, t, n + 1
            sums = [s * fade + more for s, more in zip(sums, (1.0, h, x, h * h, h * x))]
            w, wt, wy, wtt, wty = sums
            spread = w * wtt - wt * wt
            if n < 3:
                assert got[k, i] == 0
            elif spread > 1e-8:
                assert math.isclose(got[k, i], (w * wty - wt * wy) / spread, rel_tol=1e-4, abs_tol=1e-3)


@pytest.mark.parametrize("every", [3.0, 60.0, 1e5])
def test_throttle_equals_the_greedy_rule(table, every):
    rows, df = table
    got = {(r.vehicle, r.seq) for r in windows.throttled(df, "vehicle", "seq", "ts", every).collect()}
    want = set()
    for k, own in by_key(rows).items():
        kept = None
        for i, t, _ in own:
            if kept is None or t - kept >= every:
                kept = t
                want.add((k, i))
    assert got == want


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], "vehicle string, seq int, ts double, x double, n int, _range int")
    assert windows.ewvar(none, "vehicle", "seq", "x", 0.5).collect() == []
    assert windows.throttled(none, "vehicle", "seq", "ts", 5.0).collect() == []
    one = spark.createDataFrame([("a", 1, 5.0, 2.0, 9, 9), ("a", 1, 5.0, 2.0, 9, 9), ("a", 2, None, None, 9, 9)], none.schema)
    assert [r.ewma for r in windows.ewma(one, "vehicle", "seq", "x", 1.0).collect()] == [2.0, 2.0]
    assert windows.throttled(one, "vehicle", "seq", "ts", 5.0).count() == 1


def test_hot_key_is_spread(spark):
    """A vehicle with most rows is dealt over several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame([(k, i, t, x or 0.0) for k, i, t, x in rows_of(5, hot=4000)], "vehicle string, seq int, ts double, x double").repartition(6)
    dealt = df.repartitionByRange("vehicle", "seq").filter("vehicle = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) >= 3 and max(r["count"] for r in dealt) < 2500


def test_joined_summaries_do_not_depend_on_where_they_are_cut():
    rng = np.random.default_rng(1)
    t, y = np.cumsum(rng.uniform(0, 50, 40)), rng.normal(5, 1, 40)
    for fold, inputs in [(folds.variance_fold(0.2), {"x": y}), (folds.line_fold(100.0), {"t": t, "y": y})]:
        s = fold.row(*inputs.values())
        whole = {k: v[-1] for k, v in folds.scanned_arrays(s, np.zeros(40, bool), fold.join).items()}
        for at in (1, 13, 39):
            new = np.arange(40) == at
            part = folds.scanned_arrays(s, new, fold.join)
            joined = fold.join({k: v[at - 1] for k, v in part.items()}, {k: v[-1] for k, v in part.items()})
            assert all(math.isclose(joined[k], whole[k], rel_tol=1e-9, abs_tol=1e-12) for k in whole)
