"""Ordered operators for each key: verdicts, statistics, latches and islands (WIN1-WIN16).

`key` names the key, `order` the arrival order within it, `ts` a time in seconds. Plain windows shuffle once on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolith.operators import folds


def _before(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _through(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def dedup_verdict(df: DataFrame, key: str, order: str, seq: str = "seq", width: int = 1024) -> DataFrame:
    """`verdict`: NEW if the first or above all before, TOO_OLD if `width` or more below the highest, DUPLICATE if seen, else NEW_LATE."""
    high = F.max(seq).over(_before(key, order))
    again = F.row_number().over(Window.partitionBy(key, seq).orderBy(order)) > 1
    new, old = high.isNull() | (F.col(seq) > high), high - F.col(seq) >= width
    return df.withColumn("verdict", F.when(new, "NEW").when(old, "TOO_OLD").when(again, "DUPLICATE").otherwise("NEW_LATE"))


def in_order(df: DataFrame, key: str, order: str, ts: str) -> DataFrame:
    """`in_order`: not before any time already seen."""
    return df.withColumn("in_order", F.coalesce(F.col(ts) >= F.max(ts).over(_before(key, order)), F.lit(True)))


def on_runs(df: DataFrame, key: str, order: str, ts: str, on: Column, warm_s: float = 900.0) -> DataFrame:
    """`on_since`: start of the unbroken run of rows where `on` holds (null counts as off); `warm`: it lasts for warm_s."""
    held = F.coalesce(on, F.lit(False))
    island = df.withColumn("_on", held).withColumn("_island", F.count_if(~F.col("_on")).over(_through(key, order)))
    start = F.min(F.when(F.col("_on"), F.col(ts))).over(Window.partitionBy(key, "_island"))
    out = island.withColumn("on_since", F.when(F.col("_on"), start))
    return out.withColumn("warm", F.coalesce(F.col(ts) - F.col("on_since") >= warm_s, F.lit(False))).drop("_on", "_island")


def ewma(df: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """key, order, `n`, `ewma`: each value moves the mean by alpha of the difference; the first is the start. Null values are left out."""
    known = df.filter(F.col(value).isNotNull())
    return folds.folded(known, [key], order, {"x": F.col(value)}, folds.mean_fold(alpha), {"n": _rows, "ewma": folds.mean_of})


def ewvar(df: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """key, order, `n`, `mean`, `var`: exponentially weighted, both updated by the difference from the old mean. Null values are left out."""
    known = df.filter(F.col(value).isNotNull())
    return folds.folded(known, [key], order, {"x": F.col(value)}, folds.variance_fold(alpha), {"n": _rows, "mean": folds.mean_of, "var": folds.variance_of})


def _rows(s: folds.Summary) -> Column:
    return s["n"].cast("int")


def cusum(df: DataFrame, key: str, order: str, value: str, k: float) -> DataFrame:
    """`cusum`: max(0, s + x - k) in turn, which is the running sum less its least value so far, or less 0."""
    total = df.withColumn("_s", F.sum(F.col(value) - k).over(_through(key, order)))
    return total.withColumn("cusum", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(_through(key, order)))).drop("_s")


def ew_trend(df: DataFrame, key: str, order: str, ts: str, value: str, tau_s: float) -> DataFrame:
    """key, order, `slope_per_hour`: least-squares slope with weights that decay by exp(-dt / tau_s); 0 before three rows or without spread.

    Rows without a time or a value are left out.
    """
    known = df.filter(F.col(ts).isNotNull() & F.col(value).isNotNull())
    return folds.folded(known, [key], order, {"t": F.col(ts), "y": F.col(value)}, folds.line_fold(tau_s), {"slope_per_hour": folds.slope_of})


def tyre_deficits(pressures: Column) -> Column:
    """For an array of four pressures: each one's shortfall against the median of the other three, as a share of it, 0 at least; null unless all are there."""

    wheels = [pressures[i] for i in range(4)]

    def shortfall(i: int) -> Column:
        a, b, c = wheels[:i] + wheels[i + 1 :]
        middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
        return F.when(middle != 0, F.greatest(F.lit(0.0), (middle - wheels[i]) / middle)).otherwise(0.0)

    whole = (F.size(pressures) == 4) & ~F.exists(pressures, lambda p: p.isNull())
    return F.when(whole, F.array(*[shortfall(i) for i in range(4)]))


def tyre_leaks(df: DataFrame, key: str, order: str, ts: str, pressures: tuple[str, ...], alpha: float, tau_s: float, least: int = 1) -> DataFrame:
    """key, order, `worst` (index of the wheel with the highest mean shortfall, the first of equals), `shortfall` (that mean) and its `slope_per_hour`.

    Rows lacking a pressure or a time are left out, and so are a vehicle's first least - 1 rows.
    """
    known = df.withColumn("_d", tyre_deficits(F.array(*pressures))).filter(F.col("_d").isNotNull() & F.col(ts).isNotNull())
    long = known.select(key, order, F.col(ts).cast("double").alias("t"), F.posexplode("_d").alias("wheel", "y"))
    both = folds.together(folds.mean_fold(alpha, "y"), folds.line_fold(tau_s))
    wheels = folds.folded(long, [key, "wheel"], order, {"t": F.col("t"), "y": F.col("y")}, both, {"n": _rows, "shortfall": folds.mean_of, "slope": folds.slope_of})
    named = wheels.filter(F.col("n") >= least).select(key, order, F.struct(F.col("shortfall"), (-F.col("wheel")).alias("i"), F.col("slope")).alias("_s"))
    worst = named.groupBy(key, order).agg(F.max("_s").alias("_s"))
    return worst.select(key, order, (-F.col("_s.i")).alias("worst"), F.col("_s.shortfall").alias("shortfall"), F.col("_s.slope").alias("slope_per_hour"))


def hysteresis(df: DataFrame, key: str, order: str, opens: Column, clears: Column, seq: str, by: list[str] | None = None) -> DataFrame:
    """Rows where a latch changes: `status` open or cleared, `opened_seq` (of the opening row). The last of opens/clears before a row decides."""
    part = [key, *(by or [])]
    through = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = Window.partitionBy(*part).orderBy(order)
    held = df.withColumn("_latch", F.coalesce(F.last(F.when(opens, 1).when(clears, 0), ignorenulls=True).over(through), F.lit(0)))
    edge = held.withColumn("_was", F.coalesce(F.lag("_latch").over(turn), F.lit(0)))
    edge = edge.withColumn("opened_seq", F.last(F.when((F.col("_latch") == 1) & (F.col("_was") == 0), F.col(seq)), ignorenulls=True).over(through))
    return edge.filter("_latch <> _was").withColumn("status", F.when(F.col("_latch") == 1, "open").otherwise("cleared")).drop("_latch", "_was")


def rule_transitions(df: DataFrame, rules: DataFrame, key: str, order: str, seq: str, signals: list[str]) -> DataFrame:
    """Open and cleared alerts of a rule table (rule_code, side, opens, clears, severity, failure_mode) over the columns `signals`, which are named like rules. Null signals leave a rule as it is."""
    long = df.select(key, order, seq, F.explode(F.array(*[F.struct(F.lit(s).alias("rule_code"), F.col(s).cast("double").alias("value")) for s in signals])).alias("s")).select(key, order, seq, "s.*")
    # the rule table is a handful of rows
    long = long.filter("value IS NOT NULL").join(F.broadcast(rules), "rule_code")
    above = F.col("side") == ">"
    opens = F.when(above, F.col("value") > F.col("opens")).otherwise(F.col("value") < F.col("opens"))
    clears = F.when(above, F.col("value") < F.col("clears")).otherwise(F.col("value") > F.col("clears"))
    return hysteresis(long, key, order, opens, clears, seq, by=["rule_code"])


def breakdown_latch(df: DataFrame, key: str, order: str, set_: Column, reset: Column) -> DataFrame:
    """`latched`: set by `set_`, which wins, and reset by `reset`."""
    return df.withColumn("latched", F.coalesce(F.last(F.when(set_, True).when(reset, False), ignorenulls=True).over(_through(key, order)), F.lit(False)))


def _place(at: Column, kind: int, turn: Column | None = None, sub: int = 0) -> Column:
    """Where something lies in a sweep: by time, then what opens there (0), rows (1) and what ends there (2), then by the turn of rows."""
    return F.struct(at.cast("double").alias("at"), F.lit(kind).alias("kind"), (F.lit(None) if turn is None else turn).cast("bigint").alias("turn"), F.lit(sub).alias("sub"))


def code_steps(reports: DataFrame, key: str) -> DataFrame:
    """reports (key, code, since, gone: places) -> key, code, place, n (reports in force from there on) and `upto`, the next such place."""
    steps = reports.select(key, "code", F.inline(F.array(F.struct(F.col("since").alias("place"), F.lit(1).alias("step")), F.struct(F.col("gone").alias("place"), F.lit(-1).alias("step")))))
    turn = Window.partitionBy(key, "code").orderBy("place")
    counted = steps.withColumn("n", F.sum("step").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return counted.select(key, "code", "place", "n", F.lead("place").over(turn).alias("upto"))


def first_rows(steps: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, code, n, need and `row` (a struct) of the first of rows (key, place, row) in each stretch of steps where the count says something: n >= need or n = 0."""
    spans = steps.filter("n >= need OR n = 0").select(key, "place", F.struct("code", "n", "need", "upto").alias("_span"), F.lit(None).alias("row"))
    # backwards, the last row seen is the first one after
    back = Window.partitionBy(key).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = spans.unionByName(rows.select(key, "place", F.lit(None).alias("_span"), F.struct("place", "row").alias("row")))
    ahead = both.withColumn("_first", F.last("row", ignorenulls=True).over(back)).filter("_span IS NOT NULL AND _first IS NOT NULL")
    inside = F.col("_span.upto").isNull() | (F.col("_first.place") < F.col("_span.upto"))
    return ahead.filter(inside).select(key, "_span.code", "_span.n", "_span.need", "_first.row")


def code_moves(df: DataFrame, need: DataFrame, key: str, ts: str, order: str, seq: str, codes: str, window_s: float) -> DataFrame:
    """key, code, n, need, order, ts, seq: the rows where a code's count of the last window_s seconds may open (n >= need) or clear (n = 0) it. need: code, need.

    A sweep over occurrences and expiries: each stretch of equal meaning is seen first by the first row in it, if rows come
    in the order of time. Only rows that come late, and the row after such a one, are met with all codes of their key. So
    rows are proportional to occurrences and to late rows, not to rows times codes. Rows without a time are left out.
    """
    known = df.filter(F.col(ts).isNotNull())
    row = F.struct(order, F.col(ts).alias(ts), F.col(seq).alias(seq)).alias("row")
    rows = in_order(known.select(key, order, ts, seq), key, order, ts).withColumn("place", _place(F.col(ts), 1, F.col(order)))
    rows = rows.withColumn("_again", ~F.col("in_order") | ~F.lag("in_order", 1, True).over(Window.partitionBy(key).orderBy(order)))
    reports = known.select(key, ts, F.explode(F.array_distinct(codes)).alias("code")).select(key, "code", _place(F.col(ts), 0).alias("since"), _place(F.col(ts) + window_s, 2).alias("gone"))
    # the code table is small: one row for each code of the catalogue
    steps = code_steps(reports, key).join(F.broadcast(need), "code")
    first = first_rows(steps, rows.filter("in_order").select(key, "place", row), key)
    asked = rows.filter("_again").join(steps.select(key, "code", "need").distinct(), key).select(key, "code", "need", "place", row, F.lit(None).cast("bigint").alias("n"))
    met = asked.unionByName(steps.select(key, "code", "need", "place", F.lit(None).alias("row"), "n"))
    forth = Window.partitionBy(key, "code").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    late = met.withColumn("n", F.coalesce(F.last("n", ignorenulls=True).over(forth), F.lit(0))).filter("row IS NOT NULL")
    return first.unionByName(late.select(*first.columns)).select(key, "code", "n", "need", "row.*")


def recent_code_moves(df: DataFrame, need: DataFrame, key: str, ts: str, latest: str, order: str, keep: list[str], codes: str, window_s: float) -> DataFrame:
    """The same against the latest time so far: a report counts from its row on until that time is more than window_s after it. Every row is in order then."""
    row = F.struct(order, *keep).alias("row")
    rows = df.select(key, _place(F.col(latest), 1, F.col(order), 1).alias("place"), row)
    reports = df.filter(F.col(ts) + window_s >= F.col(latest)).select(key, ts, latest, order, F.explode(codes).alias("code"))
    reports = reports.select(key, "code", _place(F.col(latest), 1, F.col(order)).alias("since"), _place(F.col(ts) + window_s, 2).alias("gone"))
    return first_rows(code_steps(reports, key).join(F.broadcast(need), "code"), rows, key).select(key, "code", "n", "need", "row.*")


def dtc_transitions(df: DataFrame, catalog: DataFrame, key: str, ts: str, order: str, seq: str, codes: str = "dtc_codes", window_s: int = 600, repeats: int = 3) -> DataFrame:
    """Alerts of trouble codes: a critical code opens at once, a warning at `repeats` in the window, others never; it clears at the first later row without it in the window."""
    need = catalog.filter(F.col("severity") != "info").select("code", F.when(F.col("severity") == "critical", 1).otherwise(repeats).alias("need"))
    moves = code_moves(df, need, key, ts, order, seq, codes, float(window_s))
    return hysteresis(moves, key, order, F.col("n") >= F.col("need"), F.col("n") == 0, seq, by=["code"])


def throttled(df: DataFrame, key: str, order: str, ts: str, every_s: float) -> DataFrame:
    """Rows at least every_s seconds after the row of their key that was kept before. Rows without a time are not kept."""
    return folds.throttled(df, key, order, ts, every_s)


def last_of_each(df: DataFrame, key: str, ts: str, every_s: float, order: str) -> DataFrame:
    """The last row of each key in each window of every_s seconds."""
    slot = F.floor(F.col(ts) / every_s)
    return df.groupBy(key, slot.alias("slot")).agg(F.max_by(F.struct(*df.columns), F.struct(ts, order)).alias("r")).select("r.*")


def latest_version(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row for each key: that of the highest version columns."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*version)).alias("r")).select("r.*")


def overlapping(df: DataFrame, key: str, lo: str, hi: str, order: str) -> DataFrame:
    """Half-open intervals that begin before the end of an earlier one of their key; a null end is open."""
    end = F.coalesce(F.col(hi), F.lit(float("inf")))
    before = Window.partitionBy(key).orderBy(lo, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_reach", F.max(end).over(before)).filter(F.col("_reach") > F.col(lo)).drop("_reach")


def more_than_one(df: DataFrame, keys: list[str], active: Column) -> DataFrame:
    """Keys with more than one active row, and how many."""
    return df.filter(active).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
