"""Fault detection over a table as one relational plan (STR2, UDF5): what the stream keeps as state is made here by folds and windows.

Statistics of all kinds run in one pass of mergeable folds; their values, one row for each event and rule, meet the rule
table and are latched once; codes are swept; which alerts are open at a snapshot is a running sum of one bit for each rule.
Merged sums differ from the recursion in their last bits, so a value that lies on a threshold could fall on either side:
vehicles that have such a value are counted again one row after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolith.functions import catalog
from odolith.operators import folds, windows
from odolith.session import cut, ship

# Warm-up, windows, weights and reference lines of the detector.
WARM_S, CODE_WINDOW_S, REPEATS, SNAPSHOT_S, TREND_S = 900.0, 600.0, 3, 15.0, 3600.0
DRIFT_SLACK, LEAK_END = 4.0, 0.25
TYRES = ("tyre_fl_kpa", "tyre_fr_kpa", "tyre_rl_kpa", "tyre_rr_kpa")
#: name, fold, values before it says anything, rules
TRACKS = (
    ("drift", folds.cusum_fold(DRIFT_SLACK), 1, ("COOLANT_DRIFT",)), ("rpm", folds.variance_fold(0.02), 60, ("MISFIRE_ROUGHNESS",)), ("lv", folds.mean_fold(0.05), 30, ("LV_BATTERY_WEAK", "LV_BATTERY_CRITICAL")),
    ("cell", folds.mean_fold(0.05), 30, ("HV_CELL_IMBALANCE", "HV_CELL_CRITICAL")),
)
TYRE_ALPHA, TYRE_LEAST, TYRE_RULES = 0.05, 30, ("TYRE_SLOW_LEAK", "TYRE_PRESSURE_CRITICAL")
CODES = tuple((f"DTC_{code}", severity, mode, 1 if severity == "critical" else REPEATS) for code, severity, mode in catalog.DTCS if severity != "info")
#: Every rule has a bit of its own in the mask of open alerts.
BITS = {name: i for i, name in enumerate([*(r[0] for r in catalog.RULES), *(c[0] for c in CODES)])}
SEVERITY = {r[0]: r[2] for r in catalog.RULES} | {c[0]: c[1] for c in CODES}
ROW = ["vehicle_id", "order", "ts", "seq"]
#: What the folds take, besides the tyres' `gaps`.
INPUTS = ["drift_x", "rpm_x", "lv_x", "cell_x"]
#: A value this close to a threshold, as a share of it (1 at least), may lie on either side of it by rounding.
NEAR = 1e-6


def readings(events: DataFrame, order: str) -> DataFrame:
    """What the detector looks at, with `in_order`, the `latest` time so far and `warm`: the ignition has been on for WARM_S without a break, late rows left aside."""
    used = ["event_type", "speed_kmh", "coolant_temp_c", "engine_rpm", "lv_battery_v", "hv_cell_delta_mv", *TYRES, "dtc_codes"]
    rows = events.select("vehicle_id", F.col(order).alias("order"), F.col("ts").cast("double").alias("ts"), F.col("seq").cast("bigint").alias("seq"), *used, F.coalesce("ignition_on", F.lit(False)).alias("on"))
    through = Window.partitionBy("vehicle_id").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = windows.in_order(rows, "vehicle_id", "order", "ts").withColumn("latest", F.max("ts").over(through))
    rows = rows.withColumn("run", F.count_if(F.col("in_order") & ~F.col("on")).over(through))
    since = F.min(F.when(F.col("in_order") & F.col("on"), F.col("ts"))).over(Window.partitionBy("vehicle_id", "run"))
    return rows.withColumn("warm", F.coalesce(F.col("on") & (F.col("ts") - since >= WARM_S), F.lit(False))).drop("run")


def signals(rows: DataFrame) -> DataFrame:
    """rows with `tyre` (worst wheel: its mean, -i and slope) and a column for each rule, null where it has nothing to look at. Late rows feed only what needs no history.

    All statistics run in one pass of folds, each over the rows that have its input.
    """
    on, speed = F.col("on"), F.col("speed_kmh")
    gaps = windows.tyre_deficits(F.array(*TYRES))
    inputs = {
        "drift_x": F.when(F.col("warm"), F.col("coolant_temp_c") - (88 + 0.03 * speed)), "rpm_x": F.when(on & (F.col("engine_rpm") != 0) & (speed > 5), F.col("engine_rpm") - (750 + 28 * speed)),
        "lv_x": F.when(~on, F.col("lv_battery_v")), "cell_x": F.col("hv_cell_delta_mv"),
    }
    wide = rows.select(*ROW, "latest", "in_order", "event_type", "speed_kmh", "coolant_temp_c", "dtc_codes", *[F.when(F.col("in_order"), inputs[n]).cast("double").alias(n) for n in INPUTS], F.when(F.col("in_order"), gaps).alias("gaps"))
    wheels, fields = [], {n: F.col(n) for n in inputs}
    for i in range(4):
        wheels += [folds.where_given(f"mean{i}", folds.mean_fold(TYRE_ALPHA)), folds.where_given(f"line{i}", folds.line_fold(TREND_S))]
        fields |= {f"mean{i}_x": F.col("gaps")[i], f"line{i}_t": F.when(F.col("gaps").isNotNull(), F.col("ts")), f"line{i}_y": F.col("gaps")[i]}
    fold = folds.together(*[folds.where_given(name, f) for name, f, _, _ in TRACKS], *wheels)
    said = {"spread": lambda s: F.sqrt(folds.variance_of(s)), "low": folds.cusum_of, "start": folds.mean_of}
    results = {}
    for name, f, least, _ in TRACKS:
        results[name] = lambda s, name=name, value=said[f.parts[-1]], least=least: F.when(F.col(f"{name}_x").isNotNull() & (s[f"{name}_n"] >= least), value(folds.given(s, name)))
    worst = lambda s: F.array_max(F.array(*[F.struct(folds.mean_of(folds.given(s, f"mean{i}")).alias("mean"), F.lit(-i).alias("i"), folds.slope_of(folds.given(s, f"line{i}")).alias("slope")) for i in range(4)]))
    results["tyre"] = lambda s: F.when(F.col("gaps").isNotNull() & (s["mean0_n"] >= TYRE_LEAST), worst(s))
    found = folds.folded(wide, ["vehicle_id"], "order", fields, fold, results, keep=("ts", "seq", "latest", "event_type", "speed_kmh", "coolant_temp_c", "dtc_codes", "in_order", "gaps", *INPUTS))
    # a stop keeps the latch of a breakdown as it is
    broken = F.when(F.col("event_type") == "BREAKDOWN", 1.0).when(F.col("speed_kmh") < 1, F.lit(None)).otherwise(0.0)
    rules = {rule: F.col(name) for name, _, _, own in TRACKS for rule in own} | {rule: F.col("tyre.mean") for rule in TYRE_RULES} | {"COOLANT_OVERHEAT": F.col("coolant_temp_c"), "VEHICLE_BREAKDOWN": broken}
    return found.select(*ROW, "latest", "in_order", "dtc_codes", "tyre", *[rules[r[0]].cast("double").alias(r[0]) for r in catalog.RULES], *INPUTS, "gaps")


def followed(held: list[float], x: np.ndarray, alpha: float, part: str) -> np.ndarray:
    """The mean or standard deviation after each value, one after another; held = [n, mean, variance] moves on."""
    n, mean, variance = held
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        weight = alpha if n else 1.0
        gap = v - mean
        mean, variance, n = mean + weight * gap, (1 - weight) * (variance + weight * gap * gap), n + 1
        out[i] = mean if part == "mean" else math.sqrt(variance)
    held[:] = [n, mean, variance]
    return out


def in_turn(rows: DataFrame) -> DataFrame:
    """rows with the values of statistics as the recursion gives them, one row after another. A vehicle is in one task, which holds a batch of its rows and its state."""
    ship(rows.sparkSession)
    tracks = {"rpm": (0.02, "sd"), "lv": (0.05, "mean"), "cell": (0.05, "mean")}
    said = {name: (least, rules) for name, _, least, rules in TRACKS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key: list = []
        s: dict[str, list[float]] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in INPUTS}
            gaps = batch.column("gaps")
            given = gaps.is_valid().to_numpy(zero_copy_only=False)
            wheels = np.full((n, len(TYRES)), np.nan)
            wheels[given] = gaps.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(TYRES))
            out = {rule: np.full(n, np.nan) for _, rules in said.values() for rule in rules} | {rule: np.full(n, np.nan) for rule in TYRE_RULES}
            begins = [0, *np.flatnonzero(folds.stretches(batch, ["vehicle_id"])).tolist(), n]
            for lo, hi in zip(begins, begins[1:]):
                key = [batch.column("vehicle_id")[lo].as_py()]
                if key != held_key:
                    held_key, s = key, {"drift": [0.0], **{k: [0, 0.0, 0.0] for k in (*tracks, *TYRES)}}
                for name, (least, rules) in said.items():
                    own = lo + np.flatnonzero(~np.isnan(x[f"{name}_x"][lo:hi]))
                    if name == "drift":
                        value, total = np.empty(len(own)), s["drift"][0]
                        for i, v in enumerate(x["drift_x"][own].tolist()):
                            total = max(0.0, total + (v - DRIFT_SLACK))
                            value[i] = total
                        s["drift"][0] = total
                    else:
                        before = s[name][0]
                        value = followed(s[name], x[f"{name}_x"][own], *tracks[name])
                        value[: max(0, least - 1 - before)] = np.nan
                    for rule in rules:
                        out[rule][own] = value
                own = lo + np.flatnonzero(given[lo:hi])
                before = s[TYRES[0]][0]
                worst = np.max([followed(s[t], wheels[own, i], TYRE_ALPHA, "mean") for i, t in enumerate(TYRES)], axis=0)
                worst[: max(0, TYRE_LEAST - 1 - before)] = np.nan
                for rule in TYRE_RULES:
                    out[rule][own] = worst
            new = {rule: pa.array(v, mask=np.isnan(v)) for rule, v in out.items()}
            yield pa.RecordBatch.from_pydict({c: new.get(c, batch.column(c)) for c in batch.schema.names})

    return rows.repartition("vehicle_id").sortWithinPartitions("vehicle_id", "order").mapInArrow(run, rows.schema)


def settled(rows: DataFrame) -> DataFrame:
    """rows with the vehicles in turn that have a statistic on a threshold."""
    near = F.lit(False)
    for rule, _, _, _, *ends in catalog.RULES:
        if rule not in ("COOLANT_OVERHEAT", "VEHICLE_BREAKDOWN"):  # these are read off the row
            for end in ends:
                near = near | F.coalesce(F.abs(F.col(rule) - end) <= NEAR * max(1.0, end), F.lit(False))
    doubtful = cut(rows.filter(near).select(F.col("vehicle_id").alias("_id")).distinct(), "doubtful")
    if doubtful.isEmpty():
        return rows
    same = rows.vehicle_id.eqNullSafe(doubtful["_id"])
    again = cut(in_turn(rows.join(doubtful, same, "left_semi")), "in-turn")
    return rows.join(doubtful, same, "left_anti").unionByName(again)


def judged(rule: tuple) -> Column:
    """A rule with its value and whether that opens or clears it; null if there is no value, or it does neither."""
    code, mode, severity, side, opens, clears = rule
    value = F.col(code)
    opens, clears = (value > opens, value < clears) if side == ">" else (value < opens, value > clears)
    leak = code in TYRE_RULES
    parts = {"rule_code": F.lit(code), "severity": F.lit(severity), "failure_mode": F.lit(mode).cast("string"), "value": value, "opens": opens, "wheel": (-F.col("tyre.i") if leak else F.lit(None)).cast("int"), "slope": (F.col("tyre.slope") if leak else F.lit(None)).cast("double")}
    return F.when(opens | clears, F.struct(*[c.alias(n) for n, c in parts.items()]))


def transitions(rows: DataFrame) -> DataFrame:
    """Openings and clearings of all rules, with the value and, for an opening, wheel and slope or occurrences. rows: as signals() gives them."""
    spark = rows.sparkSession
    met = rows.select(*ROW, F.explode(F.array_compact(F.array(*[judged(r) for r in catalog.RULES]))).alias("x")).select(*ROW, "x.*")
    columns = [*ROW, "rule_code", "severity", "failure_mode", "status", "opened_seq", "value", "wheel", "slope", "occurrences"]
    by_rule = windows.hysteresis(met, "vehicle_id", "order", F.col("opens"), ~F.col("opens"), "seq", by=["rule_code"]).withColumn("occurrences", F.lit(None).cast("int"))
    codes = spark.createDataFrame([(c[0][4:], *c) for c in CODES], "code string, rule_code string, severity string, failure_mode string, need int")
    moves = windows.recent_code_moves(rows, codes.select("code", "need"), "vehicle_id", "ts", "latest", "order", ["ts", "seq"], "dtc_codes", CODE_WINDOW_S)
    by_code = windows.hysteresis(moves, "vehicle_id", "order", F.col("n") >= F.col("need"), F.col("n") == 0, "seq", by=["code"]).join(F.broadcast(codes.drop("need")), "code")
    by_code = by_code.withColumns({"value": F.col("n").cast("double"), "occurrences": F.col("n").cast("int"), "wheel": F.lit(None).cast("int"), "slope": F.lit(None).cast("double")})
    return by_rule.select(*columns).unionByName(by_code.select(*columns))


def snapshots(rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Throttled rows with health, active rules and indicators."""
    kept = folds.throttled(rows.filter("in_order"), "vehicle_id", "order", "ts", SNAPSHOT_S).select("vehicle_id", "order")
    values = [F.struct(F.lit(r[0]).alias("rule_code"), F.round(r[0], 3).alias("value")) for r in catalog.RULES if r[0] != "VEHICLE_BREAKDOWN"]
    shown = F.map_from_entries(F.filter(F.array(*values), lambda x: x["value"].isNotNull()))
    kept = kept.join(rows.select(*ROW, shown.alias("shown")), ["vehicle_id", "order"])
    table = F.create_map(*[F.lit(x) for k, i in BITS.items() for x in (k, 1 << i)])
    cost = F.create_map(*[F.lit(x) for k in BITS for x in (k, catalog.PENALTY.get(SEVERITY[k], 0))])
    sign = F.when(F.col("status") == "open", 1).otherwise(-1)
    moves = alerts.select(*ROW, F.lit(0).alias("rank"), (sign * table[F.col("rule_code")]).alias("mask"), (sign * cost[F.col("rule_code")]).alias("cost"), F.lit(None).cast("map<string,double>").alias("shown"))
    through = Window.partitionBy("vehicle_id").orderBy("order", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = moves.unionByName(kept.select(*ROW, F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("mask"), F.lit(0).alias("cost"), "shown"))
    held = both.withColumns({"mask": F.sum("mask").over(through), "cost": F.sum("cost").over(through)}).filter("rank = 1")
    has = lambda name: F.col("mask").bitwiseAND(F.lit(1 << BITS[name])) != 0
    active = F.array_compact(F.array(*[F.when(has(name), name) for name in sorted(BITS)]))
    indicators = F.map_concat("shown", F.create_map(F.lit("VEHICLE_BREAKDOWN"), F.when(has("VEHICLE_BREAKDOWN"), 1.0).otherwise(0.0)))
    health = F.greatest(100 - F.col("cost"), F.lit(0)).cast("double")
    return held.select(*ROW, health.alias("value"), active.alias("active"), indicators.alias("indicators"))


def detections(events: DataFrame, order: str = "arrival") -> DataFrame:
    """Alert transitions (kind alert) and snapshots (kind state) of a table of canonical rows; further columns than the stream's say what it has in `details`.

    Rows without a vehicle are one vehicle; a null reading feeds nothing; rows are taken in the order of `order`.
    """
    rows = settled(cut(signals(cut(readings(events, order), "readings")), "signals"))
    alerts = cut(transitions(rows), "transitions")
    return alerts.withColumns({"kind": F.lit("alert"), "value": F.round("value", 3)}).unionByName(snapshots(rows, alerts).withColumn("kind", F.lit("state")), allowMissingColumns=True)


def leak_details(value: Column, wheel: Column, slope: Column) -> dict[str, Column]:
    """What an opened leak alert tells: the worst tyre and when it will be critical."""
    hours = F.when(slope > 1e-6, F.round(F.greatest((LEAK_END - value) / slope, F.lit(0.0)), 1))
    return {"tyre": wheel, "deficit_pct": F.round(100 * value, 1), "leak_rate_pct_per_hour": F.round(100 * slope, 2), "estimated_hours_to_critical": hours}
