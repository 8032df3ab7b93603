"""Minute rollups and window features (AGG1-AGG6, AGG27-AGG29, JOIN5-JOIN9, FN14, JOB1-JOB2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.functions import catalog, vehicle

TYRES = ("tyre_fl_kpa", "tyre_fr_kpa", "tyre_rl_kpa", "tyre_rr_kpa")


def minute_rollup(events: DataFrame, keys: tuple[str, ...] = ("tenant_id", "vehicle_id"), ts: str = "event_ts", seq: str = "seq", averages: tuple[str, ...] = (), maxima: tuple[str, ...] = (), minima: tuple[str, ...] = (), codes: str | None = None, width_s: int = 60) -> DataFrame:
    """One row for each key and bucket: exact distinct seq as n_events, averages as (sum, count), maxima, minima and the union of codes. All parts can be merged again."""
    start = F.col(ts) if dict(events.dtypes)[ts] == "double" else vehicle.epoch(F.col(ts))
    parts = [F.collect_set(seq).alias("seqs")]
    for c in averages:
        parts += [F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_count")]
    parts += [F.max(c).alias(f"{c}_max") for c in maxima] + [F.min(c).alias(f"{c}_min") for c in minima]
    rows = events.withColumn("bucket", vehicle.bucket_start(start, width_s).cast("long"))
    if codes:
        parts.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(codes)))).alias("codes"))
    return rows.groupBy(*keys, "bucket").agg(*parts)


def merged_rollup(parts: DataFrame, keys: tuple[str, ...] = ("tenant_id", "vehicle_id")) -> DataFrame:
    """Partial rollups of the same buckets made one. Sets, maxima and minima take a repeated row once; sums and counts add."""
    out = []
    for c in parts.columns:
        if c == "seqs" or c == "codes":
            out.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c))
        elif c.endswith("_sum") or c.endswith("_count"):
            out.append(F.sum(c).alias(c))
        elif c.endswith("_max"):
            out.append(F.max(c).alias(c))
        elif c.endswith("_min"):
            out.append(F.min(c).alias(c))
    return parts.groupBy(*keys, "bucket").agg(*out)


def finished_rollup(parts: DataFrame) -> DataFrame:
    """Counts and averages of a rollup."""
    out = [c for c in parts.columns if not c.endswith(("_sum", "_count")) and c != "seqs"]
    averages = [(F.col(f"{c[:-4]}_sum") / F.nullif(F.col(f"{c[:-4]}_count"), F.lit(0))).alias(f"{c[:-4]}_avg") for c in parts.columns if c.endswith("_sum")]
    return parts.select(*out, F.size("seqs").cast("long").alias("n_events"), *averages)


def minute_buckets(events: DataFrame, vehicle_id: str = "vehicle_id", ts: str = "ts", width_s: int = 60, modes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The buckets that window features are made of; ts in seconds. Absent columns of the canonical event are not needed twice: each aggregate ignores nulls."""
    modes = modes if modes is not None else {m: tuple(c for c, _, mode in catalog.DTCS if mode == m) for m in catalog.FAILURE_MODES}
    other = [c for c, _, mode in catalog.DTCS if mode is None]
    on, off = F.col("ignition_on"), ~F.col("ignition_on")
    coolant, rpm = vehicle.coolant_residual(F.col("coolant_temp_c"), F.col("speed_kmh")), vehicle.rpm_residual(F.col("engine_rpm"), F.col("speed_kmh"))
    ratio = vehicle.tyre_ratio(*[F.col(t) for t in TYRES])
    has = lambda codes: F.count_if(F.arrays_overlap("dtc_codes", F.array(*[F.lit(c) for c in codes]))).cast("double")
    return events.withColumn("m", vehicle.bucket_start(F.col(ts), width_s)).groupBy(vehicle_id, "m").agg(
        F.count("*").cast("double").alias("n"), F.count_if(on).cast("double").alias("n_ign"), F.avg(F.when(on, F.col("coolant_temp_c"))).alias("coolant_mean"), F.max("coolant_temp_c").alias("coolant_max"),
        F.avg(F.when(on, coolant)).alias("coolant_resid"), F.stddev_pop(F.when(on & (F.col("engine_rpm") > 0), rpm)).alias("rpm_resid_sd"), F.avg(F.when(off, F.col("lv_battery_v"))).alias("lv_rest"),
        F.min("lv_battery_v").alias("lv_min"), F.avg("lv_battery_v").alias("lv_mean"), F.avg(ratio).alias("tyre_ratio"), F.min(ratio).alias("tyre_ratio_min"), F.avg("hv_cell_delta_mv").alias("cell_delta"),
        F.max("hv_cell_delta_mv").alias("cell_delta_max"), F.max("hv_pack_temp_c").alias("pack_temp_max"), F.avg("hv_soh_pct").alias("soh"), F.max("odometer_km").alias("odometer_km"),
        F.count_if(F.size("dtc_codes") > 0).cast("double").alias("dtc_events"), *[has(c).alias(f"dtc_{m.lower()}") for m, c in modes.items()], has(other).alias("dtc_other"),
    )


def snapshot_grid(vehicles: DataFrame, first: int, end: int, step: int, vehicle_id: str = "vehicle_id") -> DataFrame:
    """Every vehicle at every time of a grid (end exclusive)."""
    times = list(range(first, end, step))
    return vehicles.select(vehicle_id, F.explode(F.sequence(F.lit(first), F.lit(times[-1]), F.lit(step))).alias("t")).withColumn("t", F.col("t").cast("double")) if times else vehicles.select(vehicle_id, F.lit(0.0).alias("t")).limit(0)


def in_window(snaps: DataFrame, buckets: DataFrame, long_s: float, vehicle_id: str = "vehicle_id") -> DataFrame:
    """Snapshots with the buckets of [t - long_s, t). Both sides are keyed by stretches of long_s, so a vehicle's history is matched piece by piece."""
    stretch = lambda c: F.floor(c / long_s).cast("long")
    asked = snaps.withColumn("_s", F.explode(F.sequence(stretch(F.col("t") - long_s), stretch(F.col("t")))))
    held = buckets.withColumn("_s", stretch(F.col("m")))
    return asked.join(held, [vehicle_id, "_s"]).filter((F.col("m") >= F.col("t") - long_s) & (F.col("m") < F.col("t"))).drop("_s")


def window_features(snaps: DataFrame, buckets: DataFrame, long_s: float = 3600.0, short_s: float = 600.0, vehicle_id: str = "vehicle_id") -> DataFrame:
    """Features of every (vehicle, t) that has a bucket in the long window; `_short` columns use its last short_s seconds."""
    recent = F.col("m") >= F.col("t") - short_s
    short = lambda c: F.when(recent, F.col(c))
    slope = lambda c: (F.regr_slope(F.col(c), F.col("m")) * 3600).alias(f"{c}_slope_h")
    n, n_short = F.sum("n"), F.nullif(F.sum(short("n")), F.lit(0.0))
    modes = [c for c in buckets.columns if c.startswith("dtc_") and c not in ("dtc_events", "dtc_other")]
    rates = []
    for c in modes:
        rates += [(F.sum(c) / n).alias(f"{c}_rate_long"), F.coalesce(F.sum(short(c)) / n_short, F.lit(0.0)).alias(f"{c}_rate_short")]
    return in_window(snaps, buckets, long_s, vehicle_id).groupBy(vehicle_id, "t").agg(
        n.alias("events_long"), F.count_distinct("m").alias("minutes_long"), (F.sum("n_ign") / F.nullif(n, F.lit(0.0))).alias("ignition_share_long"), F.max("odometer_km").alias("odometer_km"),
        F.avg("coolant_mean").alias("coolant_mean_long"), F.max("coolant_max").alias("coolant_max_long"), F.avg("coolant_resid").alias("coolant_resid_long"), F.avg(short("coolant_resid")).alias("coolant_resid_short"), slope("coolant_resid"),
        F.avg("rpm_resid_sd").alias("rpm_resid_sd_long"), F.max("rpm_resid_sd").alias("rpm_resid_sd_max_long"), F.avg(short("rpm_resid_sd")).alias("rpm_resid_sd_short"),
        F.avg("lv_rest").alias("lv_rest_long"), F.avg(short("lv_rest")).alias("lv_rest_short"), F.min("lv_min").alias("lv_min_long"), slope("lv_mean"),
        F.avg("tyre_ratio").alias("tyre_ratio_long"), F.min("tyre_ratio_min").alias("tyre_ratio_min_long"), F.min(short("tyre_ratio_min")).alias("tyre_ratio_min_short"), slope("tyre_ratio"),
        F.avg("cell_delta").alias("cell_delta_long"), F.max("cell_delta_max").alias("cell_delta_max_long"), F.avg(short("cell_delta")).alias("cell_delta_short"), slope("cell_delta"),
        F.max("pack_temp_max").alias("pack_temp_max_long"), F.avg("soh").alias("soh_long"), (F.sum("dtc_events") / n).alias("dtc_rate_long"), F.coalesce(F.sum(short("dtc_events")) / n_short, F.lit(0.0)).alias("dtc_rate_short"),
        *rates, (F.sum("dtc_other") / n).alias("dtc_other_rate_long"),
    )


def features_at(buckets: DataFrame, vehicles: DataFrame, t: float, long_s: float = 3600.0, short_s: float = 600.0) -> DataFrame:
    """Serving: the same features for all vehicles at one minute boundary."""
    if t % 60:
        raise ValueError("t must be a minute boundary")
    snaps = vehicles.select("vehicle_id", F.lit(float(t)).alias("t"))
    return window_features(snaps, buckets, long_s, short_s).join(vehicles.select("vehicle_id", "model_code", "powertrain"), "vehicle_id")


def cleared_after(alerts: DataFrame, ts: str = "ts") -> DataFrame:
    """Opened alerts with `cleared`: the first clearing of the same fingerprint at or after the opening, null if none."""
    opened = alerts.filter("status = 'open'")
    ends = alerts.filter("status = 'cleared'").select("fingerprint", F.col(ts).alias("_c"))
    cols = opened.columns
    # a fingerprint belongs to one episode; openings that repeat keep their own rows
    joined = opened.join(ends, (opened.fingerprint == ends.fingerprint) & (ends._c >= opened[ts]), "left").select(*[opened[c] for c in cols], "_c")
    return joined.groupBy(*cols).agg(F.min("_c").alias("cleared"))


def open_baseline(snaps: DataFrame, intervals: DataFrame, rule_p: DataFrame, fallback: float, vehicle_id: str = "vehicle_id") -> DataFrame:
    """For each snapshot with open alerts: the highest rule probability and the number of alerts; intervals (vehicle, rule_code, opened, cleared or null)."""
    held = intervals.filter("opened IS NOT NULL").join(F.broadcast(rule_p), "rule_code", "left")
    inside = (F.col("i.opened") < F.col("s.t")) & (F.col("i.cleared").isNull() | (F.col("i.cleared") >= F.col("s.t")))
    joined = snaps.alias("s").join(held.alias("i"), (F.col(f"s.{vehicle_id}") == F.col(f"i.{vehicle_id}")) & inside)
    return joined.groupBy(F.col(f"s.{vehicle_id}").alias(vehicle_id), F.col("s.t").alias("t")).agg(F.max(F.coalesce("i.p", F.lit(fallback))).alias("rule_p_max"), F.count("*").alias("rules_open"))


def baseline_score(rule_p_max: Column, rules_open: Column) -> Column:
    return F.coalesce(rule_p_max, F.lit(0.0)) + 0.001 * F.least(F.coalesce(rules_open, F.lit(0)), F.lit(50))


def next_failure(snaps: DataFrame, failures: DataFrame, horizon_s: float, vehicle_id: str = "vehicle_id") -> DataFrame:
    """Snapshots with next_failure_ts and next_failure_mode in (t, t + horizon], null if none."""
    reach = (F.col("f.failure_ts") > F.col("s.t")) & (F.col("f.failure_ts") <= F.col("s.t") + horizon_s)
    joined = snaps.alias("s").join(failures.alias("f"), (F.col(f"s.{vehicle_id}") == F.col(f"f.{vehicle_id}")) & reach, "left")
    return joined.groupBy(*[F.col(f"s.{c}").alias(c) for c in snaps.columns]).agg(F.min("f.failure_ts").alias("next_failure_ts"), F.min_by("f.failure_mode", F.struct("f.failure_ts", "f.failure_mode")).alias("next_failure_mode"))


def outside_downtime(snaps: DataFrame, failures: DataFrame, downtime_s: float, vehicle_id: str = "vehicle_id") -> DataFrame:
    """Snapshots that are in no [failure, failure + downtime)."""
    s, f = snaps.alias("s"), failures.alias("f")
    down = (F.col("s.t") >= F.col("f.failure_ts")) & (F.col("s.t") < F.col("f.failure_ts") + downtime_s)
    return s.join(f, (F.col(f"s.{vehicle_id}") == F.col(f"f.{vehicle_id}")) & down, "left_anti")


def training_table(events: DataFrame, vehicles: DataFrame, alerts: DataFrame, truth: DataFrame, rule_p: DataFrame, start: float, end: float, fallback: float, horizon_s: float, downtime_s: float, snapshot_s: int = 300, long_s: float = 3600.0, short_s: float = 600.0) -> DataFrame:
    """One row for each vehicle and snapshot with features, baseline and label. Snapshots lie on minute boundaries and use buckets that end by then."""
    if any(x % 60 for x in (snapshot_s, long_s, short_s)):
        raise ValueError("windows must be whole minutes")
    first = int(-(-(start + long_s) // 60) * 60)
    failures = truth.filter("type = 'FAILURE'").select("vehicle_id", "failure_mode", "failure_ts")
    snaps = outside_downtime(snapshot_grid(vehicles, first, int(end - horizon_s), snapshot_s), failures, downtime_s)
    intervals = cleared_after(alerts.filter("failure_mode IS NOT NULL OR status = 'cleared'").select("vehicle_id", "rule_code", "fingerprint", "status", "ts"), "ts").select("vehicle_id", "rule_code", F.col("ts").alias("opened"), "cleared")
    base = open_baseline(snaps, intervals, rule_p, fallback)
    out = window_features(snaps, minute_buckets(events), long_s, short_s).join(base, ["vehicle_id", "t"], "left")
    out = next_failure(out, failures, horizon_s).join(vehicles.select("vehicle_id", "model_code", "powertrain", "model_year"), "vehicle_id")
    return out.withColumn("baseline_score", baseline_score(F.col("rule_p_max"), F.col("rules_open"))).withColumn("rules_open", F.coalesce("rules_open", F.lit(0))).withColumn("label", F.col("next_failure_ts").isNotNull().cast("int")).drop("rule_p_max")


def health(open_rules: DataFrame, vehicle_id: str = "vehicle_id") -> DataFrame:
    """Health score 100 less a penalty for each open rule, 0 at least, and the sorted codes of those rules."""
    penalty = F.sum(F.coalesce(F.create_map(*[F.lit(x) for kv in catalog.PENALTY.items() for x in kv])[F.col("severity")], F.lit(0)))
    return open_rules.groupBy(vehicle_id).agg(F.greatest(F.lit(100) - penalty, F.lit(0)).cast("long").alias("health_score"), F.array_sort(F.collect_set("rule_code")).alias("active"))


def density(positions: DataFrame, precision: int, tenant: str = "tenant_id", vehicle_id: str = "vehicle_id") -> DataFrame:
    """Distinct vehicles and the centre of each geohash cell of a tenant."""
    cells = positions.withColumn("cell", vehicle.geohash(F.col("latitude"), F.col("longitude"), precision)).filter("cell IS NOT NULL")
    counted = cells.groupBy(tenant, "cell").agg(F.count_distinct(vehicle_id).alias("vehicles"))
    return counted.withColumn("centre", vehicle.geohash_centre(F.col("cell"))).select(tenant, "cell", "vehicles", F.col("centre.latitude").alias("latitude"), F.col("centre.longitude").alias("longitude"))
