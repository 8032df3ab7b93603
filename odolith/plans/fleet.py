"""Registered queries of the telemetry operators over the test tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.functions import catalog, vehicle
from odolith.operators import detect, evaluate, normalise, plan, quality, radar, rollup, serve, windows
from odolith.plans.bindings import Bound, prelude, rounded
from odolith.plans.registry import ORACLES, QUERIES, query  # noqa: F401 - the entry file takes them from here
from odolith.sources import sinks

DAY = 86_400


def settled(c: Column | str) -> Column | str:
    """To six digits, with ties and what lies a ten-thousandth of a digit below them going up: sums in another order, whose last bits differ, give the same. A column, or its SQL."""
    return f"floor({c} * 1000000 + 0.5001) / 1000000 + 0.0" if isinstance(c, str) else F.floor(c * 1000000 + 0.5001) / 1000000 + 0.0


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in columns)


# Rollups


@query(prelude("telemetry") + f"""
SELECT tenant_id, vehicle_id, CAST(floor(ts / {DAY}) * {DAY} AS BIGINT) AS bucket, CAST(count(DISTINCT seq) AS BIGINT) AS n_events, round(avg(speed_kmh), 6) + 0.0 AS speed_kmh_avg, max(speed_kmh) AS speed_kmh_max,
  round(avg(coolant_temp_c), 6) + 0.0 AS coolant_temp_c_avg, round(max(coolant_temp_c), 6) AS coolant_temp_c_max, max(odometer_km) AS odometer_km_max, round(min(lv_battery_v), 6) AS lv_battery_v_min, min(tyre_fl_kpa) AS tyre_fl_kpa_min,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(dtc_codes)))), ','), '') AS codes
FROM telemetry GROUP BY ALL""")  # fmt: skip
def minute_rollup(b: Bound) -> DataFrame:
    parts = rollup.minute_rollup(b.telemetry, ts="ts", averages=("speed_kmh", "coolant_temp_c"), maxima=("speed_kmh", "coolant_temp_c", "odometer_km"), minima=("lv_battery_v", "tyre_fl_kpa"), codes="dtc_codes", width_s=DAY)
    return rollup.finished_rollup(parts).withColumn("codes", F.array_join("codes", ","))


@query(prelude("telemetry") + f"""
SELECT tenant_id, vehicle_id, CAST(floor(ts / {DAY}) * {DAY} AS BIGINT) AS bucket, CAST(count(DISTINCT seq) AS BIGINT) AS n_events, round(avg(speed_kmh), 6) + 0.0 AS speed_kmh_avg, max(speed_kmh) AS speed_kmh_max FROM telemetry GROUP BY ALL""")
def rollup_merge(b: Bound) -> DataFrame:
    """Two partial rollups, made one, equal the rollup of all."""
    part = lambda rows: rollup.minute_rollup(rows, ts="ts", averages=("speed_kmh",), maxima=("speed_kmh",), width_s=DAY)
    t = b.telemetry
    return rollup.finished_rollup(rollup.merged_rollup(part(t.filter("arrival % 2 = 0")).unionByName(part(t.filter("arrival % 2 = 1")))))


@query(prelude("telemetry") + """
SELECT vehicle_id, seq, arrival, round(value, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, seq ORDER BY ingest_s DESC, arrival DESC) AS rn FROM telemetry) WHERE rn = 1""")
def final_view(b: Bound) -> DataFrame:
    return windows.latest_version(b.telemetry, ["vehicle_id", "seq"], ["ingest_s", "arrival"]).select("vehicle_id", "seq", "arrival", "value")


_BUCKETS = """buckets AS (SELECT vehicle_id, floor(ts / 86400) * 86400 AS m, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (ignition_on) AS DOUBLE) AS n_ign, avg(coolant_temp_c) FILTER (ignition_on) AS coolant_mean, max(coolant_temp_c) AS coolant_max,
  avg(coolant_temp_c - (88 + 0.03 * speed_kmh)) FILTER (ignition_on) AS coolant_resid, stddev_pop(engine_rpm - (750 + 28 * speed_kmh)) FILTER (ignition_on AND engine_rpm > 0) AS rpm_resid_sd,
  avg(lv_battery_v) FILTER (NOT ignition_on) AS lv_rest, min(lv_battery_v) AS lv_min, avg(lv_battery_v) AS lv_mean, avg(CASE WHEN tyre_rr_kpa IS NOT NULL THEN least(tyre_fl_kpa, tyre_fr_kpa, tyre_rl_kpa, tyre_rr_kpa) / greatest(tyre_fl_kpa, tyre_fr_kpa, tyre_rl_kpa, tyre_rr_kpa) END) AS tyre_ratio,
  avg(hv_cell_delta_mv) AS cell_delta, max(hv_pack_temp_c) AS pack_temp_max, CAST(count(*) FILTER (len(dtc_codes) > 0) AS DOUBLE) AS dtc_events, CAST(count(*) FILTER (list_has_any(dtc_codes, ['P0217', 'P0118', 'P0128'])) AS DOUBLE) AS dtc_cooling_failure,
  CAST(count(*) FILTER (list_has_any(dtc_codes, ['P0420', 'P0455', 'U0100'])) AS DOUBLE) AS dtc_other FROM telemetry GROUP BY ALL)"""
_BUCKET_COLUMNS = ["n", "n_ign", "coolant_mean", "coolant_max", "coolant_resid", "rpm_resid_sd", "lv_rest", "lv_min", "lv_mean", "tyre_ratio", "cell_delta", "pack_temp_max", "dtc_events", "dtc_cooling_failure", "dtc_other"]


@query(prelude("telemetry") + f", {_BUCKETS} SELECT vehicle_id, m, {r6(*_BUCKET_COLUMNS)} FROM buckets")
def minute_buckets(b: Bound) -> DataFrame:
    return rollup.minute_buckets(b.telemetry, width_s=DAY).select("vehicle_id", "m", *_BUCKET_COLUMNS)


_SNAPS = "snaps AS (SELECT vehicle_id, CAST(t AS DOUBLE) AS t FROM (SELECT DISTINCT vehicle_id FROM telemetry), (SELECT unnest(range(1704672000, 1706486400, 604800)) AS t))"
_FEATURES = ["events_long", "coolant_mean_long", "coolant_max_long", "coolant_resid_long", "coolant_resid_short", "coolant_resid_slope_h", "lv_rest_short", "lv_min_long", "lv_mean_slope_h", "tyre_ratio_long", "cell_delta_short", "pack_temp_max_long", "dtc_rate_long", "dtc_rate_short", "dtc_cooling_failure_rate_long", "dtc_cooling_failure_rate_short"]


def _snapshots(b: Bound) -> DataFrame:
    return rollup.snapshot_grid(b.telemetry.select("vehicle_id").distinct(), 1704672000, 1706486400, 604800)


@query(prelude("telemetry") + f""", {_BUCKETS}, {_SNAPS}, f AS (
SELECT s.vehicle_id, s.t, sum(b.n) AS events_long, count(DISTINCT b.m) AS minutes_long, avg(b.coolant_mean) AS coolant_mean_long, max(b.coolant_max) AS coolant_max_long, avg(b.coolant_resid) AS coolant_resid_long,
  avg(b.coolant_resid) FILTER (b.m >= s.t - 172800) AS coolant_resid_short, regr_slope(b.coolant_resid, b.m) * 3600 AS coolant_resid_slope_h, avg(b.lv_rest) FILTER (b.m >= s.t - 172800) AS lv_rest_short, min(b.lv_min) AS lv_min_long, regr_slope(b.lv_mean, b.m) * 3600 AS lv_mean_slope_h,
  avg(b.tyre_ratio) AS tyre_ratio_long, avg(b.cell_delta) FILTER (b.m >= s.t - 172800) AS cell_delta_short, max(b.pack_temp_max) AS pack_temp_max_long, sum(b.dtc_events) / sum(b.n) AS dtc_rate_long,
  coalesce(sum(b.dtc_events) FILTER (b.m >= s.t - 172800) / nullif(sum(b.n) FILTER (b.m >= s.t - 172800), 0), 0) AS dtc_rate_short, sum(b.dtc_cooling_failure) / sum(b.n) AS dtc_cooling_failure_rate_long,
  coalesce(sum(b.dtc_cooling_failure) FILTER (b.m >= s.t - 172800) / nullif(sum(b.n) FILTER (b.m >= s.t - 172800), 0), 0) AS dtc_cooling_failure_rate_short
FROM snaps s JOIN buckets b ON b.vehicle_id = s.vehicle_id AND b.m >= s.t - 604800 AND b.m < s.t GROUP BY s.vehicle_id, s.t)
SELECT vehicle_id, t, CAST(minutes_long AS BIGINT) AS minutes_long, {", ".join(f"{settled(c)} AS {c}" for c in _FEATURES)} FROM f""")  # fmt: skip
def window_features(b: Bound) -> DataFrame:
    found = rollup.window_features(_snapshots(b), rollup.minute_buckets(b.telemetry, width_s=DAY), 604800.0, 172800.0)
    return found.select("vehicle_id", "t", "minutes_long", *[settled(F.col(c)).alias(c) for c in _FEATURES])


# Alerts, failures and labels over time

_OPENED = "SELECT * FROM alerts WHERE status <> 'resolved'"
_INTERVALS = "intervals AS (SELECT vehicle_id, rule_code, ts AS opened, CASE WHEN status = 'resolved' THEN ts + 8640000 END AS cleared FROM alerts)"
_GRID = "snaps AS (SELECT vehicle_id, CAST(t AS DOUBLE) AS t FROM vehicles, (SELECT unnest(range(820454400, 978307200, 31557600)) AS t))"


def _intervals(b: Bound) -> DataFrame:
    return b.alerts.select("vehicle_id", "rule_code", F.col("ts").alias("opened"), F.when(F.col("status") == "resolved", F.col("ts") + 8640000).alias("cleared"))


def _grid(b: Bound) -> DataFrame:
    return rollup.snapshot_grid(b.vehicles, 820454400, 978307200, 31557600)


def _rule_p(b: Bound) -> DataFrame:
    return b.spark.createDataFrame([("COOLANT_DRIFT", 0.9), ("LV_BATTERY_WEAK", 0.6), ("TYRE_SLOW_LEAK", 0.8)], "rule_code string, p double")


@query(prelude("vehicles", "alerts") + f""", {_INTERVALS}, {_GRID}, p AS (SELECT * FROM (VALUES ('COOLANT_DRIFT', 0.9::DOUBLE), ('LV_BATTERY_WEAK', 0.6), ('TYRE_SLOW_LEAK', 0.8)) AS v(rule_code, p)),
base AS (SELECT s.vehicle_id, s.t, max(coalesce(p.p, 0.4)) AS rule_p_max, count(*) AS rules_open FROM snaps s JOIN intervals i ON i.vehicle_id = s.vehicle_id AND i.opened < s.t AND (i.cleared IS NULL OR i.cleared >= s.t) LEFT JOIN p USING (rule_code) GROUP BY ALL)
SELECT vehicle_id, t, rule_p_max, CAST(rules_open AS BIGINT) AS rules_open, round(rule_p_max + 0.001 * least(rules_open, 50), 6) + 0.0 AS baseline_score FROM base""")  # fmt: skip
def open_interval_baseline(b: Bound) -> DataFrame:
    found = rollup.open_baseline(_grid(b), _intervals(b), _rule_p(b), 0.4)
    return found.withColumn("baseline_score", rollup.baseline_score(F.col("rule_p_max"), F.col("rules_open")))


_TRANSITIONS = "tr AS (SELECT fingerprint, vehicle_id, 'open' AS status, ts FROM alerts UNION ALL SELECT CAST(CAST(fingerprint AS BIGINT) + 5 AS VARCHAR), vehicle_id, 'cleared', ts FROM alerts WHERE alert_id % 3 = 0)"


@query(prelude("alerts") + f""", {_TRANSITIONS}
SELECT o.fingerprint, o.vehicle_id, o.ts, (SELECT min(c.ts) FROM tr c WHERE c.status = 'cleared' AND c.fingerprint = o.fingerprint AND c.ts >= o.ts) AS cleared FROM tr o WHERE o.status = 'open'""")
def clear_asof(b: Bound) -> DataFrame:
    a = b.alerts
    rows = a.select("fingerprint", "vehicle_id", F.lit("open").alias("status"), "ts").unionByName(a.filter("alert_id % 3 = 0").select((F.col("fingerprint").cast("bigint") + 5).cast("string").alias("fingerprint"), "vehicle_id", F.lit("cleared").alias("status"), "ts"))
    return rollup.cleared_after(rows).drop("status")


@query(prelude("vehicles", "failures") + f""", {_GRID}
SELECT s.vehicle_id, s.t, min(f.failure_ts) AS next_failure_ts, arg_min(f.failure_mode, (f.failure_ts, f.failure_mode)) AS next_failure_mode FROM snaps s LEFT JOIN failures f ON f.vehicle_id = s.vehicle_id AND f.failure_ts > s.t AND f.failure_ts <= s.t + 15552000 GROUP BY ALL""")
def next_failure_label(b: Bound) -> DataFrame:
    return rollup.next_failure(_grid(b), b.failures, 15552000.0)


@query(prelude("vehicles", "failures") + f", {_GRID} SELECT s.vehicle_id, s.t FROM snaps s WHERE NOT EXISTS (SELECT 1 FROM failures f WHERE f.vehicle_id = s.vehicle_id AND s.t >= f.failure_ts AND s.t < f.failure_ts + 5184000)")
def downtime_exclusion(b: Bound) -> DataFrame:
    return rollup.outside_downtime(_grid(b), b.failures, 5184000.0)


@query(prelude("alerts", "failures") + """, o AS (SELECT a.*, (SELECT min(f.failure_ts) FROM failures f WHERE f.vehicle_id = a.vehicle_id AND f.failure_mode = a.failure_mode AND f.failure_ts BETWEEN a.ts AND a.ts + 31557600) AS nf FROM alerts a WHERE a.ts <= 965088000 - 31557600),
p AS (SELECT rule_code, count(*) AS n, count(nf) AS k, median((nf - ts) / 3600) AS med, quantile_disc((nf - ts) / 3600, 0.1) AS p10 FROM o GROUP BY rule_code)
SELECT rule_code, CAST(n AS BIGINT) AS eligible, CAST(k AS BIGINT) AS followed, round(k / n, 3) + 0.0 AS p_failure, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 3) + 0.0 AS ci_low,
  round(least(1, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 3) + 0.0 AS ci_high, round(med, 1) + 0.0 AS median_h, round(p10, 1) + 0.0 AS p10_h FROM p""")  # fmt: skip
def rule_calibration(b: Bound) -> DataFrame:
    return evaluate.rule_calibration(evaluate.outcomes(b.alerts, b.failures, 31557600.0, 965088000.0))


_PER_RULE = """per AS (SELECT rule_code, count(*) AS eligible, count(nf) AS followed FROM (SELECT a.*, (SELECT min(f.failure_ts) FROM failures f WHERE f.vehicle_id = a.vehicle_id AND f.failure_mode = a.failure_mode AND f.failure_ts BETWEEN a.ts AND a.ts + 31557600) AS nf FROM alerts a) GROUP BY rule_code),
pool AS (SELECT round(sum(followed) / sum(eligible), 3) AS p FROM per), mid AS (SELECT median(eligible) AS m FROM per)"""


@query(prelude("alerts", "failures") + f""", named AS (SELECT * REPLACE (CASE WHEN alert_id % 2000 = 0 THEN 'RARE_RULE' ELSE rule_code END AS rule_code) FROM alerts), {_PER_RULE.replace("FROM alerts a", "FROM named a")}
SELECT rule_code, CAST(eligible AS BIGINT) AS eligible, CASE WHEN eligible < 10 THEN pool.p ELSE round(followed / eligible, 3) END + 0.0 AS p, CASE WHEN eligible < 10 THEN 'pooled' ELSE 'measured' END AS basis FROM per, pool
UNION ALL SELECT NULL, NULL, p + 0.0, 'fallback' FROM pool""")
def pooled_calibration(b: Bound) -> DataFrame:
    """One alert in 2,000 belongs to a rule of its own, which is too rare for a rate of its own on small tables."""
    named = b.alerts.withColumn("rule_code", F.when(F.col("alert_id") % 2000 == 0, "RARE_RULE").otherwise(F.col("rule_code")))
    return evaluate.pooled_calibration(evaluate.rule_calibration(evaluate.outcomes(named, b.failures, 31557600.0)))


@query(prelude("alerts", "failures") + """, w AS (SELECT f.*, (SELECT min(a.ts) FROM alerts a WHERE a.vehicle_id = f.vehicle_id AND a.failure_mode = f.failure_mode AND a.ts >= f.onset_ts - 20000000 AND a.ts < f.failure_ts) AS fa FROM failures f)
SELECT failure_mode, CAST(count(*) AS BIGINT) AS failures, CAST(count(fa) AS BIGINT) AS warned, round(count(fa) / count(*), 3) + 0.0 AS recall, round(median((failure_ts - fa) / 3600), 1) + 0.0 AS median_lead_h, round(min((failure_ts - fa) / 3600), 1) + 0.0 AS min_lead_h FROM w GROUP BY GROUPING SETS ((failure_mode), ())""")
def backtest_score(b: Bound) -> DataFrame:
    early = b.failures.withColumn("onset_ts", F.col("onset_ts") - 20000000)
    return evaluate.backtest_modes(evaluate.warned(early, b.alerts))


@query(prelude("alerts", "failures") + """, t AS (SELECT a.rule_code FROM alerts a WHERE EXISTS (SELECT 1 FROM failures e WHERE e.vehicle_id = a.vehicle_id AND e.failure_mode = a.failure_mode AND a.ts BETWEEN e.onset_ts - 20000000 AND e.failure_ts)),
n AS (SELECT rule_code, count(*) AS opened FROM alerts GROUP BY GROUPING SETS ((rule_code), ())), k AS (SELECT rule_code, count(*) AS t FROM t GROUP BY GROUPING SETS ((rule_code), ()))
SELECT n.rule_code, CAST(opened AS BIGINT) AS opened, CAST(coalesce(t, 0) AS BIGINT) AS true_alerts, round(coalesce(t, 0) / opened, 3) + 0.0 AS precision FROM n LEFT JOIN k ON n.rule_code IS NOT DISTINCT FROM k.rule_code""")
def backtest_rules(b: Bound) -> DataFrame:
    episodes = b.failures.select("vehicle_id", "failure_mode", (F.col("onset_ts") - 20000000).alias("onset_ts"), F.col("failure_ts").alias("until_ts"))
    return evaluate.backtest_rules(b.alerts, evaluate.true_alerts(b.alerts, episodes))


# Planning

_ACTIVE = "('proposed', 'scheduled', 'in_progress')"


@query(prelude("alerts", "work_orders") + f" SELECT alert_id, vehicle_id, failure_mode FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM work_orders w WHERE w.vehicle_id = a.vehicle_id AND w.failure_mode = a.failure_mode AND w.status IN {_ACTIVE})")
def active_anti(b: Bound) -> DataFrame:
    return plan.without_active_order(b.alerts, b.work_orders).select("alert_id", "vehicle_id", "failure_mode")


@query(prelude("work_orders") + " SELECT workshop_id, CAST(date_diff('day', DATE '1998-06-01', CAST(scheduled_for AS DATE)) AS INTEGER) AS day, CAST(count(*) AS BIGINT) AS n FROM work_orders WHERE status IN ('scheduled', 'in_progress') AND scheduled_for >= DATE '1998-06-01' GROUP BY ALL")
def booked_slots(b: Bound) -> DataFrame:
    return plan.booked_slots(b.work_orders, "1998-06-01")


def _candidates(b: Bound) -> DataFrame:
    opened = b.alerts.filter("status = 'open'").select("*", F.pmod(F.col("alert_id"), F.lit(200)).cast("double").alias("age_hours"), F.when(F.col("alert_id") % 4 == 0, F.col("alert_id") % 300).cast("double").alias("estimated_hours_to_critical"))
    cal = b.spark.createDataFrame([("COOLANT_DRIFT", 0.9, 30.0), ("LV_BATTERY_WEAK", 0.6, None), ("TYRE_SLOW_LEAK", 0.8, 40.0)], "rule_code string, p_failure double, p10_h double")
    costs = b.spark.createDataFrame([(t, m, 5000.0, 50000.0, 2000.0, 3.0, "INR", "quote" if t % 2 else "PLACEHOLDER") for t in range(25) for m in catalog.FAILURE_MODES], "tenant_id int, failure_mode string, planned double, unplanned double, downtime_per_day double, extra_downtime_days double, currency string, source string")
    return plan.candidates(opened, cal, 0.4, costs)


_CANDIDATES = """cand AS (SELECT vehicle_id, failure_mode, tenant_id, alert_id AS source_alert_id, rule_code, severity, p AS p_failure, hours_remaining,
  CASE WHEN tenant_id % 2 = 1 THEN round(p * 51000, 2) ELSE p * CASE severity WHEN 'critical' THEN 1.0 WHEN 'warning' THEN 0.5 ELSE 0.1 END END AS value, CASE WHEN tenant_id % 2 = 1 THEN 'cost' ELSE 'risk_only' END AS value_basis
  FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, failure_mode ORDER BY p DESC, alert_id) AS rn, min(left_h) OVER (PARTITION BY vehicle_id, failure_mode) AS hours_remaining FROM (
    SELECT a.*, CASE rule_code WHEN 'COOLANT_DRIFT' THEN 0.9 WHEN 'LV_BATTERY_WEAK' THEN 0.6 WHEN 'TYRE_SLOW_LEAK' THEN 0.8 ELSE 0.4 END::DOUBLE AS p,
      coalesce(CASE WHEN alert_id % 4 = 0 THEN CAST(alert_id % 300 AS DOUBLE) END, CASE rule_code WHEN 'COOLANT_DRIFT' THEN 30.0 WHEN 'TYRE_SLOW_LEAK' THEN 40.0 END::DOUBLE) - alert_id % 200 AS left_h FROM alerts a WHERE status = 'open')) WHERE rn = 1)"""


@query(prelude("alerts") + f", {_CANDIDATES} SELECT vehicle_id, failure_mode, tenant_id, source_alert_id, rule_code, severity, p_failure, round(hours_remaining, 6) + 0.0 AS hours_remaining, round(value, 6) + 0.0 AS value, value_basis FROM cand")
def candidate_argmax(b: Bound) -> DataFrame:
    return _candidates(b).select("vehicle_id", "failure_mode", "tenant_id", "source_alert_id", "rule_code", "severity", "p_failure", "hours_remaining", "value", "value_basis")


@query(prelude("vehicles", "workshops") + """, d AS (SELECT v.vehicle_id, w.workshop_id, 2 * 6371.0088 * asin(sqrt(power(sin((radians(w.latitude) - radians(v.latitude)) / 2), 2) + cos(radians(v.latitude)) * cos(radians(w.latitude)) * power(sin(radians(w.longitude - v.longitude) / 2), 2))) AS km FROM vehicles v JOIN workshops w ON w.tenant_id = v.tenant_id)
SELECT vehicle_id, CAST(rn - 1 AS INTEGER) AS near, workshop_id, round(km, 6) + 0.0 AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY km, workshop_id) AS rn FROM d) WHERE rn <= 3""")
def nearest_k(b: Bound) -> DataFrame:
    return plan.nearest_workshops(b.vehicles, b.workshops, 3).select("vehicle_id", "near", "workshop_id", "distance_km")


@query(prelude("alerts", "vehicles", "workshops", "work_orders") + f""", {_CANDIDATES}, o AS (
  SELECT c.*, v.latitude, v.longitude, row_number() OVER (PARTITION BY c.tenant_id ORDER BY value DESC, coalesce(hours_remaining, 1e300), c.vehicle_id, failure_mode) AS rn FROM cand c JOIN vehicles v ON v.vehicle_id = c.vehicle_id),
km AS (SELECT o.tenant_id, o.rn, w.workshop_id, w.daily_capacity, 2 * 6371.0088 * asin(sqrt(power(sin((radians(w.latitude) - radians(o.latitude)) / 2), 2) + cos(radians(o.latitude)) * cos(radians(w.latitude)) * power(sin(radians(w.longitude - o.longitude) / 2), 2))) AS km FROM o JOIN workshops w ON w.tenant_id = o.tenant_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, rn ORDER BY km, workshop_id) - 1 AS near FROM km) WHERE near < 3),
booked AS (SELECT workshop_id, date_diff('day', DATE '1998-06-01', CAST(scheduled_for AS DATE)) AS day, count(*) AS n FROM work_orders WHERE status IN ('scheduled', 'in_progress') AND scheduled_for >= DATE '1998-06-01' GROUP BY ALL),
slot AS (SELECT w.tenant_id, w.workshop_id, d.day, greatest(w.daily_capacity - coalesce(b.n, 0), 0) AS free, row_number() OVER (PARTITION BY w.tenant_id ORDER BY w.workshop_id, d.day) AS i FROM workshops w CROSS JOIN (SELECT unnest(range(7)) AS day) d LEFT JOIN booked b ON b.workshop_id = w.workshop_id AND b.day = d.day),
wish AS (SELECT n.tenant_id, n.rn, list(s.i ORDER BY s.day, n.near) AS wishes FROM near n JOIN slot s ON s.tenant_id = n.tenant_id AND s.workshop_id = n.workshop_id GROUP BY n.tenant_id, n.rn),
r AS (SELECT tenant_id, 0::BIGINT AS rn, list(free ORDER BY i) AS rem, NULL::BIGINT AS got FROM slot GROUP BY tenant_id
  UNION ALL SELECT x.tenant_id, x.rn, list_transform(x.rem, lambda f, j: f - CASE WHEN j = x.got THEN 1 ELSE 0 END), x.got FROM (SELECT w.tenant_id, w.rn, r.rem, list_filter(w.wishes, lambda s: r.rem[s] > 0)[1] AS got FROM r JOIN wish w ON w.tenant_id = r.tenant_id AND w.rn = r.rn + 1) x)
SELECT o.tenant_id, o.vehicle_id, o.failure_mode, round(o.value, 6) + 0.0 AS value, s.workshop_id, CAST(s.day AS INTEGER) AS day, round(n.km, 1) + 0.0 AS distance_km, coalesce(s.day * 24 > o.hours_remaining, false) AS late
FROM o LEFT JOIN r ON r.tenant_id = o.tenant_id AND r.rn = o.rn LEFT JOIN slot s ON s.tenant_id = o.tenant_id AND s.i = r.got LEFT JOIN near n ON n.tenant_id = o.tenant_id AND n.rn = o.rn AND n.workshop_id = s.workshop_id""")
def schedule(b: Bound) -> DataFrame:
    """All candidates and what they get; the SQL serves them one by one."""
    where = b.vehicles.select("vehicle_id", "latitude", "longitude")
    booked = plan.booked_slots(b.work_orders, "1998-06-01")
    cands = _candidates(b).join(where, "vehicle_id")
    return plan.schedule(cands, b.workshops, booked).select("tenant_id", "vehicle_id", "failure_mode", "value", "workshop_id", "day", "distance_km", "late")


@query(f"WITH planned AS ({ORACLES['schedule']})" + """
SELECT tenant_id, CAST(count(workshop_id) AS BIGINT) AS proposed, CAST(count(*) FILTER (late AND workshop_id IS NOT NULL) AS BIGINT) AS late, CAST(count(*) FILTER (workshop_id IS NULL) AS BIGINT) AS unscheduled,
  CAST(count(*) FILTER (tenant_id % 2 = 1) AS BIGINT) AS by_cost, CAST(count(*) FILTER (tenant_id % 2 = 0) AS BIGINT) AS by_risk FROM planned GROUP BY tenant_id""")
def planner_summary(b: Bound) -> DataFrame:
    cands = _candidates(b).join(b.vehicles.select("vehicle_id", "latitude", "longitude"), "vehicle_id")
    return plan.plan_summary(plan.schedule(cands, b.workshops, plan.booked_slots(b.work_orders, "1998-06-01")))


# Radar


_COHORTS = "coh AS (SELECT vehicle_id, oem, model_code, firmware, powertrain FROM vehicles)"
_AFFECTED = """aff AS (SELECT window_start, dtc, oem, model_code, firmware, powertrain, count(*) AS k FROM (SELECT DISTINCT floor(ts / 604800) * 604800 AS window_start, unnest(dtc_codes) AS dtc, vehicle_id FROM telemetry) e JOIN coh USING (vehicle_id) GROUP BY ALL)"""
_TESTS = """pop AS (SELECT oem, model_code, firmware, powertrain, count(*) AS n FROM coh GROUP BY ALL), mpop AS (SELECT model_code, min(powertrain) AS powertrain, sum(n) AS n FROM pop GROUP BY 1), ppop AS (SELECT powertrain, sum(n) AS n FROM pop GROUP BY 1),
mk AS (SELECT window_start, dtc, model_code, sum(k) AS k FROM aff GROUP BY ALL), pk AS (SELECT window_start, dtc, powertrain, sum(k) AS k FROM aff GROUP BY ALL),
tests AS (SELECT a.window_start, a.dtc, 'firmware' AS level, a.model_code, a.firmware AS firmware_version, a.k, p.n, mk.k - a.k AS base_k, mpop.n - p.n AS base_n FROM aff a JOIN pop p USING (model_code, firmware) JOIN mpop USING (model_code) JOIN mk ON mk.window_start = a.window_start AND mk.dtc = a.dtc AND mk.model_code = a.model_code
  UNION ALL SELECT mk.window_start, mk.dtc, 'model', mk.model_code, NULL, mk.k, mpop.n, pk.k - mk.k, ppop.n - mpop.n FROM mk JOIN mpop USING (model_code) JOIN ppop ON ppop.powertrain = mpop.powertrain JOIN pk ON pk.window_start = mk.window_start AND pk.dtc = mk.dtc AND pk.powertrain = mpop.powertrain)"""


def _tests(b: Bound) -> DataFrame:
    events = b.telemetry.select("vehicle_id", "ts", F.col("dtc_codes").alias("dtcs"))
    cohorts = b.vehicles.select("vehicle_id", *radar.COHORT)
    return radar.tests(radar.affected(events, cohorts, 604800.0), radar.populations(cohorts))


@query(prelude("telemetry", "vehicles") + f", {_COHORTS}, {_AFFECTED} SELECT window_start, dtc, model_code, firmware, CAST(k AS BIGINT) AS k FROM aff")
def cohort_distinct(b: Bound) -> DataFrame:
    return radar.affected(b.telemetry.select("vehicle_id", "ts", F.col("dtc_codes").alias("dtcs")), b.vehicles, 604800.0).select("window_start", "dtc", "model_code", "firmware", "k")


@query(prelude("telemetry", "vehicles") + f", {_COHORTS}, {_AFFECTED}, {_TESTS} SELECT window_start, dtc, level, model_code, firmware_version, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, CAST(base_k AS BIGINT) AS base_k, CAST(base_n AS BIGINT) AS base_n FROM tests WHERE base_n > 0")
def cohort_baseline(b: Bound) -> DataFrame:
    return _tests(b).select("window_start", "dtc", "level", "model_code", "firmware_version", "k", "n", "base_k", "base_n")


@query(prelude("telemetry", "vehicles") + f""", {_COHORTS}, {_AFFECTED}, {_TESTS}, t AS (SELECT *, count(*) OVER (PARTITION BY window_start) AS nt, (base_k + 0.5) / (base_n + 1) AS p0 FROM tests WHERE base_n > 0), c AS (SELECT *, n * p0 AS lam FROM t WHERE k >= 2 AND k / n >= 1.2 * p0),
p AS (SELECT *, 1 - list_sum(list_transform(range(0, CAST(k AS BIGINT)), lambda i: exp(-lam + i * ln(lam) - lgamma(CAST(i + 1 AS DOUBLE))))) AS pv FROM c)
SELECT window_start, dtc, level, model_code, firmware_version, CAST(k AS BIGINT) AS affected_vehicles, round(k / n, 5) + 0.0 AS rate, round(k / n / p0, 2) + 0.0 AS rate_ratio, round(pv, 6) + 0.0 AS p_value, round(least(1, pv * nt), 6) + 0.0 AS p_adjusted, CAST(nt AS BIGINT) AS tests_in_window, least(1, pv * nt) < 0.2 AS signal FROM p""")
def poisson_signals(b: Bound) -> DataFrame:
    """Every comparison above the ratio with its tail; `signal` is the verdict of the tail."""
    found = radar.compared(_tests(b), 604800.0, min_vehicles=2, min_ratio=1.2, alpha=0.2)
    return found.select("window_start", "dtc", "level", "model_code", "firmware_version", "affected_vehicles", "rate", "rate_ratio", "p_value", "p_adjusted", "tests_in_window", "signal")


# Serving


@query(prelude("vehicles", "alerts", "work_orders") + """
SELECT tenant_id, CAST((SELECT count(*) FROM vehicles v WHERE v.tenant_id = t.tenant_id) AS BIGINT) AS vehicles, CAST((SELECT count(*) FROM alerts a WHERE a.tenant_id = t.tenant_id AND status = 'open') AS BIGINT) AS open_alerts,
  CAST((SELECT count(*) FROM alerts a WHERE a.tenant_id = t.tenant_id AND status = 'open' AND severity = 'critical') AS BIGINT) AS critical_alerts, CAST((SELECT count(*) FROM alerts a WHERE a.tenant_id = t.tenant_id AND status = 'acknowledged') AS BIGINT) AS acknowledged_alerts,
  CAST((SELECT count(*) FROM work_orders w WHERE w.tenant_id = t.tenant_id AND status = 'proposed') AS BIGINT) AS proposed_orders, CAST((SELECT count(*) FROM work_orders w WHERE w.tenant_id = t.tenant_id AND status = 'scheduled') AS BIGINT) AS scheduled_orders,
  CAST((SELECT count(*) FROM work_orders w WHERE w.tenant_id = t.tenant_id AND status = 'in_progress') AS BIGINT) AS active_orders, CAST((SELECT count(*) FROM work_orders w WHERE w.tenant_id = t.tenant_id AND status = 'completed') AS BIGINT) AS completed_orders
FROM (SELECT DISTINCT tenant_id FROM vehicles) t""")  # fmt: skip
def fleet_summary(b: Bound) -> DataFrame:
    return serve.fleet_summary(b.vehicles, b.alerts, b.work_orders)


@query(prelude("vehicles", "alerts") + " SELECT v.vehicle_id, CAST(count(a.alert_id) AS BIGINT) AS open_alerts FROM vehicles v LEFT JOIN alerts a ON a.vehicle_id = v.vehicle_id AND a.status = 'open' GROUP BY 1")
def open_alert_counts(b: Bound) -> DataFrame:
    return serve.open_alert_counts(b.vehicles.select("vehicle_id"), b.alerts)


@query(prelude("alerts") + ", f AS (SELECT alert_id, ts, severity FROM alerts WHERE status = 'open' AND tenant_id = 7 AND (ts < 900000000 OR (ts = 900000000 AND alert_id < 5000))) SELECT *, (SELECT count(*) > 10 FROM f) AS more FROM f ORDER BY ts DESC, alert_id DESC LIMIT 10")
def keyset_page(b: Bound) -> DataFrame:
    return serve.keyset_page(serve.tenant_scope(b.alerts, 7), ["ts", "alert_id"], 10, after=(900000000.0, 5000), filters={"status": "open", "severity": None}).select("alert_id", "ts", "severity", "more")


@query(prelude("vehicles", "alerts") + ", s AS (SELECT vehicle_id, max(price) / 1000000 AS score FROM alerts GROUP BY 1) SELECT vehicle_id, round(score, 6) + 0.0 AS rank_value, 'model' AS source FROM s JOIN vehicles USING (vehicle_id) ORDER BY score DESC, vehicle_id LIMIT 20")
def at_risk(b: Bound) -> DataFrame:
    scores = b.alerts.groupBy("vehicle_id").agg((F.max("price") / 1000000).alias("score"))
    states = b.vehicles.select("vehicle_id", F.lit(100).alias("health_score"))
    return serve.at_risk(scores, states, b.vehicles.select("vehicle_id"), 20).select("vehicle_id", "rank_value", "source")


# Metrics


def _scored(b: Bound) -> DataFrame:
    """Line items as scored rows: label from the return flag, score from the discount."""
    li = b.table("lineitem")
    return li.select(F.col("l_suppkey").alias("vehicle_id"), (F.col("l_linenumber") * 86400.0).alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").alias("score"), (F.col("l_quantity") / 50).alias("p"), "l_orderkey", F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") * 86400.0 + F.col("l_quantity") * 3600).alias("next_failure_ts"))


@query("""WITH r AS (SELECT l_linenumber * 86400.0::DOUBLE AS t, CAST(l_returnflag = 'R' AS INT) AS y, l_discount AS s, l_quantity / 50 AS p FROM lineitem),
g AS (SELECT t, s, sum(y) AS pos, sum(1 - y) AS neg FROM r GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS al, coalesce(sum(pos) OVER (PARTITION BY t ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM g WINDOW w AS (PARTITION BY t ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT t, sum(pos * tp / al) / sum(pos) AS ap, sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY t), q AS (SELECT t, count(*) AS n, avg(y) AS pr, avg(power(least(greatest(p, 0), 1) - y, 2)) AS brier FROM r GROUP BY t)
SELECT t, CAST(n AS BIGINT) AS rows, round(pr, 6) + 0.0 AS positive_rate, round(brier, 6) + 0.0 AS brier, round(ap, 6) + 0.0 AS average_precision, round(auc, 6) + 0.0 AS roc_auc FROM q JOIN m USING (t)""")  # fmt: skip
def model_metrics(b: Bound) -> DataFrame:
    return evaluate.model_metrics(_scored(b), "score", "label", "p", ["t"])


@query("""WITH r AS (SELECT l_orderkey, l_suppkey AS v, l_linenumber * 86400.0::DOUBLE AS t, CAST(l_returnflag = 'R' AS INT) AS y, l_discount AS s, l_extendedprice AS x, l_quantity FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s DESC, x) AS rn, count(*) OVER (PARTITION BY t) AS n FROM r),
top AS (SELECT * FROM o WHERE rn <= greatest(1, round_even(n * 0.05, 0)))
SELECT t, CAST(count(*) AS BIGINT) AS listed, round(avg(y), 6) + 0.0 AS precision FROM top GROUP BY t""")
def topk_share(b: Bound) -> DataFrame:
    rows = b.table("lineitem").select((F.col("l_linenumber") * 86400.0).alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").alias("score"), "l_extendedprice")
    return evaluate.top_share(rows, "t", "score", F.col("l_extendedprice"), 0.05).groupBy("t").agg(F.count("*").alias("listed"), F.avg("label").alias("precision"))


@query("""WITH r AS (SELECT l_suppkey AS v, l_linenumber * 86400.0::DOUBLE AS t, CAST(l_returnflag = 'R' AS INT) AS y, l_discount AS s, l_extendedprice AS x, CASE WHEN l_returnflag = 'R' THEN l_linenumber * 86400.0::DOUBLE + l_quantity * 3600 END AS nf FROM lineitem),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s DESC, x) AS rn, count(*) OVER (PARTITION BY t) AS n FROM r) WHERE rn <= greatest(1, round_even(n * 0.1, 0))),
pr AS (SELECT avg(p) AS mp, count(*) AS snaps FROM (SELECT t, avg(y) AS p FROM top GROUP BY t)), best AS (SELECT v, nf, max(nf - t) AS lead FROM top WHERE y = 1 GROUP BY ALL), f AS (SELECT count(*) AS n FROM (SELECT DISTINCT v, nf FROM r WHERE y = 1)), c AS (SELECT count(*) AS listed, count(*) FILTER (lead >= 86400) AS caught, median(lead / 3600) AS med FROM best)
SELECT CAST(snaps AS BIGINT) AS snapshots, round(mp, 4) + 0.0 AS mean_precision, CAST(f.n AS BIGINT) AS failures, CAST(listed AS BIGINT) AS listed, round(caught / f.n, 4) + 0.0 AS recall_ahead, round(med, 1) + 0.0 AS median_lead_h FROM pr, c, f""")  # fmt: skip
def capacity_metrics(b: Bound) -> DataFrame:
    rows = b.table("lineitem").select(F.col("l_suppkey").alias("vehicle_id"), (F.col("l_linenumber") * 86400.0).alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").alias("score"), "l_extendedprice", F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") * 86400.0 + F.col("l_quantity") * 3600).alias("next_failure_ts"))
    return evaluate.capacity_metrics(rows, "score", 0.1, 86400.0, F.col("l_extendedprice"))


_MIX = "((xor({x}, {x} >> 16) * 73244475) % 4294967296)"
_STEPS = ", ".join(f"{x!r}::DOUBLE" for x in evaluate.poisson_steps())


@query(f"""WITH v AS (SELECT vehicle_id, r, CAST('0x' || substr(md5(vehicle_id || '|11'), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT l_suppkey AS vehicle_id FROM lineitem), (SELECT unnest(range(200)) AS r)),
x0 AS (SELECT vehicle_id, r, (h + r * 2654435769) % 4294967296 AS x FROM v), x1 AS (SELECT vehicle_id, r, {_MIX.format(x='x')} AS x FROM x0), x2 AS (SELECT vehicle_id, r, {_MIX.format(x='x')} AS x FROM x1),
w AS (SELECT vehicle_id, r, len(list_filter([{_STEPS}], lambda s: s < (xor(x, x >> 16) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) AS w FROM x2),
li AS (SELECT l_suppkey AS vehicle_id, CAST(l_returnflag = 'R' AS INT) AS y, l_discount AS a, l_quantity / 50 AS b, count(*) AS c FROM lineitem GROUP BY ALL),
s AS (SELECT 'a' AS m, a AS score, vehicle_id, y, sum(c) AS c FROM li GROUP BY ALL UNION ALL SELECT 'b', b, vehicle_id, y, sum(c) FROM li GROUP BY ALL),
g AS (SELECT m, r, score, sum(w * c * y)::DOUBLE AS pos, sum(w * c * (1 - y))::DOUBLE AS neg FROM s JOIN w USING (vehicle_id) GROUP BY m, r, score),
k AS (SELECT m, r, pos, neg, sum(pos) OVER o AS tp, sum(pos + neg) OVER o AS al FROM g WINDOW o AS (PARTITION BY m, r ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT m, r, sum(CASE WHEN al > 0 THEN pos * tp / al ELSE 0 END) / nullif(sum(pos), 0) AS ap, sum(neg) AS neg FROM k GROUP BY m, r),
d AS (SELECT x.ap - y.ap AS d FROM ap x JOIN ap y ON x.r = y.r AND x.m = 'a' AND y.m = 'b' WHERE x.neg > 0 AND x.ap IS NOT NULL)
SELECT round(avg(d), 6) + 0.0 AS mean, round(quantile_cont(d, 0.025), 6) + 0.0 AS low, round(quantile_cont(d, 0.975), 6) + 0.0 AS high, CAST(count(*) AS BIGINT) AS resamples FROM d""")
def bootstrap_difference(b: Bound) -> DataFrame:
    """200 resamples of whole vehicles; the SQL draws the same weights."""
    return evaluate.bootstrap(_scored(b), "score", "p")


# Quality


@query("""WITH RECURSIVE r AS (SELECT l_returnflag AS g, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT g, CAST(max(n) AS BIGINT) AS n, max(v) FILTER (rn = least(floor(0.5 * n), n - 1) + 1) AS p50, max(v) FILTER (rn = least(floor(0.95 * n), n - 1) + 1) AS p95, max(v) FILTER (rn = least(floor(0.99 * n), n - 1) + 1) AS p99, max(v) AS max, round(count(*) FILTER (v < 20) / count(*), 6) + 0.0 AS share_under FROM r GROUP BY g""")
def latency_index_quantile(b: Bound) -> DataFrame:
    rows = b.table("lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("v"))
    return quality.latency_summary(rows, "v", ["g"], under=20.0)


@query("""WITH e AS (SELECT unnest([0.0::DOUBLE, 5, 10, 20, 40]) AS lo, unnest([5.0::DOUBLE, 10, 20, 40, NULL]) AS hi, unnest([0, 1, 2, 3, 4]) AS b), r AS (SELECT l_returnflag AS g, CAST(l_quantity > 5 AS INT) + CAST(l_quantity > 10 AS INT) + CAST(l_quantity > 20 AS INT) + CAST(l_quantity > 40 AS INT) AS b FROM lineitem),
h AS (SELECT g, b, count(*) AS c FROM r GROUP BY ALL), u AS (SELECT *, sum(c) OVER (PARTITION BY g ORDER BY b) AS upto, sum(c) OVER (PARTITION BY g) AS n FROM h)
SELECT g, CAST(n AS BIGINT) AS n, round(coalesce(lo + (hi - lo) * (n * 0.7 - (upto - c)) / c, 40), 6) + 0.0 AS quantile FROM u JOIN e USING (b) WHERE upto >= n * 0.7 AND upto - c < n * 0.7""")
def bucket_quantile(b: Bound) -> DataFrame:
    return quality.bucket_quantile(b.table("lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("v")), "v", ["g"], [5, 10, 20, 40], 0.7)


@query(prelude("telemetry") + """, s AS (SELECT CAST(floor(ts / 3600) * 3600 AS BIGINT) AS step, count(*) AS n, count(*) FILTER (event_type = 'BREAKDOWN') AS bad FROM telemetry GROUP BY 1),
r AS (SELECT step, sum(bad) OVER (ORDER BY step RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) / sum(n) OVER (ORDER BY step RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS ratio_7200, sum(bad) OVER (ORDER BY step RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW) / sum(n) OVER (ORDER BY step RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW) AS ratio_86400 FROM s)
SELECT step, round(ratio_7200, 6) + 0.0 AS ratio_7200, round(ratio_86400, 6) + 0.0 AS ratio_86400, ratio_86400 > 0.2 AND ratio_7200 > 0.2 AS burning FROM r""")
def burn_rate(b: Bound) -> DataFrame:
    ratios = quality.ratio_windows(b.telemetry, "ts", F.col("event_type") == "BREAKDOWN", (7200, 86400), 3600)
    return quality.burn_alerts(ratios, 0.1, ((86400, 7200, 2.0),))


@query(prelude("alerts") + """ SELECT vehicle_id, CAST(greatest(100 - sum(CASE severity WHEN 'critical' THEN 40 WHEN 'warning' THEN 15 ELSE 0 END), 0) AS BIGINT) AS health_score, string_agg(DISTINCT rule_code, ',' ORDER BY rule_code) AS active FROM alerts WHERE status = 'open' GROUP BY 1""")
def health_score(b: Bound) -> DataFrame:
    return rollup.health(b.alerts.filter("status = 'open'")).withColumn("active", F.array_join("active", ","))


@query(prelude("telemetry", "alerts") + """, v AS (SELECT *, max(seq) OVER (PARTITION BY vehicle_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h, row_number() OVER (PARTITION BY vehicle_id, seq ORDER BY arrival) AS rn FROM telemetry),
o AS (SELECT vehicle_id, seq, arrival, CASE WHEN h IS NULL OR seq > h THEN 'NEW' WHEN h - seq >= 3 THEN 'TOO_OLD' WHEN rn > 1 THEN 'DUPLICATE' ELSE 'NEW_LATE' END AS verdict FROM v),
k AS (SELECT count(*) AS raw, count(*) FILTER (verdict = 'DUPLICATE') AS dup, count(*) FILTER (verdict <> 'DUPLICATE') AS canonical, count(DISTINCT vehicle_id || '|' || arrival) FILTER (verdict <> 'DUPLICATE') AS ids FROM o),
st AS (SELECT count(DISTINCT vehicle_id || '|' || seq) AS n FROM telemetry), al AS (SELECT count(DISTINCT fingerprint) AS opened, count(DISTINCT fingerprint) FILTER (status <> 'resolved') AS current FROM alerts),
c AS (SELECT 'conserved' AS name, raw AS expected, canonical + dup AS actual FROM k UNION ALL SELECT 'unique_ids', canonical, ids FROM k UNION ALL SELECT 'stored_ids', ids, st.n FROM k, st UNION ALL SELECT 'alerts', opened, current FROM al UNION ALL SELECT 'not_empty', 1, least(raw, 1) FROM k)
SELECT name, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, expected = actual AS ok FROM c""")  # fmt: skip
def conservation(b: Bound) -> DataFrame:
    """Rows judged in order against a store of one row for each sequence number, and alerts against those not resolved: a loss shows as a difference."""
    judged = windows.dedup_verdict(b.telemetry, "vehicle_id", "arrival", "seq", 3)
    rows = judged.select(F.when(F.col("verdict") == "DUPLICATE", "duplicate").otherwise("canonical").alias("outcome"), vehicle.stable_id(F.col("vehicle_id"), F.col("arrival")).alias("event_id"))
    stored = b.telemetry.groupBy("vehicle_id", "seq").agg(F.min("arrival").alias("arrival")).select(vehicle.stable_id(F.col("vehicle_id"), F.col("arrival")).alias("event_id"))
    return quality.conservation(rows, stored, b.alerts, b.alerts.filter("status <> 'resolved'").select("fingerprint").distinct())


@query(prelude("telemetry") + " SELECT event_id_k AS id, side FROM (SELECT DISTINCT user_id AS event_id_k, 'missing' AS side FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT DISTINCT c_custkey, 'extra' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events))")
def id_difference(b: Bound) -> DataFrame:
    return quality.missing_and_extra(b.table("events").select(F.col("user_id").alias("id")), b.table("customer").select(F.col("c_custkey").alias("id")), "id")


# Ordered operators

_ORDERED = "PARTITION BY vehicle_id ORDER BY arrival"


@query(prelude("telemetry") + f""", v AS (SELECT *, max(seq) OVER ({_ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h, row_number() OVER (PARTITION BY vehicle_id, seq ORDER BY arrival) AS rn FROM telemetry)
SELECT vehicle_id, arrival, seq, CASE WHEN h IS NULL OR seq > h THEN 'NEW' WHEN h - seq >= 3 THEN 'TOO_OLD' WHEN rn > 1 THEN 'DUPLICATE' ELSE 'NEW_LATE' END AS verdict FROM v""")
def dedup_verdict(b: Bound) -> DataFrame:
    return windows.dedup_verdict(b.telemetry, "vehicle_id", "arrival", "seq", 3).select("vehicle_id", "arrival", "seq", "verdict")


@query(prelude("telemetry") + f" SELECT vehicle_id, arrival, coalesce(ingest_s >= max(ingest_s) OVER ({_ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS in_order FROM telemetry")
def in_order(b: Bound) -> DataFrame:
    return windows.in_order(b.telemetry, "vehicle_id", "arrival", "ingest_s").select("vehicle_id", "arrival", "in_order")


@query(prelude("telemetry") + f""", i AS (SELECT *, coalesce(ignition_on, false) AS o, sum(CASE WHEN coalesce(ignition_on, false) THEN 0 ELSE 1 END) OVER ({_ORDERED}) AS isl FROM telemetry),
s AS (SELECT *, min(CASE WHEN o THEN ts END) OVER (PARTITION BY vehicle_id, isl) AS st FROM i)
SELECT vehicle_id, arrival, round(CASE WHEN o THEN st END, 6) + 0.0 AS on_since, coalesce(o AND ts - st >= 90000, false) AS warm FROM s""")
def ignition_islands(b: Bound) -> DataFrame:
    return windows.on_runs(b.telemetry, "vehicle_id", "arrival", "ts", F.col("ignition_on"), 90000.0).select("vehicle_id", "arrival", "on_since", "warm")


_NUMBERED = "n AS (SELECT vehicle_id, arrival, ts, value AS x, row_number() OVER (PARTITION BY vehicle_id ORDER BY arrival) AS rn FROM telemetry)"


@query(prelude("telemetry") + f", {_NUMBERED}, f AS (SELECT vehicle_id, arrival, rn, x AS m FROM n WHERE rn = 1 UNION ALL SELECT n.vehicle_id, n.arrival, n.rn, f.m + 0.05 * (n.x - f.m) FROM f JOIN n ON n.vehicle_id = f.vehicle_id AND n.rn = f.rn + 1) SELECT vehicle_id, arrival, CAST(rn AS INTEGER) AS n, {settled('m')} AS ewma FROM f")
def ewma(b: Bound) -> DataFrame:
    return windows.ewma(b.telemetry, "vehicle_id", "arrival", "value", 0.05).withColumn("ewma", settled(F.col("ewma")))


@query(prelude("telemetry") + f", {_NUMBERED}, f AS (SELECT vehicle_id, arrival, rn, x AS m, 0.0::DOUBLE AS v FROM n WHERE rn = 1 UNION ALL SELECT n.vehicle_id, n.arrival, n.rn, f.m + 0.02 * (n.x - f.m), 0.98 * (f.v + 0.02 * (n.x - f.m) * (n.x - f.m)) FROM f JOIN n ON n.vehicle_id = f.vehicle_id AND n.rn = f.rn + 1) SELECT vehicle_id, arrival, CAST(rn AS INTEGER) AS n, round(m, 6) + 0.0 AS mean, round(v, 6) + 0.0 AS var FROM f")
def ewvar(b: Bound) -> DataFrame:
    return windows.ewvar(b.telemetry, "vehicle_id", "arrival", "value", 0.02)


@query(prelude("telemetry") + f", {_NUMBERED}, f AS (SELECT vehicle_id, arrival, rn, greatest(0, x - 54.0)::DOUBLE AS s FROM n WHERE rn = 1 UNION ALL SELECT n.vehicle_id, n.arrival, n.rn, greatest(0, f.s + n.x - 54.0) FROM f JOIN n ON n.vehicle_id = f.vehicle_id AND n.rn = f.rn + 1) SELECT vehicle_id, arrival, round(s, 6) + 0.0 AS cusum FROM f")
def cusum(b: Bound) -> DataFrame:
    return windows.cusum(b.telemetry, "vehicle_id", "arrival", "value", 54.0).select("vehicle_id", "arrival", "cusum")


@query(prelude("telemetry") + f""", {_NUMBERED}, z AS (SELECT *, min(ts) OVER (PARTITION BY vehicle_id) AS t0 FROM n), p AS (SELECT a.vehicle_id, a.arrival, count(*) AS c, sum(exp(-(a.ts - b.ts) / 864000)) AS w, sum(exp(-(a.ts - b.ts) / 864000) * (b.ts - b.t0) / 3600) AS wt, sum(exp(-(a.ts - b.ts) / 864000) * b.x) AS wy,
  sum(exp(-(a.ts - b.ts) / 864000) * power((b.ts - b.t0) / 3600, 2)) AS wtt, sum(exp(-(a.ts - b.ts) / 864000) * (b.ts - b.t0) / 3600 * b.x) AS wty FROM z a JOIN z b ON a.vehicle_id = b.vehicle_id AND b.rn <= a.rn GROUP BY ALL)
SELECT vehicle_id, arrival, round(CASE WHEN c < 3 OR w * wtt - wt * wt <= 1e-12 THEN 0 ELSE (w * wty - wt * wy) / (w * wtt - wt * wt) END, 5) + 0.0 AS slope_per_hour FROM p""")
def ew_trend(b: Bound) -> DataFrame:
    return rounded(windows.ew_trend(b.telemetry, "vehicle_id", "arrival", "ts", "value", 864000.0), 5)


@query(prelude("telemetry") + """, a AS (SELECT vehicle_id, arrival, [tyre_fl_kpa, tyre_fr_kpa, tyre_rl_kpa, tyre_rr_kpa] AS p FROM telemetry WHERE tyre_rr_kpa IS NOT NULL), m AS (SELECT *, [list_sort([p[2], p[3], p[4]])[2], list_sort([p[1], p[3], p[4]])[2], list_sort([p[1], p[2], p[4]])[2], list_sort([p[1], p[2], p[3]])[2]] AS md FROM a)
SELECT vehicle_id, arrival, round(greatest(0, (md[1] - p[1]) / md[1]), 6) + 0.0 AS fl, round(greatest(0, (md[2] - p[2]) / md[2]), 6) + 0.0 AS fr, round(greatest(0, (md[3] - p[3]) / md[3]), 6) + 0.0 AS rl, round(greatest(0, (md[4] - p[4]) / md[4]), 6) + 0.0 AS rr FROM m""")
def tyre_deficit(b: Bound) -> DataFrame:
    d = b.telemetry.withColumn("d", windows.tyre_deficits(F.array("tyre_fl_kpa", "tyre_fr_kpa", "tyre_rl_kpa", "tyre_rr_kpa"))).filter("d IS NOT NULL")
    return d.select("vehicle_id", "arrival", *[F.col("d")[i].alias(n) for i, n in enumerate(("fl", "fr", "rl", "rr"))])


@query(prelude("telemetry") + """, a AS (SELECT vehicle_id, arrival, [tyre_fl_kpa, tyre_fr_kpa, tyre_rl_kpa, tyre_rr_kpa] AS p FROM telemetry WHERE tyre_rr_kpa IS NOT NULL),
m AS (SELECT *, [list_sort([p[2], p[3], p[4]])[2], list_sort([p[1], p[3], p[4]])[2], list_sort([p[1], p[2], p[4]])[2], list_sort([p[1], p[2], p[3]])[2]] AS md FROM a),
n AS (SELECT m.vehicle_id, m.arrival, w.i, greatest(0, (md[w.i] - p[w.i]) / md[w.i])::DOUBLE AS x, row_number() OVER (PARTITION BY vehicle_id, w.i ORDER BY arrival) AS rn FROM m, (VALUES (1), (2), (3), (4)) AS w(i)),
f AS (SELECT vehicle_id, arrival, i, rn, x AS m FROM n WHERE rn = 1 UNION ALL SELECT n.vehicle_id, n.arrival, n.i, n.rn, f.m + 0.02 * (n.x - f.m) FROM f JOIN n ON n.vehicle_id = f.vehicle_id AND n.i = f.i AND n.rn = f.rn + 1)
SELECT vehicle_id, arrival, round(max(m), 6) + 0.0 AS shortfall FROM f GROUP BY ALL""")
def tyre_leaks(b: Bound) -> DataFrame:
    wheels = ("tyre_fl_kpa", "tyre_fr_kpa", "tyre_rl_kpa", "tyre_rr_kpa")
    return windows.tyre_leaks(b.telemetry, "vehicle_id", "arrival", "ts", wheels, 0.02, 864000.0).select("vehicle_id", "arrival", "shortfall")


@query(prelude("telemetry") + """, a AS (SELECT vehicle_id, arrival, ts, [tyre_fl_kpa, tyre_fr_kpa, tyre_rl_kpa, tyre_rr_kpa] AS p FROM telemetry WHERE tyre_rr_kpa IS NOT NULL),
m AS (SELECT *, [list_sort([p[2], p[3], p[4]])[2], list_sort([p[1], p[3], p[4]])[2], list_sort([p[1], p[2], p[4]])[2], list_sort([p[1], p[2], p[3]])[2]] AS md FROM a),
n AS (SELECT m.vehicle_id, m.arrival, m.ts, w.i, greatest(0, (md[w.i] - p[w.i]) / md[w.i])::DOUBLE AS x, row_number() OVER (PARTITION BY vehicle_id, w.i ORDER BY arrival) AS rn, min(m.ts) OVER (PARTITION BY vehicle_id) AS t0 FROM m, (VALUES (1), (2), (3), (4)) AS w(i)),
f AS (SELECT vehicle_id, arrival, i, rn, x AS m FROM n WHERE rn = 1 UNION ALL SELECT n.vehicle_id, n.arrival, n.i, n.rn, f.m + 0.02 * (n.x - f.m) FROM f JOIN n ON n.vehicle_id = f.vehicle_id AND n.i = f.i AND n.rn = f.rn + 1),
p AS (SELECT a.vehicle_id, a.arrival, a.i, count(*) AS c, sum(exp(-(a.ts - b.ts) / 864000)) AS w, sum(exp(-(a.ts - b.ts) / 864000) * (b.ts - b.t0) / 3600) AS wt, sum(exp(-(a.ts - b.ts) / 864000) * b.x) AS wy, sum(exp(-(a.ts - b.ts) / 864000) * power((b.ts - b.t0) / 3600, 2)) AS wtt,
  sum(exp(-(a.ts - b.ts) / 864000) * (b.ts - b.t0) / 3600 * b.x) AS wty FROM n a JOIN n b ON a.vehicle_id = b.vehicle_id AND a.i = b.i AND b.rn <= a.rn GROUP BY ALL),
s AS (SELECT p.*, f.m, CASE WHEN c < 3 OR w * wtt - wt * wt <= 1e-12 THEN 0 ELSE (w * wty - wt * wy) / (w * wtt - wt * wt) END AS slope FROM p JOIN f ON f.vehicle_id = p.vehicle_id AND f.arrival = p.arrival AND f.i = p.i),
r AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, arrival ORDER BY m DESC, i) AS best FROM s)
SELECT vehicle_id, arrival, CAST(i - 1 AS INTEGER) AS worst, round(m, 6) + 0.0 AS shortfall, round(slope, 5) + 0.0 AS slope_per_hour FROM r WHERE best = 1 AND c >= 10""")
def tyre_leak_rate(b: Bound) -> DataFrame:
    """The worst wheel with its mean shortfall and how fast that grows, from a vehicle's tenth row on."""
    wheels = ("tyre_fl_kpa", "tyre_fr_kpa", "tyre_rl_kpa", "tyre_rr_kpa")
    found = windows.tyre_leaks(b.telemetry, "vehicle_id", "arrival", "ts", wheels, 0.02, 864000.0, least=10)
    return found.withColumn("slope_per_hour", F.round("slope_per_hour", 5) + 0.0)


_LATCH = """f AS (SELECT vehicle_id, rn, arrival, seq, CAST({open} AS INT) AS l, CAST({open} AS INT) AS edge, CASE WHEN {open} THEN seq END AS os FROM n WHERE rn = 1
  UNION ALL SELECT n.vehicle_id, n.rn, n.arrival, n.seq, CASE WHEN {nopen} THEN 1 WHEN {nclear} THEN 0 ELSE f.l END, CASE WHEN {nopen} AND f.l = 0 THEN 1 WHEN f.l = 1 AND NOT ({nopen}) AND {nclear} THEN -1 ELSE 0 END, CASE WHEN {nopen} AND f.l = 0 THEN n.seq ELSE f.os END FROM f JOIN n ON n.vehicle_id = f.vehicle_id AND n.rn = f.rn + 1)
SELECT vehicle_id, arrival, CASE edge WHEN 1 THEN 'open' ELSE 'cleared' END AS status, os AS opened_seq FROM f WHERE edge <> 0"""


@query(prelude("telemetry") + ", n AS (SELECT vehicle_id, arrival, seq, value AS x, row_number() OVER (PARTITION BY vehicle_id ORDER BY arrival) AS rn FROM telemetry), " + _LATCH.format(open="x > 90", nopen="n.x > 90", nclear="n.x < 40"))
def hysteresis(b: Bound) -> DataFrame:
    return windows.hysteresis(b.telemetry, "vehicle_id", "arrival", F.col("value") > 90, F.col("value") < 40, "seq").select("vehicle_id", "arrival", "status", "opened_seq")


@query(prelude("telemetry") + ", n AS (SELECT vehicle_id, arrival, event_type, speed_kmh, row_number() OVER (PARTITION BY vehicle_id ORDER BY arrival) AS rn FROM telemetry), f AS (SELECT vehicle_id, rn, arrival, event_type = 'BREAKDOWN' AS l FROM n WHERE rn = 1 UNION ALL SELECT n.vehicle_id, n.rn, n.arrival, CASE WHEN n.event_type = 'BREAKDOWN' THEN true WHEN n.speed_kmh >= 30 THEN false ELSE f.l END FROM f JOIN n ON n.vehicle_id = f.vehicle_id AND n.rn = f.rn + 1) SELECT vehicle_id, arrival, l AS latched FROM f")
def breakdown_latch(b: Bound) -> DataFrame:
    return windows.breakdown_latch(b.telemetry, "vehicle_id", "arrival", F.col("event_type") == "BREAKDOWN", F.col("speed_kmh") >= 30).select("vehicle_id", "arrival", "latched")


_CODE_ROWS = "g AS (SELECT t.vehicle_id, t.arrival, t.ts, t.seq, c.code, list_contains(t.dtc_codes, c.code) AS has FROM telemetry t JOIN (SELECT DISTINCT vehicle_id, unnest(dtc_codes) AS code FROM telemetry) c USING (vehicle_id)), w AS (SELECT a.vehicle_id, a.arrival, a.seq, a.code, (SELECT count(*) FROM g b WHERE b.vehicle_id = a.vehicle_id AND b.code = a.code AND b.has AND b.ts BETWEEN a.ts - 1000000 AND a.ts) AS n FROM g a)"


@query(prelude("telemetry") + f""", {_CODE_ROWS}, sev AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {1 if s == 'critical' else 2})" for c, s, _ in catalog.DTCS if s != 'info')}) AS v(code, need)),
l AS (SELECT w.*, CASE WHEN n >= need THEN 1 WHEN n = 0 THEN 0 END AS b FROM w JOIN sev USING (code)), h AS (SELECT *, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY vehicle_id, code ORDER BY arrival ROWS UNBOUNDED PRECEDING), 0) AS s FROM l),
e AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY vehicle_id, code ORDER BY arrival), 0) AS was FROM h), o AS (SELECT *, last_value(CASE WHEN s = 1 AND was = 0 THEN seq END IGNORE NULLS) OVER (PARTITION BY vehicle_id, code ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS os FROM e)
SELECT vehicle_id, arrival, code, CASE s WHEN 1 THEN 'open' ELSE 'cleared' END AS status, os AS opened_seq FROM o WHERE s <> was""")
def dtc_window(b: Bound) -> DataFrame:
    found = windows.dtc_transitions(b.telemetry, catalog.dtcs(b.spark), "vehicle_id", "ts", "arrival", "seq", window_s=1000000, repeats=2)
    return found.select("vehicle_id", "arrival", "code", "status", "opened_seq")


@query(prelude("telemetry") + f", n AS (SELECT vehicle_id, arrival, ts, row_number() OVER ({_ORDERED}) AS rn FROM telemetry), f AS (SELECT vehicle_id, rn, arrival, ts, ts AS kept, true AS k FROM n WHERE rn = 1 UNION ALL SELECT n.vehicle_id, n.rn, n.arrival, n.ts, CASE WHEN n.ts - f.kept >= 100000 THEN n.ts ELSE f.kept END, n.ts - f.kept >= 100000 FROM f JOIN n ON n.vehicle_id = f.vehicle_id AND n.rn = f.rn + 1) SELECT vehicle_id, arrival, round(ts, 6) + 0.0 AS ts FROM f WHERE k")
def throttled_snapshots(b: Bound) -> DataFrame:
    return windows.throttled(b.telemetry, "vehicle_id", "arrival", "ts", 100000.0)


@query("WITH i AS (SELECT o_custkey AS k, o_orderkey AS id, epoch_us(o_orderdate) / 1000000.0::DOUBLE AS lo, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE epoch_us(o_orderdate) / 1000000.0::DOUBLE + (o_orderkey % 90) * 86400 END AS hi FROM orders) SELECT b.k, b.id FROM i b WHERE EXISTS (SELECT 1 FROM i a WHERE a.k = b.k AND (a.lo < b.lo OR (a.lo = b.lo AND a.id < b.id)) AND coalesce(a.hi, 1e30) > b.lo)")
def overlap_audit(b: Bound) -> DataFrame:
    lo = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ)) / 1000000.0D")
    rows = b.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), lo.alias("lo")).withColumn("hi", F.when(F.col("id") % 50 != 0, F.col("lo") + (F.col("id") % 90) * 86400.0))
    return windows.overlapping(rows, "k", "lo", "hi", "id").select("k", "id")


@query(prelude("work_orders") + f" SELECT vehicle_id, failure_mode, CAST(count(*) AS BIGINT) AS n FROM work_orders WHERE status IN {_ACTIVE} GROUP BY ALL HAVING count(*) > 1")
def duplicate_active(b: Bound) -> DataFrame:
    return windows.more_than_one(b.work_orders, ["vehicle_id", "failure_mode"], F.col("status").isin("proposed", "scheduled", "in_progress"))


# Audits

_VIN = "CASE WHEN c_custkey % 11 = 0 THEN 'IOQ' || lpad(CAST(c_custkey AS {s}), 14, '0') ELSE 'PG1CT1A5' || CAST(c_custkey % 10 AS {s}) || substr('ABCDEFGHJK', CAST(c_custkey % 10 + 1 AS INT), 1) || 'P' || lpad(CAST(c_custkey AS {s}), 6, '0') END"


@query(f"""WITH v AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'ORION' WHEN 1 THEN 'VEGA' ELSE 'LYRA' END AS oem, {_VIN.format(s='VARCHAR')} AS vin, 2010 + (c_custkey * 3) % 10 AS y FROM customer),
c AS (SELECT *, regexp_full_match(vin, '[A-HJ-NPR-Z0-9]{{17}}') AS shaped, list_sum(list_transform(range(1, 18), lambda i: CAST(translate(substr(vin, i, 1), 'ABCDEFGHJKLMNPRSTUVWXYZIOQ', '12345678123457923456789000') AS INT) * [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2][i])) % 11 AS r FROM v)
SELECT oem, CASE WHEN NOT shaped THEN 'bad_shape' WHEN oem <> 'LYRA' AND substr(vin, 9, 1) <> CASE WHEN r = 10 THEN 'X' ELSE CAST(r AS VARCHAR) END THEN 'bad_check_digit' WHEN strpos('ABCDEFGHJKLMNPRSTVWXY123456789', substr(vin, 10, 1)) + 2009 <> y THEN 'bad_year' ELSE 'ok' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL""")  # fmt: skip
def vin_audit(b: Bound) -> DataFrame:
    v = b.table("customer").select(F.expr("CASE c_custkey % 3 WHEN 0 THEN 'ORION' WHEN 1 THEN 'VEGA' ELSE 'LYRA' END").alias("oem"), F.expr(_VIN.format(s="STRING")).alias("vin"), (F.lit(2010) + (F.col("c_custkey") * 3) % 10).alias("model_year"))
    return quality.vin_audit(v, catalog.oems(b.spark))


@query(prelude("telemetry") + """, t AS (SELECT vehicle_id, CASE WHEN len(dtc_codes) > 0 THEN 'codes: ' || lower(dtc_codes[1]) || ',' || dtc_codes[1] || '; U0100 x' || CAST(k AS VARCHAR) ELSE NULL END AS txt FROM telemetry), x AS (SELECT vehicle_id, unnest(list_distinct(list_transform(regexp_extract_all(upper(txt), '(?:^|[^0-9A-Z])([PCBU][0-3][0-9A-F]{3})', 1), lambda c: upper(c)))) AS code FROM t),
c AS (SELECT code, count(*) AS occurrences, count(DISTINCT vehicle_id) AS vehicles FROM x GROUP BY code)
SELECT c.code, CAST(occurrences AS BIGINT) AS occurrences, CAST(vehicles AS BIGINT) AS vehicles, CASE substr(c.code, 1, 1) WHEN 'P' THEN 'powertrain' WHEN 'C' THEN 'chassis' WHEN 'B' THEN 'body' ELSE 'network' END AS system, substr(c.code, 2, 1) IN ('0', '2') AS generic, s.severity, s.failure_mode
FROM c LEFT JOIN (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', '{s}', {repr(m) if m else 'NULL'})" for c, s, m in catalog.DTCS) + """) AS v(code, severity, failure_mode)) s USING (code)""")  # fmt: skip
def dtc_census(b: Bound) -> DataFrame:
    text = F.when(F.size("dtc_codes") > 0, F.concat(F.lit("codes: "), F.lower(F.col("dtc_codes")[0]), F.lit(","), F.col("dtc_codes")[0], F.lit("; U0100 x"), F.col("k").cast("string")))
    return quality.dtc_census(b.telemetry.withColumn("txt", text), "txt", "vehicle_id", catalog.dtcs(b.spark))


@query(prelude("telemetry") + """, h AS (SELECT tenant_id, vehicle_id, CAST(floor((longitude + 180) / 45) AS INT) AS x, CAST(floor((latitude + 90) / 45) AS INT) AS y FROM telemetry WHERE longitude < 180 AND latitude < 90),
c AS (SELECT tenant_id, vehicle_id, x, y, ((x // 4) % 2) * 16 + ((y // 2) % 2) * 8 + ((x // 2) % 2) * 4 + (y % 2) * 2 + x % 2 AS i FROM h)
SELECT tenant_id, substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(i + 1 AS INT), 1) AS cell, CAST(count(DISTINCT vehicle_id) AS BIGINT) AS vehicles, min(y) * 45 - 67.5::DOUBLE AS latitude, min(x) * 45 - 157.5::DOUBLE AS longitude FROM c GROUP BY tenant_id, i""")
def geo_density(b: Bound) -> DataFrame:
    return rollup.density(b.telemetry, 1)


@query(prelude("telemetry") + " SELECT arrival, vehicle_id, CASE WHEN vehicle_id % 7 = 3 THEN NULL ELSE latitude END AS latitude, CASE WHEN vehicle_id % 7 = 3 THEN NULL ELSE longitude END AS longitude FROM telemetry")
def erase_locations(b: Bound) -> DataFrame:
    subjects = b.telemetry.filter("vehicle_id % 7 = 3").select("vehicle_id")
    return quality.erased(b.telemetry.select("arrival", "vehicle_id", "latitude", "longitude"), subjects, "vehicle_id").select("arrival", "vehicle_id", "latitude", "longitude")


@query(prelude("alerts") + """, rows AS (SELECT alert_id, status, CASE WHEN status = 'resolved' AND alert_id % 7 <> 0 THEN ts END AS ra FROM alerts) SELECT alert_id, 'resolved_has_time' AS rule FROM rows WHERE status = 'resolved' AND ra IS NULL""")
def constraint_audit(b: Bound) -> DataFrame:
    rows = b.alerts.withColumn("resolved_at", F.when((F.col("status") == "resolved") & (F.col("alert_id") % 7 != 0), F.col("ts")))
    return quality.violations(rows, "alert_id", {"resolved_has_time": quality.ALERT_RULES["resolved_has_time"]()})


@query(prelude("alerts") + f""", {_TRANSITIONS}, n AS (SELECT fingerprint, min(ts) FILTER (status = 'open') AS o, max(ts) FILTER (status = 'cleared') AS c FROM tr GROUP BY 1), cur AS (SELECT fingerprint, status, ts AS d, CASE WHEN status = 'resolved' THEN ts END AS r FROM alerts WHERE alert_id % 2 = 0)
SELECT fingerprint, CASE WHEN n.c IS NOT NULL AND coalesce(cur.status, CASE WHEN n.o IS NOT NULL THEN 'open' END) IN ('open', 'acknowledged') THEN 'resolved' ELSE coalesce(cur.status, 'open') END AS status, coalesce(cur.d, n.o) AS detected_at,
  CASE WHEN n.c IS NOT NULL AND coalesce(cur.status, CASE WHEN n.o IS NOT NULL THEN 'open' END) IN ('open', 'acknowledged') THEN coalesce(cur.r, greatest(n.c, coalesce(cur.d, n.o))) ELSE cur.r END AS resolved_at
FROM cur FULL JOIN n USING (fingerprint) WHERE cur.status IS NOT NULL OR n.o IS NOT NULL""")  # fmt: skip
def current_alerts(b: Bound) -> DataFrame:
    a = b.alerts
    cur = a.filter("alert_id % 2 = 0").select("fingerprint", "status", F.col("ts").alias("detected_at"), F.when(F.col("status") == "resolved", F.col("ts")).alias("resolved_at"))
    moves = a.select("fingerprint", F.lit("open").alias("status"), F.col("ts").alias("detected_at")).unionByName(a.filter("alert_id % 3 = 0").select((F.col("fingerprint").cast("bigint") + 5).cast("string").alias("fingerprint"), F.lit("cleared").alias("status"), F.col("ts").alias("detected_at")))
    return sinks.current_alerts(cur, moves)


# Normaliser: telemetry written as raw payloads of each format, some of them broken, and read back

_STEM = {"ORION": "PG1CT1A5", "VEGA": "PG2TR4D2", "LYRA": "PG3EV7V4"}


def _raw(b: Bound, oem: str, body: Callable[[DataFrame], Column]) -> tuple[DataFrame, DataFrame]:
    """Raw messages of all telemetry, and the registry of its vehicles; vehicles of a multiple of 13 are not registered."""
    tail = F.concat(F.lit("T"), F.lpad(F.col("vehicle_id").cast("string"), 7, "0"))
    digit = vehicle.vin_check_digit(F.concat(F.lit(f"{_STEM[oem]}0"), tail))
    rows = b.telemetry.withColumn("vin", F.concat(F.lit(_STEM[oem]), digit, tail)).withColumn("iso", F.date_format(F.timestamp_micros((F.col("ts") * 1000000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    registry = rows.filter("vehicle_id % 13 <> 0").select("vin", F.col("vehicle_id").cast("string").alias("vehicle_id"), F.col("tenant_id").cast("string").alias("tenant_id"), F.lit(oem).alias("registered_oem")).distinct()
    value = F.when(F.col("k") == 50, "{broken").otherwise(F.to_json(body(rows), {"ignoreNullFields": "true"}))
    return rows.select("arrival", value.alias("value"), F.lit(oem).alias("oem"), F.lit(None).cast("string").alias("schema")), registry


def _expected(speed: str, odometer: str, fl: str, rr: str, pack: str, cell: str) -> str:
    return prelude("telemetry") + f""", j AS (SELECT *, CASE WHEN k = 50 THEN 'malformed_json' WHEN k = 51 THEN 'invalid_type' WHEN k = 52 THEN 'missing_required_field' WHEN k = 53 THEN 'out_of_range' WHEN vehicle_id % 13 = 0 THEN 'unknown_vehicle' END AS reason FROM telemetry),
v AS (SELECT *, max(CASE WHEN reason IS NULL THEN seq END) OVER (PARTITION BY vehicle_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h, row_number() OVER (PARTITION BY vehicle_id, seq, reason IS NULL ORDER BY arrival) AS rn FROM j),
o AS (SELECT *, CASE WHEN reason IS NOT NULL THEN NULL WHEN h IS NULL OR seq > h THEN 'NEW' WHEN h - seq >= 3 THEN 'TOO_OLD' WHEN rn > 1 THEN 'DUPLICATE' ELSE 'NEW_LATE' END AS verdict FROM v),
f AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'dlq' WHEN verdict = 'DUPLICATE' THEN 'duplicate' ELSE 'canonical' END AS outcome FROM o)
SELECT arrival, outcome, reason, coalesce(verdict IN ('NEW_LATE', 'TOO_OLD'), false) AS late, CASE WHEN outcome = 'canonical' THEN CAST(seq AS DOUBLE) END AS seq, CASE WHEN outcome = 'canonical' THEN round({speed}, 6) + 0.0 END AS speed_kmh, CASE WHEN outcome = 'canonical' THEN round({odometer}, 6) + 0.0 END AS odometer_km,
  CASE WHEN outcome = 'canonical' THEN round({fl}, 6) + 0.0 END AS tyre_fl_kpa, CASE WHEN outcome = 'canonical' THEN round({rr}, 6) + 0.0 END AS tyre_rr_kpa, CASE WHEN outcome = 'canonical' THEN round({pack}, 6) + 0.0 END AS hv_pack_temp_c,
  CASE WHEN outcome = 'canonical' THEN CAST({cell} AS DOUBLE) END AS hv_cell_delta_mv, CASE WHEN outcome = 'canonical' THEN round(latitude, 6) + 0.0 END AS latitude, CASE WHEN outcome = 'canonical' THEN array_to_string(dtc_codes, ',') END AS codes FROM f"""


def _marked(number: str, plain: Column) -> list[Column]:
    """A field that is text in one broken case and a number else: the two never occur together in a row."""
    return [F.when(F.col("k") != 51, plain).alias(number), F.when(F.col("k") == 51, F.lit("fast")).alias(f"{number}_text")]


def _text_in_place(value: Column, field: str) -> Column:
    return F.regexp_replace(value, f'"{field}_text":', f'"{field}":')


@query(_expected("speed_kmh", "odometer_km", "tyre_fl_kpa", "tyre_rr_kpa", "hv_pack_temp_c", "round_even(hv_cell_delta_mv, 0)"))
def normalise_flat(b: Bound) -> DataFrame:
    def body(rows: DataFrame) -> Column:
        tyres = F.array("tyre_fl_kpa", "tyre_fr_kpa", "tyre_rl_kpa", "tyre_rr_kpa")
        return F.struct("vin", F.col("iso").alias("ts"), F.when(F.col("k") != 52, F.col("seq")).alias("seq"), F.when(F.col("k") == 53, 999.0).otherwise(F.col("latitude")).alias("lat"), F.col("longitude").alias("lon"), *_marked("speed_kmh", F.col("speed_kmh")), F.col("odometer_km").alias("odo_km"), tyres.alias("tpms_kpa"), F.col("hv_pack_temp_c").alias("pack_temp_c"), F.col("hv_cell_delta_mv").alias("cell_delta_mv"), F.col("dtc_codes").alias("dtc"))

    return _with_text(b, "ORION", body, "speed_kmh")


_REASONS = {1: "invalid_timestamp", 2: "unknown_oem", 3: "unknown_schema_version", 4: "invalid_vin", 5: "invalid_event_type", 6: "future_timestamp", 7: "stale_event", 8: "unsupported_unit", 9: "missing_required_field", 10: "out_of_range", 11: "invalid_type", 12: "malformed_json"}


@query(prelude("telemetry") + f" SELECT arrival, CASE {' '.join(f'WHEN k = {k} THEN {r!r}' for k, r in _REASONS.items())} WHEN vehicle_id % 13 = 0 THEN 'unknown_vehicle' WHEN vehicle_id % 13 = 5 THEN 'oem_mismatch' END AS reason FROM telemetry")
def reject_reasons(b: Bound) -> DataFrame:
    """Messages with every fault that has a reason, at the default limits of age; each is received a minute after its own time."""
    tail = F.concat(F.lit("T"), F.lpad(F.col("vehicle_id").cast("string"), 7, "0"))
    vin = F.concat(F.lit(_STEM["ORION"]), vehicle.vin_check_digit(F.concat(F.lit(f"{_STEM['ORION']}0"), tail)), tail)
    rows = b.telemetry.select("arrival", "vehicle_id", "tenant_id", "k", "seq", "ts", "speed_kmh", "longitude", "latitude", vin.alias("vin"))
    is_ = {reason: F.col("k") == k for k, reason in _REASONS.items()}
    at = F.col("ts") + F.when(is_["future_timestamp"], 86_400).when(is_["stale_event"], -10 * DAY).otherwise(0)
    iso = F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    flat = F.struct(
        F.when(is_["invalid_vin"], F.concat(F.lit("IOQ"), F.substring("vin", 4, 14))).otherwise(F.col("vin")).alias("vin"), F.when(is_["invalid_timestamp"], F.substring(iso, 1, 19)).otherwise(iso).alias("ts"), F.when(~is_["missing_required_field"], F.col("seq")).alias("seq"),
        F.when(is_["invalid_event_type"], "DANCE").alias("evt"), F.when(is_["out_of_range"], 999.0).otherwise(F.col("latitude")).alias("lat"), F.col("longitude").alias("lon"), "speed_kmh",
    )
    unit = F.struct(F.lit("vehicle.speed").alias("name"), F.lit(3.5).alias("value"), F.lit("furlong/h").alias("unit"))
    listed = F.struct("vin", F.col("seq").alias("counter"), (at * 1000).cast("bigint").alias("timestampMs"), F.array(unit).alias("signals"))
    text = F.when(is_["malformed_json"], "{broken").when(is_["unsupported_unit"], F.to_json(listed)).when(is_["invalid_type"], F.regexp_replace(F.to_json(flat), '"lat":[^,]*', '"lat":"north"')).otherwise(F.to_json(flat))
    raw = rows.select(
        "arrival", text.alias("value"), F.when(is_["unsupported_unit"], "LYRA").when(is_["unknown_oem"], "NOVA").otherwise("ORION").alias("oem"), F.when(is_["unknown_schema_version"], "orion.v9").alias("schema"), F.timestamp_seconds(F.col("ts") + 60).alias("received"),
    )
    owner = F.when(F.col("vehicle_id") % 13 == 5, "VEGA").otherwise("ORION")
    registry = rows.filter("vehicle_id % 13 <> 0").select("vin", F.col("vehicle_id").cast("string").alias("vehicle_id"), F.col("tenant_id").cast("string").alias("tenant_id"), owner.alias("registered_oem")).distinct()
    return normalise.normalise(raw, registry, F.col("received"), order="arrival").select("arrival", "reason")


def _with_text(b: Bound, oem: str, body: Callable[[DataFrame], Column], field: str) -> DataFrame:
    raw, registry = _raw(b, oem, body)
    raw = raw.withColumn("value", _text_in_place(F.col("value"), field))
    rows = normalise.normalise(raw, registry, F.timestamp_seconds(F.lit(1706745600)), order="arrival", width=3, max_age_s=1e9)
    ok = F.col("outcome") == "canonical"
    values = [F.when(ok, F.col(c)).cast("double").alias(c) for c in ("seq", "speed_kmh", "odometer_km", "tyre_fl_kpa", "tyre_rr_kpa", "hv_pack_temp_c", "hv_cell_delta_mv", "latitude")]
    return rows.select("arrival", "outcome", "reason", "late", *values, F.when(ok, F.array_join("dtc_codes", ",")).alias("codes"))


@query(_expected("round_even(speed_kmh / 0.621371, 2)", "round_even(odometer_km / 0.621371, 2)", "round_even(tyre_fl_kpa / 7 / 0.145038, 2)", "round_even(tyre_rr_kpa / 7 / 0.145038, 2)", "round_even((hv_pack_temp_c + 33.7 - 32) / 1.8, 2)", "round_even(hv_cell_delta_mv, 0)"))
def normalise_nested(b: Bound) -> DataFrame:
    def body(rows: DataFrame) -> Column:
        header = F.struct(F.col("vin").alias("vehicleIdentifier"), F.col("iso").alias("timestamp"), F.when(F.col("k") != 52, F.col("seq")).alias("sequence"))
        location = F.struct(F.when(F.col("k") == 53, 999.0).otherwise(F.col("latitude")).alias("latitude"), "longitude")
        motion = F.struct(*_marked("speedMph", F.col("speed_kmh")), F.col("odometer_km").alias("odometerMiles"))
        tires = F.struct((F.col("tyre_fl_kpa") / 7).alias("frontLeftPsi"), (F.col("tyre_rr_kpa") / 7).alias("rearRightPsi"))
        hybrid = F.struct((F.col("hv_pack_temp_c") + 33.7).alias("packTempF"), F.col("hv_cell_delta_mv").alias("cellDeltaMv"))
        return F.struct(header.alias("header"), location.alias("location"), motion.alias("motion"), tires.alias("tires"), hybrid.alias("hybrid"), F.struct(F.lower(F.array_join("dtc_codes", ";")).alias("activeCodes")).alias("diagnostics"))

    return _with_text(b, "VEGA", body, "speedMph")


@query(_expected("round_even(speed_kmh / 5 * 3.6, 2)", "round_even(odometer_km * 0.001, 2)", "round_even(tyre_fl_kpa / 130 * 100, 2)", "tyre_rr_kpa", "hv_pack_temp_c", "round_even(hv_cell_delta_mv, 0)"))
def normalise_list(b: Bound) -> DataFrame:
    def body(rows: DataFrame) -> Column:
        item = lambda name, value, unit: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(unit).alias("unit"), F.lit(None).cast("string").alias("value_text"))
        speed = F.struct(F.lit("vehicle.speed").alias("name"), F.when(F.col("k") != 51, F.col("speed_kmh") / 5).alias("value"), F.lit("m/s").alias("unit"), F.when(F.col("k") == 51, F.lit("fast")).alias("value_text"))
        signals = F.array(
            item("position.lat", F.lit(0.5), "deg"), item("position.lat", F.when(F.col("k") == 53, 999.0).otherwise(F.col("latitude")), "deg"), item("position.lon", F.col("longitude"), "deg"), speed, item("vehicle.odometer", F.col("odometer_km"), "m"), item("tyre.fl.pressure", F.col("tyre_fl_kpa") / 130, "bar"),
            item("tyre.rr.pressure", F.col("tyre_rr_kpa"), "kPa"), item("hv.packTemp", F.col("hv_pack_temp_c"), "degC"), item("hv.cellDelta", F.col("hv_cell_delta_mv"), "mV"), item("something.else", F.lit(1.0), "?"),
        )
        return F.struct("vin", F.when(F.col("k") != 52, F.col("seq")).alias("counter"), (F.col("ts") * 1000).cast("bigint").alias("timestampMs"), signals.alias("signals"), F.transform("dtc_codes", lambda c: F.struct(c.alias("code"))).alias("faults"))

    return _with_text(b, "LYRA", body, "value")


@query(prelude("telemetry") + """, j AS (SELECT CASE WHEN k = 50 THEN 'malformed_json' WHEN k = 51 THEN 'invalid_type' WHEN k = 52 THEN 'missing_required_field' WHEN k = 53 THEN 'out_of_range' WHEN vehicle_id % 13 = 0 THEN 'unknown_vehicle' END AS reason FROM telemetry) SELECT reason, CAST(count(*) AS BIGINT) AS n FROM j WHERE reason IS NOT NULL GROUP BY 1""")
def reject_reason(b: Bound) -> DataFrame:
    return normalise_flat(b).filter("outcome = 'dlq'").groupBy("reason").agg(F.count("*").alias("n"))


# Further reads, sinks and audits


@query(prelude("alerts", "failures") + f""", {_PER_RULE}, fit AS (SELECT rule_code, CASE rule_code WHEN 'COOLANT_DRIFT' THEN 0.4 WHEN 'LV_BATTERY_WEAK' THEN 0.5 ELSE 0.38 END::DOUBLE AS p FROM per),
ci AS (SELECT *, round(greatest(0, (followed / eligible + 1.96 * 1.96 / (2 * eligible) - 1.96 * sqrt(followed / eligible * (1 - followed / eligible) / eligible + 1.96 * 1.96 / (4 * eligible * eligible))) / (1 + 1.96 * 1.96 / eligible)), 3) AS lo,
  round(least(1, (followed / eligible + 1.96 * 1.96 / (2 * eligible) + 1.96 * sqrt(followed / eligible * (1 - followed / eligible) / eligible + 1.96 * 1.96 / (4 * eligible * eligible))) / (1 + 1.96 * 1.96 / eligible)), 3) AS hi FROM per)
SELECT CAST(sum(eligible) AS BIGINT) AS alerts, round(sum(followed * power(1 - fit.p, 2) + (eligible - followed) * power(fit.p, 2)) / sum(eligible), 6) + 0.0 AS brier, round(sum(followed) / sum(eligible) * (1 - sum(followed) / sum(eligible)), 6) + 0.0 AS no_skill,
  CAST(count(*) FILTER (fit.p BETWEEN lo AND hi) AS BIGINT) AS inside, CAST(count(*) AS BIGINT) AS rules FROM ci JOIN fit USING (rule_code)""")  # fmt: skip
def holdout_brier(b: Bound) -> DataFrame:
    held = evaluate.rule_calibration(evaluate.outcomes(b.alerts, b.failures, 31557600.0))
    p = F.when(F.col("rule_code") == "COOLANT_DRIFT", 0.4).when(F.col("rule_code") == "LV_BATTERY_WEAK", 0.5).otherwise(0.38)
    return evaluate.holdout_brier(held.select("rule_code", p.alias("p")), held)


@query("SELECT round(coalesce(avg(CASE WHEN l_linenumber > 3 THEN CAST(l_returnflag = 'R' AS INT) END), 0), 6) + 0.0 AS no_alert_rate FROM lineitem")
def no_alert_rate(b: Bound) -> DataFrame:
    rows = b.table("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.when(F.col("l_linenumber") > 3, 0).otherwise(1).alias("rules_open"))
    return evaluate.no_alert_rate(rows)


@query("SELECT s AS vehicle_id, x AS best FROM (SELECT l_suppkey AS s, max(l_extendedprice) AS x FROM lineitem GROUP BY 1) ORDER BY x DESC, s LIMIT 5")
def best_row_of_each(b: Bound) -> DataFrame:
    rows = b.table("lineitem").select(F.col("l_suppkey").alias("vehicle_id"), F.col("l_extendedprice").alias("best"))
    return evaluate.best_row_of_each(rows, "vehicle_id", "best", 5)


@query(prelude("telemetry", "vehicles") + ", c AS (SELECT * FROM vehicles WHERE vehicle_id % 4 <> 1) SELECT CAST(count(*) AS BIGINT) AS n FROM telemetry t WHERE len(dtc_codes) > 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.vehicle_id = t.vehicle_id)")
def unknown_vehicle_count(b: Bound) -> DataFrame:
    events = b.telemetry.select("vehicle_id", "ts", F.col("dtc_codes").alias("dtcs"))
    return radar.unknown_vehicles(events, b.vehicles.filter("vehicle_id % 4 <> 1"))


@query(prelude("alerts", "work_orders") + """, s AS (SELECT vehicle_id FROM alerts WHERE severity = 'critical' GROUP BY 1), a AS (SELECT vehicle_id, min(ts) AS ts FROM alerts GROUP BY 1), w AS (SELECT vehicle_id, min(scheduled_s) AS ts FROM work_orders GROUP BY 1)
SELECT vehicle_id, 'alert' AS kind, round((ts - 788918400) / 3600, 6) + 0.0 AS hours FROM a JOIN s USING (vehicle_id) UNION ALL SELECT vehicle_id, 'order', round((ts - 788918400) / 3600, 6) + 0.0 FROM w JOIN s USING (vehicle_id)""")
def timeline(b: Bound) -> DataFrame:
    subjects = b.alerts.filter("severity = 'critical'").select("vehicle_id").distinct()
    return serve.timeline(subjects, b.alerts, b.work_orders.withColumnRenamed("scheduled_s", "ts"), 788918400.0)


@query(prelude("telemetry") + " SELECT arrival, round(CASE WHEN tenant_id = 3 THEN latitude ELSE round(latitude, 0) END, 6) + 0.0 AS latitude, round(CASE WHEN tenant_id = 3 THEN longitude ELSE round(longitude, 0) END, 6) + 0.0 AS longitude, CASE WHEN tenant_id = 3 THEN 'exact' ELSE 'approximate' END AS precision FROM telemetry")
def masked_positions(b: Bound) -> DataFrame:
    return serve.masked_positions(b.telemetry, F.col("tenant_id") == 3, 0).select("arrival", "latitude", "longitude", "precision")


@query(prelude("telemetry") + ", l AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC) AS rn FROM telemetry) SELECT vehicle_id, arrival, round(ts, 6) + 0.0 AS ts FROM l WHERE rn = 1 AND ts >= 1706486400")
def latest_state(b: Bound) -> DataFrame:
    states = b.telemetry.withColumn("as_of", F.timestamp_micros((F.col("ts") * 1000000).cast("bigint")))
    return sinks.latest_state(states, F.timestamp_seconds(F.lit(1706572800)), 86400).select("vehicle_id", "arrival", "ts")


@query(prelude("work_orders") + " SELECT work_order_id FROM work_orders WHERE scheduled_for >= DATE '2001-06-01' - INTERVAL 400 DAY")
def retained_rows(b: Bound) -> DataFrame:
    return sinks.retained(b.work_orders, "rollup", F.lit("2001-06-01").cast("date"), "scheduled_for").select("work_order_id")


@query("SELECT k, coalesce(n.v, o.v) AS v, o.w FROM (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS w FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN -c_acctbal END AS v FROM customer WHERE c_custkey % 2 = 0) n USING (k)")
def dimension_upsert(b: Bound) -> DataFrame:
    c = b.table("customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("w"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 != 0, -F.col("c_acctbal")).alias("v"))
    return sinks.upsert(old, new, ["k"], ["v"])


@query(prelude("telemetry") + f", l AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, floor(ts / {DAY}) ORDER BY ts DESC, arrival DESC) AS rn FROM telemetry) SELECT vehicle_id, arrival FROM l WHERE rn = 1")
def last_of_each_day(b: Bound) -> DataFrame:
    return windows.last_of_each(b.telemetry, "vehicle_id", "ts", float(DAY), "arrival").select("vehicle_id", "arrival")


@query(prelude("telemetry") + """, g AS (SELECT vehicle_id, arrival, seq, 'COOLANT_OVERHEAT' AS rule_code, CASE WHEN coolant_temp_c > 112 THEN 1 WHEN coolant_temp_c < 105 THEN 0 END AS b FROM telemetry UNION ALL SELECT vehicle_id, arrival, seq, 'LV_BATTERY_WEAK', CASE WHEN lv_battery_v < 12.25 THEN 1 WHEN lv_battery_v > 12.45 THEN 0 END FROM telemetry
  UNION ALL SELECT vehicle_id, arrival, seq, 'HV_CELL_IMBALANCE', CASE WHEN hv_cell_delta_mv > 40 THEN 1 WHEN hv_cell_delta_mv < 25 THEN 0 END FROM telemetry WHERE hv_cell_delta_mv IS NOT NULL),
h AS (SELECT *, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY vehicle_id, rule_code ORDER BY arrival ROWS UNBOUNDED PRECEDING), 0) AS s FROM g), e AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY vehicle_id, rule_code ORDER BY arrival), 0) AS was FROM h),
o AS (SELECT *, last_value(CASE WHEN s = 1 AND was = 0 THEN seq END IGNORE NULLS) OVER (PARTITION BY vehicle_id, rule_code ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS os FROM e)
SELECT vehicle_id, arrival, rule_code, CASE s WHEN 1 THEN 'open' ELSE 'cleared' END AS status, os AS opened_seq FROM o WHERE s <> was""")  # fmt: skip
def rule_transitions(b: Bound) -> DataFrame:
    t = b.telemetry.select("vehicle_id", "arrival", "seq", F.col("coolant_temp_c").alias("COOLANT_OVERHEAT"), F.col("lv_battery_v").alias("LV_BATTERY_WEAK"), F.col("hv_cell_delta_mv").alias("HV_CELL_IMBALANCE"))
    found = windows.rule_transitions(t, catalog.rules(b.spark), "vehicle_id", "arrival", "seq", ["COOLANT_OVERHEAT", "LV_BATTERY_WEAK", "HV_CELL_IMBALANCE"])
    return found.select("vehicle_id", "arrival", "rule_code", "status", "opened_seq")


@query(prelude("vehicles", "work_orders") + " SELECT w.work_order_id FROM work_orders w LEFT JOIN (SELECT vehicle_id, CASE WHEN vehicle_id % 9 = 0 THEN -1 ELSE tenant_id END AS t FROM vehicles) v USING (vehicle_id) WHERE v.t IS NULL OR v.t <> w.tenant_id")
def foreign_tenant(b: Bound) -> DataFrame:
    parents = b.vehicles.select("vehicle_id", F.when(F.col("vehicle_id") % 9 == 0, -1).otherwise(F.col("tenant_id")).alias("tenant_id"))
    return quality.foreign_tenant(b.work_orders, parents, "vehicle_id").select("work_order_id")


@query(prelude("telemetry", "work_orders") + """, s AS (SELECT DISTINCT vehicle_id FROM telemetry WHERE vehicle_id % 7 = 3) SELECT s.vehicle_id, CAST((SELECT count(*) FROM telemetry t WHERE t.vehicle_id = s.vehicle_id) AS BIGINT) AS rows_masked, CAST((SELECT count(*) FROM work_orders w WHERE w.vehicle_id = s.vehicle_id) AS BIGINT) AS links_deleted, 'completed' AS status FROM s""")
def erasure_report(b: Bound) -> DataFrame:
    return quality.erasure_report(b.telemetry, b.work_orders, b.telemetry.filter("vehicle_id % 7 = 3").select("vehicle_id"), "vehicle_id")


@query(prelude("alerts", "work_orders") + f""", {_CANDIDATES}, f AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM work_orders w WHERE w.vehicle_id = c.vehicle_id AND w.failure_mode = c.failure_mode AND w.status IN {_ACTIVE})) SELECT vehicle_id, failure_mode, source_alert_id, round(value, 6) + 0.0 AS value FROM f""")
def new_proposals(b: Bound) -> DataFrame:
    planned = _candidates(b).withColumn("workshop_id", F.lit(1))
    return plan.new_proposals(planned, b.work_orders).select("vehicle_id", "failure_mode", "source_alert_id", "value")


@query(prelude("alerts", "vehicles") + " SELECT DISTINCT model_code FROM vehicles WHERE tenant_id = 4")
def tenant_models(b: Bound) -> DataFrame:
    return serve.tenant_scope(b.vehicles, 4).select("model_code").distinct()


@query(prelude("vehicles", "alerts") + """, pg AS (SELECT alert_id, vehicle_id, ts FROM alerts WHERE tenant_id = 7 ORDER BY ts DESC, alert_id DESC LIMIT 15) SELECT pg.alert_id, pg.vehicle_id, pg.ts, v.model_code FROM pg LEFT JOIN vehicles v USING (vehicle_id)""")
def named_page(b: Bound) -> DataFrame:
    page = serve.keyset_page(serve.tenant_scope(b.alerts, 7), ["ts", "alert_id"], 15).select("alert_id", "vehicle_id", "ts")
    return serve.named_page(page, [(b.vehicles.select("vehicle_id", "model_code"), "vehicle_id")])


@query(prelude("alerts") + " SELECT severity, CAST(count(*) FILTER (status = 'open') AS BIGINT) AS open, CAST(count(*) FILTER (status <> 'open') AS BIGINT) AS other FROM alerts GROUP BY 1")
def severity_counts(b: Bound) -> DataFrame:
    return serve.conditional_counts(b.alerts, {"open": F.col("status") == "open", "other": F.col("status") != "open"}, ["severity"])


_RULES = ", ".join("({}, {}, {}, '{}', {}::DOUBLE, {}::DOUBLE, {})".format(*[f"'{x}'" if x else "NULL" for x in (code, mode, severity)], side, opens, clears, catalog.PENALTY.get(severity, 0)) for code, mode, severity, side, opens, clears in catalog.RULES)
_CODES = ", ".join(f"('{c}', '{severity}', {repr(mode) if mode else 'NULL'}, {need}, {catalog.PENALTY[severity]})" for c, severity, mode, need in detect.CODES)
_DETECTED = prelude("telemetry") + f""", rules AS (SELECT * FROM (VALUES {_RULES}) AS v(rule_code, failure_mode, severity, side, opens, clears, cost)), codes AS (SELECT * FROM (VALUES {_CODES}) AS v(rule_code, severity, failure_mode, need, cost)),
o AS (SELECT vehicle_id, arrival, ts, seq, event_type, speed_kmh, coolant_temp_c, engine_rpm, lv_battery_v, trunc(hv_cell_delta_mv) AS cell, [tyre_fl_kpa, tyre_fr_kpa, tyre_rl_kpa, tyre_rr_kpa] AS p, dtc_codes, coalesce(ignition_on, false) AS is_on,
  coalesce(ts >= max(ts) OVER (PARTITION BY vehicle_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS timely, max(ts) OVER (PARTITION BY vehicle_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS latest FROM telemetry),
tm AS (SELECT * FROM o WHERE timely),
isl AS (SELECT *, sum(CASE WHEN is_on THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_id ORDER BY arrival) AS isl FROM tm), st AS (SELECT *, min(CASE WHEN is_on THEN ts END) OVER (PARTITION BY vehicle_id, isl) AS since FROM isl),
dn AS (SELECT vehicle_id, arrival, coolant_temp_c - (88 + 0.03 * speed_kmh) - 4 AS x, row_number() OVER (PARTITION BY vehicle_id ORDER BY arrival) AS rn FROM st WHERE is_on AND ts - since >= 900 AND coolant_temp_c IS NOT NULL),
dr AS (SELECT vehicle_id, arrival, rn, greatest(0, x)::DOUBLE AS s FROM dn WHERE rn = 1 UNION ALL SELECT n.vehicle_id, n.arrival, n.rn, greatest(0, r.s + n.x) FROM dr r JOIN dn n ON n.vehicle_id = r.vehicle_id AND n.rn = r.rn + 1),
md AS (SELECT *, [list_sort([p[2], p[3], p[4]])[2], list_sort([p[1], p[3], p[4]])[2], list_sort([p[1], p[2], p[4]])[2], list_sort([p[1], p[2], p[3]])[2]] AS md FROM tm WHERE p[4] IS NOT NULL),
ser AS (SELECT vehicle_id, arrival, 'rpm' AS track, 0.02::DOUBLE AS al, engine_rpm - (750 + 28 * speed_kmh) AS x FROM tm WHERE is_on AND engine_rpm <> 0 AND speed_kmh > 5
  UNION ALL SELECT vehicle_id, arrival, 'lv', 0.05, lv_battery_v FROM tm WHERE NOT is_on AND lv_battery_v IS NOT NULL UNION ALL SELECT vehicle_id, arrival, 'cell', 0.05, cell FROM tm WHERE cell IS NOT NULL
  UNION ALL SELECT vehicle_id, arrival, 'tyre' || w.i, 0.05, greatest(0, (md[w.i] - p[w.i]) / md[w.i]) FROM md, (VALUES (1), (2), (3), (4)) AS w(i)),
sn AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, track ORDER BY arrival) AS rn FROM ser),
ew AS (SELECT vehicle_id, arrival, track, rn, x::DOUBLE AS m, 0.0::DOUBLE AS v FROM sn WHERE rn = 1
  UNION ALL SELECT n.vehicle_id, n.arrival, n.track, n.rn, e.m + n.al * (n.x - e.m), (1 - n.al) * (e.v + n.al * (n.x - e.m) * (n.x - e.m)) FROM ew e JOIN sn n ON n.vehicle_id = e.vehicle_id AND n.track = e.track AND n.rn = e.rn + 1),
val AS (SELECT vehicle_id, arrival, 'COOLANT_OVERHEAT' AS rule_code, coolant_temp_c AS value FROM o WHERE coolant_temp_c IS NOT NULL UNION ALL SELECT vehicle_id, arrival, 'COOLANT_DRIFT', s FROM dr
  UNION ALL SELECT vehicle_id, arrival, 'VEHICLE_BREAKDOWN', CASE WHEN event_type = 'BREAKDOWN' THEN 1 ELSE 0 END FROM o WHERE event_type = 'BREAKDOWN' OR speed_kmh >= 1
  UNION ALL SELECT vehicle_id, arrival, 'MISFIRE_ROUGHNESS', sqrt(v) FROM ew WHERE track = 'rpm' AND rn >= 60
  UNION ALL SELECT vehicle_id, arrival, r.rule_code, m FROM ew JOIN (VALUES ('lv', 'LV_BATTERY_WEAK'), ('lv', 'LV_BATTERY_CRITICAL'), ('cell', 'HV_CELL_IMBALANCE'), ('cell', 'HV_CELL_CRITICAL')) AS r(track, rule_code) ON r.track = ew.track WHERE rn >= 30
  UNION ALL SELECT vehicle_id, arrival, r.rule_code, max(m) FROM ew, (VALUES ('TYRE_SLOW_LEAK'), ('TYRE_PRESSURE_CRITICAL')) AS r(rule_code) WHERE track LIKE 'tyre%' AND rn >= 30 GROUP BY ALL),
cd AS (SELECT DISTINCT vehicle_id, unnest(dtc_codes) AS code FROM o), cn AS (SELECT o.vehicle_id, o.arrival, 'DTC_' || cd.code AS rule_code, (SELECT count(*) FROM o b WHERE b.vehicle_id = o.vehicle_id AND b.arrival <= o.arrival AND list_contains(b.dtc_codes, cd.code) AND b.ts + 600 >= o.latest) AS n FROM o JOIN cd ON cd.vehicle_id = o.vehicle_id),
j AS (SELECT vehicle_id, arrival, v.rule_code, value, severity, failure_mode, cost, CASE WHEN side = '>' THEN value > opens ELSE value < opens END AS op, CASE WHEN side = '>' THEN value < clears ELSE value > clears END AS cl FROM val v JOIN rules USING (rule_code)
  UNION ALL SELECT vehicle_id, arrival, cn.rule_code, n, severity, failure_mode, cost, n >= need, n = 0 FROM cn JOIN codes USING (rule_code)),
h AS (SELECT *, coalesce(last_value(CASE WHEN op THEN 1 WHEN cl THEN 0 END IGNORE NULLS) OVER w, 0) AS l FROM j WINDOW w AS (PARTITION BY vehicle_id, rule_code ORDER BY arrival ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, coalesce(lag(l) OVER (PARTITION BY vehicle_id, rule_code ORDER BY arrival), 0) AS was FROM h), tr AS (SELECT e.*, o.ts, o.seq, last_value(CASE WHEN l = 1 AND was = 0 THEN o.seq END IGNORE NULLS) OVER (PARTITION BY e.vehicle_id, rule_code ORDER BY e.arrival ROWS UNBOUNDED PRECEDING) AS os FROM e JOIN o ON o.vehicle_id = e.vehicle_id AND o.arrival = e.arrival),
al AS (SELECT * FROM tr WHERE l <> was),
kn AS (SELECT vehicle_id, arrival, ts, seq, row_number() OVER (PARTITION BY vehicle_id ORDER BY arrival) AS rn FROM tm),
kp AS (SELECT vehicle_id, rn, arrival, ts, seq, ts AS kept, true AS k FROM kn WHERE rn = 1 UNION ALL SELECT n.vehicle_id, n.rn, n.arrival, n.ts, n.seq, CASE WHEN n.ts - f.kept >= 15 THEN n.ts ELSE f.kept END, n.ts - f.kept >= 15 FROM kp f JOIN kn n ON n.vehicle_id = f.vehicle_id AND n.rn = f.rn + 1),
op AS (SELECT k.vehicle_id, k.arrival, a.rule_code, arg_max(a.l, a.arrival) AS l, any_value(a.cost) AS cost FROM kp k JOIN al a ON a.vehicle_id = k.vehicle_id AND a.arrival <= k.arrival WHERE k.k GROUP BY ALL),
act AS (SELECT vehicle_id, arrival, string_agg(rule_code, ',' ORDER BY rule_code) AS active, sum(cost) AS cost, bool_or(rule_code = 'VEHICLE_BREAKDOWN') AS broken FROM op WHERE l = 1 GROUP BY ALL),
ind AS (SELECT vehicle_id, arrival, count(*) AS n, sum(value) AS s FROM val WHERE rule_code <> 'VEHICLE_BREAKDOWN' GROUP BY ALL)
SELECT 'alert' AS kind, CAST(vehicle_id AS VARCHAR) AS vehicle_id, round(ts, 6) + 0.0 AS ts, CAST(seq AS BIGINT) AS seq, rule_code, severity, failure_mode, CASE l WHEN 1 THEN 'open' ELSE 'cleared' END AS status, CAST(os AS BIGINT) AS opened_seq, round(value, 3) + 0.0 AS value, NULL AS active, NULL::BIGINT AS indicators FROM al
UNION ALL SELECT 'state', CAST(k.vehicle_id AS VARCHAR), round(k.ts, 6) + 0.0, CAST(k.seq AS BIGINT), NULL, NULL, NULL, NULL, NULL, greatest(100 - coalesce(a.cost, 0), 0)::DOUBLE, coalesce(a.active, ''), CAST(coalesce(i.n, 0) + 1 AS BIGINT)
FROM kp k LEFT JOIN act a ON a.vehicle_id = k.vehicle_id AND a.arrival = k.arrival LEFT JOIN ind i ON i.vehicle_id = k.vehicle_id AND i.arrival = k.arrival WHERE k.k"""


def _canonical_rows(b: Bound) -> DataFrame:
    return b.telemetry.withColumn("vehicle_id", F.col("vehicle_id").cast("string")).withColumn("hv_cell_delta_mv", F.col("hv_cell_delta_mv").cast("int"))


@query(_DETECTED)
def detector(b: Bound) -> DataFrame:
    """Alerts, and snapshots with health, active rules and the number of indicators."""
    columns = ["kind", "vehicle_id", "ts", "seq", "rule_code", "severity", "failure_mode", "status", "opened_seq", "value"]
    found = detect.detections(_canonical_rows(b))
    return found.select(*columns, F.array_join("active", ",").alias("active"), F.when(F.col("kind") == "state", F.size("indicators")).cast("bigint").alias("indicators"))


_SIGNALS = """, t AS (SELECT *, count(*) OVER (PARTITION BY window_start) AS nt, (base_k + 0.5) / (base_n + 1) AS p0 FROM tests WHERE base_n > 0), c AS (SELECT *, n * p0 AS lam FROM t WHERE k >= 2 AND k / n >= 1.2 * p0),
sig AS (SELECT window_start, dtc, level, model_code, firmware_version FROM (SELECT *, 1 - list_sum(list_transform(range(0, CAST(k AS BIGINT)), lambda i: exp(-lam + i * ln(lam) - lgamma(CAST(i + 1 AS DOUBLE))))) AS pv FROM c) WHERE least(1, pv * nt) < 0.2)"""


def _found_signals(b: Bound) -> DataFrame:
    return radar.signals(_tests(b), 604800.0, min_vehicles=2, min_ratio=1.2, alpha=0.2)


@query(prelude("telemetry", "vehicles") + f", {_COHORTS}, {_AFFECTED}, {_TESTS}{_SIGNALS} SELECT window_start, dtc, level, model_code, firmware_version FROM sig WHERE window_start + 604800 >= 1706745600 - 340 * 3600")
def recent_signals(b: Bound) -> DataFrame:
    return serve.recent_signals(_found_signals(b), 1706745600.0, 340.0, 100_000).select("window_start", "dtc", "level", "model_code", "firmware_version")


@query(prelude("telemetry", "vehicles") + f", {_COHORTS}, {_AFFECTED}, {_TESTS}{_SIGNALS} SELECT window_start, dtc, level, model_code, firmware_version FROM sig WHERE model_code IN (SELECT model_code FROM vehicles WHERE tenant_id = 4)")
def signals_of_tenant(b: Bound) -> DataFrame:
    own = serve.tenant_scope(b.vehicles, 4)
    return serve.signals_of_tenant(_found_signals(b), own).select("window_start", "dtc", "level", "model_code", "firmware_version")


@query()
def failure_model(b: Bound) -> DataFrame:
    """Boosted trees on window features, trained on some vehicles and scored on all with the data gate."""
    numeric = ["coolant_mean_long", "coolant_resid_long", "lv_min_long", "tyre_ratio_long", "cell_delta_long", "dtc_rate_long", "pack_temp_max_long"]
    features = rollup.window_features(_snapshots(b), rollup.minute_buckets(b.telemetry, width_s=DAY), 604800.0, 172800.0).join(b.vehicles.select("vehicle_id", "model_code"), "vehicle_id")
    rows = evaluate.split(features.withColumn("label", (F.col("coolant_max_long") > 115).cast("int")), 0.75).withColumn("is_validation", ~F.col("is_train"))
    model = evaluate.train_failure_model(rows, numeric, ["model_code"], rounds=5, depth=3)
    return evaluate.score_fleet(rows, model, numeric, min_events=10, min_minutes=5).select("vehicle_id", "t", "label", "sufficient", "probability")
