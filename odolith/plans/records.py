"""Registered queries of readers, typed records, dimensions, ids and feeds, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.functions import vehicle
from odolith.operators import evaluate, plan
from odolith.plans.bindings import Bound, prelude
from odolith.plans.registry import query
from odolith.sources import readers, sinks
from odolith.streaming import jobs


def _time(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))


@query(prelude("telemetry") + """
SELECT CAST(vehicle_id % 4 AS INTEGER) AS partition, arrival AS "offset", k = 50 AS broken, CASE WHEN k <> 50 THEN CAST(seq AS BIGINT) END AS seq, CASE WHEN k <> 50 THEN speed_kmh END AS speed_kmh,
  CASE WHEN k <> 50 THEN CASE WHEN k % 5 = 0 THEN 0 ELSE odometer_km END END::DOUBLE AS odometer_km, CASE WHEN k <> 50 THEN array_to_string(dtc_codes, ',') END AS codes FROM telemetry""")
def typed_messages(b: Bound) -> DataFrame:
    """Canonical messages read from their text: typed rows with defaults, and those that cannot be read."""
    body = F.to_json(F.struct(F.col("seq").cast("bigint").alias("seq"), "speed_kmh", F.when(F.col("k") % 5 != 0, F.col("odometer_km")).alias("odometer_km"), "dtc_codes"))
    text = b.telemetry.select(F.lit("canonical").alias("topic"), (F.col("vehicle_id") % 4).cast("int").alias("partition"), F.col("arrival").alias("offset"), F.when(F.col("k") == 50, F.lit("{broken")).otherwise(body).alias("value"))
    rows = readers.read_canonical(text)
    good = sinks.typed_events(rows).select("partition", "offset", F.lit(False).alias("broken"), "seq", "speed_kmh", "odometer_km", F.array_join("dtc_codes", ",").alias("codes"))
    return good.unionByName(sinks.ingestion_errors(rows).select("partition", "offset", F.lit(True).alias("broken")), allowMissingColumns=True)


@query(prelude("telemetry") + " SELECT 'raw/' || CAST(vehicle_id % 4 AS VARCHAR) || '/' || CAST(arrival AS VARCHAR) AS source, 'reason' || k AS reason, repeat('x', least(k * 40, 200)) AS detail, CAST(floor(ts * 1000) AS BIGINT) AS at_ms, '{' || k AS payload FROM telemetry WHERE k % 2 = 0")
def dead_letters(b: Bound) -> DataFrame:
    """Rejected rows as records with their place, and details cut to 200 letters."""
    rows = b.telemetry.select(
        F.when(F.col("k") % 2 == 0, "dlq").otherwise("canonical").alias("outcome"), F.lit("raw").alias("topic"), (F.col("vehicle_id") % 4).alias("partition"), F.col("arrival").alias("offset"), F.concat(F.lit("{"), F.col("k").cast("string")).alias("value"),
        F.concat(F.lit("reason"), F.col("k").cast("string")).alias("reason"), F.repeat(F.lit("x"), F.col("k") * 40).alias("detail"), _time(F.col("ts")).alias("ingest_ts"),
    )
    return sinks.dlq_records(rows).drop("event_date")


@query(prelude("alerts") + " SELECT vehicle_id, fingerprint, status, ts + 50 AS detected_s FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, vehicle_id, fingerprint, status) AS rn FROM alerts) WHERE rn = 1")
def final_alert_rows(b: Bound) -> DataFrame:
    """Each alert came twice; the later one stays."""
    a = b.alerts.select("tenant_id", "vehicle_id", "fingerprint", "status", F.col("ts").alias("detected_at"))
    return sinks.final_alerts(a.unionByName(a.withColumn("detected_at", F.col("detected_at") + 50))).select("vehicle_id", "fingerprint", "status", F.col("detected_at").alias("detected_s"))


@query(prelude("alerts") + """, s AS (SELECT vehicle_id, CASE WHEN alert_id % 5 <> 0 THEN (alert_id % 1000) / 1000 END AS probability, ts AS scored_at, alert_id, CASE WHEN alert_id % 3 <> 0 THEN ts + 86400 * (alert_id % 400) END AS expires_at FROM alerts)
SELECT vehicle_id, round(probability, 6) + 0.0 AS probability, model_version FROM (SELECT *, 'm' || alert_id AS model_version, row_number() OVER (PARTITION BY vehicle_id ORDER BY scored_at DESC, 'm' || alert_id DESC) AS rn FROM s WHERE probability IS NOT NULL AND (expires_at IS NULL OR expires_at > 880000000)) WHERE rn = 1""")
def live_scores(b: Bound) -> DataFrame:
    """The newest score in force of each vehicle."""
    scores = b.alerts.select(
        "vehicle_id", F.when(F.col("alert_id") % 5 != 0, (F.col("alert_id") % 1000) / 1000).alias("probability"), F.col("ts").alias("scored_at"), F.concat(F.lit("m"), F.col("alert_id").cast("string")).alias("model_version"),
        F.when(F.col("alert_id") % 3 != 0, F.col("ts") + 86400 * (F.col("alert_id") % 400)).alias("expires_at"),
    )
    return plan.live_scores(scores, F.lit(880_000_000.0)).select("vehicle_id", "probability", "model_version")


@query(prelude("alerts") + """ SELECT alert_id, round((980000000 - ts) / 3600, 6) + 0.0 AS age_hours, CASE WHEN alert_id % 4 = 0 THEN CAST(alert_id % 300 AS DOUBLE) / 2 END AS estimated_hours_to_critical FROM alerts WHERE status = 'open'""")
def planner_inputs(b: Bound) -> DataFrame:
    """Open alerts with their age, and the hours that their details name."""
    hours = F.concat(F.lit('{"estimated_hours_to_critical": '), F.when(F.col("alert_id") % 4 == 0, ((F.col("alert_id") % 300) / 2).cast("string")).otherwise("null"), F.lit("}"))
    rows = b.alerts.select("alert_id", "status", "failure_mode", _time(F.col("ts")).alias("event_ts"), F.when(F.col("alert_id") % 7 == 1, "no json").otherwise(hours).alias("details"))
    rows = rows.withColumn("details", F.when(F.col("alert_id") % 4 == 0, hours).otherwise(F.col("details")))
    return plan.planner_alerts(rows, F.timestamp_seconds(F.lit(980_000_000))).select("alert_id", "age_hours", "estimated_hours_to_critical")


@query(prelude("vehicles", "telemetry") + """, p AS (SELECT vehicle_id, arg_max(latitude, arrival) AS la, arg_max(longitude, arrival) AS lo FROM telemetry GROUP BY 1)
SELECT v.vehicle_id, round(CASE WHEN p.vehicle_id IS NOT NULL AND v.vehicle_id % 3 <> 0 THEN la WHEN v.vehicle_id % 5 <> 0 THEN v.latitude END, 6) + 0.0 AS latitude, round(CASE WHEN p.vehicle_id IS NOT NULL AND v.vehicle_id % 3 <> 0 THEN lo WHEN v.vehicle_id % 5 <> 0 THEN v.longitude END, 6) + 0.0 AS longitude FROM vehicles v LEFT JOIN p ON p.vehicle_id = v.vehicle_id""")
def located_vehicles(b: Bound) -> DataFrame:
    """Live positions where both coordinates are known, else those of the home workshop, if any."""
    live = b.telemetry.groupBy("vehicle_id").agg(F.max_by(F.struct("latitude", "longitude"), "arrival").alias("p")).select("vehicle_id", "p.latitude", F.when(F.col("vehicle_id") % 3 != 0, F.col("p.longitude")).alias("longitude"))
    homes = b.vehicles.filter("vehicle_id % 5 <> 0").select("vehicle_id", "latitude", "longitude")
    return plan.located(b.vehicles.select("vehicle_id"), live, homes)


@query(prelude("telemetry") + """, h AS (SELECT *, md5(CAST(vehicle_id AS VARCHAR) || ':' || CAST(seq AS VARCHAR)) AS h FROM telemetry)
SELECT arrival, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS event_id, strftime(make_timestamp(CAST(floor(ts * 1000) * 1000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at,
  round((1706745600 - ts) / 3600, 6) + 0.0 AS age_hours, round(ingest_s - ts, 4) + 0.0 AS detection_s, round(ingest_s - ts + 1, 4) + 0.0 AS receipt_s FROM h""")
def event_ids(b: Bound) -> DataFrame:
    """Ids, times as text, ages and the latency of a feed."""
    t = _time(F.col("ts"))
    rows = b.telemetry.select("arrival", vehicle.stable_id(F.col("vehicle_id"), F.col("seq")).alias("event_id"), t.alias("event_ts"), _time(F.col("ingest_s")).alias("detected_at"), _time(F.col("ingest_s") + 1).alias("received_at"))
    timed = jobs.feed_latency(rows)
    age = vehicle.age_hours(F.timestamp_seconds(F.lit(1_706_745_600)), F.col("event_ts"))
    return timed.select("arrival", "event_id", vehicle.iso_utc_ms(F.col("event_ts")).alias("at"), age.alias("age_hours"), F.round("detection_s", 4).alias("detection_s"), F.round("receipt_s", 4).alias("receipt_s"))


@query(prelude("telemetry") + """, c AS (SELECT arrival, [{'n': 'speed', 'v': speed_kmh - 60}, {'n': 'temperature', 'v': (k - 20.0)::DOUBLE}, {'n': 'voltage', 'v': (vehicle_id % 30)::DOUBLE}] AS parts FROM telemetry),
u AS (SELECT arrival, unnest(parts) AS p FROM c), r AS (SELECT arrival, p.n AS n, p.v AS v, row_number() OVER (PARTITION BY arrival ORDER BY abs(p.v) DESC, p.n) AS rn FROM u)
SELECT arrival, string_agg(n, ',' ORDER BY rn) AS names, round(max(v) FILTER (rn = 1), 3) + 0.0 AS first_value FROM r WHERE rn <= 2 GROUP BY arrival""")
def score_reasons(b: Bound) -> DataFrame:
    """The two strongest contributions of a score, kept as a map."""
    part = lambda name, v: F.struct(F.lit(name).alias("name"), v.cast("double").alias("value"))
    parts = F.array(part("speed", F.col("speed_kmh") - 60), part("temperature", F.col("k") - 20), part("voltage", F.col("vehicle_id") % 30))
    kept = sinks.score_history(b.telemetry.select("arrival", evaluate.top_contributions(parts, 2).alias("top")), "top")
    names = F.map_keys("top_features")
    return kept.select("arrival", F.array_join(names, ",").alias("names"), F.col("top_features")[names[0]].alias("first_value"))


_FLEET = "f AS (SELECT c_custkey AS vehicle_id, '  V' || c_custkey || ' ' AS vin, c_nationkey AS tenant_id, CASE WHEN c_custkey % 17 = 0 THEN 'retired' WHEN c_custkey % 2 = 0 THEN 'active' END AS status, c_mktsegment AS model_code, ' fw' || c_custkey % 3 AS fw FROM customer)"


def _fleet(b: Bound) -> tuple[DataFrame, DataFrame]:
    c = b.table("customer")
    fleet = c.select(
        F.col("c_custkey").alias("vehicle_id"), F.concat(F.lit("  V"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("vin"), F.col("c_nationkey").alias("tenant_id"), F.when(F.col("c_custkey") % 17 == 0, "retired").when(F.col("c_custkey") % 2 == 0, "active").alias("status"),
        F.col("c_mktsegment").alias("model_code"), F.concat(F.lit(" fw"), (F.col("c_custkey") % 3).cast("string")).alias("firmware_version"), F.lit("?").alias("oem"), F.lit("?").alias("powertrain"),
    )
    models = c.select(F.col("c_mktsegment").alias("model_code")).distinct().filter("model_code <> 'FURNITURE'")
    return fleet, models.select("model_code", F.lit("ORION").alias("oem"), F.when(F.col("model_code") == "BUILDING", "BEV").otherwise("ICE").alias("powertrain"))


@query(f"WITH {_FLEET} SELECT vehicle_id, trim(vin) AS vin, tenant_id FROM f WHERE status IS DISTINCT FROM 'retired'")
def vehicle_registry(b: Bound) -> DataFrame:
    return readers.registry(_fleet(b)[0]).select("vehicle_id", "vin", "tenant_id")


@query(f"WITH {_FLEET} SELECT vehicle_id, 'ORION' AS oem, model_code, trim(fw) AS firmware, CASE model_code WHEN 'BUILDING' THEN 'BEV' ELSE 'ICE' END AS powertrain, status IS DISTINCT FROM 'retired' AS scored FROM f WHERE model_code <> 'FURNITURE'")
def vehicle_cohorts(b: Bound) -> DataFrame:
    """Cohorts of all vehicles of known models, and which of them are scored."""
    fleet, models = _fleet(b)
    scored = readers.fleet_for_scoring(fleet, models).select("vehicle_id", F.lit(True).alias("scored"))
    return readers.cohorts(fleet, models).join(scored, "vehicle_id", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))


@query(prelude("alerts", "failures") + " SELECT run, vehicle_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT 0 AS run, vehicle_id FROM alerts UNION ALL SELECT 1, vehicle_id FROM failures) GROUP BY ALL")
def runs_together(b: Bound) -> DataFrame:
    """Runs with different columns as one table."""
    return readers.training_runs([b.alerts.select("vehicle_id", "price"), b.failures.select("vehicle_id", "onset_ts")]).groupBy("run", "vehicle_id").agg(F.count("*").alias("n"))
