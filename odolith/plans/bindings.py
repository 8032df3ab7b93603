"""Stand-ins that read the test tables as telemetry, alerts, orders and dimensions. One text serves both SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolith.functions import catalog

SPARK = {
    "epoch": lambda c: f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ)) / 1000000.0D)", "k": "CAST(get_json_object(props, '$.k') AS INT)", "list": lambda x: f"array({x})", "none": "CAST(array() AS ARRAY<STRING>)",
    "string": lambda x: f"CAST({x} AS STRING)", "lpad": lambda x, n: f"lpad(CAST({x} AS STRING), {n}, '0')", "double": lambda x: f"CAST({x} AS DOUBLE)",
}
DUCK = {
    "epoch": lambda c: f"(epoch_us({c}) / 1000000.0::DOUBLE)", "k": "CAST(json_extract_string(props, '$.k') AS INT)", "list": lambda x: f"[{x}]", "none": "CAST([] AS VARCHAR[])",
    "string": lambda x: f"CAST({x} AS VARCHAR)", "lpad": lambda x, n: f"lpad(CAST({x} AS VARCHAR), {n}, '0')", "double": lambda x: f"CAST({x} AS DOUBLE)",
}
CODES = ", ".join(f"({i}, '{c[0]}')" for i, c in enumerate(catalog.DTCS))


def telemetry(d: dict) -> str:
    """Events as canonical rows: some numbers repeat or come late, ignition is unknown at times, tyres may be missing."""
    dbl = d["double"]
    return f"""
SELECT r.event_id AS arrival, r.user_id AS vehicle_id, r.user_id % 25 AS tenant_id, {d['epoch']('r.ts')} AS ts,
  CASE WHEN r.rn > (r.event_id * 7) % 5 THEN r.rn - (r.event_id * 7) % 5 ELSE 0 END AS seq,
  CASE r.event_type WHEN 'error' THEN 'BREAKDOWN' WHEN 'signup' THEN 'IGNITION_ON' WHEN 'purchase' THEN 'HARSH_BRAKE' ELSE 'PERIODIC' END AS event_type,
  {dbl('(r.event_id * 37) % 1200')} / 10 AS speed_kmh, CASE WHEN r.k % 10 = 9 THEN NULL ELSE r.k % 4 <> 0 END AS ignition_on,
  60 + r.value * 0.6 AS coolant_temp_c, CAST(700 + r.k * 30 AS INT) AS engine_rpm, 11.5 + r.value * 0.02 AS lv_battery_v, CASE WHEN r.k % 5 = 4 THEN NULL ELSE r.value END AS hv_cell_delta_mv,
  {dbl('25 + r.k % 40')} AS hv_pack_temp_c, {dbl('100 - r.user_id % 20')} AS hv_soh_pct, {dbl('r.rn * 12')} AS odometer_km,
  {dbl('240 - r.k % 50')} AS tyre_fl_kpa, {dbl('241 - r.k % 3')} AS tyre_fr_kpa, {dbl('239 + r.k % 4')} AS tyre_rl_kpa, CASE WHEN r.k % 11 = 0 THEN NULL ELSE {dbl('240 + r.k % 2')} END AS tyre_rr_kpa,
  {dbl('(r.event_id * 13) % 1800')} / 10 - 90 AS latitude, {dbl('(r.event_id * 29) % 3600')} / 10 - 180 AS longitude,
  CASE WHEN r.event_type IN ('error', 'click') THEN {d['list']('c.code')} ELSE {d['none']} END AS dtc_codes, r.value AS value, r.k AS k, {d['epoch']('r.ts')} + {dbl('r.k')} / 20 AS ingest_s
FROM (SELECT event_id, ts, user_id, event_type, value, {d['k']} AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) r
JOIN (SELECT * FROM (VALUES {CODES}) AS v(i, code)) c ON c.i = r.k % {len(catalog.DTCS)}"""


def vehicles(d: dict) -> str:
    """Customers as vehicles: model from the market segment, two firmwares, powertrain from the region."""
    return f"""
SELECT c.c_custkey AS vehicle_id, c.c_nationkey AS tenant_id, c.c_mktsegment AS model_code, CASE WHEN c.c_custkey % 3 = 0 THEN 'A' ELSE 'B' END AS firmware,
  CASE WHEN c.c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'ICE' ELSE 'BEV' END AS powertrain, 'OEM' AS oem, {d['double']('(c.c_custkey * 17) % 1400')} / 10 - 70 AS latitude, {d['double']('(c.c_custkey * 31) % 3400')} / 10 - 170 AS longitude
FROM customer c"""


def workshops(d: dict) -> str:
    return f"""
SELECT s_nationkey AS tenant_id, s_suppkey AS workshop_id, {d['double']('(s_suppkey * 37) % 1400')} / 10 - 70 AS latitude, {d['double']('(s_suppkey * 53) % 3400')} / 10 - 170 AS longitude, CAST(1 + s_suppkey % 3 AS INT) AS daily_capacity
FROM supplier"""


RULE_OF = "CASE o_orderkey % 5 WHEN 0 THEN 'COOLANT_DRIFT' WHEN 1 THEN 'LV_BATTERY_WEAK' WHEN 2 THEN 'TYRE_SLOW_LEAK' WHEN 3 THEN 'HV_CELL_IMBALANCE' ELSE 'MISFIRE_ROUGHNESS' END"
MODE_OF = "CASE o_orderkey % 5 WHEN 0 THEN 'COOLING_FAILURE' WHEN 1 THEN 'LV_BATTERY_FAILURE' WHEN 2 THEN 'TYRE_SLOW_LEAK' WHEN 3 THEN 'HV_BATTERY_THERMAL' ELSE 'IGNITION_MISFIRE' END"


def alerts(d: dict) -> str:
    """Orders as alerts."""
    return f"""
SELECT o_orderkey AS alert_id, {d['string']('o_orderkey')} AS fingerprint, o_custkey AS vehicle_id, c.c_nationkey AS tenant_id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'acknowledged' ELSE 'resolved' END AS status,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'critical' WHEN o_orderpriority = '3-MEDIUM' THEN 'warning' ELSE 'info' END AS severity, {RULE_OF} AS rule_code, {MODE_OF} AS failure_mode,
  {d['epoch']('o_orderdate')} + o_orderkey % 86400 AS ts, o_totalprice AS price
FROM orders JOIN customer c ON c.c_custkey = o_custkey"""


def work_orders(d: dict) -> str:
    """Line items as work orders."""
    return f"""
SELECT l.l_orderkey * 10 + l.l_linenumber AS work_order_id, o.o_custkey AS vehicle_id, c.c_nationkey AS tenant_id, l.l_suppkey AS workshop_id, {MODE_OF.replace('o_orderkey', 'o.o_orderkey')} AS failure_mode,
  CASE WHEN l.l_linestatus = 'O' THEN CASE l.l_returnflag WHEN 'N' THEN 'proposed' WHEN 'R' THEN 'scheduled' ELSE 'in_progress' END ELSE 'completed' END AS status, {d['epoch']('l.l_shipdate')} AS scheduled_s, CAST(l.l_shipdate AS DATE) AS scheduled_for, l.l_quantity AS quantity
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey"""


def failures(d: dict) -> str:
    """Returned line items as failures of the vehicle, with the onset some days before."""
    return f"""
SELECT DISTINCT o.o_custkey AS vehicle_id, {MODE_OF.replace('o_orderkey', 'o.o_orderkey')} AS failure_mode, {d['epoch']('l.l_shipdate')} AS failure_ts, {d['epoch']('l.l_shipdate')} - 86400 * (1 + l.l_linenumber) AS onset_ts
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'R'"""


VIEWS = {"telemetry": telemetry, "vehicles": vehicles, "workshops": workshops, "alerts": alerts, "work_orders": work_orders, "failures": failures}
TABLES = ("events", "customer", "supplier", "orders", "lineitem", "documents")


def prelude(*names: str) -> str:
    """WITH clause of the stand-ins for the other engine."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n](DUCK)})" for n in names)


class Bound:
    """The stand-ins over the tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        text = VIEWS[name](SPARK)
        used = [t for t in TABLES if f" {t} " in f"{text} ".replace("\n", " ") or f" {t})" in text]
        for t in used:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        return self.spark.sql(text, **{t: self.table(t) for t in used})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, without a negative zero, to compare with another engine."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])
