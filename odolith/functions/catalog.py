"""Reference tables: manufacturers, models, failure modes, trouble codes, canonical fields and rules. All are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OEMS = (("ORION", "Orion Motors", "orion.v1", True), ("VEGA", "Vega Automotive", "vega.2.3", True), ("LYRA", "Lyra Electric", "lyra.v1", False))
OEM_SCHEMA = "oem string, name string, default_schema string, check_digit boolean"
MODELS = (
    ("ORION", "CT1A5", "ICE"), ("ORION", "HL2B7", "ICE"), ("ORION", "SD3H1", "HEV"), ("VEGA", "TR4D2", "ICE"), ("VEGA", "PK5C8", "ICE"),
    ("VEGA", "CV6H3", "HEV"), ("LYRA", "EV7V4", "BEV"), ("LYRA", "EC8S6", "BEV"), ("LYRA", "ET9T5", "BEV"),
)
FAILURE_MODES = {
    "COOLING_FAILURE": ("ICE", "HEV"), "IGNITION_MISFIRE": ("ICE", "HEV"), "LV_BATTERY_FAILURE": ("ICE", "HEV", "BEV"),
    "TYRE_SLOW_LEAK": ("ICE", "HEV", "BEV"), "HV_BATTERY_THERMAL": ("HEV", "BEV"),
}
# code, severity, failure mode
DTCS = (
    ("P0217", "critical", "COOLING_FAILURE"), ("P0118", "warning", "COOLING_FAILURE"), ("P0128", "warning", "COOLING_FAILURE"),
    ("P0300", "critical", "IGNITION_MISFIRE"), ("P0301", "warning", "IGNITION_MISFIRE"), ("P0302", "warning", "IGNITION_MISFIRE"), ("P0303", "warning", "IGNITION_MISFIRE"), ("P0304", "warning", "IGNITION_MISFIRE"),
    ("P0562", "warning", "LV_BATTERY_FAILURE"), ("P0563", "info", "LV_BATTERY_FAILURE"),
    ("C1A10", "warning", "TYRE_SLOW_LEAK"), ("C1A11", "warning", "TYRE_SLOW_LEAK"), ("C1A12", "warning", "TYRE_SLOW_LEAK"), ("C1A13", "warning", "TYRE_SLOW_LEAK"),
    ("P0A80", "critical", "HV_BATTERY_THERMAL"), ("P0A7F", "warning", "HV_BATTERY_THERMAL"), ("P0AFA", "warning", "HV_BATTERY_THERMAL"),
    ("P0420", "info", None), ("P0455", "info", None), ("U0100", "warning", None),
)
REQUIRED = ("vin", "event_ts", "seq", "latitude", "longitude", "speed_kmh")
RANGES = {
    "latitude": (-90, 90), "longitude": (-180, 180), "speed_kmh": (0, 250), "heading_deg": (0, 360), "odometer_km": (0, 3_000_000), "engine_rpm": (0, 10_000),
    "coolant_temp_c": (-40, 150), "fuel_level_pct": (0, 100), "lv_battery_v": (0, 20), "hv_soc_pct": (0, 100), "hv_soh_pct": (0, 100), "hv_pack_temp_c": (-40, 100),
    "hv_cell_delta_mv": (0, 2_000), "tyre_fl_kpa": (0, 1_500), "tyre_fr_kpa": (0, 1_500), "tyre_rl_kpa": (0, 1_500), "tyre_rr_kpa": (0, 1_500),
}
EVENT_TYPES = ("PERIODIC", "IGNITION_ON", "IGNITION_OFF", "HARSH_BRAKE", "BREAKDOWN")
# rule, failure mode, severity, side on which it opens, opens beyond, clears beyond
RULES = (
    ("COOLANT_OVERHEAT", "COOLING_FAILURE", "critical", ">", 112.0, 105.0), ("TYRE_PRESSURE_CRITICAL", "TYRE_SLOW_LEAK", "critical", ">", 0.25, 0.15),
    ("HV_CELL_CRITICAL", "HV_BATTERY_THERMAL", "critical", ">", 100.0, 60.0), ("LV_BATTERY_CRITICAL", "LV_BATTERY_FAILURE", "critical", "<", 11.8, 12.2),
    ("VEHICLE_BREAKDOWN", None, "critical", ">", 0.5, 0.5), ("COOLANT_DRIFT", "COOLING_FAILURE", "warning", ">", 60.0, 5.0),
    ("MISFIRE_ROUGHNESS", "IGNITION_MISFIRE", "warning", ">", 90.0, 70.0), ("LV_BATTERY_WEAK", "LV_BATTERY_FAILURE", "warning", "<", 12.25, 12.45),
    ("TYRE_SLOW_LEAK", "TYRE_SLOW_LEAK", "warning", ">", 0.08, 0.05), ("HV_CELL_IMBALANCE", "HV_BATTERY_THERMAL", "warning", ">", 40.0, 25.0),
)
PENALTY = {"critical": 40, "warning": 15}
SEVERITY_WEIGHT = {"critical": 1.0, "warning": 0.5, "info": 0.1}

NUMBERS = tuple(f for f in RANGES if f not in ("heading_deg", "engine_rpm", "hv_cell_delta_mv"))
WHOLE = ("heading_deg", "engine_rpm", "hv_cell_delta_mv")
CANONICAL = (
    "schema_version int, event_id string, tenant_id string, vehicle_id string, vin string, oem string, seq bigint, event_ts timestamp, ingest_ts timestamp, event_type string, "
    "latitude double, longitude double, speed_kmh double, heading_deg int, odometer_km double, ignition_on boolean, engine_rpm int, coolant_temp_c double, fuel_level_pct double, "
    "lv_battery_v double, hv_soc_pct double, hv_soh_pct double, hv_pack_temp_c double, hv_cell_delta_mv int, tyre_fl_kpa double, tyre_fr_kpa double, tyre_rl_kpa double, tyre_rr_kpa double, "
    "dtc_codes array<string>, late boolean"
)
ALERT = (
    "schema_version int, fingerprint string, status string, tenant_id string, vehicle_id string, vin string, rule_code string, severity string, failure_mode string, event_ts timestamp, "
    "event_seq bigint, detected_at timestamp, value double, threshold double, details map<string,string>"
)
SIGNAL = (
    "schema_version int, signal_type string, level string, dtc string, oem string, model_code string, firmware_version string, powertrain string, window_start double, window_end double, "
    "affected_vehicles bigint, cohort_vehicles bigint, rate double, baseline string, baseline_affected bigint, baseline_vehicles bigint, baseline_rate double, rate_ratio double, p_value double, p_adjusted double, tests_in_window bigint"
)


def oems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OEMS, OEM_SCHEMA)


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "oem string, model_code string, powertrain string")


def dtcs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DTCS, "code string, severity string, failure_mode string")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_code string, failure_mode string, severity string, side string, opens double, clears double")


def failure_modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in FAILURE_MODES.items()], "failure_mode string, powertrains array<string>")
