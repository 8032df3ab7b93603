import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from odolith.functions import catalog
from odolith.operators import normalise

TS = "2026-09-21T14:13:20.250Z"
NOW = datetime(2026, 9, 21, 14, 14, tzinfo=timezone.utc)
VIN = {"ORION": "PG1CT1A58T0000041", "VEGA": "PG2TR4D29T0000041", "LYRA": "PG3EV7V41T0000041"}


def check_digit(vin):
    values = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ0123456789", [*map(int, "12345678123457923456789"), *range(10)]))
    r = sum(values[c] * w for c, w in zip(vin, (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2))) % 11
    return "X" if r == 10 else str(r)


VIN = {k: v[:8] + check_digit(v) + v[9:] for k, v in VIN.items()}


def flat(**change):
    p = {"vin": VIN["ORION"], "ts": TS, "seq": 41, "evt": "HARSH_BRAKE", "lat": 13.08271, "lon": 80.270712, "speed_kmh": 64.3, "heading": 270, "odo_km": 18234.71, "ign": True, "batt_v": 13.9, "tpms_kpa": [241.3, 238.9, 240.2, 180.4], "dtc": ["P0420", "P0301", "P0301", "zzz"], "rpm": 2150, "coolant_c": 97.4, "pack_temp_c": 31.7, "cell_delta_mv": 46}
    return "ORION", p | change


def nested(**change):
    p = {
        "header": {"vehicleIdentifier": VIN["VEGA"], "timestamp": "2026-09-21T19:43:20.250+05:30", "sequence": 41, "eventType": "harsh_brake"}, "location": {"latitude": 13.08271, "longitude": 80.270712, "headingDeg": 270.0}, "motion": {"speedMph": 39.95, "odometerMiles": 11330.52},
        "electrical": {"batteryVolts": 13.9}, "tires": {"frontLeftPsi": 35.0, "frontRightPsi": 34.65, "rearLeftPsi": 34.84, "rearRightPsi": 26.16}, "diagnostics": {"activeCodes": "p0301,P0420;"}, "engine": {"ignition": "ON", "rpm": 2150, "coolantTempF": 207.3}, "hybrid": {"packTempF": 89.06, "cellDeltaMv": 46},
    }
    return "VEGA", p | change


def listed(**change):
    s = lambda n, v, u: {"name": n, "value": v, "unit": u}
    p = {
        "vin": VIN["LYRA"], "timestampMs": 1790000000250, "counter": 41, "event": "HARSH_BRAKE", "faults": [{"code": "P0420", "status": "x"}, {"code": "P0301"}],
        "signals": [s("position.lat", 13.08271, "deg"), s("position.lon", 80.270712, "deg"), s("vehicle.speed", 1, "m/s"), s("vehicle.speed", 17.86, "m/s"), s("vehicle.heading", 270, "deg"), s("vehicle.odometer", 18234710, "m"), s("tyre.fl.pressure", 2.413, "bar"), s("tyre.fr.pressure", 238.9, "kPa"), s("tyre.rl.pressure", 2.402, "bar"), s("tyre.rr.pressure", 1.804, "bar"), s("hv.packTemp", 31.7, "degC"), s("hv.cellDelta", 0.046, "V"), s("unknown.thing", "x", "?"), s("vehicle.ready", True, "")],
    }
    return "LYRA", p | change


def signal(name, value, unit):
    oem, p = listed()
    return oem, p | {"signals": [*p["signals"], {"name": name, "value": value, "unit": unit}]}


@pytest.fixture(scope="module")
def run(spark):
    registry = spark.createDataFrame([(v, f"veh-{o}", "ten-1", o) for o, v in VIN.items()] + [("PG1CT1A50T0000099", "veh-x", "ten-1", "VEGA")], "vin string, vehicle_id string, tenant_id string, registered_oem string")

    def go(messages, now=NOW):
        rows = [(i, m[1] if isinstance(m[1], str) else json.dumps(m[1]), m[0], m[2] if len(m) > 2 else None) for i, m in enumerate(messages)]
        raw = spark.createDataFrame(rows, "offset long, value string, oem string, schema string")
        out = normalise.normalise(raw, registry, F.lit(now))
        return {r.offset: r for r in out.collect()}, out

    return go


def test_three_formats_give_one_row(run):
    got, out = run([flat(), nested(), listed()])
    for r in got.values():
        assert r.outcome == "canonical", (r.reason, r.detail)
        assert (r.seq, r.event_type, r.heading_deg, r.hv_cell_delta_mv, r.dtc_codes) == (41, "HARSH_BRAKE", 270, 46, ["P0301", "P0420"])
        assert abs(r.speed_kmh - 64.3) < 0.2 and abs(r.odometer_km - 18234.71) < 0.05 and abs(r.hv_pack_temp_c - 31.7) < 0.1 and r.ignition_on is True
        assert all(abs(a - b) < 0.7 for a, b in zip((r.tyre_fl_kpa, r.tyre_fr_kpa, r.tyre_rl_kpa, r.tyre_rr_kpa), (241.3, 238.9, 240.2, 180.4)))
        assert r.event_ts == datetime(2026, 9, 21, 14, 13, 20, 250000) and len(r.event_id) == 36
    names = [x.split()[0] for x in catalog.CANONICAL.split(", ")]
    assert normalise.canonical(out).columns == names
    assert {(r.outcome, r.n) for r in normalise.outcome_counts(out).collect()} == {("canonical", 3)}


CASES = [
    (("ORION", ""), "malformed_json"), (("ORION", "<telemetry>"), "malformed_json"), (("ORION", "[1,2]"), "malformed_json"), (("ORION", '{"vin": "PG1'), "malformed_json"), (("ZETA", {}), "unknown_oem"), ((None, {}), "unknown_oem"), (("ORION", {}, "orion.v9"), "unknown_schema_version"),
    (flat(vin="IOQ00000000000000"), "invalid_vin"), (flat(vin="PG1CT1A5ZT0000041"), "invalid_vin"), (flat(lat=999.0), "out_of_range"), (flat(speed_kmh="fast"), "invalid_type"), (flat(speed_kmh=True), "invalid_type"), (flat(seq=1.5), "invalid_type"), (flat(ts="yesterday"), "invalid_timestamp"), (flat(ts="2026-09-21T14:13:20"), "invalid_timestamp"),
    (flat(ts=5), "invalid_timestamp"), (flat(tpms_kpa=[1, 2, 3]), "invalid_type"), (flat(dtc="P0301"), "invalid_type"), (flat(evt="PARTY"), "invalid_event_type"), (flat(seq=-1), "out_of_range"), (flat(lat=None), "missing_required_field"), (flat(vin="PG1CT1A5" + check_digit("PG1CT1A50T0000077") + "T0000077"), "unknown_vehicle"),
    (flat(vin=VIN["LYRA"]) if check_digit(VIN["LYRA"]) == VIN["LYRA"][8] else flat(vin=VIN["VEGA"]), "oem_mismatch"), (flat(ts="2026-10-21T14:13:20Z"), "future_timestamp"), (flat(ts="2026-09-01T14:13:20Z"), "stale_event"),
    (nested(motion=[1]), "invalid_type"), (nested(motion=None), "missing_required_field"), (nested(diagnostics={"activeCodes": 5}), "invalid_type"), (listed(signals={}), "invalid_type"), (listed(signals=[1]), "invalid_type"), (listed(timestampMs=1.5), "invalid_timestamp"), (signal("vehicle.speed", 3, "knots"), "unsupported_unit"), (signal("vehicle.speed", "x", "m/s"), "invalid_type"),
]


def test_reasons(run):
    got, _ = run([c for c, _ in CASES])
    assert {i: got[i].reason for i in got} == {i: r for i, (_, r) in enumerate(CASES)}
    assert all(r.outcome == "dlq" and r.event_id is None for r in got.values())


def test_duplicates_and_late(run):
    got, _ = run([flat(seq=5), flat(seq=7), flat(seq=5), flat(seq=6), flat(seq=2000), flat(seq=6)])
    assert [(got[i].outcome, got[i].late) for i in range(6)] == [("canonical", False), ("canonical", False), ("duplicate", False), ("canonical", True), ("canonical", False), ("canonical", True)]
    assert len({r.event_id for r in got.values() if r.outcome == "canonical"}) == 4


def test_contract(spark):
    df = spark.createDataFrame([("a", "open"), (None, "shut"), ("b!", "open")], "id string, status string").withColumn("extra", F.lit(1))
    got = {(r.key, r.field, r.rule) for r in normalise.contract_violations(df, "id", "id string, status string, value double", ("id",), {"id": "^[a-z]$"}, {"status": ("open",)}).collect()}
    assert got == {(None, "id", "required"), (None, "status", "enum"), ("b!", "id", "pattern"), (None, "value", "missing"), (None, "extra", "extra")}


def odd(payload, path=()):
    """The payload with each of its values replaced by values of other types, at its limits, or left out."""
    values = [None, "1", "", "x", 1, -1, 1.5, 2.5, 1e300, 10**17, 10**25, True, [], {}, [1, 2, 3, 4], [None, 1, 2, 3], ["P0301", 5, None], "NaN", "2026-09-21T14:13:20"]
    for k, v in list(payload.items()) if isinstance(payload, dict) else list(enumerate(payload)):
        for new in values:
            copy = json.loads(json.dumps(payload))
            copy[k] = new
            yield copy
        if isinstance(v, dict | list):
            for inner in odd(v):
                copy = json.loads(json.dumps(payload))
                copy[k] = inner
                yield copy
    yield {**payload, "more": [1]} if isinstance(payload, dict) else [*payload, None]


def test_typed_form_is_the_adapter(spark, run, monkeypatch):
    """Every text has the same outcome, fields and detail with the typed form of its format as through its adapter alone."""
    messages = [(m[0], p) for m in (flat(), nested(), listed()) for p in [m[1], *odd(m[1])]]
    plain = [(o, json.dumps(p)) for o, p in messages]
    plain += [("ORION", t) for t in ('  {"vin": 1}', '{"vin": "a", "vin": "b"}', '[{"vin": "a"}]', '{"seq": 1e2}', '{"seq": 1} x', '{"lat": NaN}', '{"lat": 1e400}', '{"vin": "\\u0041"}', "null", '"{}"')]
    quick, out = run(plain)
    reads = spark.createDataFrame([(i, v, o, None) for i, (o, v) in enumerate(plain)], "offset long, value string, oem string, schema string")
    assert normalise.adapted(normalise.parsed(reads)).count() == len(plain)
    monkeypatch.setattr(normalise, "TYPED", {})
    slow, _ = run(plain)
    assert len(quick) == len(plain) and len(plain) > 1000
    # by repr, since a number that is none differs from itself
    differ = [(plain[i], {c: (quick[i][c], slow[i][c]) for c in out.columns if repr(quick[i][c]) != repr(slow[i][c])}) for i in quick if repr(quick[i]) != repr(slow[i])]
    assert not differ, (len(differ), differ[:3])


def test_absent_time_and_numbers_beyond_their_types(run):
    got, _ = run([flat(ts=None), nested(header={"vehicleIdentifier": VIN["VEGA"], "sequence": 1}), flat(heading=1e300), (listed()[0], {**listed()[1], "timestampMs": 9 * 10**18})])
    assert [(got[i].reason, got[i].detail) for i in range(4)] == [("missing_required_field", "event_ts"), ("missing_required_field", "event_ts"), ("out_of_range", "heading_deg"), ("invalid_timestamp", "timestampMs")]


def test_absent_whole_numbers_stay_absent(run):
    changes = [flat(heading=None, rpm=None, cell_delta_mv=None), nested(engine={}, hybrid={})]
    got, _ = run(changes)
    assert [(got[i].outcome, got[i].engine_rpm, got[i].hv_cell_delta_mv) for i in range(2)] == [("canonical", None, None)] * 2
