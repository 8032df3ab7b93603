"""Raw manufacturer payloads to canonical events, each row with one outcome (NRM1-NRM21, JOIN1, UDF1).

An adapter is a function of DataFrames: it takes rows with a VARIANT column `p` and adds one column for each canonical
field, `dtc_raw`, and `bad`, the reason of the first field that has the wrong type. Adapters are registered by
manufacturer and schema. Everything is a column expression; the registry and the manufacturers are joined.

A format may have a typed form besides: a schema that reads the whole text at once. Rows that it reads without a fault
have that form's fields; all others, those to be rejected above all, go through the adapter, which names the fault.
Both forms give the same fields for the same text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.functions import catalog, vehicle
from odolith.operators.windows import dedup_verdict

Adapter = Callable[[DataFrame], DataFrame]
ADAPTERS: dict[tuple[str, str], Adapter] = {}
#: The typed form of a format: schema of the text; its fields with a column that is true where they may be taken as read; columns that both look at.
TYPED: dict[tuple[str, str], tuple] = {}
LARGEST_INT, LARGEST_MS = 2_147_483_647, 9_000_000_000_000_000
ISO_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})$"
PLAIN = "^[A-Za-z0-9_]*$"
MPH, MILES, PSI = 1 / 0.621371, 1 / 0.621371, 1 / 0.145038

# Signal name, canonical field, unit, factor.
SIGNALS = (
    ("position.lat", "latitude", "deg", 1.0), ("position.lon", "longitude", "deg", 1.0), ("vehicle.speed", "speed_kmh", "km/h", 1.0), ("vehicle.speed", "speed_kmh", "m/s", 3.6),
    ("vehicle.heading", "heading_deg", "deg", 1.0), ("vehicle.odometer", "odometer_km", "km", 1.0), ("vehicle.odometer", "odometer_km", "m", 0.001), ("lv.voltage", "lv_battery_v", "V", 1.0),
    ("hv.soc", "hv_soc_pct", "%", 1.0), ("hv.soh", "hv_soh_pct", "%", 1.0), ("hv.packTemp", "hv_pack_temp_c", "degC", 1.0), ("hv.cellDelta", "hv_cell_delta_mv", "V", 1000.0), ("hv.cellDelta", "hv_cell_delta_mv", "mV", 1.0),
    ("tyre.fl.pressure", "tyre_fl_kpa", "bar", 100.0), ("tyre.fl.pressure", "tyre_fl_kpa", "kPa", 1.0), ("tyre.fr.pressure", "tyre_fr_kpa", "bar", 100.0), ("tyre.fr.pressure", "tyre_fr_kpa", "kPa", 1.0),
    ("tyre.rl.pressure", "tyre_rl_kpa", "bar", 100.0), ("tyre.rl.pressure", "tyre_rl_kpa", "kPa", 1.0), ("tyre.rr.pressure", "tyre_rr_kpa", "bar", 100.0), ("tyre.rr.pressure", "tyre_rr_kpa", "kPa", 1.0),
)


def register_adapter(oem: str, schema: str, adapter: Adapter, typed: tuple | None = None) -> None:
    ADAPTERS[oem, schema] = adapter
    TYPED.pop((oem, schema), None)
    if typed:
        TYPED[oem, schema] = typed


# Strict types: the type of a VARIANT tells 1 from 1.0, "1" and true.


def at(path: str, root: str = "p") -> Column:
    return F.try_variant_get(F.col(root), path, "variant")


def kind(v: Column) -> Column:
    """bigint, decimal, double, string, boolean, object, array; null where the value is absent or a JSON null."""
    word = F.lower(F.regexp_extract(F.schema_of_variant(v), r"^[A-Za-z]+", 0))
    return F.when(v.isNull() | (word == "void"), None).otherwise(word)


def is_number(v: Column) -> Column:
    return F.coalesce(kind(v).isin("bigint", "decimal", "double", "float", "int", "smallint", "tinyint"), F.lit(True))


def is_integer(v: Column) -> Column:
    return F.coalesce(kind(v).isin("bigint", "int", "smallint", "tinyint"), F.lit(True))


def is_text(v: Column) -> Column:
    return F.coalesce(kind(v) == "string", F.lit(True))


def cast(v: Column, to: str) -> Column:
    return F.try_variant_get(v, "$", to)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def whole(x: Column) -> Column:
    """Half-even as int; what no int can hold becomes the largest or the least one, which no range of a field allows."""
    # least and greatest pass nulls over, so an absent number is kept apart
    return F.when(x.isNotNull(), half_even(F.greatest(F.least(x, F.lit(float(LARGEST_INT))), F.lit(-float(LARGEST_INT)))).cast("int"))


def epoch_ms(x: Column) -> Column:
    return F.timestamp_millis(F.when(F.abs(x) <= LARGEST_MS, x))


class Fields:
    """Collects canonical columns and the checks of their types, in order."""

    def __init__(self) -> None:
        self.columns: dict[str, Column] = {}
        self.bad: list[Column] = []

    def at(self, path: str) -> Column:
        return at(f"$.{path}")

    def check(self, ok: Column, reason: str, detail: str) -> None:
        self.bad.append(F.when(~ok, F.struct(F.lit(reason).alias("reason"), F.lit(detail).alias("detail"))))

    def number(self, name: str, v: Column, detail: str, change: Callable[[Column], Column] = lambda x: x) -> None:
        self.check(is_number(v), "invalid_type", detail)
        self.columns[name] = change(cast(v, "double"))

    def whole(self, name: str, v: Column, detail: str) -> None:
        self.check(is_number(v), "invalid_type", detail)
        self.columns[name] = whole(cast(v, "double"))

    def integer(self, name: str, v: Column, detail: str) -> None:
        self.check(is_integer(v), "invalid_type", detail)
        self.columns[name] = cast(v, "bigint")

    def text(self, name: str, v: Column) -> None:
        self.columns[name] = cast(v, "string")

    def zoned(self, name: str, v: Column) -> None:
        """ISO text that names its zone."""
        text = cast(v, "string")
        # an absent time is no false one: it is missing
        ok = kind(v).isNull() | F.coalesce((kind(v) == "string") & text.rlike(ISO_ZONED) & F.try_to_timestamp(text).isNotNull(), F.lit(False))
        self.check(ok, "invalid_timestamp", name)
        self.columns[name] = F.when(text.rlike(ISO_ZONED), F.try_to_timestamp(text))

    def flag(self, name: str, v: Column) -> None:
        self.columns[name] = cast(v, "boolean")

    def added(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns | {"bad": F.coalesce(*self.bad)})


class Typed(Fields):
    """The same fields of a struct that was read with its schema: types hold, so only contents are tested, and `sure` collects that."""

    def __init__(self, root: str) -> None:
        super().__init__()
        self.root, self.sure = root, F.col(f"{root}._fault").isNull()

    def at(self, path: str) -> Column:
        return F.col(f"{self.root}.{path}")

    def number(self, name: str, v: Column, detail: str, change: Callable[[Column], Column] = lambda x: x) -> None:
        self.columns[name] = change(v)

    def whole(self, name: str, v: Column, detail: str) -> None:
        self.columns[name] = whole(v)

    def integer(self, name: str, v: Column, detail: str) -> None:
        self.columns[name] = v

    def text(self, name: str, v: Column) -> None:
        # a schema reads numbers and objects as text too, as they were spelt
        self.sure = self.sure & F.coalesce(v.rlike(PLAIN) & ~v.rlike(r"^[0-9]+[eE]"), F.lit(True))
        self.columns[name] = v

    def zoned(self, name: str, v: Column) -> None:
        read = F.when(v.rlike(ISO_ZONED), F.try_to_timestamp(v))
        self.sure = self.sure & (v.isNull() | read.isNotNull())
        self.columns[name] = read

    def flag(self, name: str, v: Column) -> None:
        self.columns[name] = v


FLAT = "vin string, ts string, seq bigint, evt string, lat double, lon double, speed_kmh double, heading double, odo_km double, ign boolean, batt_v double, tpms_kpa array<double>, dtc array<string>, rpm double, coolant_c double, fuel_pct double, soc_pct double, soh_pct double, pack_temp_c double, cell_delta_mv double"


def flat_fields(f: Fields, tyre: Callable[[int], Column], codes: Column) -> None:
    f.text("vin", f.at("vin"))
    f.zoned("event_ts", f.at("ts"))
    f.integer("seq", f.at("seq"), "seq")
    f.text("event_type", f.at("evt"))
    f.columns["event_type"] = F.coalesce(f.columns["event_type"], F.lit("PERIODIC"))
    for name, path in (("latitude", "lat"), ("longitude", "lon"), ("speed_kmh", "speed_kmh"), ("odometer_km", "odo_km"), ("coolant_temp_c", "coolant_c"), ("fuel_level_pct", "fuel_pct"), ("lv_battery_v", "batt_v"), ("hv_soc_pct", "soc_pct"), ("hv_soh_pct", "soh_pct"), ("hv_pack_temp_c", "pack_temp_c")):
        f.number(name, f.at(path), path)
    for name, path in (("heading_deg", "heading"), ("engine_rpm", "rpm"), ("hv_cell_delta_mv", "cell_delta_mv")):
        f.whole(name, f.at(path), path)
    f.flag("ignition_on", f.at("ign"))
    for i, name in enumerate(("tyre_fl_kpa", "tyre_fr_kpa", "tyre_rl_kpa", "tyre_rr_kpa")):
        f.number(name, tyre(i), "tpms_kpa")
    f.columns["dtc_raw"] = F.coalesce(codes, F.array().cast("array<string>"))


def flat_metric(df: DataFrame) -> DataFrame:
    """Flat object in metric units; tyres are a list of exactly four."""
    f = Fields()
    tyres = at("$.tpms_kpa")
    listed = F.try_variant_get(F.col("p"), "$.tpms_kpa", "array<variant>")
    f.check(F.coalesce((kind(tyres) == "array") & (F.size(listed) == 4), kind(tyres).isNull()), "invalid_type", "tpms_kpa")
    codes = at("$.dtc")
    f.check(F.coalesce(kind(codes) == "array", F.lit(True)), "invalid_type", "dtc")
    flat_fields(f, lambda i: at(f"$.tpms_kpa[{i}]"), F.try_variant_get(F.col("p"), "$.dtc", "array<string>"))
    return f.added(df)


def flat_typed(root: str) -> tuple[dict[str, Column], Column]:
    f = Typed(root)
    tyres = f.at("tpms_kpa")
    flat_fields(f, lambda i: F.get(tyres, F.lit(i)), f.at("dtc"))
    return f.columns, f.sure & (tyres.isNull() | (F.size(tyres) == 4))


NESTED = (
    "header struct<vehicleIdentifier: string, timestamp: string, sequence: bigint, eventType: string>, location struct<latitude: double, longitude: double, headingDeg: double>, "
    "motion struct<speedMph: double, odometerMiles: double>, engine struct<ignition: string, rpm: double, coolantTempF: double, fuelLevelPct: double>, "
    "hybrid struct<socPct: double, sohPct: double, packTempF: double, cellDeltaMv: double>, tires struct<frontLeftPsi: double, frontRightPsi: double, rearLeftPsi: double, rearRightPsi: double>, "
    "electrical struct<batteryVolts: double>, diagnostics struct<activeCodes: string>"
)


def nested_fields(f: Fields) -> None:
    scaled = lambda factor: lambda x: half_even(x * factor, 2)
    celsius = lambda x: half_even((x - 32) / 1.8, 2)
    f.text("vin", f.at("header.vehicleIdentifier"))
    f.zoned("event_ts", f.at("header.timestamp"))
    f.integer("seq", f.at("header.sequence"), "header.sequence")
    f.text("event_type", f.at("header.eventType"))
    f.columns["event_type"] = F.upper(F.coalesce(f.columns["event_type"], F.lit("periodic")))
    f.number("latitude", f.at("location.latitude"), "location.latitude")
    f.number("longitude", f.at("location.longitude"), "location.longitude")
    f.number("speed_kmh", f.at("motion.speedMph"), "motion.speedMph", scaled(MPH))
    f.whole("heading_deg", f.at("location.headingDeg"), "location.headingDeg")
    f.number("odometer_km", f.at("motion.odometerMiles"), "motion.odometerMiles", scaled(MILES))
    f.text("ignition_on", f.at("engine.ignition"))
    f.columns["ignition_on"] = f.columns["ignition_on"] == "ON"
    f.whole("engine_rpm", f.at("engine.rpm"), "engine.rpm")
    f.number("coolant_temp_c", f.at("engine.coolantTempF"), "engine.coolantTempF", celsius)
    f.number("fuel_level_pct", f.at("engine.fuelLevelPct"), "engine.fuelLevelPct")
    f.number("lv_battery_v", f.at("electrical.batteryVolts"), "electrical.batteryVolts")
    f.number("hv_soc_pct", f.at("hybrid.socPct"), "hybrid.socPct")
    f.number("hv_soh_pct", f.at("hybrid.sohPct"), "hybrid.sohPct")
    f.number("hv_pack_temp_c", f.at("hybrid.packTempF"), "hybrid.packTempF", celsius)
    f.whole("hv_cell_delta_mv", f.at("hybrid.cellDeltaMv"), "hybrid.cellDeltaMv")
    for name, path in (("tyre_fl_kpa", "frontLeftPsi"), ("tyre_fr_kpa", "frontRightPsi"), ("tyre_rl_kpa", "rearLeftPsi"), ("tyre_rr_kpa", "rearRightPsi")):
        f.number(name, f.at(f"tires.{path}"), "tires", scaled(PSI))


def nested_imperial(df: DataFrame) -> DataFrame:
    """Nested sections in imperial units; an absent section is empty, one of another type is rejected."""
    f = Fields()
    for name in ("header", "location", "motion", "engine", "hybrid", "tires", "electrical", "diagnostics"):
        f.check(F.coalesce(kind(at(f"$.{name}")) == "object", F.lit(True)), "invalid_type", name)
    codes = at("$.diagnostics.activeCodes")
    f.check(is_text(codes), "invalid_type", "diagnostics.activeCodes")
    nested_fields(f)
    f.columns["dtc_raw"] = vehicle.dtc_extract(F.coalesce(cast(codes, "string"), F.lit("")))
    return f.added(df)


def nested_typed(root: str) -> tuple[dict[str, Column], Column]:
    f = Typed(root)
    nested_fields(f)
    codes = f.at("diagnostics.activeCodes")
    f.columns["dtc_raw"] = vehicle.dtc_extract(F.coalesce(codes, F.lit("")))
    # a list or an object that was read as text holds brackets, a number or truth value no code at all
    return f.columns, f.sure & (codes.isNull() | (codes == "") | codes.rlike(r"^[^\[\]{}]*[PCBUpcbu][0-9][^\[\]{}]*$"))


def signal_list(df: DataFrame) -> DataFrame:
    """A list of named signals with units: unknown names are ignored, unknown units rejected, and the last of a name wins."""
    f = Fields()
    listed = F.try_variant_get(F.col("p"), "$.signals", "array<variant>")
    f.check(F.coalesce(kind(at("$.signals")) == "array", F.lit(False)), "invalid_type", "signals")
    f.check(F.coalesce(F.forall(listed, lambda s: F.coalesce(kind(s) == "object", F.lit(False))), F.lit(True)), "invalid_type", "signals[]")
    f.text("vin", at("$.vin"))
    f.integer("seq", at("$.counter"), "counter")
    ms = cast(at("$.timestampMs"), "bigint")
    f.check(is_integer(at("$.timestampMs")) & F.coalesce(F.abs(ms) <= LARGEST_MS, F.lit(True)), "invalid_timestamp", "timestampMs")
    f.columns["event_ts"] = epoch_ms(ms)
    f.columns["event_type"] = F.coalesce(cast(at("$.event"), "string"), F.lit("PERIODIC"))
    part = lambda s, name, to: F.try_variant_get(s, f"$.{name}", to)
    named = lambda name: F.try_element_at(F.filter(listed, lambda s: part(s, "name", "string") == name), F.lit(-1))
    ready = named("vehicle.ready")
    f.columns["ignition_on"] = F.when(ready.isNotNull(), F.coalesce(part(ready, "value", "boolean"), part(ready, "value", "double") != 0, F.lit(False)))
    for name in dict.fromkeys(s[0] for s in SIGNALS):
        field = next(s[1] for s in SIGNALS if s[0] == name)
        units = {s[2]: s[3] for s in SIGNALS if s[0] == name}
        last = named(name)
        f.check(known_units(listed, name, units), "unsupported_unit", name)
        value = part(last, "value", "variant")
        f.check(is_number(value), "invalid_type", name)
        factor = reduce(lambda c, u: F.when(part(last, "unit", "string") == u[0], u[1]).otherwise(c), units.items(), F.lit(None).cast("double"))
        number = cast(value, "double")
        f.columns[field] = whole(number * factor) if field in catalog.WHOLE else F.when(factor == 1, number).otherwise(half_even(number * factor, 2))
    for name, to in (("engine_rpm", "int"), ("coolant_temp_c", "double"), ("fuel_level_pct", "double")):
        f.columns[name] = F.lit(None).cast(to)
    faults = at("$.faults")
    f.check(F.coalesce(kind(faults) == "array", F.lit(True)), "invalid_type", "faults")
    fault_list = F.coalesce(F.try_variant_get(F.col("p"), "$.faults", "array<variant>"), F.array().cast("array<variant>"))
    f.columns["dtc_raw"] = F.transform(F.filter(fault_list, lambda x: F.coalesce(kind(x) == "object", F.lit(False))), lambda x: part(x, "code", "string"))
    return f.added(df)


LISTED = "vin string, counter bigint, timestampMs bigint, event string, signals array<struct<name: string, unit: string, value: variant>>, faults array<struct<code: string>>"


def listed_once(root: str) -> dict[str, Column]:
    """Names and numbers of the signals and whether all are usual, each signal looked at once: its factor by name and unit, its value as a number."""
    signals = F.col(f"{root}.signals")
    factors = F.create_map(*[F.lit(x) for s in SIGNALS for x in (f"{s[0]}|{s[2]}", s[3])])
    known = list(dict.fromkeys(s[0] for s in SIGNALS))

    def seen(s: Column) -> Column:
        value, factor = s["value"], factors[F.concat_ws("|", s["name"], s["unit"])]
        sort = F.substring(F.schema_of_variant(value), 1, 3)
        number = F.coalesce(factor.isNotNull() & sort.isin("BIG", "DEC", "DOU"), F.lit(False))
        usual = s.isNotNull() & F.when(s["name"] == "vehicle.ready", F.coalesce(sort == "BOO", F.lit(False))).when(s["name"].isin(known), number).otherwise(True)
        read = F.when(number, F.try_variant_get(value, "$", "double"))
        return F.struct(s["name"].alias("name"), read.alias("number"), factor.alias("factor"), F.when(sort == "BOO", F.try_variant_get(value, "$", "boolean")).alias("on"), usual.alias("usual"))

    return {f"{root}_seen": F.transform(signals, seen)}


def listed_typed(root: str) -> tuple[dict[str, Column], Column]:
    """Names that are unknown are passed over; the last signal of a name counts."""
    f = Typed(root)
    f.text("vin", f.at("vin"))
    f.integer("seq", f.at("counter"), "counter")
    f.columns["event_ts"] = epoch_ms(f.at("timestampMs"))
    f.text("event_type", f.at("event"))
    f.columns["event_type"] = F.coalesce(f.columns["event_type"], F.lit("PERIODIC"))
    signals = F.reverse(f"{root}_seen")
    last = lambda name: F.get(signals, (F.array_position(signals["name"], name) - 1).cast("int"))
    f.columns["ignition_on"] = last("vehicle.ready")["on"]
    for name, field in dict((s[0], s[1]) for s in SIGNALS).items():
        number, factor = last(name)["number"], last(name)["factor"]
        f.columns[field] = whole(number * factor) if field in catalog.WHOLE else F.when(factor == 1, number).otherwise(half_even(number * factor, 2))
    for name, to in (("engine_rpm", "int"), ("coolant_temp_c", "double"), ("fuel_level_pct", "double")):
        f.columns[name] = F.lit(None).cast(to)
    faults = f.at("faults")
    f.columns["dtc_raw"] = F.coalesce(F.transform(F.filter(faults, lambda x: x.isNotNull()), lambda x: x["code"]), F.array().cast("array<string>"))
    in_time = F.coalesce(F.abs(f.at("timestampMs")) <= LARGEST_MS, F.lit(True))
    return f.columns, f.sure & in_time & F.col(f"{root}.signals").isNotNull() & ~F.array_contains(F.col(f"{root}_seen")["usual"], False)


def known_units(listed: Column, name: str, units: dict[str, float]) -> Column:
    """Whether every signal of that name has one of the units."""

    def ok(s: Column) -> Column:
        unit = F.try_variant_get(s, "$.unit", "string")
        return F.coalesce(F.try_variant_get(s, "$.name", "string") != name, F.lit(True)) | F.coalesce(unit.isin(*units), F.lit(False))

    return F.coalesce(F.forall(listed, ok), F.lit(True))


register_adapter("ORION", "orion.v1", flat_metric, (FLAT, flat_typed))
register_adapter("VEGA", "vega.2.3", nested_imperial, (NESTED, nested_typed))
register_adapter("LYRA", "lyra.v1", signal_list, (LISTED, listed_typed, listed_once))


def parsed(raw: DataFrame) -> DataFrame:
    """raw (value, oem, schema, ...) with VARIANT `p` and the reason for what is no JSON object of a known format."""
    text = F.col("value").cast("string")
    p = F.try_parse_json(text)
    default = F.create_map(*[F.lit(x) for o in catalog.OEMS for x in (o[0], o[2])])[F.col("oem")]
    out = raw.withColumn("p", p).withColumn("format", F.coalesce(F.when(F.col("schema") != "", F.col("schema")), default))
    adapter = F.concat_ws("/", "oem", "format").isin([f"{o}/{s}" for o, s in ADAPTERS])
    reason = (
        F.when(F.coalesce(text, F.lit("")) == "", "malformed_json").when(F.col("p").isNull() | ~text.rlike(r"^[ \t\r\n]*\{"), "malformed_json")
        .when(default.isNull(), "unknown_oem").when(~adapter, "unknown_schema_version")
    )
    return out.withColumn("reason_parse", reason)


def adapted(rows: DataFrame) -> DataFrame:
    """Rows of parsed() with the fields of their format; those of no format have nulls. One pass: a row is read with its own format's
    schema, and only if that finds a fault by the format's adapter; nothing of other formats is evaluated."""
    base, found = rows, []
    own = {k: F.col("reason_parse").isNull() & (F.col("oem") == k[0]) & (F.col("format") == k[1]) for k in ADAPTERS}
    keys = list(ADAPTERS)
    # the text is read once, then it is decided which way the row goes, then that way is gone
    strict = {"columnNameOfCorruptRecord": "_fault", "allowNonNumericNumbers": "false"}
    texts = {f"_t{i}": F.when(own[k], F.from_json(F.col("value").cast("string"), f"{TYPED[k][0]}, _fault string", strict)) for i, k in enumerate(keys) if k in TYPED}
    base = base.withColumns(texts)
    for i, k in enumerate(keys):
        if k in TYPED and len(TYPED[k]) > 2:
            base = base.withColumns(TYPED[k][2](f"_t{i}"))
    read = {i: TYPED[k][1](f"_t{i}") for i, k in enumerate(keys) if k in TYPED}
    base = base.withColumns({f"_sure{i}": F.coalesce(own[keys[i]] & sure, F.lit(False)) for i, (_, sure) in read.items()})
    for i, k in enumerate(keys):
        out = ADAPTERS[k](base)
        added = sorted(set(out.columns) - set(base.columns))
        slow = F.when(own[k] & ~F.col(f"_sure{i}") if i in read else own[k], F.struct(*added))
        base = out.withColumn(f"_a{i}", slow).drop(*added)
        if i in read:
            columns = read[i][0] | {"bad": F.lit(None).cast("struct<reason: string, detail: string>")}
            quick = F.when(F.col(f"_sure{i}"), F.struct(*[columns[c].alias(c) for c in added]))
            base = base.withColumn(f"_a{i}", F.coalesce(quick, F.col(f"_a{i}")))
        found.append(f"_a{i}")
    return base.withColumn("_a", F.coalesce(*found)).select(*rows.columns, "_a.*")


def validation(now: Column, max_future_s: float = 300.0, max_age_s: float = 7 * 86_400.0) -> Column:
    """Reason and detail of the first rule that fails, in the fixed order; needs the column check_digit."""

    def out(reason: str, detail: str) -> Column:
        return F.struct(F.lit(reason).alias("reason"), F.lit(detail).alias("detail"))

    steps = [F.when(F.col(f).isNull(), out("missing_required_field", f)) for f in catalog.REQUIRED]
    steps.append(F.when(~vehicle.vin_is_valid(F.col("vin"), F.col("check_digit")), out("invalid_vin", "vin")))
    steps.append(F.when(F.col("seq") < 0, out("out_of_range", "seq")))
    steps.append(F.when(~F.col("event_type").isin(*catalog.EVENT_TYPES), out("invalid_event_type", "event_type")))
    ahead = vehicle.epoch(F.col("event_ts")) - vehicle.epoch(now)
    steps.append(F.when(ahead > max_future_s, out("future_timestamp", "event_ts")))
    steps.append(F.when(ahead < -max_age_s, out("stale_event", "event_ts")))
    steps += [F.when(~F.col(f).between(float(lo), float(hi)), out("out_of_range", f)) for f, (lo, hi) in catalog.RANGES.items()]
    return F.coalesce(*steps)


def normalise(raw: DataFrame, registry: DataFrame, now: Column, order: str = "offset", width: int = 1024, dedup: bool = True, max_future_s: float = 300.0, max_age_s: float = 7 * 86_400.0) -> DataFrame:
    """Every raw row (value, oem, schema, order) with `outcome` canonical, dlq or duplicate, `reason`, `detail`, the canonical columns and `late`.

    registry: vin, vehicle_id, tenant_id, registered_oem. With dedup=False (in a stream) the verdict is left to a stateful operator.
    """
    spark = raw.sparkSession
    rows = adapted(parsed(raw))
    # three manufacturers
    rows = rows.join(F.broadcast(catalog.oems(spark).select("oem", "check_digit")), "oem", "left").withColumn("check_digit", F.coalesce("check_digit", F.lit(True)))
    rows = rows.join(registry, "vin", "left")
    own = F.when(F.col("vehicle_id").isNull(), F.struct(F.lit("unknown_vehicle").alias("reason"), F.col("vin").alias("detail"))).when(F.col("registered_oem") != F.col("oem"), F.struct(F.lit("oem_mismatch").alias("reason"), F.col("vin").alias("detail")))
    parse = F.when(F.col("reason_parse").isNotNull(), F.struct(F.col("reason_parse").alias("reason"), F.lit("").alias("detail")))
    # validation only applies to rows that came through an adapter
    failed = F.coalesce(parse, F.col("bad"), validation(now, max_future_s, max_age_s), own)
    rows = rows.withColumn("failed", failed).withColumn("reason", F.col("failed.reason")).withColumn("detail", F.substring(F.col("failed.detail"), 1, 200))
    rows = rows.withColumn("dtc_codes", vehicle.dtc_clean(F.col("dtc_raw"))).withColumn("schema_version", F.lit(1)).withColumn("ingest_ts", now)
    rows = rows.withColumn("event_id", F.when(F.col("reason").isNull(), vehicle.stable_id(F.col("vehicle_id"), F.col("seq"))))
    if not dedup:
        return rows.withColumn("outcome", F.when(F.col("reason").isNotNull(), "dlq").otherwise("canonical")).withColumn("late", F.lit(False)).drop("failed", "bad", "p", "dtc_raw", "reason_parse", "format", "check_digit")
    # rejected rows take no part in the verdicts; they are spread over keys of their own
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64(order, "value"), F.lit(1 << 20)).cast("string"))
    keyed = rows.withColumn("_key", F.when(F.col("reason").isNull(), F.concat(F.lit("+"), F.col("vehicle_id").cast("string"))).otherwise(spread))
    both = dedup_verdict(keyed, "_key", order, "seq", width).drop("_key")
    outcome = F.when(F.col("reason").isNotNull(), "dlq").when(F.col("verdict") == "DUPLICATE", "duplicate").otherwise("canonical")
    return both.withColumn("outcome", outcome).withColumn("late", F.coalesce(F.col("reason").isNull() & F.col("verdict").isin("NEW_LATE", "TOO_OLD"), F.lit(False))).drop("failed", "bad", "p", "dtc_raw", "reason_parse", "format", "check_digit")


def canonical(rows: DataFrame) -> DataFrame:
    """The canonical rows of normalise(), in the shape of the schema."""
    names = [x.split()[0] for x in catalog.CANONICAL.split(", ")]
    return rows.filter("outcome = 'canonical'").select(*names)


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome", "reason", "late").agg(F.count("*").alias("n"))


def contract_violations(df: DataFrame, key: str, schema: str, required: tuple[str, ...], patterns: dict[str, str], enums: dict[str, tuple]) -> DataFrame:
    """Rows (key, field, rule) that break a contract; extra, missing or retyped columns are rows with a null key."""
    from pyspark.sql.types import _parse_datatype_string

    want = {f.name: f.dataType.simpleString() for f in _parse_datatype_string(schema)}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    shape = [(n, "missing") for n in want if n not in have] + [(n, "extra") for n in have if n not in want] + [(n, "type") for n in want if n in have and have[n] != want[n]]
    fails = [F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("field"), F.lit("required").alias("rule"))) for f in required if f in have]
    fails += [F.when(~F.col(f).rlike(p), F.struct(F.lit(f).alias("field"), F.lit("pattern").alias("rule"))) for f, p in patterns.items() if f in have]
    fails += [F.when(~F.col(f).isin(*v), F.struct(F.lit(f).alias("field"), F.lit("enum").alias("rule"))) for f, v in enums.items() if f in have]
    rows = df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*fails))).alias("v")).select("key", "v.field", "v.rule")
    return rows.unionByName(df.sparkSession.createDataFrame([(None, f, r) for f, r in shape], "key string, field string, rule string"))
