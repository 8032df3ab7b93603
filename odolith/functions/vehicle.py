"""Column expressions on vehicle data: identification numbers, trouble codes, geohash, distance, statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the VIN standard and of the SAE code scheme.
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"
VIN_VALUES = "12345678123457923456789" + "0123456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_PATTERN = "^[A-HJ-NPR-Z0-9]{17}$"
YEAR_CODES = "ABCDEFGHJKLMNPRSTVWXY123456789"
FIRST_YEAR = 2010
DTC_PATTERN = "^[PCBU][0-3][0-9A-F]{3}$"
DTC_IN_TEXT = "(?i)(?<![0-9A-Z])[PCBU][0-3][0-9A-F]{3}(?![0-9A-Z])"
DTC_SYSTEMS = {"P": "powertrain", "C": "chassis", "B": "body", "U": "network"}
GEOHASH_LETTERS = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_RADIUS_KM = 6371.0088


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vin_check_digit(vin: Column) -> Column:
    """Mod-11 check digit of a 17-letter VIN, X for ten; null where a letter is not allowed."""
    plain = F.translate(vin, VIN_LETTERS, VIN_VALUES)
    weights = F.array(*[F.lit(w) for w in VIN_WEIGHTS])
    total = F.aggregate(F.zip_with(F.split(plain, ""), weights, lambda d, w: d.cast("int") * w), F.lit(0), lambda a, x: a + x)
    return F.when(vin.rlike(VIN_PATTERN), F.when(total % 11 == 10, "X").otherwise((total % 11).cast("string")))


def vin_is_valid(vin: Column, check_digit: Column) -> Column:
    """Shape, and the check digit where the boolean column asks for it; null is invalid."""
    shaped = vin.rlike(VIN_PATTERN)
    return F.coalesce(shaped & (~check_digit | (F.substring(vin, 9, 1) == vin_check_digit(vin))), F.lit(False))


def model_year(vin: Column) -> Column:
    """Model year 2010 to 2039 from position 10; null for other letters."""
    at = F.instr(F.lit(YEAR_CODES), F.substring(vin, 10, 1))
    return F.when((at > 0) & (F.length(vin) >= 10), at + FIRST_YEAR - 1)


def model_year_code(year: Column) -> Column:
    at = year - FIRST_YEAR + 1
    return F.when(at.between(1, len(YEAR_CODES)), F.substring(F.lit(YEAR_CODES), at.cast("int"), F.lit(1)))


def dtc_is_valid(code: Column) -> Column:
    return code.rlike(DTC_PATTERN)


def dtc_extract(text: Column) -> Column:
    """Distinct codes in free text, upper case, in the order first seen."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DTC_IN_TEXT), F.lit(0)), F.upper))


def dtc_clean(codes: Column) -> Column:
    """Valid codes, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.coalesce(dtc_is_valid(c), F.lit(False)))))


def dtc_system(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in DTC_SYSTEMS.items() for x in kv])[F.substring(code, 1, 1)]


def dtc_is_generic(code: Column) -> Column:
    return F.substring(code, 2, 1).isin("0", "2")


def geohash(latitude: Column, longitude: Column, precision: int) -> Column:
    """Geohash of so many letters; null outside the globe. Each step halves the longitude (even) or latitude (odd) range."""
    box = F.struct(F.lit(-180.0).alias("west"), F.lit(180.0).alias("east"), F.lit(-90.0).alias("south"), F.lit(90.0).alias("north"), F.lit(0).cast("long").alias("bits"))

    def halve(s: Column, i: Column) -> Column:
        across = i % 2 == 0
        middle = F.when(across, (s["west"] + s["east"]) / 2).otherwise((s["south"] + s["north"]) / 2)
        upper = F.when(across, longitude).otherwise(latitude) >= middle
        return F.struct(
            F.when(across & upper, middle).otherwise(s["west"]).alias("west"), F.when(across & ~upper, middle).otherwise(s["east"]).alias("east"),
            F.when(~across & upper, middle).otherwise(s["south"]).alias("south"), F.when(~across & ~upper, middle).otherwise(s["north"]).alias("north"),
            (s["bits"] * 2 + upper.cast("long")).alias("bits"),
        )

    letter = lambda bits: F.substring(F.lit(GEOHASH_LETTERS), (bits + 1).cast("int"), F.lit(1))
    whole = let(F.aggregate(F.sequence(F.lit(0), F.lit(5 * precision - 1)), box, halve)["bits"], lambda b: F.concat(*[letter(F.shiftright(b, 5 * (precision - 1 - k)).bitwiseAND(F.lit(31))) for k in range(precision)]))
    return F.when(latitude.between(-90, 90) & longitude.between(-180, 180), whole)


def geohash_centre(cell: Column) -> Column:
    """Struct (latitude, longitude) of the centre of a cell."""
    box = F.struct(F.lit(-180.0).alias("west"), F.lit(180.0).alias("east"), F.lit(-90.0).alias("south"), F.lit(90.0).alias("north"))

    def halve(s: Column, i: Column) -> Column:
        value = F.instr(F.lit(GEOHASH_LETTERS), F.substring(cell, (F.floor(i / 5) + 1).cast("int"), F.lit(1))) - 1
        upper = (F.floor(value / F.pow(F.lit(2), 4 - i % 5)) % 2) == 1
        across = i % 2 == 0
        x, y = (s["west"] + s["east"]) / 2, (s["south"] + s["north"]) / 2
        return F.struct(
            F.when(across & upper, x).otherwise(s["west"]).alias("west"), F.when(across & ~upper, x).otherwise(s["east"]).alias("east"),
            F.when(~across & upper, y).otherwise(s["south"]).alias("south"), F.when(~across & ~upper, y).otherwise(s["north"]).alias("north"),
        )

    found = F.aggregate(F.sequence(F.lit(0), F.length(cell) * 5 - 1), box, halve)
    return let(found, lambda s: F.struct(((s["south"] + s["north"]) / 2).alias("latitude"), ((s["west"] + s["east"]) / 2).alias("longitude")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(half))


def mask_location(latitude: Column, longitude: Column, exact: Column, digits: int = 2) -> Column:
    """Struct of the position, rounded unless `exact` holds, and a label of its precision."""
    return F.struct(
        F.when(exact, latitude).otherwise(F.round(latitude, digits)).alias("latitude"), F.when(exact, longitude).otherwise(F.round(longitude, digits)).alias("longitude"),
        F.when(latitude.isNull() | longitude.isNull(), "none").when(exact, "exact").otherwise("approximate").alias("precision"),
    )


def iso_utc_ms(ts: Column) -> Column:
    """Text with whole milliseconds, the rest cut off."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch(ts: Column) -> Column:
    """Seconds as a double."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def bucket_start(seconds: Column, width: float) -> Column:
    """Start of the window of that width that holds a time in seconds."""
    return F.floor(seconds / width) * F.lit(float(width))


def age_hours(now: Column, then: Column) -> Column:
    return (epoch(now) - epoch(then)) / 3600


def stable_id(*parts: Column) -> Column:
    """Deterministic UUID-shaped id of the parts."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def fingerprint(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def hash_shard(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Struct (low, high) of the Wilson score interval, to three digits; (0, 1) without trials."""
    p = k / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (centre - spread) / scale), F.least(F.lit(1.0), (centre + spread) / scale)
    return F.struct(F.when(n == 0, 0.0).otherwise(F.round(low, 3)).alias("low"), F.when(n == 0, 1.0).otherwise(F.round(high, 3)).alias("high"))


def poisson_tail(k: Column, mean: Column) -> Column:
    """P(X >= k) for X ~ Poisson(mean). Small tails are summed directly, from k up to where terms vanish."""

    def term(i: Column) -> Column:
        return F.exp(-mean + i * F.log(mean) - log_factorial(i))

    def log_factorial(i: Column) -> Column:
        # Stirling's series from 16 on, which is exact to double precision there; a table below
        x = i + 1.0
        series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
        low = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(i, F.lit(16)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, j: a + F.log(j.cast("double")))
        return F.when(i <= 16, low).otherwise(series)

    total = lambda lo, hi: F.aggregate(F.sequence(lo.cast("int"), hi.cast("int")), F.lit(0.0), lambda a, i: a + term(i.cast("double")))
    tail = 1 - total(F.lit(0), F.greatest(k - 1, F.lit(0)))
    reach = F.ceil(k + 60 + 12 * F.sqrt(mean + k))
    exact = let(tail, lambda t: F.when(t > 1e-9, t).otherwise(total(k, reach)))
    return F.when(k <= 0, 1.0).when(mean <= 0, 0.0).otherwise(exact)


def tyre_ratio(*pressures: Column) -> Column:
    """Least over greatest pressure; null unless all are there."""
    there = F.lit(True)
    for p in pressures:
        there = there & p.isNotNull()
    return F.when(there, F.least(*pressures) / F.nullif(F.greatest(*pressures), F.lit(0.0)))


def coolant_residual(coolant: Column, speed: Column) -> Column:
    return coolant - (88.0 + 0.03 * speed)


def rpm_residual(rpm: Column, speed: Column) -> Column:
    return rpm - (750.0 + 28.0 * speed)


def avoided_cost(p: Column, planned: Column, unplanned: Column, downtime_per_day: Column, extra_days: Column) -> Column:
    return F.round(p * (unplanned - planned + downtime_per_day * extra_days), 2)


def is_sourced(source: Column, unplanned: Column, downtime_per_day: Column) -> Column:
    """Whether cost figures are real: not marked as placeholders, and not all zero."""
    return F.coalesce(~F.upper(source).startswith("PLACEHOLDER") & (unplanned + downtime_per_day > 0), F.lit(False))
