import math

from pyspark.sql import functions as F

from odolith.functions import vehicle


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_vin(spark):
    lit = F.lit
    assert value(spark, vehicle.vin_check_digit(lit("1M8GDM9AXKP042788"))) == "X"
    assert value(spark, vehicle.vin_is_valid(lit("1M8GDM9AXKP042788"), lit(True))) and not value(spark, vehicle.vin_is_valid(lit("1M8GDM9A1KP042788"), lit(True)))
    assert value(spark, vehicle.vin_is_valid(lit("1M8GDM9A1KP042788"), lit(False))) and not value(spark, vehicle.vin_is_valid(lit("IOQ00000000000000"), lit(False)))
    assert not value(spark, vehicle.vin_is_valid(lit(None).cast("string"), lit(False)))
    assert value(spark, vehicle.model_year(lit("1M8GDM9AXKP042788"))) == 2019 and value(spark, vehicle.model_year_code(lit(2039))) == "9" and value(spark, vehicle.model_year_code(lit(2040))) is None


def test_codes(spark):
    assert value(spark, vehicle.dtc_extract(F.lit("codes: p0301,P0420; p0301 xP0217 U0100."))) == ["P0301", "P0420", "U0100"]
    assert value(spark, vehicle.dtc_clean(F.array(F.lit("P0420"), F.lit("zz"), F.lit(None), F.lit("P0301"), F.lit("P0420")))) == ["P0301", "P0420"]
    assert value(spark, vehicle.dtc_system(F.lit("U0100"))) == "network" and value(spark, vehicle.dtc_is_generic(F.lit("P0301"))) and not value(spark, vehicle.dtc_is_generic(F.lit("P1301")))


def test_geo(spark):
    assert value(spark, vehicle.geohash(F.lit(57.64911), F.lit(10.40744), 11)) == "u4pruydqqvj"
    centre = value(spark, vehicle.geohash_centre(F.lit("u4pruydqqvj")))
    assert abs(centre.latitude - 57.64911) < 1e-5 and abs(centre.longitude - 10.40744) < 1e-5
    assert value(spark, vehicle.geohash(F.lit(91.0), F.lit(0.0), 5)) is None
    assert abs(value(spark, vehicle.haversine_km(F.lit(13.0827), F.lit(80.2707), F.lit(12.9716), F.lit(77.5946))) - 290) < 5
    masked = value(spark, vehicle.mask_location(F.lit(13.08271), F.lit(80.27), F.lit(False)))
    assert (masked.latitude, masked.precision) == (13.08, "approximate")


def test_statistics(spark):
    sf = lambda k, m: value(spark, vehicle.poisson_tail(F.lit(k), F.lit(m)))
    assert sf(0, 3.0) == 1 and abs(sf(1, 2.0) - (1 - math.exp(-2))) < 1e-12 and 0 < sf(40, 0.5) < 1e-40 and sf(5, 0.0) == 0
    for k, m in ((3, 2.5), (30, 12.0), (80, 40.0), (200, 90.0)):
        direct = sum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(k, k + 600))
        assert abs(sf(k, m) - direct) <= 1e-9 * direct + (1e-12 if direct > 1e-9 else 0)
    w = value(spark, vehicle.wilson(F.lit(8), F.lit(10)))
    assert (w.low, w.high) == (0.49, 0.943)
    none = value(spark, vehicle.wilson(F.lit(0), F.lit(0)))
    assert (none.low, none.high) == (0.0, 1.0)
    assert value(spark, vehicle.tyre_ratio(*[F.lit(x) for x in (200.0, 240.0, 220.0, 230.0)])) == 200 / 240
    assert value(spark, vehicle.tyre_ratio(F.lit(1.0), F.lit(None).cast("double"))) is None


def test_ids_and_times(spark):
    assert value(spark, vehicle.stable_id(F.lit("v"), F.lit(5))) == value(spark, vehicle.stable_id(F.lit("v"), F.lit(5)))
    assert value(spark, F.regexp_count(vehicle.stable_id(F.lit("v"), F.lit(5)), F.lit("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))) == 1
    assert value(spark, vehicle.iso_utc_ms(F.lit("2026-09-21 14:13:20.2509").cast("timestamp"))) == "2026-09-21T14:13:20.250Z"
    assert value(spark, vehicle.bucket_start(F.lit(125.0), 60)) == 120
