"""Unusual trouble-code rates in cohorts of the fleet, window by window (AGG11-AGG14, SET2, JOIN2, JOB11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odolith.functions import vehicle

COHORT = ("oem", "model_code", "firmware", "powertrain")


def affected(events: DataFrame, cohorts: DataFrame, window_s: float = 3600.0) -> DataFrame:
    """Distinct vehicles (k) for each window, code and cohort; events (vehicle_id, ts, dtcs), cohorts (vehicle_id and the cohort columns). Vehicles without a cohort drop out."""
    codes = events.select("vehicle_id", vehicle.bucket_start(F.col("ts"), window_s).alias("window_start"), F.explode("dtcs").alias("dtc")).distinct()
    return codes.join(cohorts.select("vehicle_id", *COHORT), "vehicle_id").groupBy("window_start", "dtc", *COHORT).agg(F.count("*").alias("k"))


def unknown_vehicles(events: DataFrame, cohorts: DataFrame) -> DataFrame:
    """How many events with codes come from vehicles that no cohort has."""
    return events.filter(F.size("dtcs") > 0).join(cohorts.select("vehicle_id"), "vehicle_id", "left_anti").agg(F.count("*").alias("n"))


def populations(cohorts: DataFrame) -> DataFrame:
    """Cohort sizes (n) with those of their model (model_n) and powertrain (powertrain_n)."""
    own = cohorts.groupBy(*COHORT).agg(F.count("*").alias("n"))
    return own.withColumn("model_n", F.sum("n").over(Window.partitionBy("model_code"))).withColumn("powertrain_n", F.sum("n").over(Window.partitionBy("powertrain")))


def tests(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """All comparisons: a firmware against the others of its model, a model against the others of its powertrain. Baseline counts are the parent's less the own; parents without others are skipped."""
    model = Window.partitionBy("window_start", "dtc", "model_code")
    firm = counts.join(sizes.select("oem", "model_code", "firmware", "powertrain", "n", "model_n"), list(COHORT))
    firm = firm.withColumn("base_k", F.sum("k").over(model) - F.col("k")).withColumn("base_n", F.col("model_n") - F.col("n"))
    firm = firm.select("window_start", "dtc", F.lit("firmware").alias("level"), "oem", "model_code", F.col("firmware").alias("firmware_version"), "powertrain", "k", "n", "base_k", "base_n", F.lit("same model, other firmware versions").alias("baseline"))
    model_sizes = sizes.groupBy("model_code").agg(F.min("oem").alias("oem"), F.min("powertrain").alias("powertrain"), F.sum("n").alias("n"), F.max("powertrain_n").alias("powertrain_n"))
    by_model = counts.groupBy("window_start", "dtc", "model_code").agg(F.sum("k").alias("k")).join(model_sizes, "model_code")
    by_model = by_model.withColumn("base_k", F.sum("k").over(Window.partitionBy("window_start", "dtc", "powertrain")) - F.col("k")).withColumn("base_n", F.col("powertrain_n") - F.col("n"))
    by_model = by_model.select("window_start", "dtc", F.lit("model").alias("level"), "oem", "model_code", F.lit(None).cast("string").alias("firmware_version"), "powertrain", "k", "n", "base_k", "base_n", F.concat(F.lit("other "), F.col("powertrain").cast("string"), F.lit(" models")).alias("baseline"))
    return firm.unionByName(by_model).filter("base_n > 0")


def compared(tested: DataFrame, window_s: float = 3600.0, min_vehicles: int = 5, min_ratio: float = 3.0, alpha: float = 0.001) -> DataFrame:
    """Comparisons whose rate is min_ratio times the smoothed baseline, and whether they are a `signal`: their Poisson tail, times the number of comparisons of the window, is below alpha."""
    counted = tested.withColumn("tests_in_window", F.count("*").over(Window.partitionBy("window_start")))
    p0 = (F.col("base_k") + 0.5) / (F.col("base_n") + 1.0)
    # the cheap tests come first, so few rows reach the tail
    rows = counted.withColumn("p0", p0).withColumn("rate", F.col("k") / F.col("n")).filter((F.col("k") >= min_vehicles) & (F.col("n") > 0) & (F.col("rate") >= min_ratio * F.col("p0")))
    rows = rows.withColumn("p_value", vehicle.poisson_tail(F.col("k"), F.col("n") * F.col("p0"))).withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p_value") * F.col("tests_in_window")))
    return rows.select(
        F.lit(1).alias("schema_version"), F.lit("EMERGING_DTC").alias("signal_type"), "level", "dtc", "oem", "model_code", "firmware_version", "powertrain", "window_start", (F.col("window_start") + window_s).alias("window_end"),
        F.col("k").alias("affected_vehicles"), F.col("n").alias("cohort_vehicles"), F.round("rate", 5).alias("rate"), "baseline", F.col("base_k").alias("baseline_affected"), F.col("base_n").alias("baseline_vehicles"),
        F.round(F.col("base_k") / F.col("base_n"), 5).alias("baseline_rate"), F.round(F.col("rate") / F.col("p0"), 2).alias("rate_ratio"), "p_value", "p_adjusted", "tests_in_window", (F.col("p_adjusted") < alpha).alias("signal"),
    )


def signals(tested: DataFrame, window_s: float = 3600.0, min_vehicles: int = 5, min_ratio: float = 3.0, alpha: float = 0.001) -> DataFrame:
    """The comparisons that are a signal."""
    return compared(tested, window_s, min_vehicles, min_ratio, alpha).filter("signal").drop("signal")


def signal_order(found: DataFrame) -> DataFrame:
    return found.orderBy("p_adjusted", "dtc", "level")


def backtest(found: DataFrame, dtc: str, model_code: str, firmware: str) -> DataFrame:
    """One row: whether the planted defect was found at firmware level, when first, and how many other signals there were."""
    hit = (F.col("dtc") == dtc) & (F.col("model_code") == model_code)
    own = hit & (F.col("level") == "firmware") & (F.col("firmware_version") == firmware)
    return found.agg((F.count_if(own) > 0).alias("found"), F.min(F.when(own, F.col("window_end"))).alias("first_detection"), F.count_if(~hit).alias("other_signals"))
