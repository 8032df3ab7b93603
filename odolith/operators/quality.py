"""Conservation, latency, service levels, audits and erasure (AGG19-AGG21, AGG26, SET4-SET5, JOB12, JOB14-JOB16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolith.functions import vehicle


def conservation(outcomes: DataFrame, stored: DataFrame, opened: DataFrame, current: DataFrame) -> DataFrame:
    """Checks (name, expected, actual, ok) over normalised rows (outcome, event_id), stored events, opened alerts and current alerts."""
    count = lambda df, name, c: df.agg(c.cast("long").alias("v")).select(F.lit(name).alias("name"), "v")
    facts = [
        count(outcomes, "raw", F.count("*")), count(outcomes, "canonical", F.count_if(F.col("outcome") == "canonical")), count(outcomes, "dlq", F.count_if(F.col("outcome") == "dlq")), count(outcomes, "duplicate", F.count_if(F.col("outcome") == "duplicate")),
        count(outcomes.filter("outcome = 'canonical'"), "ids", F.count_distinct("event_id")), count(stored, "stored", F.count_distinct("event_id")), count(opened, "opened", F.count_distinct("fingerprint")), count(current, "current", F.count("*")),
    ]
    one = reduce(DataFrame.unionByName, facts).groupBy().pivot("name", ["raw", "canonical", "dlq", "duplicate", "ids", "stored", "opened", "current"]).agg(F.first("v"))
    checks = [
        ("conserved", F.col("raw"), F.col("canonical") + F.col("dlq") + F.col("duplicate")), ("unique_ids", F.col("canonical"), F.col("ids")), ("stored_ids", F.col("ids"), F.col("stored")), ("alerts", F.col("opened"), F.col("current")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), e.alias("expected"), a.alias("actual"), (e == a).alias("ok")) for n, e, a in checks], F.struct(F.lit("not_empty").alias("name"), F.lit(1).cast("long").alias("expected"), F.least(F.col("raw"), F.lit(1)).cast("long").alias("actual"), (F.col("raw") > 0).alias("ok")))
    return one.select(F.explode(rows).alias("c")).select("c.*")


def missing_and_extra(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return only(expected, actual, "missing").unionByName(only(actual, expected, "extra"))


def latency_summary(rows: DataFrame, value: str, by: list[str], quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), under: float = 2.0) -> DataFrame:
    """n, the values at index floor(q * n) of the sorted rows, the maximum and the share under a limit, for each group. Equal values are counted together before they are ordered."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    part = Window.partitionBy(*by)
    run = counted.withColumn("upto", F.sum("c").over(part.orderBy(value))).withColumn("n", F.sum("c").over(part))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1), F.col(value)))
    return run.groupBy(*by).agg(F.max("n").alias("n"), *[at(q).alias(f"p{round(q * 100)}") for q in quantiles], F.max(value).alias("max"), (F.sum(F.when(F.col(value) < under, F.col("c")).otherwise(0)) / F.max("n")).alias("share_under"))


def bucket_quantile(rows: DataFrame, value: str, by: list[str], bounds: list[float], q: float) -> DataFrame:
    """Quantile from a histogram with upper bounds (the last one open), by linear interpolation in its bucket; the last bound if it lies beyond."""
    held = rows.filter(F.col(value).isNotNull()).withColumn("b", sum((F.col(value) > x).cast("int") for x in bounds))
    hist = held.groupBy(*by, "b").agg(F.count("*").alias("c"))
    part = Window.partitionBy(*by)
    hist = hist.withColumn("upto", F.sum("c").over(part.orderBy("b"))).withColumn("n", F.sum("c").over(part)).withColumn("want", F.col("n") * q)
    hit = hist.filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("c") < F.col("want")))
    edges = F.array(F.lit(0.0), *[F.lit(float(x)) for x in bounds])
    lo, hi = F.element_at(edges, F.col("b") + 1), F.try_element_at(edges, F.col("b") + 2)
    inside = lo + (hi - lo) * (F.col("want") - (F.col("upto") - F.col("c"))) / F.col("c")
    return hit.select(*by, "n", F.coalesce(inside, F.lit(float(bounds[-1]))).alias("quantile"))


def ratio_windows(rows: DataFrame, ts: str, bad: Column, windows_s: tuple[int, ...], step_s: int, by: list[str] | None = None) -> DataFrame:
    """For every step that has rows: the share of bad rows over each window that ends with it. Rows are summed by step first."""
    by = by or []
    steps = rows.withColumn("step", (F.floor(F.col(ts) / step_s) * step_s).cast("long")).groupBy(*by, "step").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    out = [c for c in by] + ["step"]
    for w in windows_s:
        win = Window.partitionBy(*by).orderBy("step").rangeBetween(-(w - step_s), 0)
        steps = steps.withColumn(f"ratio_{w}", F.sum("bad").over(win) / F.sum("n").over(win))
        out.append(f"ratio_{w}")
    return steps.select(*out)


def burn_alerts(ratios: DataFrame, budget: float, pairs: tuple[tuple[int, int, float], ...]) -> DataFrame:
    """`burning`: some pair (long, short, factor) has both windows over factor * budget."""
    over = [(F.col(f"ratio_{a}") > factor * budget) & (F.col(f"ratio_{b}") > factor * budget) for a, b, factor in pairs]
    return ratios.withColumn("burning", reduce(Column.__or__, over))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows (key, rule) for each rule that a row breaks; a rule that is null holds."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


ALERT_RULES = {
    "resolved_has_time": lambda: (F.col("status") != "resolved") | F.col("resolved_at").isNotNull(),
    "acknowledged_has_both": lambda: F.col("acknowledged_at").isNull() == F.col("acknowledged_by").isNull(),
    "detected_after_event": lambda: F.col("detected_at") >= F.col("event_ts"),
}
ORDER_RULES = {
    "completed_has_time": lambda: (F.col("status") != "completed") | F.col("completed_at").isNotNull(),
    "scheduled_has_date": lambda: ~F.col("status").isin("scheduled", "in_progress") | F.col("scheduled_for").isNotNull(),
    "probability": lambda: F.col("failure_probability").between(0, 1),
}


def foreign_tenant(df: DataFrame, parents: DataFrame, key: str, tenant: str = "tenant_id") -> DataFrame:
    """Rows whose parent is missing or belongs to another tenant."""
    p = parents.select(F.col(key), F.col(tenant).alias("_t"))
    return df.join(p, key, "left").filter(F.col("_t").isNull() | (F.col("_t") != F.col(tenant))).drop("_t")


def vin_audit(vehicles: DataFrame, oems: DataFrame) -> DataFrame:
    """Vehicles by manufacturer and verdict: bad_shape, bad_check_digit, bad_year or ok; vehicles (vin, oem, model_year)."""
    rows = vehicles.join(F.broadcast(oems.select("oem", "check_digit")), "oem", "left").withColumn("check_digit", F.coalesce("check_digit", F.lit(True)))
    shaped = F.coalesce(F.col("vin").rlike(vehicle.VIN_PATTERN), F.lit(False))
    verdict = F.when(~shaped, "bad_shape").when(~vehicle.vin_is_valid(F.col("vin"), F.col("check_digit")), "bad_check_digit").when(~F.coalesce(vehicle.model_year(F.col("vin")) == F.col("model_year"), F.lit(False)), "bad_year").otherwise("ok")
    return rows.groupBy("oem", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def dtc_census(rows: DataFrame, text: str, vehicle_id: str, catalog: DataFrame) -> DataFrame:
    """Codes in free text: rows that have each, distinct vehicles, system, generic flag, severity and failure mode."""
    found = rows.select(F.col(vehicle_id), F.explode(vehicle.dtc_extract(F.coalesce(F.col(text), F.lit("")))).alias("code"))
    counted = found.groupBy("code").agg(F.count("*").alias("occurrences"), F.count_distinct(vehicle_id).alias("vehicles"))
    return counted.join(F.broadcast(catalog), "code", "left").select("code", "occurrences", "vehicles", vehicle.dtc_system(F.col("code")).alias("system"), vehicle.dtc_is_generic(F.col("code")).alias("generic"), "severity", "failure_mode")


def erased(history: DataFrame, subjects: DataFrame, key: str, columns: tuple[str, ...] = ("latitude", "longitude")) -> DataFrame:
    """history with the columns null for all subjects."""
    marked = history.join(subjects.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in columns}).drop("_gone")


def erasure_report(history: DataFrame, links: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Rows of history that lose their position and links that are deleted, for each subject."""
    n = lambda df, name: df.join(subjects.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias(name))
    return subjects.select(key).distinct().join(n(history, "rows_masked"), key, "left").join(n(links, "links_deleted"), key, "left").fillna(0).withColumn("status", F.lit("completed"))


def without_links(links: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    return links.join(subjects.select(key).distinct(), key, "left_anti")
