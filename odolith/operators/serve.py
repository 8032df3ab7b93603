"""Tenant-scoped reads: summaries, pages, rankings, masking (AGG7-AGG8, TOP1-TOP5, JOIN18-JOIN20, JOIN24, JOB13, FN6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.functions import vehicle


def tenant_scope(df: DataFrame, tenant: str | int | None, column: str = "tenant_id") -> DataFrame:
    """The rows of one tenant; none without a tenant."""
    return df.filter(F.lit(False)) if tenant is None else df.filter(F.col(column) == tenant)


def conditional_counts(df: DataFrame, counts: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Several counts in one pass over a table."""
    return df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def fleet_summary(vehicles: DataFrame, alerts: DataFrame, orders: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """Counts for each tenant: vehicles, open and critical alerts, orders by state. One pass over each table."""
    v = vehicles.groupBy(tenant).agg(F.count("*").alias("vehicles"))
    a = conditional_counts(alerts, {"open_alerts": F.col("status") == "open", "critical_alerts": (F.col("status") == "open") & (F.col("severity") == "critical"), "acknowledged_alerts": F.col("status") == "acknowledged"}, [tenant])
    o = conditional_counts(orders, {"proposed_orders": F.col("status") == "proposed", "scheduled_orders": F.col("status") == "scheduled", "active_orders": F.col("status") == "in_progress", "completed_orders": F.col("status") == "completed"}, [tenant])
    out = v.join(a, tenant, "left").join(o, tenant, "left")
    return out.fillna(0, [c for c in out.columns if c != tenant])


def open_alert_counts(vehicles: DataFrame, alerts: DataFrame, key: str = "vehicle_id") -> DataFrame:
    n = alerts.filter(F.col("status") == "open").groupBy(key).agg(F.count("*").alias("open_alerts"))
    return vehicles.join(n, key, "left").withColumn("open_alerts", F.coalesce("open_alerts", F.lit(0)))


def keyset_page(df: DataFrame, order: list[str], limit: int, after: tuple | None = None, filters: dict[str, object] | None = None) -> DataFrame:
    """The next `limit` rows below `after`, all columns descending; `more` tells whether others follow. Filters of None are off."""
    for c, v in (filters or {}).items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    if after is not None:
        # (a, b) < (x, y) written out: a < x, or a = x and b < y
        steps = [reduce(Column.__and__, [F.col(p) == v for p, v in zip(order[:i], after)] + [F.col(order[i]) < after[i]]) for i in range(len(order))]
        df = df.filter(reduce(Column.__or__, steps))
    page = df.orderBy(*[F.desc(c) for c in order]).limit(limit + 1)
    # at most limit + 1 rows are left here
    rank = F.row_number().over(_everything(order))
    return page.withColumn("_r", rank).withColumn("more", F.count("*").over(_whole()) > limit).filter(F.col("_r") <= limit).drop("_r")


def _everything(order: list[str]):
    from pyspark.sql import Window

    return Window.orderBy(*[F.desc(c) for c in order])


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy()


def named_page(page: DataFrame, names: list[tuple[DataFrame, str]]) -> DataFrame:
    """Page rows with names from dimensions, joined after the limit."""
    return reduce(lambda p, d: p.join(d[0], d[1], "left"), names, page)


def at_risk(scores: DataFrame, states: DataFrame, vehicles: DataFrame, k: int, key: str = "vehicle_id") -> DataFrame:
    """The k vehicles of the highest model score, or where there are no scores the k of the lowest health below 100. Unknown vehicles drop out. `source` says which."""
    have = scores.limit(1).count() > 0
    if have:
        ranked = scores.select(key, F.col("score").alias("rank_value"), F.lit("model").alias("source")).join(vehicles, key)
        return ranked.orderBy(F.desc("rank_value"), key).limit(k)
    ranked = states.filter(F.col("health_score") < 100).select(key, F.col("health_score").cast("double").alias("rank_value"), F.lit("health").alias("source")).join(vehicles, key)
    return ranked.orderBy("rank_value", key).limit(k)


def recent_signals(signals: DataFrame, now: float, hours: float, limit: int = 200) -> DataFrame:
    return signals.filter(F.col("window_end") >= now - hours * 3600).orderBy(F.desc("window_end"), F.asc("p_value"), "dtc", "level").limit(limit)


def signals_of_tenant(signals: DataFrame, vehicles: DataFrame, model: str = "model_code") -> DataFrame:
    """Signals about models that the tenant has."""
    return signals.join(vehicles.select(model).distinct(), model, "left_semi")


def masked_positions(df: DataFrame, exact: Column, digits: int = 2) -> DataFrame:
    place = vehicle.mask_location(F.col("latitude"), F.col("longitude"), exact, digits)
    return df.withColumn("_m", place).withColumn("latitude", F.col("_m.latitude")).withColumn("longitude", F.col("_m.longitude")).withColumn("precision", F.col("_m.precision")).drop("_m")


def timeline(subjects: DataFrame, alerts: DataFrame, orders: DataFrame, start: float) -> DataFrame:
    """First alert and first order of each subject vehicle, in hours from the start."""
    first = lambda df, kind: df.join(subjects, "vehicle_id", "left_semi").groupBy("vehicle_id").agg(F.min("ts").alias("ts")).select("vehicle_id", F.lit(kind).alias("kind"), ((F.col("ts") - start) / 3600).alias("hours"))
    return first(alerts, "alert").unionByName(first(orders, "order")).orderBy("hours", "vehicle_id", "kind")
