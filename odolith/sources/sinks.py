"""Sinks: routed outcomes, typed history, snapshots, retention, exports (SNK1-SNK19, STR7, STR10)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odolith.functions import catalog
from odolith.operators.windows import latest_version
from odolith.sources import keyed_log

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def dlq_records(rows: DataFrame) -> DataFrame:
    """Rejected rows: payload, reason, detail (200 letters), where it came from, and the time in milliseconds."""
    place = F.concat_ws("/", F.col("topic"), F.col("partition").cast("string"), F.col("offset").cast("string"))
    return rows.filter("outcome = 'dlq'").select(F.col("value").alias("payload"), "reason", F.substring("detail", 1, 200).alias("detail"), place.alias("source"), F.unix_millis("ingest_ts").alias("at_ms"), F.to_date("ingest_ts").alias("event_date"))


def typed_events(rows: DataFrame) -> DataFrame:
    """Parsed canonical rows without an error, with 0 for a missing heading or odometer."""
    good = rows.filter(F.col("_corrupt").isNull())
    return good.withColumn("heading_deg", F.coalesce("heading_deg", F.lit(0))).withColumn("odometer_km", F.coalesce("odometer_km", F.lit(0.0))).drop("_corrupt", "value")


def ingestion_errors(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("_corrupt").isNotNull()).select("topic", "partition", "offset", F.lit("cannot parse").alias("error"), F.col("value").alias("raw"))


def write_by_day(df: DataFrame, path: str, ts: str = "event_ts", order: tuple[str, ...] = ("tenant_id", "vehicle_id", "event_ts", "seq")) -> None:
    """Append to day partitions, sorted in each file."""
    days = df.withColumn("event_date", F.to_date(ts))
    days.sortWithinPartitions("event_date", *order).write.mode("append").partitionBy("event_date").option("compression", "zstd").parquet(path)


def final_events(df: DataFrame) -> DataFrame:
    """Replays collapsed: the last ingest of each (tenant, vehicle, time, seq)."""
    return latest_version(df, ["tenant_id", "vehicle_id", "event_ts", "seq"], ["ingest_ts"])


def final_alerts(df: DataFrame) -> DataFrame:
    return latest_version(df, ["tenant_id", "vehicle_id", "fingerprint", "status"], ["detected_at"])


def final_signals(df: DataFrame) -> DataFrame:
    named = df.withColumn("firmware_version", F.coalesce("firmware_version", F.lit("")))
    return latest_version(named, ["model_code", "firmware_version", "dtc", "level", "window_start"], ["received_at"])


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Rows of one micro-batch (they have event_date) as partitions of their own: the same batch, written again, takes its earlier rows' place."""
    parts = df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    parts.partitionBy("event_date", "batch_id").option("compression", "zstd").parquet(path)


def route(batch: DataFrame, batch_id: int, canonical_path: str, dlq_path: str) -> None:
    """For foreachBatch: one computation of the batch, then each outcome to its place. A replayed batch changes nothing."""
    held = batch.persist()
    try:
        days = held.filter("outcome = 'canonical'").withColumn("event_date", F.to_date("event_ts"))
        write_batch(days.sortWithinPartitions("event_date", "tenant_id", "vehicle_id", "event_ts", "seq"), canonical_path, batch_id)
        write_batch(dlq_records(held), dlq_path, batch_id)
    finally:
        held.unpersist()


def current_alerts(current: DataFrame, transitions: DataFrame) -> DataFrame:
    """current (fingerprint, status, detected_at, resolved_at) after transitions (fingerprint, status, detected_at): an opening adds what is absent; a clearing resolves what is open or acknowledged, and never changes a resolution."""
    news = transitions.groupBy("fingerprint").agg(F.min(F.when(F.col("status") == "open", F.col("detected_at"))).alias("_opened"), F.max(F.when(F.col("status") == "cleared", F.col("detected_at"))).alias("_cleared"))
    j = current.join(news, "fingerprint", "full_outer")
    detected = F.coalesce("detected_at", "_opened")
    state = F.coalesce("status", F.when(F.col("_opened").isNotNull(), "open"))
    resolves = F.col("_cleared").isNotNull() & state.isin("open", "acknowledged")
    out = j.select("fingerprint", F.when(resolves, "resolved").otherwise(state).alias("status"), detected.alias("detected_at"), F.when(resolves, F.coalesce("resolved_at", F.greatest("_cleared", detected))).otherwise(F.col("resolved_at")).alias("resolved_at"))
    return out.filter("status IS NOT NULL")  # a clearing alone makes no alert


def split_poison(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that keep a constraint, and the rest; null breaks it."""
    good = F.coalesce(ok, F.lit(False))
    return df.filter(good), df.filter(~good)


def latest_state(states: DataFrame, now: Column, ttl_s: int = 3600, key: str = "vehicle_id") -> DataFrame:
    """The last state of each vehicle that is not older than the limit."""
    return latest_version(states, [key], ["as_of"]).filter(F.unix_micros("as_of") >= F.unix_micros(now) - ttl_s * 1_000_000)


def health_ranking(latest: DataFrame) -> DataFrame:
    """Vehicles by tenant, the least healthy first, with their last positions."""
    return latest.select("tenant_id", "vehicle_id", "health_score", "latitude", "longitude").repartitionByRange("tenant_id").sortWithinPartitions("tenant_id", "health_score", "vehicle_id")


def replace_snapshot(df: DataFrame, root: str, name: str) -> str:
    """Write a new version beside the old ones: readers see all of it or the one before."""
    path = f"{root}/{name}/v{max(snapshot_versions(df.sparkSession, root, name), default=0) + 1}"
    df.write.mode("overwrite").parquet(path)
    return path


def snapshot_versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Versions that are complete, which their success file tells."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The last version of a snapshot, or of a keyed log."""
    held = keyed_log.read(spark, root, name)
    return spark.read.parquet(f"{root}/{name}/v{snapshot_versions(spark, root, name)[-1]}") if held is None else held


def score_history(scores: DataFrame, contributions: str) -> DataFrame:
    """Scores with their top features as a map."""
    return scores.withColumn("top_features", F.map_from_entries(contributions)).drop(contributions)


RETENTION_DAYS = {"events": 30, "rollup": 400, "alerts": 400, "signals": 400, "scores": 180, "dlq": 7}


def retained(df: DataFrame, table: str, today: Column, day: str = "event_date") -> DataFrame:
    """Rows that are not past the table's retention; on a day-partitioned table this reads only the kept partitions."""
    return df.filter(F.col(day) >= F.date_sub(today, RETENTION_DAYS[table]))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """new rows added, and the named columns of matching old ones replaced; null in new counts as no value."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    j = old.join(n, keys, "full_outer")
    return j.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns if c not in keys])


def export_run(tables: dict[str, DataFrame], path: str, rows_a_file: int = 200_000) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/{name}.parquet")


def cached_table(spark: SparkSession, root: str, config: dict, version: int, build) -> DataFrame:
    """A derived table kept under a digest of its configuration and version; built if it is not there."""
    digest = hashlib.sha256(json.dumps(config | {"_version": version}, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root}/{digest}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def alert_feed(df: DataFrame, path: str, checkpoint: str):
    """A stream of alerts to one folder for each tenant."""
    return df.writeStream.format("parquet").partitionBy("tenant_id").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CANONICAL_RULES = {"event_id": UUID, "vin": "^.{17}$"}
CANONICAL_ENUM = {"event_type": catalog.EVENT_TYPES}
