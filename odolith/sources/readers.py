"""Sources: raw and canonical streams, registry, dimensions, calibration, training runs (SRC1-SRC11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolith.functions import catalog

RAW = "key binary, value binary, headers array<struct<key:string,value:binary>>, topic string, partition int, offset bigint, timestamp timestamp"


def read_raw_stream(spark: SparkSession, servers: str | None = None, topics: str = "telemetry.raw", path: str | None = None, max_rows: int = 2000, max_files: int = 1) -> DataFrame:
    """A bounded micro-batch stream of raw messages, from Kafka or, where there is no broker, from Parquet files of the same shape."""
    if servers:
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("includeHeaders", "true").option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_rows)
        return reader.load()
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", max_files).parquet(path)


def header(name: str):
    """One header of a raw message as text, the last of its name."""
    return F.try_element_at(F.filter("headers", lambda h: h["key"] == name), F.lit(-1))["value"].cast("string")


def raw_messages(df: DataFrame) -> DataFrame:
    """Raw messages with their manufacturer and schema headers, as normalise() takes them."""
    return df.select(F.col("value").cast("string").alias("value"), header("oem").alias("oem"), header("schema").alias("schema"), "topic", "partition", "offset", "timestamp")


def topic(df: DataFrame, name: str) -> DataFrame:
    """One of several topics that a query reads."""
    return df.filter(F.col("topic") == name)


def parsed_json(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON rows in a fixed schema: unknown fields are skipped, and what cannot be parsed is in _corrupt."""
    typed = F.from_json(F.col(value).cast("string"), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn("_j", typed).select("*", "_j.*").drop("_j")


def read_canonical(df: DataFrame) -> DataFrame:
    return parsed_json(df, catalog.CANONICAL)


def read_alerts(df: DataFrame) -> DataFrame:
    return parsed_json(df, catalog.ALERT)


def read_signals(df: DataFrame) -> DataFrame:
    """Signals with their windows as timestamps too."""
    out = parsed_json(df, catalog.SIGNAL)
    return out.withColumn("window_start_ts", F.timestamp_seconds("window_start")).withColumn("window_end_ts", F.timestamp_seconds("window_end"))


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str | None = None, url: str | None = None, table: str | None = None, **options: str) -> DataFrame:
    """A dimension from Parquet or over JDBC."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load() if url else spark.read.parquet(path)


def registry(vehicles: DataFrame) -> DataFrame:
    """vin, vehicle_id, tenant_id, registered_oem of vehicles that are not retired; padding is stripped."""
    return vehicles.filter(F.coalesce(F.col("status") != "retired", F.lit(True))).select(F.trim("vin").alias("vin"), "vehicle_id", "tenant_id", F.col("oem").alias("registered_oem"))


def cohorts(vehicles: DataFrame, models: DataFrame) -> DataFrame:
    """vehicle_id, oem, model_code, firmware, powertrain."""
    return vehicles.drop("oem", "powertrain").join(F.broadcast(models), "model_code").select("vehicle_id", "oem", "model_code", F.trim("firmware_version").alias("firmware"), "powertrain")


def fleet_for_scoring(vehicles: DataFrame, models: DataFrame) -> DataFrame:
    active = vehicles.filter(F.coalesce(F.col("status") != "retired", F.lit(True)))
    return active.drop("powertrain").join(F.broadcast(models.select("model_code", "powertrain")), "model_code").select("vehicle_id", "tenant_id", "model_code", "powertrain")


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """rule_code, p_failure, p10_h from a calibration file; the fallback has a null rule."""
    schema = "version string, horizon_hours double, rules map<string,struct<p_failure:double,hours_to_failure_p10:double>>, fallback struct<p_failure:double,hours_to_failure_p10:double>"
    one = spark.read.schema(schema).option("multiLine", "true").json(path)
    rules = one.select(F.explode("rules").alias("rule_code", "r")).select("rule_code", "r.p_failure", F.col("r.hours_to_failure_p10").alias("p10_h"))
    return rules.unionByName(one.select(F.lit(None).cast("string").alias("rule_code"), "fallback.p_failure", F.col("fallback.hours_to_failure_p10").alias("p10_h")))


def training_runs(runs: list[DataFrame]) -> DataFrame:
    """Several runs as one table, `run` numbering them."""
    out = None
    for i, df in enumerate(runs):
        one = df.withColumn("run", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
