"""A keyed table kept as a log: each batch adds the rows it brings, buckets that have grown are compacted, old files go.

Layout of root/name: data/<d or c><batch>/bucket=<n>/ holds Parquet rows, manifest/v<batch + 1> names for each bucket the
folders that make it up, with their rows. A version counts once its manifest is complete, so readers see a whole batch
or none of it, and a replayed batch does nothing. One log belongs to one stream checkpoint, whose batches count up.

A batch of n rows writes n rows at most, besides compaction: a bucket is written anew when its added rows have reached
half of its base (and at least COMPACT_ROWS), or came in MOST_PARTS batches, so the rows written are a small multiple of
the rows that came. Keys go to buckets by hash; a null key is a key of its own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, COMPACT_ROWS, MOST_PARTS = 32, 1_000, 16
#: Versions whose files stay for readers that have begun; older ones are removed.
KEPT_VERSIONS = 2
MANIFEST = "bucket int, part string, rows bigint, keys array<string>, version array<string>"


class Part(NamedTuple):
    """A folder that holds `rows` rows of a bucket."""

    bucket: int
    part: str
    rows: int


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Versions that are complete, which their success file tells."""
    found = []
    for v in _names(spark, f"{root}/{name}/manifest"):
        done, fs = _folder(spark, f"{root}/{name}/manifest/{v}/_SUCCESS")
        if v.startswith("v") and fs.exists(done):
            found.append(int(v[1:]))
    return sorted(found)


def manifest(spark: SparkSession, root: str, name: str, version: int) -> list:
    """One row for each bucket and part, at most BUCKETS * (MOST_PARTS + 1)."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/{name}/manifest/v{version}").collect()


def newest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*version)).alias("r")).select("r.*")


def bucket_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _parts(spark: SparkSession, root: str, name: str, entries: list) -> DataFrame | None:
    """All rows of the parts of some buckets, with `_bucket`."""
    by_part: dict[str, list[int]] = {}
    for e in entries:
        by_part.setdefault(e.part, []).append(e.bucket)
    out = None
    for part, buckets in sorted(by_part.items()):
        rows = spark.read.option("basePath", f"{root}/{name}/data/{part}").parquet(*[f"{root}/{name}/data/{part}/_bucket={b}" for b in sorted(buckets)])
        out = rows if out is None else out.unionByName(rows)
    return out


def read(spark: SparkSession, root: str, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest row of each key as of a version (the last one by default); None if there is none, or nothing in these buckets."""
    have = [v for v in versions(spark, root, name) if version is None or v <= version]
    entries = manifest(spark, root, name, have[-1]) if have else []
    chosen = [e for e in entries if buckets is None or e.bucket in buckets]
    if not chosen:
        return None
    return newest(_parts(spark, root, name, chosen).drop("_bucket"), chosen[0].keys, chosen[0].version)


def append(rows: DataFrame, batch_id: int, root: str, name: str, keys: list[str], version: list[str]) -> None:
    """Add a batch's rows (the newest of each key), as version batch_id + 1; a batch that the log has already changes nothing."""
    spark, at = rows.sparkSession, batch_id + 1
    last = max(versions(spark, root, name), default=0)
    if at <= last:
        return
    parts = [Part(e.bucket, e.part, e.rows) for e in manifest(spark, root, name, last)] if last else []
    parts += _write(newest(rows, keys, version), keys, f"{root}/{name}/data", f"d{at}")
    grown = set()
    for b in {p.bucket for p in parts}:
        base, *added = [p.rows for p in parts if p.bucket == b]
        if added and (sum(added) >= max(COMPACT_ROWS, base / 2) or len(added) >= MOST_PARTS):
            grown.add(b)
    if grown:
        merged = newest(_parts(spark, root, name, [p for p in parts if p.bucket in grown]).drop("_bucket"), keys, version)
        parts = [p for p in parts if p.bucket not in grown] + _write(merged, keys, f"{root}/{name}/data", f"c{at}")
    spark.createDataFrame([(*p, keys, version) for p in parts], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/manifest/v{at}")
    _clean(spark, root, name, at)


def _write(rows: DataFrame, keys: list[str], data: str, part: str) -> list[Part]:
    """Writes rows by bucket; bucket, part and number of rows of what was written."""
    placed = rows.withColumn("_bucket", bucket_of(keys))
    placed.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").option("compression", "zstd").parquet(f"{data}/{part}")
    if not any(n.startswith("_bucket=") for n in _names(rows.sparkSession, f"{data}/{part}")):
        return []
    counts = rows.sparkSession.read.parquet(f"{data}/{part}").groupBy("_bucket").count().collect()  # one row for each bucket
    return sorted(Part(r["_bucket"], part, r["count"]) for r in counts)


def _clean(spark: SparkSession, root: str, name: str, at: int) -> None:
    """Remove manifests before the last KEPT_VERSIONS and parts that none of those names."""
    have = versions(spark, root, name)
    kept = [v for v in have if v > at - KEPT_VERSIONS]
    used = {e.part for v in kept for e in manifest(spark, root, name, v)}
    for folder, names in (("manifest", {f"v{v}" for v in have if v <= at - KEPT_VERSIONS}), ("data", {p for p in _names(spark, f"{root}/{name}/data") if p not in used and int(p[1:]) <= at})):
        for x in names:
            p, fs = _folder(spark, f"{root}/{name}/{folder}/{x}")
            fs.delete(p, True)
