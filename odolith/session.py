"""What a query needs from its session: shared scratch tables and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
BATCH_BYTES, DEFAULT_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Only a session on one machine does without; it gets a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="odolith-", dir="/tmp"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/odolith/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back: lineage ends here, whichever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send the package's own modules to the executors, once for each application, and keep their Arrow batches small."""
    sc = spark.sparkContext
    # a batch of 10,000 long texts would fill a worker; a limit that the user has lowered stays
    if spark.conf.get(BATCH_BYTES, None) == DEFAULT_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, "16m")
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="odolith-", dir=tempfile.gettempdir())) / f"{top.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)
