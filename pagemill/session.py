"""Session helpers: recommended settings and the shared folder for checkpoints and stream state."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# AQE plans joins from measured sizes: sides under the threshold are broadcast, larger ones are
# shuffled with skewed partitions split. The library itself never forces a broadcast.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build(app: str = "pagemill", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**RECOMMENDED, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for an unset local session."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is not None:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="pagemill-")
    sc.setCheckpointDir(local)
    return local


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of this session, once; they need not have it installed."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_pagemill_shipped", False) or not package.is_dir():  # or it came as a zip with --py-files
        return
    packed = Path(tempfile.mkdtemp(prefix="pagemill-")) / "pagemill.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(packed))  # the driver serves the file to the executors
    sc._pagemill_shipped = True


def run_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
