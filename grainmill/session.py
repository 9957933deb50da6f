"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
LOCAL_DIR = "/tmp/checkpoints"
BROADCAST_BYTES = "grainmill.broadcast.bytes"
BROADCAST_ROWS = "grainmill.broadcast.rows"
TASK_ROWS = "grainmill.task.rows"


def build_session(app: str = "grainmill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is written for.

    Nothing here sizes the cluster; executors, memory and shuffle partitions belong to the submit command.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it; only a local session may leave it unnamed."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    local = spark.sparkContext.master.startswith("local")
    if not local and (not named or named.startswith("file:")):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share, not {named}")
    if not named:
        spark.conf.set(CHECKPOINT_DIR, named := LOCAL_DIR)
    return named.rstrip("/")


def share_code(spark: SparkSession) -> None:
    """Puts the package on the import path of Python workers (separate machines get it by --py-files)."""
    home = str(Path(__file__).resolve().parents[1])
    now = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in now.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{home}:{now}".rstrip(":")


def fresh_path(spark: SparkSession, name: str) -> str:
    """New path under the shared folder; no two calls return the same one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def order_buckets(spark: SparkSession) -> int:
    """How many ranges a global order is cut into: follows the shuffle partitions, within fixed bounds."""
    return min(4096, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def broadcast_bytes(spark: SparkSession) -> int:
    """A written table of up to this many bytes of files may be sent to every executor; files hold about a tenth of
    what rows take in memory."""
    return int(spark.conf.get(BROADCAST_BYTES, str(16 << 20)))


def broadcast_rows(spark: SparkSession) -> int:
    """A written table of up to this many rows may be sent to every executor: numbered words take 10 bytes each in files and
    hundreds on the driver, where the table is built."""
    return int(spark.conf.get(BROADCAST_ROWS, "200000"))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_rows(spark: SparkSession) -> int:
    """A written table of up to this many narrow rows may be sorted or counted up in one task."""
    return int(spark.conf.get(TASK_ROWS, "500000"))
