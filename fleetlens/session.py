"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


MIB = 1024**2


def initial_partitions(shuffle_bytes: int) -> int:
    """Shuffle partitions of about 128 MiB each; adaptive execution merges what turns out smaller."""
    return min(max(-(-shuffle_bytes // (128 * MIB)), 200), 100_000)


def build_session(
    app: str = "fleetlens", master: str | None = None, shuffle_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Session with UTC time and adaptive execution.

    `shuffle_bytes` is the size of the largest expected shuffle: adaptive execution merges and splits
    partitions, but a plain shuffle starts from the number set here. Settings in `conf` win.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A repeated attribute or label in one record must not end a job.
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        **({"spark.sql.shuffle.partitions": str(initial_partitions(shuffle_bytes))} if shuffle_bytes else {}),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names a shared folder in ``spark.checkpoint.dir``; executors and a restarted
    driver can all see it. Only in local mode, where one machine does all, is a fresh temporary folder
    taken if it is unset; on a cluster that is an error, as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="fleetlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/fleetlens/{label}-{uuid.uuid4().hex}"
