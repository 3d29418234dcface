"""Session helpers: a local builder for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "kgflow", extra: dict | None = None) -> SparkSession:
    """A local session configured the way the library expects.

    On a cluster the caller builds the session; nothing here is required by
    the operators themselves except UTC time and AQE, which are set per job.
    """
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets it to a shared filesystem and it is used
    as is.  Where it is unset, a local master gets a private folder; any other is
    refused, as its executors could not see this machine's folders.
    """
    current = spark.conf.get(CHECKPOINT_KEY, None)
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="kgflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_KEY, current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which every executor reaches."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kgflow/{name}-{uuid.uuid4().hex}"
