"""Session helpers: a local session for tests and benches, and the shared scratch folder.

Library functions never create sessions; they take DataFrames. These helpers exist for
callers that start from nothing (tests, bench, the driver entry points).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "starweave") -> SparkSession:
    """A local session with AQE on and the UI off.

    On a cluster the platform supplies the session; nothing here is needed there.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session. When it is unset, a local-mode session (tests, a laptop) gets a
    folder under the system temp dir, registered so later ``checkpoint()`` calls use it too;
    any other master must name a shared folder, since a machine-local one is not visible to
    every executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="starweave-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique sub-path of the shared checkpoint folder for derived tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{label}-{uuid.uuid4().hex}"


def strip_scheme(path: str) -> str:
    """Local path of a ``file:`` URI; other schemes are returned unchanged."""
    if path.startswith("file:"):
        rest = path[len("file:"):]
        while rest.startswith("//"):
            rest = rest[1:]
        return os.path.normpath(rest)
    return path
