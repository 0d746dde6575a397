"""Session construction and the shared working folder.

Lineage cuts and intermediate files go to the folder the cluster names in
``spark.checkpoint.dir``.  A private fallback folder is created only when the
session runs in local mode and nothing is configured (tests, local bench).
"""

from __future__ import annotations

import gc
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "rivulet", extra: dict | None = None) -> SparkSession:
    parts = shuffle_partitions or (8 if cpus == "*" else int(cpus))
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only in local mode."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if d:
            sc.setCheckpointDir(d)
            d = sc.getCheckpointDir() or d
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a shared folder is required on a cluster")
        d = tempfile.mkdtemp(prefix="rivulet-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder path below the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def opened(uri: str):
    """(pyarrow file system, path in it) of a path below the shared folder."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files and checkpoints of a finished query when the driver's JVM finds that nothing
    refers to it any more; left alone, that is when memory runs short, however full the disks are."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "rivulet_operators"), "zip", root, "rivulet"))
        _SHIPPED.add(sc.applicationId)
