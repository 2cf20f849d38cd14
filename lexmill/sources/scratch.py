"""Where tables go that outlive a query: the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_APPLICATIONS: set[str] = set()


def folder(spark: SparkSession) -> str:
    """This application's scratch folder, deleted when the driver ends.

    Only where ``spark.checkpoint.dir`` is unset and the master is local (tests) a temporary folder serves; on a cluster
    each machine would have one of its own, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lexmill-scratch")
    own = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _APPLICATIONS:
        _APPLICATIONS.add(own)
        atexit.register(_delete, spark, own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:  # noqa: BLE001 (the JVM may be gone already; what stays lies under its application's name)
        pass
