"""Sessions and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_LOCAL_SCRATCH: list[str] = []


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # sessions on one machine, such as the tests
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL_SCRATCH:
            _LOCAL_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="deskflow-"))
        base = _LOCAL_SCRATCH[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="deskflow-code-")
        target = os.path.join(folder, "deskflow.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark
