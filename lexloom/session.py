"""Session defaults for local work; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, memory: str = "12g", **extra: str) -> SparkSession:
    """A local session as tests and the bench use it."""
    cores = cores or os.cpu_count() or 4
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_lexloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lexloom-")) / "lexloom.zip"  # the driver serves it from here
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    context._lexloom_shipped = True
