"""Session helpers: a local session for tests and benches, and the package for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import factloom
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that results depend on (UTC, adaptive execution)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("factloom").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once an application.

    Workers need not have the repository on their path; executors that join
    later fetch the same file.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(factloom.__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="factloom-"), "factloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
