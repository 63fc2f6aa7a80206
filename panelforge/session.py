"""A session with settings that suit wide panel windows."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(app: str = "panelforge", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, AQE with skew joins; memory and partition sizes are the cluster's."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.parquet.compression.codec": "snappy"}
    return b.config(map={**base, **conf}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Executors import this package from a zip that goes with the application,
    unless it lies on their Python path already."""
    root = Path(__file__).resolve().parent.parent
    here = {os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    sc = spark.sparkContext
    if str(root) in here or getattr(sc, "_panelforge_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="panelforge-"), "panelforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "panelforge").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(path))
    sc._panelforge_shipped = True
