"""What tasks need of the session."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; a cluster gets it by --py-files."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH", "")]))
