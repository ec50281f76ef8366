"""The settings that jobs and tests share."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, whatever folder the job was started in."""
    home = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    if home not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [home, environment.get("PYTHONPATH", "")]))
    return spark


def local_session(cores: int = 8, partitions: int | None = None) -> SparkSession:
    """A single-machine session with the settings the operators count on: UTC, ANSI and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bidloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
