"""Paths as Spark reads them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def located(path: str | Path) -> str:
    """A local path made absolute, as the JVM's working folder may be another; URIs stay."""
    text = str(path)
    return text if "://" in text or text.startswith("file:") else str(Path(text).resolve())


#: A folder for intermediate tables that goes before ``spark.checkpoint.dir``, settable in a running session.
OWN_DIR = "spark.strandweave.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``OWN_DIR``, or what ``spark.checkpoint.dir`` names; a local one
    where the session names none."""
    found = spark.conf.get(OWN_DIR, None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/tmp/checkpoints"
    return (found if "://" in found or found.startswith("file:") else f"file://{found}").rstrip("/")
