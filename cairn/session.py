"""Session settings that suit these plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Plans here are hundreds of small expressions; recording the Python call site of each one costs more than building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(app: str) -> SparkSession.Builder:
    """A builder with these settings; the cluster's own (partitions, memory, shared folders) come from its configuration."""
    return SparkSession.builder.appName(app).config(map=SETTINGS)
