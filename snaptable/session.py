"""Session settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def session(app: str = "snaptable", **settings: str) -> SparkSession:
    """A session with SETTINGS and any others given."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Put SETTINGS into a session that is already there."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
