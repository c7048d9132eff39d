"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "riskweave", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC session with adaptive execution. A master and a partition count are only set where given, so a
    cluster's own settings stand."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
