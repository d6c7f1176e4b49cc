"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "skein", master: str | None = None, partitions: int | None = None, memory: str = "4g") -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; on a cluster master and memory come from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
