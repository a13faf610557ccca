"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "newsreach", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or get) a session. Cluster submissions leave ``master`` unset and pass their own settings.

    AQE does three jobs here: it coalesces small shuffle partitions, splits skewed join partitions, and
    turns a join into a broadcast once the *measured* size of a side is below the threshold. No operator
    forces a broadcast of data whose size is not bounded.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
