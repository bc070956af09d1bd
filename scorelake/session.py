"""One place that makes Spark sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "scorelake", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, skewed joins split, UTC; the cluster's own settings win over none that are given here."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
