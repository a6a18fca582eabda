"""A session with the settings that plans here rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", app: str = "stratalens", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
