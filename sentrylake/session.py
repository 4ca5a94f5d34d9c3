"""Session builder with the settings that every plan of the package assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "sentrylake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE on and ANSI mode left on.

    ``conf`` overrides any setting, with dots written as double underscores
    (``spark__sql__shuffle__partitions="8"``) or passed through ``**{...}``.
    """
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
