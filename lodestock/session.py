"""Session settings the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "lodestock", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": os.environ.get("SHUFFLE_PARTITIONS", "8"),
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
