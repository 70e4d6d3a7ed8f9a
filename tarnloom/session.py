"""The Spark session of the command line and of tests; libraries take the caller's."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "tarnloom", **conf: str) -> SparkSession:
    """The running session, or a new one with adaptive execution. Cluster settings come from
    spark-submit; a master is set only where none is."""
    b = SparkSession.builder.appName(app)
    if "SPARK_REMOTE" not in os.environ and "PYSPARK_SUBMIT_ARGS" not in os.environ and "spark.master" not in conf:
        b = b.master(f"local[{os.environ.get('BENCH_CPUS', '*')}]")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
