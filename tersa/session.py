"""A session with the settings the library is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", name: str = "tersa", **settings: str) -> SparkSession:
    """Adaptive execution, UTC; further settings win. On a cluster, pass the master and leave memory to it."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8" if master.startswith("local") else "2000",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    spark = SparkSession.builder.master(master).appName(name).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
