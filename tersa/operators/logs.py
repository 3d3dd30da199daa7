"""Log lines: clusters by template, runs, and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X


def clusters(rows: DataFrame, line: str, pos: str) -> DataFrame:
    """One row per template: count, worst severity, first line of that severity, first and last position."""
    rank = X.severity_rank(X.severity(F.col(line)))
    keyed = rows.select(X.log_template(F.col(line)).alias("key"), F.col(line).alias("line"), F.col(pos).alias("pos"), rank.alias("rank"))
    return keyed.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min_by(X.shorten(F.col("line")), F.struct(-F.col("rank"), F.col("pos"))).alias("sample"),
        F.element_at(F.array(F.lit("info"), F.lit("warn"), F.lit("error")), F.max("rank") + 1).alias("severity"),
        F.min("pos").alias("first_seen"),
        F.max("pos").alias("last_seen"),
    )


def runs(rows: DataFrame, value: Column, order: str, within: str | None = None) -> DataFrame:
    """Consecutive equal values, by ``within``: start, end, n."""
    parts = [within] if within else []
    line = W.partitionBy(*parts).orderBy(order)
    same = W.partitionBy(*parts, "value").orderBy(order)
    numbered = rows.select(*parts, value.alias("value"), order).withColumn("island", F.row_number().over(line) - F.row_number().over(same))
    return numbered.groupBy(*parts, "value", "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("island")
