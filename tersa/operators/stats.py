"""Exact statistics of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Half-width, as a share of the rows, of the slice that an exact percentile is searched in.
SLICE = 0.002
#: Groups of so many rows at most are ranked whole; in larger ones the slice holds the neighbours of the sought rank with room to spare.
WHOLE = 10_000


def quantiles(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """key, the exact interpolated quantile. An approximate pass brackets it, so only a thin slice of each group is ranked."""
    values = rows.where(F.col(value).isNotNull()).select(key, value)
    low, high = max(0.0, q - SLICE), min(1.0, q + SLICE)
    bounds = values.groupBy(key).agg(F.count("*").alias("n"), F.percentile_approx(value, F.array(F.lit(low), F.lit(high)), 10_000).alias("b"))
    whole = F.col("n") <= WHOLE
    sized = bounds.select(key, "n", F.when(whole, float("-inf")).otherwise(F.col("b")[0]).alias("low"), F.when(whole, float("inf")).otherwise(F.col("b")[1]).alias("high"))
    at = F.lit(q) * (F.col("n") - 1)
    placed = values.join(sized, key)
    below = placed.groupBy(key).agg(F.sum((F.col(value) < F.col("low")).cast("bigint")).alias("below"))
    inside = placed.where(F.col(value).between(F.col("low"), F.col("high")))
    counts = inside.groupBy(key, value, "n").agg(F.count("*").alias("c")).join(below, key)
    upto = W.partitionBy(key).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.col("below") + F.sum("c").over(upto))
    first, second = (F.min(F.when(F.col("upto") > p, F.col(value))) for p in (F.floor(at), F.ceil(at)))
    return ranked.groupBy(key, "n").agg(first.alias("a"), second.alias("b")).select(key, (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("quantile"))


def summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """count, min, max, mean, p50, p95 and population deviation of each group."""
    base = rows.groupBy(key).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"))
    return base.join(quantiles(rows, key, value, 0.5).withColumnRenamed("quantile", "p50"), key).join(quantiles(rows, key, value, 0.95).withColumnRenamed("quantile", "p95"), key)
