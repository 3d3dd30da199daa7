"""Histories: churn, authorship, blame blocks, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def hotspots(changes: DataFrame, file: str, author: str, top: int | None = None) -> DataFrame:
    """Files by how often they changed, with their authors."""
    sums = changes.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("commits"), F.countDistinct(author).alias("authors"))
    sums = sums.orderBy(F.desc("commits"), "file") if top else sums
    return sums.limit(top) if top else sums


def author_summary(changes: DataFrame, author: str, file: str) -> DataFrame:
    """Authors with commits, distinct files and share of all commits."""
    sums = changes.groupBy(F.col(author).alias("author")).agg(F.count("*").alias("commits"), F.countDistinct(file).alias("files"))
    whole = changes.agg(F.count("*").alias("_whole"))  # one row
    return sums.join(F.broadcast(whole)).withColumn("percent", F.round(100.0 * F.col("commits") / F.col("_whole"), 2)).drop("_whole")


def blame_blocks(lines: DataFrame, file: str, pos: str, commit: str, text: str) -> DataFrame:
    """Consecutive lines of one commit: start, end and a preview of the first line."""
    every, same = W.partitionBy(file).orderBy(pos), W.partitionBy(file, commit).orderBy(pos)
    numbered = lines.withColumn("island", F.row_number().over(every) - F.row_number().over(same))
    return numbered.groupBy(file, commit, "island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.min_by(F.substring(text, 1, 60), pos).alias("preview")).drop("island")


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def bump(commits: DataFrame) -> DataFrame:
    """major if anything breaks, minor for a feature, else patch."""
    sums = commits.agg(F.max(F.col("breaking").cast("int")).alias("b"), F.max((F.col("type") == "feat").cast("int")).alias("f"))
    return sums.select(F.when(F.col("b") == 1, "major").when(F.col("f") == 1, "minor").otherwise("patch").alias("bump"))


def evict(entries: DataFrame, scope: str, order: str, size: str, cap: int) -> DataFrame:
    """The newest entries of each scope whose sizes fit the cap."""
    used = F.sum(size).over(W.partitionBy(scope).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    return entries.withColumn("used", used).where(F.col("used") <= cap).drop("used")
