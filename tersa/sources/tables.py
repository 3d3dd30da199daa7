"""Readers: Parquet tables, text lines, JSON lines, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, modified of all files under a folder; contents aren't read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return listing.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and whole content of all files under a folder, to the last line break."""
    read_ = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return read_.select("path", F.decode("content", "UTF-8").alias("content"))


def json_lines(spark: SparkSession, path: str, schema: str, containing: str | None = None) -> DataFrame:
    """Records of a JSON-lines file; lines that don't parse are skipped. containing: cheap filter before parsing."""
    lines = spark.read.text(path)
    if containing:
        lines = lines.where(F.col("value").contains(containing))
    parsed = lines.select(F.from_json(F.regexp_replace("value", "\r$", ""), schema, {"mode": "PERMISSIVE"}).alias("r"), "value")
    return parsed.where(F.get_json_object("value", "$").isNotNull()).select("r.*")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos (from 1) and line of every text."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("p", "line")).select(key, (F.col("p") + 1).cast("bigint").alias("pos"), "line")


def event_line() -> Column:
    """An ``events`` row as a log line."""
    return F.concat(
        F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss"),
        F.lit(" "),
        F.upper("event_type"),
        F.lit(" user="),
        F.col("user_id").cast("string"),
        F.lit(" took "),
        F.floor("value").cast("string"),
        F.lit("ms"),
    )


#: The same line by DuckDB.
EVENT_LINE_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' user=' || user_id || ' took ' || floor(value)::BIGINT || 'ms'"
