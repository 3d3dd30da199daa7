"""Lexical ranking of named things by a phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

LIMIT, LEAST = 15, 0.3


def phrase_words(phrase: str) -> list[str]:
    import re

    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", phrase))
    return re.findall(r"[a-z0-9]+", spaced.lower())


def cover(words: list[str], target: Column) -> Column:
    """Share of the words, each as often as it comes, that the target has."""
    query = F.array(*(F.lit(w) for w in words))
    return F.size(F.filter(query, lambda q: F.array_contains(target, q))) / F.lit(len(words)).cast("double")


def lookup(rows: DataFrame, phrase: str, name: str = "name", signature: str = "signature", body: str = "body", size: str = "body", key: str = "line", limit: int = LIMIT) -> DataFrame:
    """The rows that a phrase means most likely: its words in the name count most, then signature and body."""
    words = phrase_words(phrase)
    if not words:
        return rows.withColumn("score", F.lit(0.0)).withColumn("tokens", F.lit(0).cast("bigint")).limit(0)
    joined, lower = "".join(words), F.lower(F.coalesce(F.col(name), F.lit("")))
    bonus = F.when(lower == joined, 0.6).when(lower.contains(joined) | F.lit(joined).contains(lower), 0.25).otherwise(0.0)
    score = F.least(F.lit(1.0), cover(words, X.identifier_words(F.col(name))) + bonus + 0.3 * cover(words, X.identifier_words(F.col(signature))) + 0.12 * cover(words, X.identifier_words(F.col(body))))
    scored = rows.withColumn("score", score).where(F.col("score") >= LEAST)
    return scored.withColumn("score", F.round("score", 2)).withColumn("tokens", X.body_tokens(F.col(size))).orderBy(F.desc("score"), "tokens", key).limit(limit)
