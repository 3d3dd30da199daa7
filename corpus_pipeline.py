"""The corpus pipeline: quality classifier, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next stage's docs. All but the last return rows of ``docs`` as they
are, with all their columns, whatever those are called. Null texts count as empty (the
rules reject them); a null doc_id is a document like others; repeated rows are judged alike,
and of rows with the same doc_id and text the near-duplicate stage keeps one; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tersa.llm import knn_quality, packing, quality_rules, simhash
from tersa.llm.common import carried, carry, column, materialize, table
from tersa.llm.queries import words


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` as row (a struct of all columns but the text) and text, so that no operator's column clashes."""
    return carry(docs, [c for c in docs.columns if c != "text"], text=F.col("text"))


def together(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """What ``apart`` took apart, with the columns of ``docs`` in their order."""
    return rows.select(*(column(c) if c == "text" else carried([c])[0] for c in docs.columns))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote predicts to be good."""
    model = knn_quality.train(docs, table(spark, sf_dir, "labels"))
    return together(knn_quality.classify(apart(docs), model, drop_text=False).where("predicted = 1"), docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose rules, weighed by their accuracy, find no defect likely."""
    return together(quality_rules.select(apart(docs)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more)."""
    return simhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and offset."""
    return packing.pack(docs, words())


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("near_duplicates", near_duplicates), ("packing", pack)]

#: No stage but the packing's arithmetic can be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
