"""Operator 8: exact token counts by length histogram.

Every document is encoded whole and only its length is kept; documents are aggregated
by length. Suffix sums over the histogram answer, for a context limit at each occurring
length and at every limit asked for, how many documents reach it, how many tokens the
corpus has below and from it, what remains if every document is truncated to it, and each
limit's quantile. Between two occurring lengths every limit is answered by the next longer
one (``at``). The sums are taken within blocks of lengths and over blocks, so no task orders
the whole histogram.

Defined cases: null and empty texts have length 0; repeated rows count each; other
columns are ignored; an empty table gives an empty histogram, whatever the limits; a limit
longer than every document has n_docs and docs_from 0.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import codec
from .common import blocks, materialize, texts

#: Usual context lengths, which the query answers as well.
LIMITS = (512, 1024, 2048, 4096, 8192, 16384, 32768, 131072)
#: Neighbouring lengths that one window orders.
BLOCK = 64


def lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens of every row."""

    def run(batches):
        own = codec(path, pattern)
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(own.count_block(texts(block)))], names=["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens, n_docs."""
    return lengths(docs, path, pattern).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Per occurring length L: n_docs, docs_from (length >= L), tokens_from, truncated_tokens (all documents cut to L), total_tokens, quantile (share of documents of length <= L)."""
    own = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = own.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later, all_ = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    sums = sums.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(all_).alias("all_docs"),
        F.sum("block_tokens").over(all_).alias("total_tokens"),
    )
    within = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    out = own.withColumn("docs_from", F.sum("n_docs").over(within)).withColumn("tokens_from", F.sum("tokens").over(within)).join(sums, "block")
    docs_from, tokens_from = F.col("docs_from") + F.col("later_docs"), F.col("tokens_from") + F.col("later_tokens")
    return out.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("total_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_tokens"),
        "total_tokens",
        ((F.col("all_docs") - docs_from + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def with_limits(counts: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """The histogram with a row for every limit, of no documents where none has that length."""
    if not limits:
        return counts
    rows = counts.sparkSession.createDataFrame([(int(x),) for x in sorted(set(limits))], "n_tokens long")
    some = counts.limit(1).select(F.lit(0).cast("long").alias("n_docs"))  # no rows without documents
    return counts.unionByName(rows.join(F.broadcast(some))).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def token_counts(docs: DataFrame, path: str, pattern: str, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """The answers at every occurring length and at ``limits``."""
    return suffix_sums(with_limits(materialize(histogram(docs, path, pattern), "histogram"), limits))


def at(answers: DataFrame, limit: int) -> DataFrame:
    """One row: docs_from, tokens_from, truncated_tokens and quantile for any context limit, from ``token_counts``' answers."""
    total, docs = F.max("total_tokens"), F.max("docs_from")
    from_ = [F.coalesce(F.min_by(c, F.when(F.col("n_tokens") >= limit, F.col("n_tokens"))), F.lit(0)) for c in ("docs_from", "tokens_from")]
    shorter = docs - F.coalesce(F.min_by("docs_from", F.when(F.col("n_tokens") > limit, F.col("n_tokens"))), F.lit(0))
    return answers.agg(from_[0].alias("docs_from"), from_[1].alias("tokens_from"), (total - from_[1] + limit * from_[0]).alias("truncated_tokens"), (shorter / docs).alias("quantile")).where("truncated_tokens is not null")
