"""The subpackage's queries and SQL, by the names under which they are registered."""

from __future__ import annotations

import public_tokenizers

from . import ann, backoff, bpe, chat, knn_quality, licenses, packing, quality_rules, simhash, token_counts
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def ranks() -> str:
    return public_tokenizers.path(RANKS)


def words() -> str:
    return public_tokenizers.path(WORDS)


QUERIES = {
    "op1_bpe": lambda spark, d: bpe.digest(table(spark, d, "documents"), ranks(), public_tokenizers.PATTERN),
    "op2_simhash": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op3_ann": lambda spark, d: ann.report(table(spark, d, "embeddings")),
    "op4_licenses": lambda spark, d: licenses.report(table(spark, d, "documents")),
    "op5_quality_rules": lambda spark, d: quality_rules.verdicts(table(spark, d, "documents")),
    "op6_packing": lambda spark, d: packing.pack(table(spark, d, "documents"), words()),
    "op7_quality_classifier": lambda spark, d: knn_quality.report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_token_counts": lambda spark, d: token_counts.token_counts(table(spark, d, "documents"), ranks(), public_tokenizers.PATTERN),
    "op9_chat": lambda spark, d: chat.report(table(spark, d, "conversations")),
    "op10_lm_scores": lambda spark, d: backoff.lm_scores(table(spark, d, "documents")),
}

SQL = {"op9_chat": chat.SQL}
