"""Output under a budget of lines or tokens. Every operator works per document, so no window spans the corpus."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X


def prefix(rows: DataFrame, key: str, pos: str, line: str, max_lines: int, max_tokens: int) -> DataFrame:
    """Lines before the first that would break the budget; after it nothing resumes."""
    before = W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    chars = F.coalesce(F.sum(F.length(line) + 1).over(before), F.lit(0))
    broken = (F.ceil(chars / 4) + X.token_estimate(F.col(line)) > max_tokens) | (F.row_number().over(W.partitionBy(key).orderBy(pos)) > max_lines)
    marked = rows.withColumn("broken", broken.cast("int"))
    return marked.withColumn("stopped", F.max("broken").over(upto)).where("stopped = 0").drop("broken", "stopped")


def head_tail(rows: DataFrame, key: str, pos: str, limit: int, head_share: float = 0.65) -> DataFrame:
    """All rows of short documents; of longer ones the head's share of the limit and the rest from the tail."""
    n = F.count("*").over(W.partitionBy(key))
    at = F.row_number().over(W.partitionBy(key).orderBy(pos))
    head = int(limit * head_share + 0.999999)
    return rows.withColumn("n", n).withColumn("at", at).where((F.col("n") <= limit) | (F.col("at") <= head) | (F.col("at") > F.col("n") - (limit - head))).drop("n", "at")


#: What makes a line worth keeping, (pattern over the trimmed line, ignore case, weight).
LINE_RULES = (
    ("\\b(error|Error|ERROR|fatal|FATAL|panic|PANIC|exception|Exception|fail|Fail|FAIL|invalid|Invalid|INVALID)\\b", False, 3),
    ("\\b(warn|Warn|WARN|warning|Warning|WARNING)\\b", False, 2),
    ("\\b(not found|does not exist|doesn't exist|no such|missing|unavailable)\\b", True, 2),
    ("\\b(denied|refused|rejected|unauthorized|forbidden|inaccessible)\\b", True, 2),
    ("\\b(deprecated|obsolete|outdated|stale|insecure|vulnerab\\w+)\\b", True, 2),
    ("\\b(cannot|can't|unable|unsupported|unrecognized|unexpected|unhandled|unknown)\\b", True, 2),
    ("\\b(timed? ?out|broken|corrupt(ed)?|crash(ed)?|abort(ed)?|unreachable)\\b", True, 2),
    ("\\b(mismatch|incompatible|conflict|exceeded|exhausted|truncated)\\b", True, 1),
    ("\\b(overflow|leak(ed)?|skipped|retrying|degraded|duplicate)\\b", True, 1),
    ("[✓✗✘✔✕⚠●]", False, 2),
    ("\\b(PASS|VALID|INVALID|SUCCESS|PASSED|FAILED|OK|TIMEOUT|DONE|COMPLETE)\\b", False, 2),
    ("^[━═─┌┐└┘├┤┬┴┼│╔╗╚╝╠╣╦╩╬║]{3,}", False, 1),
    ("^#{1,4}[ \\t]", False, 2),
    ("^[A-Z][A-Za-z ]+: *$", False, 1),
    ("^──[ \\t]", False, 2),
    ("\\b\\d+([.]\\d+)?%", False, 1),
    ("\\b(total|count|sum|average|median|summary|result|statistics)[ \\t:]", True, 1),
    ("^\\[DEBUG", False, -1),
)


def edged(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with word boundaries at its ends spelled out as ASCII classes, so that every engine agrees."""
    pattern = re.sub(r"^\\b", "(^|[^A-Za-z0-9_])", pattern)
    return ("(?i)" if ignore_case else "") + re.sub(r"\\b$", "($|[^A-Za-z0-9_])", pattern)


def stems(pattern: str) -> list[str]:
    """What a rule of words needs of a line, in lower case: one of the literal beginnings of its words; nothing for other rules."""
    words = re.fullmatch(r"\\b\((.*)\)(?:\\b|\[.*\])", pattern)
    begins = [re.match(r"[A-Za-z' ]+(?![?*])", x)[0].lower() for x in re.sub(r"\([^)]*\)\?", "", words[1]).split("|")] if words else []
    return sorted({b for b in begins if not any(b != c and b.startswith(c) for c in begins)})


def line_score(line: Column) -> Column:
    """How much a line tells; blank lines score -1. A rule's pattern is tried only where one of its words can begin."""
    t = F.trim(line)
    lower = F.lower(t)
    score = F.lit(0)
    for pattern, ignore_case, weight in LINE_RULES:
        hit = t.rlike(edged(pattern, ignore_case))
        if own := stems(pattern):
            hit = reduce(lambda a, b: a | b, (F.contains(lower, F.lit(x)) for x in own)) & hit
        score = score + F.when(hit, weight).otherwise(0)
    score = score + F.when(t.rlike("[^ \\t]+:[0-9]+") & t.rlike(edged("\\b(error|warn|fail)", True)), 2).otherwise(0)
    score = score - F.when(line.rlike("^[ \\t]*at "), 1).otherwise(0)
    return F.when(t == "", -1).otherwise(score)


def smart(rows: DataFrame, key: str, pos: str, score: Column, budget: int) -> DataFrame:
    """30 % head, 30 % tail, three lines for marks, and the best of the middle, in order."""
    ends = max(5, -(-budget * 3 // 10))
    middle = max(0, budget - 2 * ends - 3)
    line = W.partitionBy(key).orderBy(pos)
    placed = rows.withColumn("score", score).withColumn("at", F.row_number().over(line)).withColumn("n", F.count("*").over(W.partitionBy(key)))
    part = F.when(F.col("at") <= ends, "head").when(F.col("at") > F.col("n") - ends, "tail").otherwise("middle")
    best = F.row_number().over(W.partitionBy(key, "part").orderBy(F.desc("score"), pos))
    return placed.withColumn("part", part).withColumn("best", best).where((F.col("n") <= budget) | (F.col("part") != "middle") | (F.col("best") <= middle)).drop("at", "n", "best")


def regions(rows: DataFrame, key: str, pos: str, anchor: Column, before: int = 2, after: int = 6, gap: int = 2) -> DataFrame:
    """Windows around anchor lines, merged where they come within ``gap`` lines: key, start, end, anchors."""
    last = F.max(pos).over(W.partitionBy(key))
    spans = rows.withColumn("last", last).where(anchor).select(key, pos, F.greatest(F.col(pos) - before, F.lit(1)).alias("start"), F.least(F.col(pos) + after, F.col("last")).alias("end"))
    order = W.partitionBy(key).orderBy(pos)
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(reached.isNull() | (F.col("start") > reached + gap), 1).otherwise(0))
    numbered = opened.withColumn("region", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("anchors"))


def within(regions_: DataFrame, key: str, budget: int) -> DataFrame:
    """Whole regions while they fit the budget, the first always; a mark counts one line for each gap before."""
    order = W.partitionBy(key).orderBy("region")
    gapped = regions_.withColumn("gap", (F.col("start") - F.coalesce(F.lag("end").over(order), F.lit(0)) - 1).cast("bigint"))
    cost = F.col("end") - F.col("start") + 1 + F.when(F.col("gap") > 0, 1).otherwise(0)
    used = F.sum("cost").over(order.rowsBetween(W.unboundedPreceding, 0))
    kept = gapped.withColumn("cost", cost).withColumn("used", used).withColumn("over", ((F.col("used") > budget) & (F.col("region") > 1)).cast("int"))
    return kept.withColumn("stopped", F.max("over").over(order.rowsBetween(W.unboundedPreceding, 0))).where("stopped = 0").drop("over", "stopped", "used")


def line_budget(max_lines: int | None, max_tokens: int | None) -> int | None:
    limits = [x for x in (max_lines and max_lines - 5, max_tokens and max_tokens * 4 // 60 - 5) if x is not None]
    return max(15, min(limits)) if limits else None


#: Sections that a budget of tokens allows below each limit.
TIERS = ((1500, 2), (3500, 3))


def sections(rows: DataFrame, key: str, priority: str, required: str, max_tokens: int) -> DataFrame:
    """Required sections and, by priority (unique within a key), as many as the budget's tier allows; all beyond the last tier.

    The first sections of each key are cut down before they are shuffled, and only required rows meet their bound.
    """
    limit = next((n for below, n in TIERS if max_tokens < below), None)
    if limit is None:
        return rows
    first = rows.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(priority))).where(F.col("_nth") <= limit).drop("_nth")
    bounds = first.groupBy(key).agg(F.max(priority).alias("_bound"))
    more = rows.where(F.col(required)).join(bounds, key).where(F.col(priority) > F.col("_bound")).drop("_bound")
    return first.unionByName(more.select(*rows.columns))


def sampled_chars(text: Column, limit: int) -> Column:
    """A text's first 45 % and last 55 % of ``limit`` characters, if it is longer."""
    head = limit * 45 // 100
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.substr(text, F.length(text) - (limit - head) + 1)))
