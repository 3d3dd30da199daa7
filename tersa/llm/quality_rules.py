"""Operator 5: quality rules as weak supervision (DataFrame functions only).

Each rule reads one signal and votes bad (-1), good (1) or abstains (0) on a document. Rules
of one kind look for symptoms of the same defect in different signals. For every kind there
is a latent class, the defect present or not, with votes independent given it; an abstention
says nothing about it. The histogram of vote patterns (3 ** rules rows at most) goes to the
driver, where expectation-maximisation estimates each kind's prevalence and how each of its
rules votes, if it votes, in both classes. Documents of a kind's prior beliefs weigh ``PRIOR_DOCUMENTS``, whatever
the corpus holds, so data outweigh them. A kind with a single rule has nothing to agree
with: its votes keep about the worth they started with. A document's quality is the
probability that none of the defects is present, computed by the same expressions that
voted, and replaces any all-must-pass filter; only the base rules stay absolute.

Windows of words are compared by 64-bit hashes.

Defined cases: null text has no words; documents of fewer than ten words fail the
base rules; repeated rows are judged alike; extra columns pass through ``judge``, but one
that has the name of an output gives way to it; without documents the prior beliefs stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import carried, carry, materialize

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
WINDOW = 5
ROUNDS = 200
#: Share of a rule's votes that are believed to be bad where its defect is present, and where it isn't.
PRESENT, ABSENT = 0.85, 0.015
#: Share of documents that are believed to have a kind of defect.
PREVALENCE = 0.05
#: Documents that these beliefs weigh.
PRIOR_DOCUMENTS = 1000
#: The rules: name -> (kind of defect, bad if, good if) over the features.
RULES: dict[str, tuple[str, str, str]] = {
    "symbols": ("marks", "n_symbols >= 3 and n_symbols > 0.08 * n_words", "n_symbols <= 0.01 * n_words"),
    "word_length": ("shape", "word_chars < 2.5 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    "lines": ("repetition", "n_dup_lines >= 3 and n_dup_lines > 0.2 * n_lines", "n_dup_lines = 0"),
    "repeats": ("repetition", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "variety": ("repetition", "n_words >= 30 and n_distinct < 0.2 * n_words", "n_distinct > 0.35 * n_words"),
    "shouting": ("emphasis", "n_upper > 0.3 * word_chars and n_words >= 3", "n_upper <= 0.15 * word_chars"),
    "exclaiming": ("emphasis", "n_exclaims >= 3 and n_exclaims > 0.1 * n_words", "n_exclaims <= 0.02 * n_words"),
    "length": ("brevity", "n_words < 3", "n_words >= 100"),
}
KINDS = list(dict.fromkeys(kind for kind, _, _ in RULES.values()))
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims", "n_distinct"]
OUTPUTS = [*FEATURES, "base_failed", "quality", "kept"]


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """row (``keep`` as a struct) and the counts that the rules read, from whole texts."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    split = carry(docs, keep, _text=F.col(text)).select("row", whole.alias("_text"), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias("_words"), F.split(whole, "\n", -1).alias("_lines"))
    coded = split.select("row", "_text", F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"), F.filter("_lines", lambda x: x.rlike(WORD)).alias("_lines"))
    n = F.size("_codes")

    def joined(left: Column, right: Column) -> Column:
        return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))

    # codes of two words, of four and of five that follow each other; what runs over the end is cut off
    two = joined(F.col("_codes"), F.slice("_codes", 2, F.greatest(n, F.lit(0))))
    paired = coded.select("row", "_text", "_codes", "_lines", two.alias("_two"))
    four = joined(F.col("_two"), F.slice("_two", 3, F.greatest(n, F.lit(0))))
    five = F.slice(joined(four, F.slice("_codes", WINDOW, F.greatest(n, F.lit(0)))), 1, F.greatest(n - (WINDOW - 1), F.lit(0)))
    hashed = paired.select("row", "_text", "_codes", "_lines", five.alias("_windows"))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    in_order = F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    sorted_ = hashed.select("row", "_text", "_codes", "_lines", F.when(repeats, in_order).alias("_sorted"))
    # of neighbours in the sorted windows, those that equal the one before or after
    size = F.greatest(F.size("_sorted"), F.lit(1))
    before = F.slice(F.concat(F.array(F.lit(None).cast("long")), F.col("_sorted.w")), 1, size)
    after = F.concat(F.slice(F.col("_sorted.w"), 2, size), F.array(F.lit(None).cast("long")))
    zipped = F.arrays_zip(F.col("_sorted.w").alias("w"), F.col("_sorted.i").alias("i"), before.alias("b"), after.alias("a"))
    places = F.sort_array(F.transform(F.filter(zipped, lambda x: x["w"].eqNullSafe(x["b"]) | x["w"].eqNullSafe(x["a"])), lambda x: x["i"]))
    placed = sorted_.select("row", "_text", "_codes", "_lines", places.alias("_places"))
    following = F.concat(F.slice("_places", 2, F.greatest(F.size("_places"), F.lit(0))), F.array(F.lit(1 << 30)))
    covered = F.aggregate(F.zip_with("_places", following, lambda i, j: F.least(j - i, F.lit(WINDOW))), F.lit(0).cast("long"), lambda total, x: total + F.coalesce(x, F.lit(0)))
    text_ = F.col("_text")
    return placed.select(
        "row",
        F.size("_codes").cast("long").alias("n_words"),
        (F.length(text_) - occurrences(text_, SPACE)).alias("word_chars"),
        occurrences(text_, SYMBOL).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_places") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        occurrences(text_, "[A-Z]").alias("n_upper"),
        occurrences(text_, "!").alias("n_exclaims"),
        F.size(F.array_distinct("_codes")).cast("long").alias("n_distinct"),
    )


def vote(name: str) -> Column:
    _, bad, good = RULES[name]
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("int")


#: Of each kind of defect: the log odds that it is present, and what each vote of its rules adds to them.
Model = dict[str, tuple[float, dict[str, dict[int, float]]]]


def estimate(patterns: dict[tuple[int, ...], int]) -> Model:
    """The model by expectation-maximisation. patterns: documents by their votes, in the order of the rules."""
    out: Model = {}
    names = list(RULES)
    for kind in KINDS:
        own = [k for k, name in enumerate(names) if RULES[name][0] == kind]
        counts: dict[tuple[int, ...], int] = {}
        for pattern, n in patterns.items():
            key = tuple(pattern[k] for k in own)
            counts[key] = counts.get(key, 0) + n
        share, total = PREVALENCE, sum(counts.values())
        beliefs = [[{-1: p, 1: 1 - p} for _ in own] for p in (ABSENT, PRESENT)]
        chances = beliefs
        for _ in range(ROUNDS if total else 0):
            sums = [[{v: PRIOR_DOCUMENTS * weight * p for v, p in rule.items()} for rule in side] for side, weight in zip(beliefs, (1 - PREVALENCE, PREVALENCE), strict=True)]
            present = PRIOR_DOCUMENTS * PREVALENCE
            for key, n in counts.items():
                said = [(j, v) for j, v in enumerate(key) if v]
                odds = math.log(share / (1 - share)) + sum(math.log(chances[1][j][v] / chances[0][j][v]) for j, v in said)
                p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
                present += n * p
                for j, v in said:
                    sums[0][j][v] += n * (1 - p)
                    sums[1][j][v] += n * p
            share = present / (total + PRIOR_DOCUMENTS)
            chances = [[{v: x / sum(rule.values()) for v, x in rule.items()} for rule in side] for side in sums]
        worth = {names[k]: {v: math.log(chances[1][j][v] / chances[0][j][v]) for v in (-1, 1)} | {0: 0.0} for j, k in enumerate(own)}
        out[kind] = (math.log(share / (1 - share)), worth)
    return out


def posterior(model: Model) -> Column:
    """Probability that no defect is present, from a document's features."""
    out = F.lit(1.0)
    for base, rules in model.values():
        odds = F.lit(base)
        for name, weight in rules.items():
            v = vote(name)
            odds = odds + F.when(v == -1, weight[-1]).when(v == 1, weight[1]).otherwise(weight[0])
        out = out / (1 + F.exp(odds))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit(rows: DataFrame) -> Model:
    """The model of rows of features."""
    counts = rows.groupBy(*(vote(x).alias(x) for x in RULES)).count().collect()  # 3 ** rules rows at most
    return estimate({tuple(r[x] for x in RULES): r["count"] for r in counts})


def judge(docs: DataFrame, keep: list[str] | None = None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``keep`` (default: all columns), the features, base_failed, quality (posterior) and kept."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUTPUTS]
    rows = materialize(features(docs, keep, text), "features")
    judged = rows.withColumn("base_failed", base_failed()).withColumn("quality", posterior(fit(rows)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).select(*carried(keep), *OUTPUTS)


def select(docs: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps. Features are counted once for the model and once more where rows are judged, so that no text is written or moved."""
    model = fit(materialize(features(docs, [], text).drop("row"), "features"))
    counted = features(docs, docs.columns, text).withColumn("_nth", F.monotonically_increasing_id())
    # a condition that needs _nth stays above it; below, every mention of a count would count anew
    return counted.where(~base_failed() & (posterior(model) >= threshold) & (F.col("_nth") >= 0)).select(*carried(docs.columns))


def verdicts(docs: DataFrame) -> DataFrame:
    out = judge(docs, ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
