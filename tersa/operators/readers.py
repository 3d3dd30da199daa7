"""Text formats as rows: coverage records, diff hunks, environment files, test runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def lcov(lines: DataFrame, file: str = "doc", pos: str = "pos", line: str = "line") -> DataFrame:
    """source, lines found and hit, and the lines not hit. The source of a line is the last SF: record before it."""
    order = W.partitionBy(file).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    source = F.last(F.when(F.col(line).startswith("SF:"), F.substring(line, 4, F.length(line))), ignorenulls=True).over(order)
    hit = F.regexp_extract(line, "^DA:([0-9]+),([0-9]+)", 2)
    number = F.regexp_extract(line, "^DA:([0-9]+),([0-9]+)", 1)
    rows = lines.withColumn("source", source).withColumn("hit", hit).withColumn("number", number).where("hit <> ''")
    return rows.groupBy("source").agg(F.count("*").alias("found"), F.sum((F.col("hit") != "0").cast("bigint")).alias("hit"), F.sort_array(F.collect_list(F.when(F.col("hit") == "0", F.col("number").cast("int")))).alias("missed"))


def percent(hit: Column, found: Column) -> Column:
    return F.when(found == 0, F.lit(100.0)).otherwise(F.round(100.0 * hit / found, 2))


def added_lines(diff: DataFrame, file: str = "doc", pos: str = "pos", line: str = "line") -> DataFrame:
    """path, new line number and text of the lines that a unified diff adds."""
    order = W.partitionBy(file).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    path = F.last(F.when(F.col(line).startswith("+++ b/"), F.substring(line, 7, F.length(line))), ignorenulls=True).over(order)
    start = F.regexp_extract(line, "^@@ -[0-9,]+ [+]([0-9]+)", 1)
    hunk = F.sum((start != "").cast("int")).over(order)
    first = F.last(F.when(start != "", start.cast("int")), ignorenulls=True).over(order)
    body = F.col(line).rlike("^[+ ]") & ~F.col(line).startswith("+++")
    rows = diff.withColumn("path", path).withColumn("hunk", hunk).withColumn("first", first).where(body & F.col("first").isNotNull())
    nth = F.row_number().over(W.partitionBy(file, "hunk").orderBy(pos))
    return rows.withColumn("number", F.col("first") + nth - 1).where(F.col(line).startswith("+")).select("path", "number", F.substring(line, 2, F.length(line)).alias("text"))


def environment(lines: DataFrame, line: str = "line") -> DataFrame:
    """key and value; comments are skipped and quotes stripped."""
    pattern = "^[ \\t]*(?:export )?([A-Za-z_][A-Za-z0-9_]*)=(.*)$"
    rows = lines.where(~F.trim(line).startswith("#")).select(F.regexp_extract(line, pattern, 1).alias("key"), F.trim(F.regexp_extract(line, pattern, 2)).alias("value")).where("key <> ''")
    return rows.withColumn("value", F.regexp_replace("value", "^([\"'])(.*)\\1$", "$2"))


#: How runners say what passed, failed and was skipped; the first form that a run's output holds counts.
COUNTS = {
    "passed": ("(?i)Tests:\\s+(?:\\d+ failed,? *)?(?:\\d+ skipped,? *)?(\\d+) passed", "([0-9]+) passing", "(?:^|[^0-9])([0-9]+) passed(?=.*(?:in [0-9.]+s|={3}))", "test result:.*?([0-9]+) passed", "(?m)^\\s*(?:#|ℹ) pass ([0-9]+)", "(?m)^\\s*([0-9]+) pass(?:ed)?\\s*$"),
    "failed": ("(?i)Tests:\\s+(\\d+) failed", "([0-9]+) failing", "(?:^|[^0-9])([0-9]+) failed(?=.*(?:in [0-9.]+s|={3}))", "test result:.*?([0-9]+) failed", "(?m)^\\s*(?:#|ℹ) fail ([0-9]+)", "(?m)^\\s*([0-9]+) fail(?:ed)?\\s*$"),
    "skipped": ("([0-9]+) skipped", "(?m)^\\s*(?:#|ℹ) skipped ([0-9]+)", "([0-9]+) pending", "([0-9]+) ignored", "(?m)^\\s*([0-9]+) skip(?:ped)?\\s*$"),
}


def test_counts(output: Column) -> Column:
    """passed, failed and skipped of a test run's output; packages that passed or failed count where nothing else does."""

    def number(patterns: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.nullif(F.regexp_extract(output, p, 1), F.lit("")).cast("int") for p in patterns))

    said = {k: number(v) for k, v in COUNTS.items()}
    silent = said["passed"].isNull() & said["failed"].isNull()
    packages = {"passed": F.regexp_count(output, F.lit("(?m)^ok\\s+\\S+/\\S+")), "failed": F.regexp_count(output, F.lit("(?m)^FAIL\\s+\\S+/\\S+"))}
    return F.struct(*(F.when(silent, packages[k]).otherwise(F.coalesce(said[k], F.lit(0))).alias(k) for k in packages), F.coalesce(said["skipped"], F.lit(0)).alias("skipped"))


def carried(lines: DataFrame, file: str, pos: str, **values: Column) -> DataFrame:
    """``lines`` with, for each name, the last value at or before a line (null values are passed over)."""
    order = W.partitionBy(file).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return lines.select("*", *(F.last(v, ignorenulls=True).over(order).alias(n) for n, v in values.items()))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's group, null where it doesn't match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


_COMMIT = "^([0-9a-f]{7,40})[|]([^|]*)[|]([0-9-]{10})[^|]*[|](.*)$"


def git_log(lines: DataFrame, file: str = "doc", pos: str = "pos", line: str = "line") -> DataFrame:
    """hash, author, date, subject, path: one row for each file line below a ``hash|author|date|subject`` line."""
    heads = {name: found(F.col(line), _COMMIT, k) for k, name in enumerate(("hash", "author", "date", "subject"), 1)}
    rows = carried(lines, file, pos, **heads)
    return rows.where(F.col("hash").isNotNull() & ~F.col(line).rlike(_COMMIT) & (F.trim(line) != "")).select("hash", "author", "date", "subject", F.col(line).alias("path"))


def numstat(lines: DataFrame, file: str = "doc", pos: str = "pos", line: str = "line") -> DataFrame:
    """hash, files, added, deleted of each commit; a binary file (``-``) counts as a file of no lines."""
    pattern = "^([0-9]+|-)\t([0-9]+|-)\t(.+)$"
    rows = carried(lines, file, pos, hash=found(F.col(line), _COMMIT)).where(F.col("hash").isNotNull() & F.col(line).rlike(pattern))
    number = lambda k: F.coalesce(F.nullif(F.regexp_extract(line, pattern, k), F.lit("-")).cast("bigint"), F.lit(0))
    return rows.groupBy("hash").agg(F.count("*").alias("files"), F.sum(number(1)).alias("added"), F.sum(number(2)).alias("deleted"))


def porcelain(lines: DataFrame, file: str = "doc", pos: str = "pos", line: str = "line") -> DataFrame:
    """file, number, hash, author, text of every blamed line; a commit's author stands where it first comes up."""
    head = "^([0-9a-f]{40}) [0-9]+ ([0-9]+)"
    rows = carried(lines, file, pos, hash=found(F.col(line), head), number=found(F.col(line), head, 2))
    authors = rows.where(F.col(line).startswith("author ")).groupBy(F.col(file), "hash").agg(F.min_by(F.substr(F.col(line), F.lit(8)), pos).alias("author"))
    told = rows.where(F.col(line).startswith("\t")).select(file, F.col("number").cast("int").alias("number"), "hash", F.substr(F.col(line), F.lit(2)).alias("text"))
    return told.join(authors, [file, "hash"], "left").select(file, "number", "hash", "author", "text")


def diff_stat(lines: DataFrame, line: str = "line") -> DataFrame:
    """path, changes (null for a binary file) of the lines of a diff's statistics."""
    pattern = "^ ?(.+?) +[|] +([0-9]+|Bin)"
    return lines.where(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).alias("path"), F.nullif(F.regexp_extract(line, pattern, 2), F.lit("Bin")).cast("bigint").alias("changes"))


def untracked(files: DataFrame, content: str = "content") -> DataFrame:
    """path, changes of new files: their lines, or null if a NUL among the first 8192 characters makes them binary."""
    text = F.col(content)
    binary = F.instr(F.substring(text, 1, 8192), "\0") > 0
    lines_ = F.size(F.split(text, "\n", -1)) - text.endswith("\n").cast("int")
    return files.select("path", F.when(~binary, F.when(text == "", 0).otherwise(lines_)).cast("bigint").alias("changes"))


def statement_coverage(reports: DataFrame, report: str = "report") -> DataFrame:
    """source, found, hit from a JSON report of statement counters by file."""
    files = F.from_json(report, "map<string, struct<s: map<string, bigint>>>")
    rows = reports.select(F.explode(files).alias("source", "r"))
    counts = F.map_values("r.s")
    return rows.select("source", F.size(counts).alias("found"), F.size(F.filter(counts, lambda n: n > 0)).alias("hit"))


def summary_coverage(reports: DataFrame, report: str = "report") -> DataFrame:
    """source, found, hit from a JSON summary by file; its total is left out."""
    files = F.from_json(report, "map<string, struct<lines: struct<total: bigint, covered: bigint>>>")
    return reports.select(F.explode(files).alias("source", "r")).where("source <> 'total'").select("source", F.col("r.lines.total").alias("found"), F.col("r.lines.covered").alias("hit"))


def newest(sessions: DataFrame, provider: str, modified: str, path: str, n: int) -> DataFrame:
    """The newest sessions of each provider."""
    nth = F.row_number().over(W.partitionBy(provider).orderBy(F.desc(modified), path))
    return sessions.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def merged(records: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row per key: each field's last value that is neither null nor empty."""
    last = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order)))
    return records.groupBy(key).agg(*(F.when(F.max(F.coalesce(F.col(c).cast("string"), F.lit("")) != ""), last(c)).alias(c) for c in fields))


#: Patterns by name; ``files`` is a condition on the path that narrows a search, ``pattern`` one on the line (none: files only).
NAMED = {
    "todos": {"pattern": "(TODO|FIXME|HACK)[:(]"},
    "errors": {"pattern": "\\bthrow\\b|\\braise\\b"},
    "tests": {"files": "[.](test|spec)[.]"},
    "endpoints": {"pattern": "[.](get|post|put|delete)\\(|@(Get|Post)\\("},
}


def named_search(lines: DataFrame, name: str, patterns: dict | None = None, path: str = "path", line: str = "line") -> DataFrame:
    """Lines (or, for a pattern of files only, paths) that a named pattern finds."""
    own = (NAMED | (patterns or {}))[name]
    rows = lines.where(F.col(path).rlike(own["files"])) if "files" in own else lines
    return rows.where(F.col(line).rlike(own["pattern"])) if "pattern" in own else rows.select(path).distinct()


def snapshot_key(folder: Column, command: Column) -> Column:
    """The name under which a run is kept."""
    return F.substring(F.md5(F.concat(folder, F.lit(":"), command)), 1, 12)


def against_previous(run: DataFrame, kept: DataFrame, key: str, lines: str) -> DataFrame:
    """key, fresh, gone: lines of a run that the kept one lacks, and the reverse (arrays of failure lines, sorted)."""
    both = run.select(key, F.col(lines).alias("now")).join(kept.select(key, F.col(lines).alias("was")), key, "left")
    was = F.coalesce("was", F.array().cast("array<string>"))
    return both.select(key, F.sort_array(F.array_except("now", was)).alias("fresh"), F.sort_array(F.array_except(was, F.col("now"))).alias("gone"))


def keep_runs(run: DataFrame, folder: str) -> None:
    """Write a run's rows where the next one finds them."""
    run.write.mode("overwrite").parquet(folder)
