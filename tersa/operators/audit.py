"""What an agent session wasted: calls paired with results, judged by ordered rules, summed up and planned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X

SIGNIFICANT, LARGE_FILE, TOKEN_CHARS = 500, 150, 4
#: Share of tokens that a better tool would have kept, by category.
KEPT_SHARE = {"read-large-file": 0.20, "build-test-output": 0.35, "cat-large-file": 0.20, "tail-command": 0.30, "curl-command": 0.30, "head-command": 0.80, "webfetch": 0.30}
SUGGESTION = {"read-large-file": "symbols + snippet", "build-test-output": "run", "cat-large-file": "symbols + snippet", "tail-command": "tail", "curl-command": "browse", "head-command": "bounded read", "webfetch": "browse"}
#: Commands whose output is a build's or a test's.
BUILD_TEST = (
    "(npm|yarn|pnpm|bun) +(test|run +test|run +build|run +lint)",
    "node +--test",
    "(cargo|go) +(test|build|check|clippy)",
    "(make|cmake)",
    "(pytest|python +-m +(pytest|unittest))",
    "(mvn|gradle) +(test|build|compile)",
    "(dotnet) +(test|build)",
    "(mix) +(test|compile)",
    "bundle +exec +r(spec|ake)",
    "tsc",
    "eslint",
    "prettier",
)
NON_CODE = "md txt json yaml yml toml xml csv lock svg html css log env gitignore dockerignore editorconfig".split()
START = "(^|(&&|;) *)"


def pair(turns: DataFrame, session: str = "conv_id", order: str = "turn", call_role: str = "user", result_role: str = "assistant") -> DataFrame:
    """Calls with the result that follows them directly; a call without one is dropped."""
    after = W.partitionBy(session).orderBy(order)
    paired = turns.withColumn("result_role", F.lead("role").over(after)).withColumn("result", F.lead("text").over(after))
    return paired.where((F.col("role") == call_role) & (F.col("result_role") == result_role)).withColumnRenamed("text", "call").drop("role", "result_role")


def build_or_test(command: Column) -> Column:
    return command.rlike(f"(^|[^A-Za-z0-9_])({'|'.join(BUILD_TEST)})($|[^A-Za-z0-9_])")


def http_url(text: Column) -> Column:
    return F.regexp_extract(text, "https?://[^ \\t\\n\\r\\f\"'<>|)]+", 0)


def private_host(host: Column) -> Column:
    return host.isin("localhost", "0.0.0.0", "::1") | host.rlike("^(127|10)[.]|^192[.]168[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]")


def api_like(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, "^https?://([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(url, "^https?://[^/?#]+(/[^?#]*)", 1))
    return (host == "") | private_host(host) | host.startswith("api.") | path.rlike("^/(api|graphql)(/|$)")


def api_options(command: Column) -> Column:
    return command.rlike("(?i)(^|[ \\t])(-[xhi]|--request|--header|--data(-[a-z0-9_-]+)?|-d|--include|--head)($|[^A-Za-z0-9_])")


def lines(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.size(F.split(text, "\n", -1))).otherwise(0)


def category(tool: Column, argument: Column, result: Column) -> Column:
    """The first rule that a call breaks. argument: path, command or URL."""
    code = ~X.extension(argument).isin(NON_CODE)
    target = F.regexp_extract(argument, START + "(cat|head) +(-[^ ]+ +)*([^ ]+)", 5)
    shell = (
        F.when(build_or_test(argument), "build-test-output")
        .when(argument.rlike(START + "tail +"), "tail-command")
        .when(argument.rlike(START + "cat +[^|]"), F.when((lines(result) > LARGE_FILE) & ~X.extension(target).isin(NON_CODE), "cat-large-file"))
        .when(argument.rlike(START + "head +"), "head-command")
        .when(argument.rlike(START + "curl ") & ~api_options(argument) & (http_url(argument) != "") & ~api_like(http_url(argument)), "curl-command")
    )
    return F.when(tool == "Read", F.when((lines(result) > LARGE_FILE) & code, "read-large-file")).when(tool.isin("Bash", "Shell", "exec_command"), shell).when(tool == "WebFetch", "webfetch")


def findings(calls: DataFrame, tool: Column, argument: Column, result: Column) -> DataFrame:
    """Calls with category, actual, saved and estimated tokens. Short results are no finding."""
    judged = calls.where(F.length(result) >= SIGNIFICANT).withColumn("category", category(tool, argument, result)).where("category is not null")
    return price(judged, F.ceil(F.length(result) / TOKEN_CHARS).cast("bigint"))


def price(judged: DataFrame, tokens: Column) -> DataFrame:
    share = F.element_at(F.create_map(*(F.lit(x) for kv in KEPT_SHARE.items() for x in kv)), F.col("category"))
    out = judged.withColumn("actual_tokens", tokens).withColumn("saved_tokens", F.round(F.col("actual_tokens") * (1 - share)).cast("bigint"))
    return out.withColumn("estimated_tokens", F.col("actual_tokens") - F.col("saved_tokens"))


def by_category(found: DataFrame, order: str) -> DataFrame:
    """Count, tokens and the first suggestion by category, with a grand total (category null)."""
    said = F.element_at(F.create_map(*(F.lit(x) for kv in SUGGESTION.items() for x in kv)), F.col("category"))
    return found.withColumn("suggestion", said).rollup("category").agg(F.count("*").alias("n"), F.sum("actual_tokens").alias("actual_tokens"), F.sum("saved_tokens").alias("saved_tokens"), F.min_by("suggestion", order).alias("suggestion"))


def capture_rate(saved: Column, saveable: Column) -> Column:
    return F.when(saved + saveable > 0, F.round(100.0 * saved / (saved + saveable)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def plan(found: DataFrame, already_saved: int = 0, items: int = 5) -> DataFrame:
    """The largest savings, with two general items while something is left to save."""
    own = found.groupBy("category").agg(F.count("*").alias("n"), F.sum("actual_tokens").alias("actual_tokens"), F.sum("saved_tokens").alias("saveable_tokens"))
    total = found.agg(F.sum("actual_tokens").alias("actual"), F.sum("saved_tokens").alias("saveable")).where("saveable > 0")
    setup = total.where(capture_rate(F.lit(already_saved), F.col("saveable")) < 80).select(F.lit("agent-setup").alias("category"), F.lit(1).cast("bigint").alias("n"), (F.col("saveable") + already_saved).alias("actual_tokens"), F.col("saveable").alias("saveable_tokens"))
    routing = total.select(F.lit("workflow-routing").alias("category"), F.lit(1).cast("bigint").alias("n"), F.col("actual").alias("actual_tokens"), F.round(F.col("saveable") * 0.25).cast("bigint").alias("saveable_tokens"))
    every = own.unionByName(setup).unionByName(routing)
    percent = F.when(F.col("actual_tokens") > 0, F.round(100.0 * F.col("saveable_tokens") / F.col("actual_tokens")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return every.withColumn("percent", percent).orderBy(F.desc("saveable_tokens"), "category").limit(items)


#: Share of the raw output that each reducing tool keeps.
TOOL_SHARE = {"tl-symbols": 0.20, "tl-snippet": 0.10, "tl-run": 0.35, "tl-browse": 0.30, "tl-tail": 0.30, "tl-diff": 0.40, "tl-impact": 0.25, "tl-structure": 0.15, "tl-deps": 0.20, "tl-exports": 0.20}


def savings(calls: DataFrame, command: Column, tokens: Column) -> DataFrame:
    """What calls of reducing tools already saved: raw estimate and difference."""
    tool = F.regexp_extract(command, "(^|[^A-Za-z0-9_])(tl-[A-Za-z0-9_]+)", 2)
    share = F.element_at(F.create_map(*(F.lit(x) for kv in TOOL_SHARE.items() for x in kv)), tool)
    out = calls.withColumn("tool", tool).where(tool.isin(list(TOOL_SHARE))).withColumn("actual_tokens", tokens).withColumn("raw_tokens", F.round(tokens / share).cast("bigint"))
    return out.withColumn("saved_tokens", F.col("raw_tokens") - F.col("actual_tokens"))


def policy(tool: Column, argument: Column, size: Column) -> Column:
    """The nudge that a tool call gets before it runs, or null. size: bytes of a file to be read."""
    cats = F.split(F.regexp_replace(F.trim(argument), "^cat +", ""), " +")
    shell = (
        F.when((argument == "") | argument.rlike("^ *tl[ -]"), None)
        .when(build_or_test(argument), "bash-test")
        .when(argument.rlike(START + "tail +"), "bash-tail")
        .when(argument.rlike("^ *cat +[^|]"), F.when(F.exists(cats, lambda x: X.extension(x).isin(NON_CODE)), "bash-cat-non-code").otherwise("bash-cat"))
        .when(argument.rlike("^ *head "), "bash-head")
        .when(argument.rlike(START + "curl ") & ~api_options(argument) & (http_url(argument) != "") & ~api_like(http_url(argument)), "bash-curl")
    )
    return F.when(tool == "Read", F.when(~X.extension(argument).isin(NON_CODE) & (size > 20_000), "read-large")).when(tool.isin("Bash", "Shell", "exec_command"), shell).when(tool == "WebFetch", F.when(argument != "", "webfetch"))
