"""Audits of conversations, logs from events, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit as A, budget as B, code as K, logs as L, rules as R
from ..sources.tables import EVENT_LINE_SQL, event_line, lines, read
from . import project as P
from .registry import query

# documents stand in for calls: a document's length says which tool was called with what, and its text, twice, is the result
_NON_CODE = ", ".join(f"'{x}'" for x in A.NON_CODE)
_ARGUMENTS = {
    0: ["src/~k~.py", "docs/~k~.md", "src/~k~.go", "a/~k~.json", "b/~k~.rs", "Makefile"],
    1: ["npm run test", "tail -n 5 a.log", "cat src/~k~.py", "cat README.md", "head -5 ~k~.c", "curl https://example.com/~k~"],
    2: ["cd x && pytest -q", "ls; tail x", "cat -n ~k~.go", "curl https://api.example.com/v1", "curl -X POST https://example.com", "tl-diff ~k~"],
    3: ["https://example.com/~k~"] * 6,
    4: ["cat a ~k~", "npm test", "tail x", "x", "y", "z"],
}
_TOOLS = ("Read", "Bash", "Shell", "WebFetch", "Other")
_CALLS = f"""calls AS (SELECT doc_id AS k, lang AS provider, ['{"', '".join(_TOOLS)}'][n_chars % 5 + 1] AS tool,
  CASE {" ".join(f"WHEN n_chars % 5 = {t} AND (n_chars // 5) % 6 = {i} THEN {P.fill_sql(x).replace(' k ', ' doc_id ').replace('|| k', '|| doc_id')}" for t, own in _ARGUMENTS.items() for i, x in enumerate(own))} END AS argument, text || chr(10) || text AS result FROM documents)"""
_EXT = "CASE WHEN contains({0}, '.') THEN lower(string_split({0}, '.')[-1]) ELSE '' END"
_LARGE = "len(string_split(result, chr(10))) > 150"
_FOUND = f"""{_CALLS}, judged AS (SELECT *, CASE
    WHEN tool = 'Read' THEN CASE WHEN {_LARGE} AND {_EXT.format('argument')} NOT IN ({_NON_CODE}) THEN 'read-large-file' END
    WHEN tool IN ('Bash', 'Shell') THEN CASE
      WHEN regexp_matches(argument, '(^|[^a-z])(npm (run )?test|pytest)($| )') THEN 'build-test-output'
      WHEN regexp_matches(argument, '(^|; )tail ') THEN 'tail-command'
      WHEN regexp_matches(argument, '^cat [^|]') THEN CASE WHEN {_LARGE} AND {_EXT.format("regexp_extract(argument, '[^ ]+$')")} NOT IN ({_NON_CODE}) THEN 'cat-large-file' END
      WHEN starts_with(argument, 'head ') THEN 'head-command'
      WHEN starts_with(argument, 'curl https://example.com/') THEN 'curl-command' END
    WHEN tool = 'WebFetch' THEN 'webfetch' END AS category, ceil(length(result) / 4.0)::BIGINT AS actual_tokens FROM calls WHERE length(result) >= 500),
  found AS (SELECT *, round(actual_tokens * (1 - CASE category WHEN 'read-large-file' THEN 0.20::DOUBLE WHEN 'cat-large-file' THEN 0.20 WHEN 'build-test-output' THEN 0.35 WHEN 'head-command' THEN 0.80 ELSE 0.30 END))::BIGINT AS saved_tokens FROM judged WHERE category IS NOT NULL)"""
_SUGGEST = "CASE category WHEN 'read-large-file' THEN 'symbols + snippet' WHEN 'cat-large-file' THEN 'symbols + snippet' WHEN 'build-test-output' THEN 'run' WHEN 'tail-command' THEN 'tail' WHEN 'head-command' THEN 'bounded read' ELSE 'browse' END"


def _calls(spark, d):
    """k, provider, tool, argument, result of every document."""
    rows = read(spark, d, "documents").withColumn("k", F.col("doc_id"))
    tool, command = F.col("n_chars") % 5, F.floor(F.col("n_chars") / 5) % 6
    argument = F.coalesce(*(F.when((tool == t) & (command == i), P.fill(x)) for t, own in _ARGUMENTS.items() for i, x in enumerate(own)))
    return rows.select("k", F.col("lang").alias("provider"), F.element_at(F.array(*map(F.lit, _TOOLS)), (tool + 1).cast("int")).alias("tool"), argument.alias("argument"), F.concat("text", F.lit("\n"), "text").alias("result"))


def _found(spark, d):
    return A.findings(_calls(spark, d), F.col("tool"), F.col("argument"), F.col("result"))


@query(f"WITH {_FOUND} SELECT k, tool, category, actual_tokens, saved_tokens, actual_tokens - saved_tokens AS estimated_tokens FROM found")
def audit_findings(spark, d):
    """Calls that a better tool would have made smaller, by the first rule that each breaks."""
    return _found(spark, d).select("k", "tool", "category", "actual_tokens", "saved_tokens", "estimated_tokens")


@query(f"WITH {_FOUND} SELECT coalesce(category, 'total') AS category, count(*) AS n, sum(actual_tokens)::BIGINT AS actual_tokens, sum(saved_tokens)::BIGINT AS saved_tokens, arg_min({_SUGGEST}, k) AS suggestion FROM found GROUP BY ROLLUP (category)")
def audit_by_category(spark, d):
    return A.by_category(_found(spark, d), "k").withColumn("category", F.coalesce("category", F.lit("total")))


@query(f"WITH {_FOUND} SELECT coalesce(provider, 'all') AS provider, category, count(*) AS n, sum(saved_tokens)::BIGINT AS saved_tokens FROM found GROUP BY GROUPING SETS ((provider, category), (category))")
def audit_by_provider(spark, d):
    sets = _found(spark, d).groupingSets([["provider", "category"], ["category"]], "provider", "category").agg(F.count("*").alias("n"), F.sum("saved_tokens").alias("saved_tokens"))
    return sets.select(F.coalesce("provider", F.lit("all")).alias("provider"), "category", "n", "saved_tokens")


@query("""SELECT conv_id, turn, sha1(result) AS digest FROM (SELECT conv_id, turn, role, lead(role) OVER w AS result_role, lead(text) OVER w AS result FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND result_role = 'assistant'""")
def call_pairs(spark, d):
    """Turns of users with the answer that follows them."""
    return A.pair(read(spark, d, "conversations")).select("conv_id", "turn", F.sha1("result").alias("digest"))


@query("""SELECT role, count(*) AS n, sum(ceil(length(text) / 4.0)::BIGINT)::BIGINT AS tokens, round(avg(length(text)), 4)::DOUBLE AS mean_chars FROM conversations GROUP BY role""")
def audit_by_role(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(X.token_estimate(F.col("text"))).alias("tokens"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


@query(f"""WITH {_FOUND}, t AS (SELECT sum(actual_tokens)::BIGINT AS a, sum(saved_tokens)::BIGINT AS s FROM found),
  every AS (SELECT category, count(*) AS n, sum(actual_tokens)::BIGINT AS actual_tokens, sum(saved_tokens)::BIGINT AS saveable_tokens FROM found GROUP BY category
    UNION ALL SELECT 'agent-setup', 1, s + 10000, s FROM t WHERE s > 0 AND round(100.0 * 10000 / (10000 + s)) < 80
    UNION ALL SELECT 'workflow-routing', 1, a, round(s * 0.25)::BIGINT FROM t WHERE s > 0)
  SELECT category, n::BIGINT AS n, actual_tokens, saveable_tokens, round(100.0 * saveable_tokens / actual_tokens)::BIGINT AS percent FROM every ORDER BY saveable_tokens DESC, category LIMIT 5""")
def audit_plan(spark, d):
    return A.plan(_found(spark, d), already_saved=10000)


@query(f"WITH {_FOUND} SELECT sum(saved_tokens)::BIGINT AS saveable, round(100.0 * 10000 / (10000 + sum(saved_tokens)))::BIGINT AS capture_rate FROM found")
def capture_rate(spark, d):
    return _found(spark, d).agg(F.sum("saved_tokens").alias("saveable")).withColumn("capture_rate", A.capture_rate(F.lit(10000), F.col("saveable")))


@query(f"""WITH {_CALLS} SELECT k, CASE WHEN tool = 'Read' THEN CASE WHEN {_EXT.format('argument')} NOT IN ({_NON_CODE}) AND length(result) > 20000 THEN 'read-large' END
    WHEN tool IN ('Bash', 'Shell') THEN CASE WHEN regexp_matches(argument, '^ *tl[ -]') THEN NULL WHEN regexp_matches(argument, '(^|[^a-z])(npm (run )?test|pytest)($| )') THEN 'bash-test' WHEN regexp_matches(argument, '(^|; )tail ') THEN 'bash-tail'
      WHEN argument = 'cat README.md' THEN 'bash-cat-non-code' WHEN starts_with(argument, 'cat ') THEN 'bash-cat' WHEN starts_with(argument, 'head ') THEN 'bash-head' WHEN starts_with(argument, 'curl https://example.com/') THEN 'bash-curl' END
    WHEN tool = 'WebFetch' THEN 'webfetch' END AS decision FROM calls""")
def policy_decision(spark, d):
    """The nudge before each call."""
    return _calls(spark, d).select("k", A.policy(F.col("tool"), F.col("argument"), F.length("result")).alias("decision"))


@query(f"""WITH {_CALLS} SELECT k, CASE WHEN regexp_matches(argument, '(^|[^a-z])(npm (run )?test|pytest)($| )') THEN 'run "' || argument || '"' WHEN starts_with(argument, 'curl https://example.com/') THEN 'browse "' || substr(argument, 6) || '"' END AS rewritten FROM calls WHERE tool IN ('Bash', 'Shell')""")
def rewritten_commands(spark, d):
    """What should be run instead."""
    return _calls(spark, d).where("tool in ('Bash', 'Shell')").select("k", R.rewritten(F.col("argument")).alias("rewritten"))


@query(f"""WITH {_CALLS} SELECT k, unnest([0, 1])::INT AS nth, unnest(['', CASE WHEN contains(argument, '&&') THEN '&&' ELSE ';' END]) AS op, unnest(CASE WHEN contains(argument, '&&') THEN ['cd x', 'pytest -q'] ELSE ['ls', 'tail x'] END) AS segment FROM calls WHERE argument IN ('cd x && pytest -q', 'ls; tail x')""")
def command_chains(spark, d):
    """The segments of commands that are chains."""
    calls = _calls(spark, d).withColumn("lang", F.lit("shell"))
    return K.scan(calls, "chains", "k", "argument").select(F.col("path").cast("bigint").alias("k"), "nth", "op", "segment")


@query(f"""WITH {_CALLS}, s AS (SELECT ceil(length(result) / 4.0)::BIGINT AS t FROM calls WHERE starts_with(argument, 'tl-diff ') AND tool = 'Shell') SELECT 'tl-diff' AS tool, count(*) AS n, sum(t)::BIGINT AS actual_tokens, sum(round(t / 0.40::DOUBLE)::BIGINT)::BIGINT AS raw_tokens, sum(round(t / 0.40::DOUBLE)::BIGINT - t)::BIGINT AS saved_tokens FROM s HAVING count(*) > 0""")
def savings_by_tool(spark, d):
    """What calls of reducing tools already saved."""
    saved = A.savings(_calls(spark, d), F.col("argument"), X.token_estimate(F.col("result")))
    return saved.groupBy("tool").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("actual_tokens", "raw_tokens", "saved_tokens")))


_TEMPLATE = """regexp_replace(regexp_replace(regexp_replace(line, '[0-9]{4}-[0-9]{2}-[0-9]{2}', '<date>', 'g'), '[0-9]{2}:[0-9]{2}:[0-9]{2}', '<time>', 'g'), '=[0-9]+', '=<n>', 'g')"""
_RANK = "CASE WHEN event_type = 'error' THEN 2 ELSE 0 END"


@query(f"""WITH l AS (SELECT event_id, event_type, {EVENT_LINE_SQL} AS line FROM events), k AS (SELECT *, {_TEMPLATE} AS key, {_RANK} AS rank FROM l)
  SELECT key, count(*) AS n, arg_min(line, event_id) AS sample, CASE max(rank) WHEN 2 THEN 'error' ELSE 'info' END AS severity, min(event_id) AS first_seen, max(event_id) AS last_seen FROM k GROUP BY key""")
def log_clusters(spark, d):
    rows = read(spark, d, "events").select("event_id", event_line().alias("line"))
    return L.clusters(rows, "line", "event_id")


@query(f"""WITH l AS (SELECT event_id, {EVENT_LINE_SQL} AS line FROM events)
  SELECT {_TEMPLATE} AS key, count(*) AS n, max(event_id) AS last_seen FROM l GROUP BY 1 ORDER BY n DESC, last_seen DESC LIMIT 8""")
def log_top(spark, d):
    rows = read(spark, d, "events").select("event_id", event_line().alias("line"))
    return L.clusters(rows, "line", "event_id").select("key", "n", "last_seen").orderBy(F.desc("n"), F.desc("last_seen")).limit(8)


@query("""WITH x AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
  SELECT user_id, event_type AS value, min(event_id) AS start, max(event_id) AS end, count(*) AS n FROM x GROUP BY user_id, event_type, island""")
def log_runs(spark, d):
    """Consecutive events of one type, by user."""
    return L.runs(read(spark, d, "events"), F.col("event_type"), "event_id", "user_id")


@query(f"""SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, count(*) AS n FROM events GROUP BY 1""")
def severity_counts(spark, d):
    return read(spark, d, "events").groupBy(X.severity(event_line()).alias("severity")).agg(F.count("*").alias("n"))


_LINES = "l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"""WITH {_LINES}, b AS (SELECT *, CASE WHEN ceil(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4.0) + ceil(length(line) / 4.0) > 200
    OR row_number() OVER (PARTITION BY doc_id ORDER BY pos) > 10 THEN 1 ELSE 0 END AS broken FROM l)
  SELECT doc_id, pos, length(line)::BIGINT AS chars FROM (SELECT *, max(broken) OVER (PARTITION BY doc_id ORDER BY pos) AS stopped FROM b) WHERE stopped = 0""")
def budget_prefix(spark, d):
    """Each document's lines within 10 lines and 200 tokens."""
    return B.prefix(lines(read(spark, d, "documents")), "doc_id", "pos", "line", 10, 200).select("doc_id", "pos", F.length("line").cast("bigint").alias("chars"))


@query(f"""WITH {_LINES}, n AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n FROM l) SELECT doc_id, pos FROM n WHERE n <= 6 OR pos <= 4 OR pos > n - 2""")
def head_tail(spark, d):
    return B.head_tail(lines(read(spark, d, "documents")), "doc_id", "pos", 6).select("doc_id", "pos")


_SCORE = "CASE WHEN trim(line) = '' THEN -1 ELSE " + " + ".join(f"(CASE WHEN regexp_matches(trim(line), '{B.edged(p, i).replace(chr(39), chr(39) * 2)}') THEN {w} ELSE 0 END)" for p, i, w in B.LINE_RULES) + f" + (CASE WHEN regexp_matches(trim(line), '[^ \\t]+:[0-9]+') AND regexp_matches(trim(line), '{B.edged(chr(92) + 'b(error|warn|fail)', True)}') THEN 2 ELSE 0 END) - (CASE WHEN regexp_matches(line, '^[ \\t]*at ') THEN 1 ELSE 0 END) END"


@query(f"WITH {_LINES} SELECT ({_SCORE})::INT AS score, count(*) AS n FROM l GROUP BY 1")
def line_scores(spark, d):
    """How many lines tell how much."""
    return lines(read(spark, d, "documents")).groupBy(B.line_score(F.col("line")).alias("score")).agg(F.count("*").alias("n"))


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n, {_SCORE} AS score FROM l),
   p AS (SELECT *, CASE WHEN pos <= 5 THEN 'head' WHEN pos > n - 5 THEN 'tail' ELSE 'middle' END AS part FROM s),
   r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY score DESC, pos) AS best FROM p)
  SELECT doc_id, pos, part FROM r WHERE n <= 16 OR part <> 'middle' OR best <= 3""")
def smart_budget(spark, d):
    """Head, tail and the lines of the middle that tell most, within 16 lines."""
    return B.smart(lines(read(spark, d, "documents")), "doc_id", "pos", B.line_score(F.col("line")), 16).select("doc_id", "pos", "part")


@query(f"""WITH {_LINES}, n AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n FROM l) SELECT doc_id, pos FROM n WHERE n <= 10 OR pos <= 6 OR pos > n - 4""")
def truncated_output(spark, d):
    """The first 60 % and the last 40 % of ten lines."""
    return B.head_tail(lines(read(spark, d, "documents")), "doc_id", "pos", 10, 0.6).select("doc_id", "pos")


@query("SELECT doc_id, sha1(CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 90) || chr(10) || '...' || chr(10) || right(text, 110) END) AS digest FROM documents")
def sampled_text(spark, d):
    """The first 45 % and the last 55 % of 200 characters."""
    return read(spark, d, "documents").select("doc_id", F.sha1(B.sampled_chars(F.col("text"), 200)).alias("digest"))


_OUTPUT = "o AS (SELECT doc_id // 10 AS run, doc_id * 100000 + pos AS place, line FROM l)"


@query(f"""WITH {_LINES}, {_OUTPUT}, n AS (SELECT *, run % 2 = 0 AS failed, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY place) AS k FROM o),
   p AS (SELECT *, CASE WHEN n <= CASE WHEN failed THEN 250 ELSE 150 END THEN 'all' WHEN k <= CASE WHEN failed THEN 40 ELSE 25 END THEN 'head' WHEN k > n - CASE WHEN failed THEN 40 ELSE 25 END THEN 'tail'
     WHEN regexp_matches(line, CASE WHEN failed THEN '{R.FAILED_LINE}' ELSE '{R.PASSED_LINE}' END) THEN 'diagnostic' END AS part FROM n),
   r AS (SELECT *, row_number() OVER (PARTITION BY run, part ORDER BY place) AS nth FROM p WHERE part IS NOT NULL) SELECT run, place, part FROM r WHERE part <> 'diagnostic' OR nth <= CASE WHEN failed THEN 25 ELSE 15 END""")
def output_summary(spark, d):
    """What is shown of long outputs (ten documents each; every other run failed)."""
    rows = lines(read(spark, d, "documents")).select(F.floor(F.col("doc_id") / 10).alias("run"), (F.col("doc_id") * 100000 + F.col("pos")).alias("place"), "line")
    return R.output_summary(rows, "run", "place", "line", F.col("run") % 2 == 0)


_REGIONS = """e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS last FROM events),
  s AS (SELECT user_id, pos, greatest(pos - 2, 1) AS a, least(pos + 6, last) AS b FROM e WHERE event_type = 'error'),
  o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s),
  r AS (SELECT *, sum(CASE WHEN reached IS NULL OR a > reached + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS region FROM o),
  g AS (SELECT user_id, region::BIGINT AS region, min(a) AS start, max(b) AS end, count(*) AS anchors FROM r GROUP BY user_id, region)"""


def _regions(spark, d):
    from pyspark.sql import Window as W

    rows = read(spark, d, "events").withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("bigint"))
    return B.regions(rows, "user_id", "pos", F.col("event_type") == "error")


@query(f"WITH {_REGIONS} SELECT * FROM g")
def failure_regions(spark, d):
    """Windows around each user's errors, merged where they meet."""
    return _regions(spark, d)


@query(f"""WITH {_REGIONS}, c AS (SELECT *, start - coalesce(lag(g.end) OVER (PARTITION BY user_id ORDER BY region), 0) - 1 AS gap FROM g),
  u AS (SELECT *, g2.end - start + 1 + CASE WHEN gap > 0 THEN 1 ELSE 0 END AS cost FROM c g2),
  k AS (SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY region) AS used FROM u),
  x AS (SELECT *, max(CASE WHEN used > 40 AND region > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY region) AS stopped FROM k)
  SELECT user_id, region, start, x.end AS end, anchors, gap::BIGINT AS gap, cost::BIGINT AS cost FROM x WHERE stopped = 0""")
def failure_budget(spark, d):
    return B.within(_regions(spark, d), "user_id", 40)


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k <= 2 OR c_mktsegment = 'BUILDING'""")
def section_budget(spark, d):
    rows = read(spark, d, "customer").withColumn("required", F.col("c_mktsegment") == "BUILDING")
    return B.sections(rows, "c_nationkey", "c_custkey", "required", 1200).select("c_nationkey", "c_custkey")
